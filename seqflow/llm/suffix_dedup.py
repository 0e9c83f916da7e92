"""Removal of repeated byte strings by column-wise construction of a collection's Burrows-Wheeler transform.

Each window of WINDOW bytes has an anchor, K of its bytes: the place of its T bytes of least hash, modulo the number of
places K bytes can have in it (a mod-minimizer). A text is cut to strings, maximal runs of windows with one anchor. Equal
windows have equal anchors, so all copies of a window are in strings of one anchor, and each anchor's strings are a
collection that is indexed on its own:

1. Anchors that occur in one document only cannot repeat and are left out.
2. The distinct strings of each other anchor, each with its least document, are gathered to collections.
3. Each round inserts one symbol of each string, last symbol first, into the collection's transform and its longest
   common prefixes, by one sequential pass over both (the two "files" of a round, arrays here: a collection holds
   BATCH strings of at most WINDOW + SPAN - 1 bytes, or one anchor's where that has more).
4. Runs of suffixes with common prefixes of WINDOW or more are the windows with one content; the least document of a
   run is compared with the documents of its strings.

An anchor with one distinct string skips 3: equality of string hashes decides. So does equality of single windows for
an anchor with more than HOT distinct strings, whose collection would be one task's without bound. An anchor that very
many documents share is dealt out too: of 256 documents two stand for it, the others know already that it is shared.
No text is ever in one row with another's.

Defined results: a null text is empty; null ids come after all others and are not before one another; equal ids are
one document's for the comparison; repeated rows give equal results; texts shorter than WINDOW lose nothing; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqflow.llm.common import cut, discard

WINDOW, K, T = 50, 32, 13
SPAN = WINDOW - K + 1  # places of an anchor in a window, and windows of a string at most
BATCH, HOT, CHUNK = 1024, 8192, 4_000_000
#: Windows of a text that are looked at at once; documents of 256 that share an anchor from which on all but two are dealt out.
PIECE, OFTEN = 1 << 19, 8
LAST = (1 << 63) - 1
_U = np.uint64
#: A 64-bit number for each byte, by rule.
BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 50) for b in range(256)], _U)
#: What a hash is multiplied by to append 1, 2, 4, 8, 16 bytes; the low bits that hold a place.
POWERS = [_U(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(5)]
MIX, LOCAL = _U(0xBF58476D1CE4E5B9), _U((1 << 20) - 1)


def anchors_of(h: list[np.ndarray], start: int, n_windows: int) -> np.ndarray:
    """The places of the anchors of n_windows windows from start on, fewer than LOCAL. h: hashes of 1, 2, 4, 8, 16 bytes."""
    n = n_windows + WINDOW - T
    h0, h2, h3 = (h[k][start:] for k in (0, 2, 3))
    small = (h3[:n] * POWERS[2] + h2[8 : 8 + n]) * POWERS[0] + h0[12 : 12 + n]  # 8 + 4 + 1 bytes
    small ^= small >> _U(29)
    small *= MIX
    # the upper bits order, the lower ones say where: of equal ones the first counts
    place = np.arange(n, dtype=_U)
    least, w = (small & ~LOCAL) | place, 1
    while w * 2 <= WINDOW - T + 1:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    rest = WINDOW - T + 1 - w
    least = np.minimum(least[:n_windows], least[rest : rest + n_windows])
    ahead = ((least & LOCAL) - place[:n_windows]).astype(np.int64)
    return start + np.arange(n_windows) + np.where(ahead >= SPAN, ahead - SPAN, ahead)


def strings_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor's hash (int64), first window, number of windows of each string of a text."""
    if len(text) < WINDOW:
        none = np.empty(0, np.int64)
        return none, none, none
    # hashes of 1, 2, 4, 8, 16 bytes at each place, by doubling
    h = [BYTES[np.frombuffer(text, np.uint8)]]
    for k in range(4):
        h.append(h[k][: -(1 << k)] * POWERS[k] + h[k][1 << k :])
    n_windows = len(text) - WINDOW + 1
    # a window's anchor depends on the window alone, so a long text's windows are taken in pieces whose places fit in LOCAL
    anchor = np.concatenate([anchors_of(h, a, min(PIECE, n_windows - a)) for a in range(0, n_windows, PIECE)])
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    at = anchor[first]
    m = h[4][at] * POWERS[4] + h[4][at + 16]
    m ^= m >> _U(29)
    m *= MIX
    return (m ^ (m >> _U(32))).view(np.int64), first, np.diff(np.append(first, n_windows))


def string_ids(text: bytes, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(text[a : a + c + WINDOW - 1]) for a, c in zip(first.tolist(), count.tolist(), strict=True)), _U, len(first)).view(np.int64)


def construct(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transform (0 where a string begins), the longest common prefixes, and the place of each string's end.

    Suffixes are in order, the empty ones first; after round j all suffixes of j symbols or fewer are in.
    """
    n = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    width = int(lengths.max(initial=0))
    # text[:, width - k] precedes the suffix of k symbols; UTF-8 has no byte 255, so symbols are bytes plus 1 and 0 ends
    padded = b"".join(s.rjust(width + 1, b"\xff") for s in strings)
    text = np.frombuffer(padded, np.uint8).reshape(n, width + 1) + np.uint8(1)
    bwt = text[:, width].copy()
    lcp = np.zeros(n, np.uint8)
    live, place = np.arange(n), np.arange(n)
    for k in range(1, width + 1):
        keep = lengths[live] >= k
        live, place = live[keep], place[keep]
        order = np.argsort(bwt, kind="stable")
        ends = int(np.count_nonzero(bwt == 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        r = rank[place]
        symbol = bwt[place]
        into = n + r - ends  # the suffix's place among all, the new ones included
        # common prefixes with the neighbours: one more than the least between the two occurrences of the symbol
        before = order[np.maximum(r - 1, 0)]
        has_before = (r > 0) & (bwt[before] == symbol)
        after = order[np.minimum(r + 1, len(order) - 1)]
        has_after = (r + 1 < len(order)) & (bwt[after] == symbol)
        up = np.where(has_before, 1 + least_between(lcp, np.where(has_before, before + 1, place), place), 0)
        down = np.where(has_after, 1 + least_between(lcp, place + 1, np.where(has_after, after, place)), 0)
        size = len(bwt) + len(live)
        old = np.ones(size, bool)
        old[into] = False
        new_bwt, new_lcp = np.empty(size, bwt.dtype), np.empty(size, np.uint8)
        new_bwt[old], new_lcp[old] = bwt, lcp
        new_bwt[into] = text[live, width - k]
        follows = has_after & (into + 1 < size)
        new_lcp[into[follows] + 1] = down[follows]
        new_lcp[into] = up
        bwt, lcp, place = new_bwt, new_lcp, into
    return bwt, lcp, lengths


def least_between(lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of lcp[a..b] for each pair, anything where a > b. Spans are about as long as there are symbols."""
    down = np.argsort(-a)  # from right to left, so that nothing is read between the spans
    bounds = np.empty(2 * len(a), np.int64)
    bounds[::2], bounds[1::2] = np.minimum(a[down], len(lcp)), np.minimum(b[down] + 1, len(lcp))
    out = np.empty(len(a), np.int64)
    out[down] = np.minimum.reduceat(np.append(lcp, np.uint8(255)), bounds)[::2]
    return out


def least_documents(strings: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each window of each string the least document of any string that has that window."""
    bwt, lcp, lengths = construct(strings)
    order = np.argsort(bwt, kind="stable")
    ends = int((bwt == 0).sum())
    lf = np.empty(len(bwt), np.int64)
    lf[order] = np.arange(len(bwt)) + len(strings) - ends
    run = np.cumsum(lcp < WINDOW) - 1
    live, place = np.arange(len(strings)), np.arange(len(strings))
    places, owners, at = [], [], []
    for k in range(1, int(lengths.max()) + 1):
        keep = lengths[live] >= k
        live, place = live[keep], lf[place[keep]]
        if k >= WINDOW:
            places.append(run[place])
            owners.append(live)
            at.append(lengths[live] - k)
    runs, owner, offset = np.concatenate(places), np.concatenate(owners), np.concatenate(at)
    least = np.full(int(runs.max()) + 1, LAST)
    np.minimum.at(least, runs, docs[owner])
    out = np.full((len(strings), SPAN), LAST)
    out[owner, offset] = least[runs]
    return [out[i, : n - WINDOW + 1] for i, n in enumerate(lengths.tolist())]


def distinct(values: np.ndarray) -> np.ndarray:
    out = np.sort(values)
    return out[np.concatenate(([True], out[1:] != out[:-1]))] if len(out) else out


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text to m, doc, salt: the distinct anchors of each text. A salt other than 0: the anchor is known to be shared."""
    for batch in batches:
        docs = batch.column(0).to_numpy()
        for c in range(0, batch.num_rows, 256):  # the keys of all texts at once would be long
            hs = [distinct(strings_of(t.as_py())[0]) for t in batch.column(1)[c : c + 256].cast(pa.binary())]
            m, doc = np.concatenate(hs), np.repeat(docs[c : c + 256], [len(h) for h in hs])
            salt = np.zeros(len(m), np.int32)
            # few bits of the anchor tell which may be frequent, so that only these are sorted
            slot = m & ((1 << max(16, len(m).bit_length() + 1)) - 1)
            maybe = np.flatnonzero(np.bincount(slot)[slot] >= OFTEN) if len(m) else np.empty(0, np.int64)
            if len(maybe):
                maybe = maybe[np.argsort(m[maybe], kind="stable")]
                own = m[maybe]
                starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                sizes = np.diff(np.append(starts, len(own)))
                spare = (np.arange(len(own)) - np.repeat(starts, sizes) >= 2) & np.repeat(sizes >= OFTEN, sizes)  # two say that it is shared
                salt[maybe[spare]] = 1 + (maybe[spare] & 0xFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(doc), pa.array(salt)], ["m", "doc", "salt"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows m, doc, salt, dealt by m and salt, those whose m has two documents or more, in any order.

    Holds the keys with two documents and one row of each other key, so a frequent key is one entry; CHUNK rows at a time.
    """
    many, alone, lone_docs, held, n = (np.empty(0, np.int64),) * 3 + ([], 0)

    def flush() -> pa.RecordBatch:
        nonlocal many, alone, lone_docs, held, n
        m = np.concatenate([alone, *(b.column(0).to_numpy() for b in held)])
        doc = np.concatenate([lone_docs, *(b.column(1).to_numpy() for b in held)])
        held, n = [], 0
        order = np.argsort(m)
        m, doc = m[order], doc[order]
        starts = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        keys, sizes = m[starts], np.diff(np.append(starts, len(m)))
        two = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        if len(many):
            two |= many[np.minimum(np.searchsorted(many, keys), len(many) - 1)] == keys
        alone, lone_docs = keys[~two], doc[starts[~two]]
        many = np.union1d(many, keys[two])
        keep = np.repeat(two, sizes)
        return pa.RecordBatch.from_arrays([pa.array(m[keep]), pa.array(doc[keep])], ["m", "doc"])

    for batch in batches:
        sure = batch.column(2).to_numpy() != 0
        if sure.any():
            yield batch.filter(pa.array(sure)).select(["m", "doc"])
            batch = batch.filter(pa.array(~sure))
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield flush()
    if n:
        yield flush()


def _lists(column: pa.ListArray) -> Iterator[slice]:
    """Where each row's list is in the flat values."""
    offsets = column.offsets.to_numpy()
    return (slice(int(i), int(j)) for i, j in zip(offsets[:-1], offsets[1:], strict=True))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, rk, text, anchors to m, sid, doc, rk, n (windows), at (first windows): the distinct strings of each text at these anchors."""
    for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        texts, flat = batch.column(2).cast(pa.binary()), batch.column(3).values.to_numpy()
        ms, sids, ns, ats, sizes, spans = [], [], [], [], [], []
        for text, part in zip(texts, _lists(batch.column(3)), strict=True):
            text = text.as_py()
            m, first, count = strings_of(text)
            wanted = np.sort(flat[part])
            own = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, m), len(wanted) - 1)] == m)
            sid = string_ids(text, first[own], count[own])
            order = np.argsort(sid, kind="stable")
            own, sid = own[order], sid[order]
            starts = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1]))) if len(sid) else np.empty(0, np.int64)
            one = own[starts]
            for column, more in zip((ms, sids, ns, ats, spans), (m[one], sid[starts], count[one], first[own], np.diff(np.append(starts, len(own)))), strict=True):
                column.append(more)
            sizes.append(len(one))
        at = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.concatenate(spans)))), pa.int32()), pa.array(np.concatenate(ats), pa.int32()))
        docs, rows = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))
        columns = [pa.array(np.concatenate(ms)), pa.array(np.concatenate(sids)), pa.array(docs), pa.array(rows), pa.array(np.concatenate(ns), pa.int32()), at]
        yield pa.RecordBatch.from_arrays(columns, ["m", "sid", "doc", "rk", "n", "at"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text, places (m, sid, at, n) to m, sid, string, doc."""
    for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        docs, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
        parts = list(_lists(batch.column(2)))
        whole = slice(parts[0].start, parts[-1].stop)
        m, sid, at, n = (batch.column(2).values.field(k).to_numpy() for k in range(4))
        cuts = []
        for text, part in zip(texts, parts, strict=True):
            text = text.as_py()
            cuts += [text[a : a + c + WINDOW - 1] for a, c in zip(at[part].tolist(), n[part].tolist(), strict=True)]
        doc = np.repeat(docs, [part.stop - part.start for part in parts])
        yield pa.RecordBatch.from_arrays([pa.array(m[whole]), pa.array(sid[whole]), pa.array(cuts, pa.binary()), pa.array(doc)], ["m", "sid", "string", "doc"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """m, sid, string, doc to m, sid, i, window (its hash), doc: each window of each string."""
    h = xxhash.xxh64_intdigest
    for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
        strings = batch.column(2).to_pylist()
        sizes = [len(s) - WINDOW + 1 for s in strings]
        window = np.fromiter((h(s[i : i + WINDOW], 50) for s, n in zip(strings, sizes, strict=True) for i in range(n)), _U, sum(sizes)).view(np.int64)
        i = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        m, sid, doc = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1, 3))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (m, sid, i, window, doc)], ["m", "sid", "i", "window", "doc"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of strings sorted by m: each string's least documents by window, for whole anchors at a time."""

    def done(m: list[int], sid: list[int], strings: list[bytes], docs: list[int]) -> pa.RecordBatch:
        low = least_documents(strings, np.array(docs))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in low])))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(low)))
        return pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(sid, pa.int64()), lists], ["m", "sid", "low"])

    m, sid, strings, docs = [], [], [], []
    for batch in batches:
        for column, more in zip((m, sid, strings, docs), batch.columns, strict=True):
            column += more.to_pylist()
        at = 0
        while len(m) - at > BATCH:
            end = at + BATCH
            while end < len(m) and m[end] == m[end - 1]:
                end += 1
            if end == len(m):
                break  # the last anchor may go on
            yield done(m[at:end], sid[at:end], strings[at:end], docs[at:end])
            at = end
        m, sid, strings, docs = m[at:], sid[at:], strings[at:], docs[at:]
    if m:
        yield done(m, sid, strings, docs)


def removed(length: int, at: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs to remove. For each string, a bit for each of its n windows that is in an earlier document."""
    window = np.arange(SPAN)
    string, offset = np.nonzero(((bits[:, None] >> window) & 1).astype(bool) & (window < n[:, None]))
    starts = at[string] + offset
    edge = np.bincount(starts, minlength=length + 1) - np.bincount(starts + WINDOW, minlength=length + 1)
    gone = np.concatenate(([False], np.cumsum(edge[:length]) > 0, [False]))
    return np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, repeats to the result's columns."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
    for batch in batches:
        flat = [batch.column(2).values.field(k).to_numpy() for k in range(3)]
        rows = []
        for text, part in zip(batch.column(1).cast(pa.binary()), _lists(batch.column(2)), strict=True):
            text = text.as_py()
            runs = removed(len(text), *(x[part] for x in flat))
            ends = np.concatenate(([0], runs.ravel(), [len(text)])).reshape(-1, 2).tolist()
            kept = b"".join(text[a:b] for a, b in ends)
            rows.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "stop": b} for a, b in runs.tolist()]))
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        )


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), spans (byte offsets of what is removed)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), text.alias("_text"))
    # rows are told apart by their id or, where ids repeat, by a hash of id and text; rows that are repeated whole are one
    repeated = df.groupBy(F.col(id_col).alias("_rid")).count().where("count > 1").limit(1).count() > 0
    docs = docs.withColumn("rk", F.xxhash64("doc", "_text") if repeated else F.col("doc"))
    long = docs.where(F.octet_length("_text") >= WINDOW).select("doc", "rk", "_text")
    if repeated:
        long = long.dropDuplicates(["rk"])
    occurring = long.select("rk", "_text").mapInArrow(_anchors, "m long, doc long, salt int").repartition("m", "salt")
    shared = cut(occurring.mapInArrow(_shared, "m long, doc long"), "anchors")

    lists = shared.groupBy(F.col("doc").alias("rk")).agg(F.collect_list("m").alias("ms"))
    occurrences = cut(long.join(lists, "rk").select("doc", "rk", "_text", "ms").mapInArrow(_occurrences, "m long, sid long, doc long, rk long, n int, at array<int>"), "occurrences")
    discard(shared)
    first_of = occurrences.select("m", "sid", "doc", "rk", "n", F.get("at", F.lit(0)).alias("at")).groupBy("m", "sid")
    if repeated:
        least = first_of.agg(F.min(F.struct("doc", "rk", "at")).alias("x"), F.max("n").alias("n")).select("m", "sid", "x.*", "n")
    else:
        least = first_of.agg(F.min("doc").alias("doc"), F.min("rk").alias("rk"), F.min_by("at", "doc").alias("at"), F.max("n").alias("n"))
    firsts = cut(least, "firsts")
    many = firsts.groupBy("m").agg(F.count("*").alias("_n")).where("_n > 1").select("m", (F.col("_n") > HOT).alias("hot"))
    flagged = cut(firsts.join(many.hint("shuffle_hash"), "m", "left"), "flagged")
    discard(firsts)

    def strings(chosen: DataFrame) -> DataFrame:
        places = chosen.groupBy("rk").agg(F.collect_list(F.struct("m", "sid", "at", "n")).alias("places"))
        return long.join(places, "rk").select("doc", "_text", "places").mapInArrow(_strings, "m long, sid long, string binary, doc long")

    indexed = strings(flagged.where("not hot")).repartition("m").sortWithinPartitions("m").mapInArrow(_index, "m long, sid long, low array<long>")
    alone = flagged.where("hot is null").select("m", "sid", F.array("doc").alias("low"))
    windows = alone.union(indexed)
    if flagged.where("hot").limit(1).count():
        single = cut(strings(flagged.where("hot")).mapInArrow(_windows, "m long, sid long, i int, window long, doc long"), "single")
        # written, so that the windows that very many strings share are split by the join
        earliest = cut(single.groupBy("m", "window").agg(F.min("doc").alias("low")), "earliest")
        lows = single.drop("doc").join(earliest, ["m", "window"]).groupBy("m", "sid").agg(F.array_sort(F.collect_list(F.struct("i", "low"))).alias("lows"))
        windows = windows.union(lows.select("m", "sid", F.col("lows.low")))
    windows = cut(windows, "windows")
    discard(flagged)
    bits = F.aggregate(
        "low",
        F.struct(F.lit(0).cast("long").alias("bits"), F.lit(1).cast("long").alias("one")),
        lambda a, x: F.struct(F.when(x < F.col("doc"), a["bits"] + a["one"]).otherwise(a["bits"]).alias("bits"), (a["one"] * 2).alias("one")),
        lambda a: a["bits"],
    )
    bits = F.when(F.size("low") > 1, bits).when(F.get("low", F.lit(0)) < F.col("doc"), F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long"))
    repeats = (
        occurrences.join(windows.hint("shuffle_hash"), ["m", "sid"])
        .select("rk", "n", "at", bits.alias("bits"))
        .where("bits <> 0")
        .select("rk", "n", F.explode("at").alias("at"), "bits")
        .groupBy("rk")
        .agg(F.collect_list(F.struct("at", "n", "bits")).alias("repeats"))
    )
    repeats = cut(repeats, "repeats")
    discard(occurrences, windows)
    none = F.array().cast("array<struct<at:int,n:int,bits:bigint>>")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,stop:long>>"
    return docs.join(repeats, "rk", "left").select("_id", "_text", F.coalesce("repeats", none)).mapInArrow(_keep, out)
