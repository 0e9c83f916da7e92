import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqflow.llm import decontamination, fingerprints, similar, simhash
from seqflow.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of (id, fingerprint), ids may repeat or be null."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_of_documents(documents, texts):
    rows = simhash.simhash(documents).collect()
    prints = {i: brute_print(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(prints)
    want = dict(zip(ids, brute_components([(i, prints[i]) for i in ids]), strict=True))
    assert {r.doc_id: r.component_id for r in rows} == want


def test_simhash_of_awkward_rows(awkward, nothing):
    source = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    prints = [(i, brute_print(t)) for i, t in source]
    want = Counter((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints), strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash(awkward).collect()) == want
    assert simhash.simhash(nothing).count() == 0


def test_links_find_every_pair(spark, monkeypatch):
    """Clusters of prints at distances up to 4, with cells small enough to be dealt out in blocks."""
    rng = np.random.default_rng(3)
    prints = []
    for size in (1, 2, 5, 60):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(size):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            prints.append(centre ^ sum(1 << int(b) for b in flips))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = brute_components(list(enumerate(prints)))
    for cell in (4096, 8):
        monkeypatch.setattr(simhash, "CELL", cell)
        got = {r.id: r.root for r in components(simhash.links(spark.createDataFrame([(s,) for s in signed], "_fp long"))).collect()}
        for i in range(len(prints)):
            for j in range(i):
                same = signed[i] in got and got.get(signed[i]) == got.get(signed[j])
                assert same == (want[i] == want[j])


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.id: r.root for r in components(edges).collect()}
    assert len({got[i] for i in range(201)}) == 1
    assert got[1000] == got[1001] != got[0]


def brute_second(text, n, bits):
    """Prints of distinct shingles: of two words, and of five words in 256 bits."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    own = {xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))}
    out = 0
    for k in range(bits // 64):
        hs = [int(h) for h in (simhash.mixed(np.array(sorted(own), np.uint64), k) if bits > 64 else sorted(own))]
        out |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) << (64 * k)
    return out


def brute_groups(docs):
    """docs: id, text. Least ids of the groups of all links of the rule, and of those that the grids find for certain."""
    prints = [(d, brute_second(t, 2, 64), brute_second(t, 5, 256)) for d, t in docs]

    def groups(most):
        parent = {d: d for d, *_ in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, (d, p, q) in enumerate(prints):
            for e, r, s in prints[:i]:
                if (p ^ r).bit_count() <= most and (q ^ s).bit_count() <= 47:
                    a, b = sorted((find(d), find(e)))
                    parent[b] = a
        return {find(d) for d, *_ in prints}

    return groups(8), groups(5)


def test_rule_of_similar_texts(documents, texts):
    """All links of up to 5 bits are found, none beyond 8, and most pairs of similarity 0.8 or more."""
    found, sure = brute_groups(list(texts.items()))
    left = {r.doc_id for r in simhash.deduplicate(documents).collect()}
    assert found <= left <= sure
    sets = {d: shingles_of(t) for d, t in texts.items()}
    ids = sorted(d for d in sets if sets[d])
    classes = {r.doc_id: r._class for r in simhash.simhash(documents, rule=simhash.SIMILAR).collect()}
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert all(classes[a] == classes[b] for a in ids for b in ids if sets[a] == sets[b])
    assert sum(classes[a] == classes[b] for a, b in pairs) >= 0.8 * len(pairs)


def shingles_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("rule", [simhash.CONTRACT, simhash.SIMILAR])
def test_one_row_of_each_group_stays(awkward, rule):
    clashing = awkward.withColumnRenamed("_h", "_kept_id").withColumnRenamed("size", "_row_h")
    kept = simhash.deduplicate(clashing, rule=rule)
    assert kept.columns == clashing.columns
    assert {r._row_h for r in kept.collect()} == {"clash"}
    left = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    found = simhash.simhash(awkward, rule=rule).collect()
    assert len(left) == len({r._class for r in found}) and sum(d is None for d, _ in left) == 2
    if rule == simhash.CONTRACT:
        apart = brute_components([(k, brute_print(t)) for k, (_, t) in enumerate(left)])
        assert len(set(apart)) == len(left)


def test_many_near_copies_are_dealt_out(spark, monkeypatch):
    """One large group whose cells are compared in blocks."""
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = np.random.default_rng(8)
    base = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        w[int(rng.integers(0, 120))] = f"other{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([*rows, (500, "something else that has nothing to do with the others")], "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicate(df).collect()} == {0, 500}


def similar_groups(docs):
    """docs: id, text. Groups of ids that are joined by chains of pairs of similarity 0.8 or more."""
    own = [(d, shingles_of(t)) for d, t in docs]
    parent = list(range(len(own)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(own):
        for j, (_, b) in enumerate(own[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(own):
        groups.setdefault(find(i), set()).add(d)
    return list(groups.values())


def edited(rng, base, tenths):
    """A text with so many other words at its end that the similarity is just the threshold or above it."""
    n = len(base) - 4
    k = max(k for k in range(n) if 10 * (n - k) >= tenths * (n + k))
    return [*base[: len(base) - k], *(f"w{rng.integers(1 << 40)}" for _ in range(k))]


@pytest.mark.parametrize("bucket", [1 << 20, 50])
def test_no_pair_of_the_threshold_is_missed(spark, monkeypatch, bucket):
    """Pairs at 0.8, whose prints often differ in more bits than the grids find, beside texts that share much and are below it."""
    monkeypatch.setattr(similar, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(300)]
    docs = []
    for i in range(150):
        base = [f"b{rng.integers(1 << 40)}" for _ in range(int(rng.integers(30, 120)))]
        docs += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(edited(rng, base, 8)))]
        if i % 3 == 0:
            half = common[: int(1.2 * len(base))]
            docs.append((10 * i + 2, " ".join([*half, *base])))
    docs += [(9000, "three words only"), (9001, "three words only"), (9002, None), (9003, " ")]
    sets = {d: shingles_of(t) for d, t in docs}
    assert all(0.8 <= len(sets[10 * i] & sets[10 * i + 1]) / len(sets[10 * i] | sets[10 * i + 1]) < 0.87 for i in range(150))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    classes = {r.doc_id: r._class for r in simhash.simhash(df, rule=simhash.SIMILAR).collect()}
    assert all(len({classes[d] for d in group}) == 1 for group in similar_groups(docs))
    left = {r.doc_id for r in simhash.deduplicate(df).collect()}
    assert not any(10 * i + 1 in left for i in range(150)) and 9001 not in left


def test_similar_pairs_are_all_pairs(spark):
    """Sets of small numbers in groups, against all pairs: hashes that many share, sizes on both sides of the threshold."""
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(40):
        base = np.unique(rng.integers(0, 400, int(rng.integers(1, 60))))
        sets += [np.unique(np.concatenate((rng.permutation(base)[int(rng.integers(0, 1 + len(base) // 5)) :], rng.integers(0, 400, int(rng.integers(0, 1 + len(base) // 6)))))) for _ in range(4)]
    sets = [s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets if len(s)]
    sets = [np.sort(s) for s in sets]
    groups = [int(rng.integers(0, 100)) for _ in sets]
    want = set()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if groups[i] != groups[j] and 5 * both >= 4 * (len(a) + len(b) - both):
                want.add(tuple(sorted((groups[i], groups[j]))))
    rows = [(k, g, len(s), bytearray(similar.prefix(s, 8).tobytes()), bytearray(s.tobytes())) for k, (g, s) in enumerate(zip(groups, sets, strict=True))]
    df = spark.createDataFrame(rows, "_set long, _group long, _n int, _prefix binary, _all binary")
    got = similar.pairs(df, lambda some: some.withColumn("_hashes", F.col("_all")), 8).collect()
    assert want and {tuple(sorted((r.a, r.b))) for r in got} == want


def words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def shingles(t, n):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_leaks(docs, items, t=0.8):
    out = set()
    for item, text in items:
        n = min(5, len(words(text)))
        own = shingles(text, n) if n else set()
        for doc, dtext in set(docs):
            both = len(own & shingles(dtext, n)) if n else 0
            if own and both >= t * len(own) - 1e-9:
                out.add((doc, item, len(own), both))
    return out


def test_leaks_of_documents(spark, sf_dir, documents, texts):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontamination.contained(documents, items).collect()}
    want = brute_leaks(texts.items(), [(r.item_id, r.text) for r in items.collect()])
    assert got == want and want
    left = {r.doc_id for r in decontamination.decontaminate(documents, items).collect()}
    assert left == set(texts) - {d for d, *_ in want}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_leaks_near_the_threshold(spark, monkeypatch, limit):
    """Items of all sizes with words changed, whether the sketches are broadcast or not."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    items = [(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in (1, 3, 4, 5, 6, 9, 12, 30, 31, 32, 70)] + [(99, ""), (98, None), (None, "an item without an id has words too")]
    docs = [(0, None), (1, "")]
    for n, text in items[:-3]:
        for at in range(0, n, 4):
            w = text.split()
            w[at] = "changed"
            docs.append((len(docs), "before it " + " ".join(w) + " and after"))
        docs.append((len(docs), "Before, " + text.upper() + "; after."))
    docs.append((len(docs), "an item without an id has words too"))
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontamination.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_leaks(docs, items)


def test_leaks_of_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "中文字符 été ça où naïve")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contained(awkward, items).collect()}
    assert got == {(1, 1), (2, 1), (6, 2)}
    assert decontamination.contained(nothing, items).count() == 0
    assert decontamination.contained(awkward, items.limit(0)).count() == 0
    assert decontamination.decontaminate(awkward, items).count() == awkward.count() - 4


def jaccard(a, b):
    x, y = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_fingerprints_of_documents(documents, texts):
    import hashlib

    rows = {r.doc_id: r for r in fingerprints.neighbours(documents).collect()}
    ids = sorted(texts, reverse=True)
    errors = []
    for i, d in enumerate(ids):
        t, after = texts[d] or "", texts[ids[(i + 1) % len(ids)]] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert rows[d].n_chars == len(t)
        assert rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [rows[d].near_edited - jaccard(t, edited), rows[d].near_next - jaccard(t, after)]
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.1


def test_fingerprints_of_awkward_rows(spark, awkward, nothing):
    rows = fingerprints.neighbours(awkward).collect()
    assert len(rows) == awkward.count()
    same = {r.fingerprint for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1 and "" not in same
    assert {r.fingerprint for r in rows if r.doc_id in (3, 4, 5)} == {""}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.neighbours(nothing).count() == 0
    lone = fingerprints.neighbours(spark.createDataFrame([(1, "one two three")], "doc_id long, text string")).first()
    assert lone.near_next == 1.0
