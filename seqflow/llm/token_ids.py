"""Token ids as directly addressable codes.

An id is split to chunks of 8 bits, the lowest in level 0. Each level has its chunks, a bitmap that says which of them
go on in the next level, and a rank directory, the number of such bits before each block of 512. The i-th id is read
by its place in level 0 and a rank in each further level: no block is decoded.

Files: rows of a Parquet table in the shared folder, which Spark commits and every machine reads. A row is a segment:
whole documents in ascending order of their ids, about SEGMENT ids or one document, with the documents' first places.

Any file of the tokenizers library will do. Its contents travel with the job, so executors need no path. Files with the
normal form, splits and model named in WORD_FILE are encoded word by word; with any other, whole texts go to the library.

Defined results: a null text has the end id alone; null ids come first; rows with equal ids are ordered by a hash of
their text; repeated rows are documents each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import sys
import types
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqflow.llm.common import scratch

SEGMENT, BLOCK, CACHE, END = 1 << 19, 512, 700_000, 2
#: ASCII marks that end words.
MARKS = (b".", b",", b";", b":", b"!", b"?")
#: How the special tokens begin.
SPECIAL = "<|"
#: What a tokenizer's file must say for its texts to be encoded word by word (fixed values).
WORD_FILE = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
FILES = "part int, seg int, n_ids long, n_docs long, doc_ids array<long>, starts array<long>, levels array<struct<chunks:binary,more:binary,ranks:binary>>"


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of an array of unsigned 32-bit integers."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        before = np.concatenate(([0], np.cumsum(more)[BLOCK - 1 :: BLOCK])).astype("<u4")
        out.append({"chunks": (rest & 0xFF).astype(np.uint8).tobytes(), "more": np.packbits(more, bitorder="little").tobytes(), "ranks": before.tobytes()})
        rest = rest[more] >> 8
        if not len(rest):
            return out


class Codes:
    """Random access to the ids of one segment."""

    def __init__(self, levels: list[dict[str, bytes]]):
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in levels]

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, (chunks, more, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not more[i >> 3] >> (i & 7) & 1:
                break
            b = i // BLOCK
            head, last = more[b * BLOCK // 8 : i >> 3], int(more[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[b]) + int(np.bitwise_count(head).sum()) + last.bit_count()
        return value

    def all(self) -> np.ndarray:
        """All ids at once, level by level from the last."""
        rest = np.empty(0, np.uint32)
        for chunks, more, _ in reversed(self.levels):
            now = chunks.astype(np.uint32)
            now[np.unpackbits(more, count=len(chunks), bitorder="little").astype(bool)] |= rest << 8
            rest = now
        return rest


#: Byte-level vocabularies write the bytes that have no visible character as the characters from 256 on.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
CHARS = str.maketrans({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in VISIBLE)})


def word_by_word(config: str) -> bool:
    """Whether what WordEncoder assumes of a tokenizer holds."""
    said = json.loads(config)
    model, added = said.get("model") or {}, said.get("added_tokens") or []
    return (
        all(said.get(k) == v for k, v in WORD_FILE.items())
        and (model.get("type"), model.get("dropout"), model.get("continuing_subword_prefix")) == ("BPE", None, None)
        and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or not t["content"].startswith(SPECIAL) or t["content"].split() != [t["content"]] for t in added)
    )


def as_letters(word: bytes) -> str | None:
    """A word of Latin letters alone as the model's characters, for which the steps before the model do no more; else null."""
    s = word.decode()
    if not s.isalpha() or max(s) >= "\u0250" or "\u0130" in s:
        return None
    return unicodedata.normalize("NFC", s).lower().encode().decode("latin-1").translate(CHARS)


class WordEncoder:
    """Ids of texts, word by word. Words met before are looked up, in two generations of at most CACHE words each.

    The tokenizer parts text at white space and drops it, and no normal form or merge reaches across it, so the ids of
    a text are those of its parts between ASCII white space, one after another. It lower-cases, so A-Z may be lower
    from the start, but for words that hold SPECIAL: it finds its special tokens in the text as written. And it parts
    letters from what is no letter, so an ASCII mark behind an ASCII letter stands alone. Where word_by_word() says that
    the file is another, encode() hands whole texts to the library.
    """

    def __init__(self, path: str | None = None, config: str | None = None):
        from tokenizers import Tokenizer

        config = config if config is not None else read_file(path)
        self.tokenizer, self.young, self.old = Tokenizer.from_str(config), {}, {}
        self.by_words = word_by_word(config)
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    @classmethod
    def of(cls, key: int, config: Callable[[], str]) -> WordEncoder:
        """The encoder that this process already has, if any: a worker runs many tasks. key: a hash of the file."""
        kept = sys.modules.setdefault("_seqflow_encoders", types.ModuleType("_seqflow_encoders")).__dict__
        if (name := f"e{key}") not in kept:
            kept[name] = cls(config=config())
        return kept[name]

    def look_up(self, words: set[bytes]) -> None:
        """Bring words to the young generation."""
        young, old, packed = self.young, self.old, self.packed
        fresh, stems = set(), {}
        for w in words:
            if w in old:
                young[w] = old[w]
            elif w[-1:] in MARKS and w[-2:-1].isalpha():
                stems[w] = stem = w[:-1]
                if stem not in young:
                    fresh.add(stem)
                if w[-1:] not in young:
                    fresh.add(w[-1:])
            else:
                fresh.add(w)
        rest, tokenize = [], self.tokenizer.model.tokenize
        for w in fresh:
            if w in old:
                young[w] = old[w]
            elif w.isalpha():  # ASCII letters, already lower
                young[w] = b"".join([packed[t.id] for t in tokenize(w.decode())])
            elif (letters := as_letters(w)) is not None:
                young[w] = b"".join([packed[t.id] for t in tokenize(letters)])
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            young[w] = b"".join([packed[i] for i in e.ids])
        for w, stem in stems.items():
            young[w] = young[stem] + young[w[-1:]]

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of each text. Nothing here makes cycles, so the collector need not walk the dictionaries."""
        if not self.by_words:
            found = self.tokenizer.encode_batch_fast([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)], add_special_tokens=False)
            return [np.array(e.ids, np.uint32) for e in found]
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        special = pc.any(pc.match_substring(column, SPECIAL)).as_py()
        lists = pc.ascii_split_whitespace(column if special else pc.ascii_lower(column))  # no cast before: of a slice it would be read amiss
        split = lists.values
        if special:
            split = pc.if_else(pc.match_substring(split, SPECIAL), split, pc.ascii_lower(split))
        coded = split.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        ids = list(map(self.young.get, distinct))
        if None in ids:
            holes = [i for i, v in enumerate(ids) if v is None]
            self.look_up({distinct[i] for i in holes})
            for i in holes:
                ids[i] = self.young[distinct[i]]
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        # each word's ids, gathered by the words' numbers
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        words = coded.indices.to_numpy()
        n = sizes[words]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = flat[np.repeat(starts[words] - ends[:-1], n) + np.arange(ends[-1])]
        return np.split(out, ends[lists.offsets.to_numpy()[1:-1]])


def write(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END, parts: int | None = None) -> str:
    """Write the ids of all texts, an end id after each, in ascending order of the documents; returns the folder.

    tokenizer: the path of the file, on the driver.
    """
    spark = df.sparkSession
    config = read_file(tokenizer)
    key, shared = xxhash.xxh64_intdigest(config), spark.sparkContext.broadcast(config)  # a vocabulary's file, some MB
    path = path or f"{scratch(spark)}/token-ids-{uuid.uuid4().hex}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "_id", "_th").sortWithinPartitions("_id", "_th").withColumn("_part", F.spark_partition_id()).select("_part", "_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, docs, arrays, size, seg, part = None, [], [], 0, 0, 0

        def segment() -> pa.RecordBatch:
            starts = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))[:-1]
            row = {"part": part, "seg": seg, "n_ids": size, "n_docs": len(docs), "doc_ids": docs, "starts": starts.tolist(), "levels": encode(np.concatenate(arrays))}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            encoder = encoder or WordEncoder.of(key, lambda: shared.value)
            part = batch.column(0)[0].as_py()
            for doc, ids in zip(batch.column(1).to_pylist(), encoder.encode(batch.column(2)), strict=True):
                ids = np.append(ids, np.uint32(end))
                if arrays and size + len(ids) > SEGMENT:
                    yield segment()
                    docs, arrays, size, seg = [], [], 0, seg + 1
                docs.append(doc)
                arrays.append(ids)
                size += len(ids)
        if arrays:
            yield segment()

    level = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("levels", pa.list_(level))])
    dealt.mapInArrow(run, FILES).write.option("parquet.block.size", 16 << 20).parquet(path)
    return path


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document, from the files."""
    files = spark.read.schema(FILES).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))  # a row for each partition that was written
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    segments = files.select("part", "seg", "n_ids")
    earlier = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    places = segments.withColumn("_in", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(offsets, F.col("part") == F.col("_p")).select(F.col("part").alias("_p"), F.col("seg").alias("_s"), (F.col("_from") + F.col("_in")).alias("_first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, docs, starts, levels = (batch.column(k)[row].as_py() for k in range(2, 6))
                ids = Codes(levels).all().astype("<u4")
                ends = [*starts[1:], n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * len(docs), pa.int32()), pa.array([batch.column(1)[row].as_py()] * len(docs), pa.int32()),
                        pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    ["part", "seg", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    decoded = files.select("part", "seg", "n_ids", "doc_ids", "starts", "levels").mapInArrow(run, "part int, seg int, doc_id long, at long, n_tokens long, ids_crc32 long")
    joined = decoded.join(places, (F.col("part") == F.col("_p")) & (F.col("seg") == F.col("_s")))
    return joined.select("doc_id", (F.col("_first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, i, token of each row (doc_id, i) of wanted, read by its place in the files; no row for places that a document lacks.

    files: the table that write() made. A place is given for each document of an id.
    """
    docs = files.select("part", "seg", "n_ids", "starts", F.posexplode("doc_ids").alias("_k", "_doc"))
    first, after = F.get("starts", F.col("_k")), F.coalesce(F.get("starts", F.col("_k") + 1), F.col("n_ids"))
    spans = docs.select("part", "seg", "_doc", first.alias("_from"), (after - first).alias("_n"))
    met = spans.join(wanted.select("doc_id", F.col("i").cast("long").alias("i")), F.col("_doc").eqNullSafe(F.col("doc_id"))).where("i >= 0 and i < _n")
    places = met.groupBy("part", "seg").agg(F.collect_list(F.struct("doc_id", "i", (F.col("_from") + F.col("i")).alias("at"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for levels, asked in zip(batch.column(0), batch.column(1), strict=True):
                codes, asked = Codes(levels.as_py()), asked.as_py()
                columns = [x["doc_id"] for x in asked], [x["i"] for x in asked], [codes[x["at"]] for x in asked]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "i", "token"])

    return files.join(places, ["part", "seg"]).select("levels", "places").mapInArrow(run, "doc_id long, i long, token long")
