"""Language identification by words first, backing off to character n-grams.

A word that the model knows is scored by its relative frequency in each language; another word by its n-grams of the
greatest order of which any is known, from MAX_ORDER down to 1. A text's score is the mean over its words.

The model is fitted on a bounded sample of the labelled rows (MAX_TRAIN rows and MAX_TRAIN_BYTES bytes of text, both
expected) and holds every word and n-gram of that sample: nothing is cut by frequency. Should it have more than MAX_PAIRS
pairs of a language and a word or n-gram, a smaller sample is taken, which bounds the broadcast (14 bytes a pair at most).
Training and scoring part texts by the same function. Every text is scored whole.

Defined results: `und` with score 0 where a text is null, has no letter, or nothing was learnt; a language is any
non-null value of lang; rows without an id are not learnt from; repeated rows and ids count as rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqflow.llm.common import cut, discard, uniform

MAX_TRAIN, MAX_TRAIN_BYTES, MAX_PAIRS, MAX_ORDER = 8000, 64 << 20, 8_000_000, 5
#: Minus the logarithm (base 10) of the frequency of what a language does not have; fixed value.
PENALTY = 7.0
#: Words whose scores a task keeps.
CACHE = 400_000
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The runs of letters in lower case; a text that has letters but no such run is a word."""
    return LETTERS.findall(text.lower()) or [text.lower()]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text is divisible by 5, or there is no id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class Table:
    """Scores of keys, hashes of words or n-grams in ascending order: those of key i are at starts[i] to starts[i + 1]."""

    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    scores: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, lang: np.ndarray, score: np.ndarray) -> Table:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        return cls(key[first], np.append(first, len(key)).astype(np.int32), lang[order].astype(np.int16), score[order].astype(np.float32))

    def look_up(self, wanted: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of wanted are known, and a row of scores for each; PENALTY where a language lacks it."""
        out = np.full((len(wanted), max(1, n_langs)), PENALTY, np.float32)
        if not len(self.keys):
            return np.zeros(len(wanted), bool), out
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = self.keys[at] == wanted
        rows = np.flatnonzero(known)
        a, n = self.starts[at[rows]], self.starts[at[rows] + 1] - self.starts[at[rows]]
        places = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.repeat(rows, n), self.langs[places]] = self.scores[places]
        return known, out


def key_of(word: str) -> int:
    """The hash that Spark's xxhash64 has, signed."""
    h = xxhash.xxh64_intdigest(word.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text to lang, w, n."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0)[at : at + 256].to_pylist(), batch.column(1)[at : at + 256].to_pylist(), strict=True):
                if any(map(str.isalpha, text)):
                    counts.setdefault(lang, Counter()).update(words_of(text))
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "w", "n"])


def grams_of(words: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams of the words between marks, and how many each word has."""
    padded = [f"<{w}>" for w in words]
    sizes = np.fromiter((max(0, len(p) - k + 1) for p in padded), np.int64, len(padded))
    h = xxhash.xxh64_intdigest
    keys = np.fromiter((h(p[a : a + k].encode(), 42) for p in padded for a in range(len(p) - k + 1)), np.uint64, int(sizes.sum()))
    return keys.view(np.int64), sizes


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, w, n to lang, k, key, n."""
    for batch in batches:
        lang, n, words = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(1).to_pylist()
        for k in range(1, MAX_ORDER + 1):
            keys, sizes = grams_of(words, k)
            owner = np.repeat(lang, sizes)
            for x in np.unique(owner):
                own = owner == x
                found, at = np.unique(keys[own], return_inverse=True)
                sums = np.bincount(at, np.repeat(n, sizes)[own], len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x, np.int32)), pa.array(np.full(len(found), k, np.int32)), pa.array(found), pa.array(sums)], ["lang", "k", "key", "n"])


def train(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """{"langs", "words", "grams"}: the languages and two Tables of minus the logarithms of relative frequencies."""
    labelled = df.where(~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    labelled = labelled.where("_text is not null and _lang is not null")
    n, size = labelled.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    rate = min(1.0, MAX_TRAIN / max(n, 1), MAX_TRAIN_BYTES / max(size, 1))
    while True:
        sample = labelled.where(uniform(F.col("_id").cast("string"), F.lit("langid")) < rate).select("_lang", "_text")
        words = cut(sample.mapInArrow(_count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")), "lang-words")
        totals = {r[0]: r[1] for r in words.groupBy("lang").agg(F.sum("n")).collect()}
        langs = sorted(totals)
        if not langs:
            none = Table.of(*(np.empty(0, np.int64),) * 3)
            return {"langs": [], "words": none, "grams": none}
        number = F.array_position(F.lit(langs), F.col("lang")).cast("int") - 1
        pieces = words.select(number.alias("lang"), "w", "n").mapInArrow(_grams, "lang int, k int, key long, n long")
        grams = cut(pieces.groupBy("lang", "k", "key").agg(F.sum("n").alias("n")), "lang-grams")
        if words.count() + grams.count() <= MAX_PAIRS:
            break
        discard(words, grams)
        rate /= 2
    a = words.select(number.alias("lang"), F.xxhash64("w").alias("key"), "n").toArrow()
    b = grams.select("lang", "k", "key", "n").toArrow()
    discard(words, grams)
    lang, key, count = (a.column(c).to_numpy() for c in ("lang", "key", "n"))
    whole = np.array([totals[x] for x in langs], float)
    known = Table.of(key, lang, np.log10(whole[lang] / count))
    lang, k, key, count = (b.column(c).to_numpy() for c in ("lang", "k", "key", "n"))
    of_order = np.zeros((len(langs), MAX_ORDER + 1))
    np.add.at(of_order, (lang, k), count)
    return {"langs": langs, "words": known, "grams": Table.of(key, lang, np.log10(of_order[lang, k] / count))}


class Scorer:
    """Scores texts with a model; keeps the scores of words it has met, up to CACHE."""

    def __init__(self, model: dict):
        self.langs, self.words, self.grams = model["langs"], model["words"], model["grams"]
        self.index: dict[str, int] = {}
        self.table = np.zeros((CACHE + 1, max(1, len(self.langs))), np.float32)

    def backoff(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word, by its n-grams alone."""
        out = np.full((len(words), max(1, len(self.langs))), PENALTY, np.float32)
        left = np.arange(len(words))
        for k in range(MAX_ORDER, 0, -1):
            keys, sizes = grams_of([words[i] for i in left.tolist()], k)
            known, scores = self.grams.look_up(keys, len(self.langs))
            owner = np.repeat(np.arange(len(left)), sizes)
            hits = np.bincount(owner, known, len(left)) > 0
            for lang in range(len(self.langs)):
                out[left[hits], lang] = np.bincount(owner, scores[:, lang], len(left))[hits] / sizes[hits]
            left = left[~hits]
            if not len(left):
                break
        return out

    def rows(self, words: list[str]) -> list[int]:
        """Places in the table; words has at most CACHE / 2 distinct ones."""
        get = self.index.get
        out = list(map(get, words))
        if None in out:
            if len(self.index) > CACHE // 2:
                self.index.clear()
                get = self.index.get
            fresh = [w for w in dict.fromkeys(words) if w not in self.index]
            known, scores = self.words.look_up(np.array([key_of(w) for w in fresh], np.int64), len(self.langs))
            rest = np.flatnonzero(~known)
            if len(rest):
                scores[rest] = self.backoff([fresh[i] for i in rest.tolist()])
            at = len(self.index)
            self.table[at : at + len(fresh)] = scores
            self.index.update(zip(fresh, range(at, at + len(fresh)), strict=True))
            out = list(map(get, words))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and score of each text."""
        out: list[tuple[str, float]] = []
        for text_words in self.pieces(texts):
            sizes = [sum(map(len, w)) for w in text_words]
            flat = [w for parts in text_words for part in parts for w in part]
            totals = np.zeros((len(sizes), max(1, len(self.langs))))
            if len(text_words) == 1:
                for part in text_words[0]:
                    totals[0] += self.table[self.rows(part)].sum(0, dtype=np.float64)
            elif flat:
                full = np.flatnonzero(sizes)
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[full]
                totals[full] = np.add.reduceat(self.table[self.rows(flat)].astype(np.float64), starts)
            out += map(self.decide, totals, sizes)
        return out

    def pieces(self, texts: list[str | None]) -> Iterator[list[list[list[str]]]]:
        """Groups of texts, each cut to lists of words, with no more words in a group than there is room for, or one text."""
        limit, group, held = CACHE // 2, [], 0
        for text in texts:
            words = words_of(text) if text and self.langs and any(map(str.isalpha, text)) else []
            if group and held + len(words) > limit:
                yield group
                group, held = [], 0
            group.append([words[i : i + limit] for i in range(0, len(words), limit)])
            held += len(words)
        if group:
            yield group

    def decide(self, total: np.ndarray, n: int) -> tuple[str, float]:
        if not n:
            return "und", 0.0
        # as if the words' evidence were that of their square root in number, since words are not independent
        mean = total / n
        weight = np.exp((mean.min() - mean) * math.log(10) * math.sqrt(n))
        best = int(mean.argmin())
        return self.langs[best], float(weight[best] / weight.sum())


def _shared(df: DataFrame, model: dict):
    """Plain arrays, so that a worker reads them without this library."""
    plain = {"langs": model["langs"], **{k: vars(model[k]) for k in ("words", "grams")}}
    return df.sparkSession.sparkContext.broadcast(plain)


def _scorer(plain: dict) -> Scorer:
    return Scorer({"langs": plain["langs"], **{k: Table(**plain[k]) for k in ("words", "grams")}})


def identify(df: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    shared = _shared(df, model)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or _scorer(shared.value)
            found = [x for i in range(0, batch.num_rows, 256) for x in scorer.predict(batch.column(2)[i : i + 256].to_pylist())]
            langs, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], langs, scores], ["doc_id", "held_out", "lang_pred", "score"])

    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def recognised(df: DataFrame, model: dict, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df, all columns, whose language is recognised with a score of least or more.

    No column is added, so the names of df's columns do not matter.
    """
    shared, at = _shared(df, model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or _scorer(shared.value)
            found = [x for i in range(0, batch.num_rows, 256) for x in scorer.predict(batch.column(at)[i : i + 256].to_pylist())]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # a dot in a name would be taken for a field's
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
