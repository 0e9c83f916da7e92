"""Toxicity by a linear-chain conditional random field.

Two tags, clean and toxic, over the words of a text. Words of training texts are labelled from their documents' labels:
a word is toxic in a text marked toxic if it, or its start, is far oftener in texts marked so than in others (a
likelihood-ratio test over distinct contexts, a word with its neighbours, so that copies of a text count once).
The field is fitted to those texts, whole, by its exact gradient, from forward-backward marginals. A whole text
is scored by the marginals of its words: a logistic curve over the expected number of toxic words, their greatest
probability and their share gives the document's score; words with a probability of a half or more give the spans.

The chain over all texts of a batch is one product of two-by-two matrices, cut where a text begins by a matrix of rank
one and evaluated in blocks, so a text of any length is tagged whole and exactly.

The classifier is fitted on a bounded sample of the labelled rows (MAX_TRAIN rows and MAX_TRAIN_BYTES bytes of text, both
expected). The field and the curve are fitted, in one task, to whole texts of it with FIT_BYTES bytes (expected), toxic
ones up to half of that. Nothing else bounds the model. Training and scoring part texts by the same function.

Defined results: null and empty texts have no words and the score of none; a document with several labels is toxic if
one says so; rows without an id are not learnt from; with nothing to learn from all scores are 0; repeated rows count
as rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqflow.llm.common import cut, discard, uniform
from seqflow.llm.langid import held_out

MAX_TRAIN, MAX_TRAIN_BYTES, FIT_BYTES = 6000, 16 << 20, 3 << 20
#: Of a toxic word or start: share of contexts in toxic texts over that in others, contexts in toxic texts, and twice the
#: logarithm of the likelihood ratio beyond twice that of the number of units tried (a Bonferroni bound).
LIFT, SUPPORT, G_BEYOND = 8.0, 3, 6.0
RANGE, STEPS, RATE, CACHE = 1 << 16, 80, 0.3, 400_000
#: Letters of the starts that are units beside whole words.
STARTS = (4, 5)
#: Features: the word, its starts, its end, the word before, the word after; and their penalties.
KINDS, L2 = "wabzpn", (1e-6, 2e-6, 2e-6, 5e-5, 2e-5, 2e-5)
BUCKETS = RANGE * len(KINDS)
OFFSETS = {k: i * RANGE for i, k in enumerate(KINDS)}
#: Least probability that counts towards a document's expected number of toxic words.
NOISE = 0.1
WORDS = re.compile(r"\w+")


def bucket(kind: str, value: str) -> int:
    """A kind's own range of buckets."""
    return OFFSETS[kind] + xxhash.xxh32_intdigest(value) % RANGE


def features(word: str) -> tuple[int, ...]:
    """Buckets of the word itself, its starts, its end, and the word as neighbour on either side."""
    w = word.lower()
    return bucket("w", w), *(bucket(k, w[:n]) for k, n in zip("ab", STARTS, strict=True)), bucket("z", w[-3:]), bucket("p", w), bucket("n", w)


def passes(emission: np.ndarray, transition: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chain's matrices, and the forward and backward messages. emission: the score for tag 1; fresh: where a text begins."""
    scale = np.maximum(emission, 0)
    e = np.stack((np.exp(-scale), np.exp(emission - scale)), 1)
    m = np.exp(transition)[None] * e[:, None, :]
    m[fresh] = e[fresh][:, None, :]  # the same row twice: whatever came before does not matter
    m[:1] = e[:1][:, None, :]
    backward = np.ones((len(m), 2))
    if len(m) > 1:
        backward[:-1] = products(m[:0:-1].transpose(0, 2, 1))[::-1]
    return m, products(m), backward


def marginals(emission: np.ndarray, transition: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Probability of the tag 1 at each place of a chain."""
    if not len(emission):
        return np.empty(0)
    _, forward, backward = passes(emission, transition, fresh)
    p = forward * backward
    return p[:, 1] / (p[:, 0] + p[:, 1])


def products(m: np.ndarray, block: int = 32) -> np.ndarray:
    """(1, 1) m[0] m[1] ... m[i] for each i, each scaled to a sum of 1."""
    n = len(m)
    if n <= block:
        out, v = np.empty((n, 2)), np.ones(2)
        for i in range(n):
            v = v @ m[i]
            v = v / v.sum()
            out[i] = v
        return out
    k = -(-n // block)
    padded = np.concatenate((m, np.broadcast_to(np.eye(2), (k * block - n, 2, 2))))
    q = np.ascontiguousarray(padded.reshape(k, block, 4).transpose(1, 2, 0))  # place in the block, entry, block
    prefix = np.empty_like(q)
    prefix[0] = q[0]
    for i in range(1, block):
        (p00, p01, p10, p11), (q00, q01, q10, q11) = prefix[i - 1], q[i]
        now = prefix[i]
        now[0], now[1] = p00 * q00 + p01 * q10, p00 * q01 + p01 * q11
        now[2], now[3] = p10 * q00 + p11 * q10, p10 * q01 + p11 * q11
        now *= 1 / (now[0] + now[1] + now[2] + now[3])
    last = prefix[-1, :, :-1].T.reshape(-1, 2, 2)
    into = np.concatenate((np.ones((1, 2)), products(last, block))).T
    out = np.empty((k, block, 2))
    one, two = into[0] * prefix[:, 0] + into[1] * prefix[:, 2], into[0] * prefix[:, 1] + into[1] * prefix[:, 3]
    total = one + two
    out[:, :, 0], out[:, :, 1] = (one / total).T, (two / total).T
    return out.reshape(-1, 2)[:n]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    curve: np.ndarray  # constant, log expected count, greatest probability, share


def fit_field(texts: list[tuple[list[str], list[int]]]) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights by buckets, bias and transitions, by the exact gradient of the likelihood with Adam's steps. texts: words and their tags."""
    sizes = np.array([len(w) for w, _ in texts])
    fresh = np.zeros(sizes.sum(), bool)
    fresh[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = True
    index: dict[str, int] = {}
    at = np.fromiter((index.setdefault(w, len(index)) for ws, _ in texts for w in ws), np.int64, len(fresh))
    rows = np.array([features(w) for w in index], np.int32)[at]
    y = np.fromiter((t for _, ts in texts for t in ts), float, len(fresh))
    n = len(y)
    previous, following = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    previous[1:] = np.where(fresh[1:], -1, rows[:-1, 4])
    following[:-1] = np.where(fresh[1:], -1, rows[1:, 5])
    columns = [np.where(c < 0, BUCKETS, c).astype(np.int64) for c in (*rows[:, :4].T, previous, following)]  # BUCKETS: no neighbour
    theta = np.zeros(BUCKETS + 1 + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pairs = ~fresh[1:]
    seen = np.array([[((y[:-1] == a) & (y[1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    penalty = np.concatenate((np.repeat(L2, RANGE), np.full(6, L2[0])))
    for step in range(1, STEPS + 1):
        w, bias, transition = theta[: BUCKETS + 1], theta[BUCKETS + 1], theta[-4:].reshape(2, 2)
        emission = sum(w[u] for u in columns) + bias
        chain, forward, backward = passes(emission, transition, fresh)
        p = forward * backward
        miss = p[:, 1] / (p[:, 0] + p[:, 1]) - y
        g = np.zeros_like(theta)
        for k in range(len(KINDS)):
            g[: BUCKETS + 1] += np.bincount(columns[k], miss, BUCKETS + 1)
        g[BUCKETS] = 0.0
        g[BUCKETS + 1] = miss.sum()
        joint = [forward[:-1, i] * chain[1:, i, j] * backward[1:, j] for i in (0, 1) for j in (0, 1)]  # of the tags of neighbours
        scale = pairs / (joint[0] + joint[1] + joint[2] + joint[3])
        g[-4:] = [(x * scale).sum() for x in joint] - seen.ravel()
        g = g / n + penalty * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[: BUCKETS + 1], float(theta[BUCKETS + 1]), theta[-4:].reshape(2, 2)


class Tagger:
    """Tags texts with a model; keeps the scores of words it has met, up to CACHE."""

    def __init__(self, model: Model):
        self.model, self.index, self.table = model, {}, np.zeros((CACHE + 1, 3))

    def rows(self, words: list[str]) -> list[int]:
        w, index = self.model.weights, self.index
        if len(index) > CACHE // 2:
            index.clear()
        for word in set(words).difference(index):
            f = features(word)
            at = index[word] = len(index)
            self.table[at] = sum(w[x] for x in f[:4]) + self.model.bias, w[f[4]], w[f[5]]
        return list(map(index.__getitem__, words))

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """The probability of the tag toxic, for each word of each text."""
        words = [WORDS.findall(t) for t in texts]
        sizes = np.array([len(w) for w in words])
        emission, fresh = np.empty(sizes.sum()), np.zeros(sizes.sum(), bool)
        at = 0
        for w in words:
            if not w:
                continue
            own = np.concatenate([self.table[self.rows(w[i : i + CACHE // 2])] for i in range(0, len(w), CACHE // 2)])
            e = own[:, 0].copy()
            e[1:] += own[:-1, 1]
            e[:-1] += own[1:, 2]
            emission[at : at + len(w)] = e
            fresh[at] = True
            at += len(w)
        return np.split(marginals(emission, self.model.transition, fresh), np.cumsum(sizes)[:-1]) if len(texts) else []


def summary(p: np.ndarray) -> tuple[float, float, float, float]:
    if not len(p):
        return 1.0, 0.0, 0.0, 0.0
    total = float(p[p >= NOISE].sum())  # else the many words of a long text would add up to one
    return 1.0, float(np.log1p(total)), float(p.max()), total / len(p)


def fit_curve(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps, with a small ridge; counts: how often each row counts."""
    b, ridge = np.zeros(x.shape[1]), 1e-4 * counts.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        b = b - np.linalg.solve(h, x.T @ (counts * (p - y)) + ridge * b)
    return b


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, y to y, c (a hash of a word with its neighbours), w: the distinct ones of each batch."""
    h = xxhash.xxh64_intdigest
    for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        found = set()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ws = ["", *(w.lower() for w in WORDS.findall(text)), ""]
            found.update((y, *x) for x in zip(ws, ws[1:], ws[2:], strict=False))
        keys = np.fromiter((h("\0".join(x[1:])) for x in found), np.uint64, len(found)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.bool_()), pa.array(keys), pa.array([x[2] for x in found], pa.string())], ["y", "c", "w"])


def _fit(toxic: set[tuple[int, str]], counts: dict[bool, float]):
    """Over the rows text, y of the bounded sample, all in one task: one row with the model's arrays. counts: by y, how many texts one stands for."""

    def is_toxic(word: str) -> bool:
        w = word.lower()
        return (0, w) in toxic or any((n, w[:n]) in toxic for n in STARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        words = [WORDS.findall(t) for t, _ in rows]
        tagged = [(ws, [int(y and is_toxic(w)) for w in ws]) for ws, (_, y) in zip(words, rows, strict=True) if ws]
        if not any(any(tags) for _, tags in tagged):
            return
        weights, bias, transition = fit_field(tagged)
        tagger, x = Tagger(Model(weights, bias, transition, np.zeros(4))), []
        for i in range(0, len(rows), 200):
            x += [summary(p) for p in tagger.tag([t for t, _ in rows[i : i + 200]])]
        curve = fit_curve(np.array(x), np.array([y for _, y in rows], float), np.array([counts[y] for _, y in rows]))
        arrays = [np.asarray(v, "<f8").tobytes() for v in (weights, bias, transition, curve)]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in arrays], ["weights", "bias", "transition", "curve"])

    return run


def toxic_units(sample: DataFrame) -> set[tuple[int, str]]:
    """Of rows _text, _y: words, as (0, word), and starts, as (length, start), that are far oftener in toxic texts."""
    contexts = cut(sample.mapInArrow(_contexts, "y boolean, c long, w string").distinct().select("y", "w"), "tox-contexts")
    m = {r[0]: r[1] for r in contexts.groupBy("y").count().collect()}
    m1, m0 = m.get(True, 0), m.get(False, 0)
    if not m1 or not m0:
        return set()
    units = [F.struct(F.lit(0).alias("k"), F.col("w").alias("u"))] + [F.struct(F.lit(n).alias("k"), F.when(F.length("w") >= n, F.substring("w", 1, n)).alias("u")) for n in STARTS]
    counted = contexts.select("y", F.explode(F.array(*units)).alias("x")).where("x.u is not null").groupBy("x.k", "x.u")
    tried = cut(counted.agg(F.count_if("y").alias("a"), F.count_if(~F.col("y")).alias("b")).where(f"a >= {SUPPORT}"), "tox-units")
    a, b, n_ = F.col("a"), F.col("b"), F.lit(float(m1 + m0))
    part = lambda o, e: F.when(o > 0, 2 * o * F.ln(o / e)).otherwise(0.0)
    g = part(a, (a + b) * m1 / n_) + part(b, (a + b) * m0 / n_) + part(m1 - a, (n_ - a - b) * m1 / n_) + part(m0 - b, (n_ - a - b) * m0 / n_)
    least = 2 * math.log(max(1, tried.count())) + G_BEYOND
    # a unit has SUPPORT contexts in the sample or more, so there are at most MAX_TRAIN_BYTES / SUPPORT of each length
    out = {(r[0], r[1]) for r in tried.where(f"a * {m0}D > b * {m1}D * {LIFT}").where(g >= least).select("k", "u").collect()}
    discard(contexts, tried)
    return out


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).alias("_y"))
    texts = documents.where(~held_out(id_col)).select(F.col(id_col).alias("_did"), F.col(text_col).alias("_text")).where("_text is not null")
    marks = marks.where(~held_out("_id"))
    n = marks.count()
    size, rows = texts.agg(F.sum(F.octet_length("_text")), F.count("*")).first()
    # the labelled rows' bytes are about those of as many others
    rate = min(1.0, MAX_TRAIN / max(n, 1), MAX_TRAIN_BYTES / max(1.0, n * (size or 0) / max(rows, 1)))
    chosen = marks.where(uniform(F.col("_id").cast("string"), F.lit("toxicity")) < rate)
    # one row for each text and mark; at most about MAX_TRAIN ids, a bound that the broadcast relies on
    sample = cut(texts.join(F.broadcast(chosen), F.col("_did") == F.col("_id")).select("_text", "_y"), "tox-sample")
    sizes = {r[0]: (r[1], r[2]) for r in sample.groupBy("_y").agg(F.count("*"), F.sum(F.octet_length("_text"))).collect()}
    if len(sizes) < 2:
        return None
    toxic = toxic_units(sample)
    (n1, toxic_bytes), (n0, clean_bytes) = sizes[True], sizes[False]
    share1 = min(1.0, FIT_BYTES / 2 / max(1, toxic_bytes))
    share0 = min(1.0, (FIT_BYTES - share1 * toxic_bytes) / max(1, clean_bytes))
    chance = uniform("_text", F.lit("fit"))
    chosen = sample.where(F.when(F.col("_y"), chance < share1).otherwise(chance < share0))
    ordered = chosen.coalesce(1).sortWithinPartitions(F.xxhash64("_text"), "_y")
    # the curve is that of all labelled texts: each text counts as many times as it stands for
    counts = {True: 1 / share1, False: 1 / share0}
    fitted = cut(ordered.mapInArrow(_fit(toxic, counts), "weights binary, bias binary, transition binary, curve binary"), "tox-model").first()
    discard(sample)
    if fitted is None:
        return None
    weights, bias, transition, curve = (np.frombuffer(v, "<f8") for v in fitted)
    return Model(weights, float(bias[0]), transition.reshape(2, 2), curve)


def score(documents: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, spans (array of struct<start, stop, probability>, in characters)."""
    shared = documents.sparkSession.sparkContext.broadcast(vars(model) if model else None)  # plain values, that a worker reads without this library
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())])

    def spans(text: str, p: np.ndarray) -> list[dict]:
        if not len(p) or p.max() < 0.5:
            return []
        return [{"start": m.start(), "stop": m.end(), "probability": float(q)} for m, q in zip(WORDS.finditer(text), p, strict=True) if q >= 0.5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value) if shared.value else None
        tagger = Tagger(model) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [t or "" for t in part.column(2).to_pylist()]
                p = tagger.tag(texts) if tagger else [np.empty(0)] * len(texts)
                scores = [float(1 / (1 + np.exp(-np.clip(np.dot(summary(x), model.curve), -30, 30)))) if model else 0.0 for x in p]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([spans(t, x) for t, x in zip(texts, p, strict=True)], pa.list_(span))],
                    ["doc_id", "held_out", "score", "predicted", "spans"],
                )

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:long,stop:long,probability:double>>")
