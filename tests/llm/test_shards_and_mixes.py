import re
import zlib
from collections import Counter, defaultdict

import pytest

from seqflow.llm import mixing, sharding


def check_shards(rows, n, slack):
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / n
    assert max(sizes[i] for i in range(n)) <= mean * (1 + slack) + max(r.size for r in rows)


def test_shards_of_all_documents(spark, documents, texts):
    rows = sharding.shard(documents, 7).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    check_shards(rows, 7, 0.02)


def test_a_hot_key_is_subdivided(spark):
    rows = [(i, "the same text for a third of all rows" if i % 3 == 0 else f"text {i} " * 4) for i in range(6000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    check_shards(out, 10, 0.02)
    assert len({r.shard for r in out if r.doc_id % 3 == 0}) >= 3


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 2} " * 5) for i in range(4000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    where = defaultdict(set)
    for r in out:
        where[r.doc_id // 2].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_awkward_rows_are_sharded(awkward, nothing):
    rows = sharding.shard(awkward, 3).collect()
    assert len(rows) == awkward.count()
    check_shards(rows, 3, 0.02)
    assert {r.size for r in rows if r.doc_id == 3} == {16}
    assert sharding.shard(nothing, 3).count() == 0
    assert sharding.shard(nothing, 3).columns == sharding.shard(awkward, 3).columns


def wanted(sizes):
    """Targets by resharing the excess over the cap until none is above it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("shape", ["even", "one large source"])
def test_mix_meets_targets(spark, shape):
    words = lambda i: (i * 7919) % 90 + 1
    source = lambda i: None if i % 11 == 0 else "z" if shape != "even" and i % 3 else f"s{i % 5}"
    data = [(i, " ".join(["w"] * words(i)), source(i)) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    sizes, taken, target = Counter(), Counter(), {}
    of = {i: s for i, _, s in data}
    for r in rows:
        assert r.size == words(r.doc_id) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        sizes[of[r.doc_id]] += r.size
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    want = wanted(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9)
        assert taken[s] == pytest.approx(want[s], rel=0.01)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_rates_are_tilted(spark):
    """Where a source is cut to a part, longer documents are taken less, and as exp(lambda * size) says."""
    data = [(i, " ".join(["w"] * (1 + i % 40)), "a" if i < 4000 else "b") for i in range(5000)]
    rows = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    mean = lambda a, b: sum(r.copies for r in rows if r.doc_id < 4000 and a <= r.size < b) / sum(1 for r in rows if r.doc_id < 4000 and a <= r.size < b)
    assert mean(1, 14) > mean(14, 27) > mean(27, 41)


def test_awkward_rows_are_mixed(awkward, nothing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count()
    count = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in awkward.collect() if r.doc_id in (1, 3, 4, 5, 7)}
    assert {r.doc_id: r.size for r in rows if r.doc_id in count} == count
    assert mixing.mix(nothing).count() == 0
