import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tallyroom.llm import mixing, sharding


def capacity(sizes, shards):
    """The smallest capacity by trying each sum of consecutive groups."""
    def fits(c):
        n, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            n, held = (n + 1, s) if held + s > c else (n, held + s)
        return n <= shards
    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("hot", [False, True])
def test_cuts_reach_the_smallest_capacity(spark, hot):
    rng = random.Random(hot)
    groups = sorted((hashlib.sha256(str(k).encode()).hexdigest()[:32], rng.randint(1, 5000)) for k in range(3000))
    if hot:
        groups[1200] = (groups[1200][0], 3_000_000)  # a third of all
    found, ends = sharding.cuts(spark.createDataFrame(groups, "key string, size bigint"), 8)
    assert found == capacity([s for _, s in groups], 8)
    sums = Counter()
    for k, s in groups:
        sums[sum(k > e for e in ends)] += s
    assert max(sums.values()) <= found
    if not hot:
        assert min(sums.values()) > 0.98 * max(sums.values())


def test_shards(stored, odd_rows, none):
    got = sharding.shard(stored, 4).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shards[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shards.values())
    assert sharding.shard(none).count() == 0


def goals(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    rest, left, out = 1.5 * sum(sizes.values()), set(names), {}
    while left:
        whole = sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / whole > 2 * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / whole for s in left}
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
        left -= over
    return out


def test_mix(stored, odd_rows, none):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = Counter(), Counter()
    for _, t, _, s in odd_rows:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    target = goals(sizes)
    table = mixing.copies(stored)
    got = table.join(stored.selectExpr("monotonically_increasing_id() row", "source"), "row").collect()
    assert len(got) == len(odd_rows)
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * (1 + r.target) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        taken[r.source] += r.size * r.copies
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    again = {(r.row, r.copies) for r in mixing.copies(stored).collect()}
    assert again == {(r.row, r.copies) for r in got}
    rows = mixing.mixed(stored)
    assert rows.schema.names == stored.schema.names and rows.count() == sum(r.copies for r in got)
    assert mixing.copies(none).count() == 0 and mixing.mixed(none).count() == 0


def test_pivot_keeps_words_and_chances(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(mixing, "_draw", lambda *key: rng.random())
    total = [0.0, 0.0]
    for _ in range(20_000):
        (_, _, p), (_, _, q) = mixing.pivot((1, 30, 0.4), (2, 70, 0.3))
        assert abs(30 * p + 70 * q - 33) < 1e-9 and {p, q} & {0.0, 1.0}
        total[0] += p
        total[1] += q
    assert abs(total[0] / 20_000 - 0.4) < 0.02 and abs(total[1] / 20_000 - 0.3) < 0.01


def test_tree_of_buckets(make, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "BUCKET", 5)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 50)), "en", "abc"[i % 3]) for i in range(400)]
    make(rows).write.parquet(str(tmp_path / "d"))
    got = mixing.copies(make(rows).sparkSession.read.parquet(str(tmp_path / "d"))).collect()
    taken = Counter()
    for r in got:
        taken[r.target] += r.size * r.copies
    assert len(got) == 400 and all(abs(n - t) <= 50 for t, n in taken.items())
