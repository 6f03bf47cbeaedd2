import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyroom.llm import grace, lines, simhash
from tallyroom.llm.components import components


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def rank(i):
    return (i is not None, i or 0)


def test_grace_report_and_survivors(stored, odd_rows, none):
    groups = defaultdict(list)
    for i, t, *_ in odd_rows:
        groups[lower(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max(ids, key=rank)
        for i in ids:
            want[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    got = grace.report(stored, memory=2000).collect()  # so little that most contents are spilled
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = grace.survivors(stored, memory=2000)
    assert kept.schema.names == stored.schema.names
    rows = kept.collect()
    assert Counter(r.doc_id for r in rows) == Counter(max(ids, key=rank) for ids in groups.values())
    assert set(rows) <= set(stored.collect())
    assert grace.report(none).count() == 0 and grace.survivors(none).count() == 0


def test_table_passes_compare_whole_contents():
    records = [(7, bytes([k % 5]) * 50, 1) for k in range(400)] + [(k, b"x%d" % k, 1) for k in range(200)]  # one hash, five contents
    found = {(c, v) for _, c, v in grace.passes(iter(records), lambda a, b: a + b, memory=500)}
    assert found == {(bytes([k]) * 50, 80) for k in range(5)} | {(b"x%d" % k, 1) for k in range(200)}


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_simhash(stored, odd_rows, none):
    fps = [brute_fingerprint(t) for _, t, *_ in odd_rows]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    root = roots(len(fps), links)
    ids = defaultdict(list)
    for k, r in enumerate(root):
        if odd_rows[k][0] is not None:
            ids[r].append(odd_rows[k][0])
    want = Counter((odd_rows[k][0], fps[k], min(ids[r], default=None)) for k, r in enumerate(root))
    got = simhash.near_duplicates(stored).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_lose_none_across_blocks(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for center in list(fps)[:3]:  # crowded cells, cut to blocks of 16
        for _ in range(120):
            near = center
            for b in rng.sample(range(64), rng.randint(1, 4)):
                near ^= 1 << b
            fps.add(near)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = roots(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), block=16)
    at = {f: k for k, f in enumerate(signed)}
    pairs = [(at[r.a], at[r.b]) for r in found.collect()]
    assert roots(len(fps), pairs) == want
    assert len(pairs) < 20 * len(fps)


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2**63, (2, 5000), dtype=np.uint64)
    half = np.uint64(0x5555555555555555)
    embed = lambda v: v - (v >> np.uint64(1) & half)
    counts = lambda v: np.array([[int(a) >> 2 * k & 3 for k in range(32)] for a in v])
    d = simhash._manhattan(embed(x), embed(y))
    assert (d == np.abs(counts(embed(x)) - counts(embed(y))).sum(1)).all()
    assert (d <= np.bitwise_count(x ^ y)).all()


def test_components(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    names = sorted({x for p in chain for x in p})
    at = {x: k for k, x in enumerate(names)}
    want = roots(len(names), [(at[a], at[b]) for a, b in chain if a != b])
    linked = {x for a, b in chain if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {x: names[want[at[x]]] for x in linked}


def brute_lines(rows):
    occurrences = defaultdict(list)
    for i, t, *_ in rows:
        for place, line in enumerate((t or "").split("\n")):
            text = re.sub(r"\s+", " ", line.lower(), flags=re.A).strip(" ")
            if text:
                occurrences[text].append((i is None, i or 0, place))
    texts = list(occurrences)
    sets = [{t[k : k + 10] for k in range(max(1, len(t) - 9))} for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root, first = roots(len(texts), links), {}
    for k, r in enumerate(root):
        first[r] = min(first.get(r, (True, math.inf, 0)), min(occurrences[texts[k]]))
    return Counter((i, n, at) for i, n, at in first.values())


def test_fuzzy_lines(spark, make, none):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij klmno") for _ in range(rng.randint(3, 400))) for _ in range(25)]
    rows = [(None, base[0], "en", "s"), (1, None, "en", "s"), (2, "\n \n", "en", "s")]
    for i in range(40):  # copies with few changes
        own = []
        for line in rng.sample(base, 4):
            t = list(line)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            own.append("".join(t))
        rows.append((10 + i, "\n".join(own), "en", "s"))
    got = lines.deduplicated(make(rows)).where("kept").collect()
    want = brute_lines(rows)
    have = Counter((r.doc_id is None, r.doc_id or 0, r.place) for r in got)
    assert sum((want - have).values()) + sum((have - want).values()) <= 0.02 * sum(want.values())  # high recall, exact otherwise
    assert lines.deduplicated(none).count() == 0


def test_unlike_lines_of_a_rarest_shingle_are_not_paired(spark):
    """All pairs of 0.8 or more are made; of the others, which share as rare shingles, hardly any."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(60)], []
    for k in range(120):
        own = list(base)
        for at in rng.sample(range(60), rng.choice([1, 2, 6, 8, 10])):
            own[at] = word()
        texts.append(" ".join(own))
    sets = [shingle_set(t) for t in texts]
    alike = {(a, b) for b in range(120) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "line long, text string")
    tokens = lines.rarest(rows.selectExpr("line", "line as root"), rows)
    made = {(r.a, r.b) for r in lines._pairs(tokens, "token").collect()}
    assert alike <= made
    assert len(made - alike) < 0.1 * (120 * 119 // 2 - len(alike))


def shingle_set(t):
    return {t[k : k + 10] for k in range(max(1, len(t) - 9))}


@pytest.mark.parametrize("low, high", [(14, 30), (31, 80), (81, 400)])
def test_pairs_of_alike_lines_share_a_band(spark, low, high):
    rng = random.Random(low)
    rows, n = [], 0
    while n < 400:  # ends cut off, least similarity first
        whole = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(low, high)))
        part = whole[: -max(1, int((len(whole) - 9) * rng.uniform(0.1, 0.2)))]
        s, t = shingle_set(whole), shingle_set(part)
        if len(part) >= 10 and 0.8 <= len(s & t) / len(s | t) <= 0.9:
            rows += [(2 * n, whole), (2 * n + 1, part)]
            n += 1
    found = lines.bands(spark.createDataFrame(rows, "line long, text string"))
    met = found.selectExpr("band", "line div 2 as pair").groupBy("band", "pair").count().where("count > 1").select("pair").distinct().count()
    assert met >= 0.99 * n


def test_repeated_shingles_do_not_change_bands(spark):
    rows = [(0, "ha " * 9), (1, "ha " * 40), (2, "-" * 30), (3, "-" * 99)]
    got = defaultdict(set)
    for r in lines.bands(spark.createDataFrame(rows, "line long, text string")).collect():
        got[r.line].add(r.band)
    assert got[0] == got[1] and got[2] == got[3] and got[0] != got[2]


def test_crowded_bands_lose_no_pair(spark, make):
    rng = random.Random(4)
    stem = "".join(rng.choice("abcdefghijklmnop") for _ in range(120))
    tails = ["".join(rng.choice("qrstuvwxyz") for _ in range(90)) for _ in range(60)]
    texts = [stem + t for t in tails] + [stem + t[:-6] for t in tails[::2]]  # alike in the stem only, but for each second one's cut copy
    ids = spark.createDataFrame(list(enumerate(texts)), "line long, text string")
    tokens = lines.rarest(ids.select("line", F.col("line").alias("root")), ids)
    met = {(r.a, r.b) for r in lines._pairs(tokens, "token").collect()}
    sets = [shingle_set(t) for t in texts]
    alike = {(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert alike <= met and len(met) < 3 * len(alike)  # of 4005 pairs
    assert {(r.a, r.b) for r in lines.verified(spark.createDataFrame(sorted(met), "a long, b long"), ids).collect()} == alike
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = lines.deduplicated(make(rows)).where("kept").collect()
    assert Counter((False, r.doc_id, r.place) for r in got) == brute_lines(rows)


def test_alike_lines_are_not_paired_at_each_shared_shingle(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(60)], []
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(60), 2):
            own[at] = word()
        texts.append(" ".join(own))
    ids = spark.createDataFrame(list(enumerate(texts)), "line long, text string")
    tokens = lines.rarest(ids.select("line", F.col("line").alias("root")), ids)
    every = lines._meetings(tokens.drop("before"), "token")  # as it was
    few = lines._meetings(tokens, "token")
    assert set(every.collect()) == set(few.collect()) and few.count() < 0.3 * every.count()


def test_crowded_lines_are_joined_before_pairs_are_made(spark, monkeypatch):
    """What is left to be paired by rarest shingles does not grow with the square of a group of near copies."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(60)], []
    for k in range(150):
        own = list(base)
        for at in rng.sample(range(60), rng.choice([3, 4, 5])):
            own[at] = word()
        texts.append(" ".join(own))
    made, pairs = [], lines._pairs

    def counted(rows, key):
        found = pairs(rows, key)
        if key == "token":
            made.append(found.count())
        return found

    monkeypatch.setattr(lines, "_pairs", counted)
    monkeypatch.setattr(lines, "FEW", 8)
    monkeypatch.setattr(lines, "ROUNDS", 1)
    ids = spark.createDataFrame(list(enumerate(texts)), "line long, text string")
    got = {r.line: r.root for r in lines.like_lines(ids).collect()}
    sets = [shingle_set(t) for t in texts]
    alike = [(a, b) for b in range(150) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(150, alike)
    assert all(got.get(a) == got.get(b) for a, b in alike) and len(set(got.values())) == len({want[k] for k in got})
    assert len(made) == 1 and made[0] <= 30


def test_long_lines_that_repeat_themselves_have_all_bands(spark):
    rng = random.Random(2)
    part = "".join(rng.choice("abcdefghijklmnop ") for _ in range(60))
    rows = [(0, part * 40), (1, part * 90 + "q")]  # 60 and 70 distinct shingles, 2391 and 5392 in all
    found = lines.bands(spark.createDataFrame(rows, "line long, text string"))
    assert found.groupBy("band").count().where("count > 1").count() >= 3
    assert found.groupBy("line").count().where(f"count = {lines.BANDS}").count() == 2


def test_white_space_is_folded_line_by_line(spark):
    texts = ["  A  b\t\n \n\n\x0bC\f d \r\n e", "\n \n x \n", "Plain\nÉtÉ  ΟΔΟΣ\nΣ", " \t ", "a \n b", "", "\n", "a\u00a0 \u2003b\n\u3000"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", lines.folded(F.col("text")).alias("folded"))
    for r in rows.collect():
        assert r.folded.split("\n") == [re.sub(r"\s+", " ", t.lower(), flags=re.A).strip(" ") for t in texts[r.k].split("\n")]


def test_repeated_rows_and_documents_without_lines(spark, make, tmp_path):
    rows = [(1, "the same long line", "en", "s")] * 3 + [(2, "The same  long line\nanother one, quite other", "en", "s"), (3, None, "en", "s"), (4, " ", "en", "s")]
    rows += [(None, "x", "en", "s"), (None, "x", "en", "s"), (5, "other text one", "en", "s"), (5, "second text, other", "en", "s"), (6, "😀é日本 " * 9, "ja", "s")]
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_lines, r.n_kept) for r in lines.op6_fuzzy_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 1), 2: (2, 1), 3: (0, 0), 4: (0, 0), None: (2, 1), 5: (2, 2), 6: (1, 1)}
    long = "".join(random.Random(1).choice("abcdefghij ") for _ in range(200_000))
    kept = lines.deduplicated(make([(1, long, "en", "s"), (2, long[:-9000], "en", "s")])).where("kept").collect()
    assert [r.doc_id for r in kept] == [1]
