import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyroom.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def way(tree, k):
    """Siblings from the place k up, None where there is none, and whether they stand on the left."""
    for level in tree[:-1]:
        other = k ^ 1
        yield (level[other] if other < len(level) else None), k & 1
        k >>= 1


def brute(rows, hit):
    """Rows (doc_id, source, lang, n_chars, text) to (doc_id, leaf, subroot, root, proof, folded, verified)."""
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(((r[0] is not None, r[0] or 0), leaf(*r), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([h for _, h, _ in sorted(langs[g], key=lambda x: x[:2])]) for g in order}
    crown = levels([trees[g][-1][0] for g in order])
    root, out = crown[-1][0], []
    for at, g in enumerate(order):
        for k, (_, h, r) in enumerate(sorted(langs[g], key=lambda x: x[:2])):
            i, source, lang, n, text = r
            now = leaf(i, source, lang, n + 1, text) if hit(i) and n is not None else h
            proof = ""
            for s, left in [*way(trees[g], k), *way(crown, at)]:
                proof += s or ""
                now = sha(now) if s is None else sha(s, now) if left else sha(now, s)
            out.append((i, h, trees[g][-1][0], root, sha(proof), now, now == root))
    return out


def hit(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 0


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "h", "t") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, place int, hash string, tree string")
    got = merkle.verified(docs, merkle.tampered())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = [tuple(r) for r in got.collect()]
    assert sorted(found, key=key) == sorted(brute(rows, hit), key=key)
    return found


def test_manifest_against_brute_force(spark, odd_rows):
    rows = [(i, s, g, None if k % 11 == 0 else len(t or ""), t) for k, (i, t, g, s) in enumerate(odd_rows)]
    found = check(spark, rows)
    assert any(not r[-1] for r in found) and any(r[-1] for r in found)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_few_leaves(spark, n):
    check(spark, [(k, "s", "en", 3, "abc") for k in range(n)])


def test_several_rounds_one_hot_language_and_many_small_ones(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STRIDE", 2)
    monkeypatch.setattr(merkle, "SALTS", 3)
    rng = random.Random(1)
    rows = [(rng.randrange(10**6), f"s{k % 3}", "en" if k % 2 else rng.choice(["", "a", "é", "z", "日本", None, *map(str, range(20))]), k, "x" * (k % 5)) for k in range(300)]
    check(spark, rows + rows[:5])


def test_links_lead_to_the_root_and_upper_rows_are_salted(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STRIDE", 2)
    monkeypatch.setattr(merkle, "SALTS", 4)
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    manifest = merkle.build(docs)
    nodes = manifest.nodes.collect()
    ends = {(r.up_tree, r.up_round, r.up_place) for r in nodes} - {(r.tree, r.round, r.place) for r in nodes}
    assert ends == {(merkle.TOP, 1, 0)}
    below = defaultdict(int)
    for r in manifest.leaves.collect():
        below[(r.place >> 2) & 3] += 1
    assert {r.salt for r in nodes if r.up_tree == merkle.TOP} == set(below)  # every leaf finds a row of its salt


def test_no_rows(spark, none):
    assert merkle.verified(none, merkle.tampered()).count() == 0 and merkle.build(none).root is None


def test_the_session_keeps_its_limit(spark, make):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.verified(make([(1, "a", "en", "s")])).count()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
