import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tallyroom.llm import phrases


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang, _ in rows:
        g = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(w)
            f.update((g, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    best = {}
    for (g, w), a in f.items():
        if len(w) > 1 and a >= least:
            cuts = [(2_000_000 * a // (f[g, w[:k]] + f[g, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            best[g, w] = (score, a, f[g, w[:k]], f[g, w[k:]])
    drop = {(g, w[i : i + k]) for (g, w), (_, a, _, _) in best.items() for k in range(2, len(w)) for i in range(len(w) - k + 1)
            if 100 * a >= 80 * f[g, w[i : i + k]]}
    out = []
    for g in n:
        mine = sorted((-s, -a, " ".join(w).encode(), l, r) for (h, w), (s, a, l, r) in best.items() if h == g and (g, w) not in drop)
        out += [(g, k + 1, p.decode(), -a, l, r, n[g], -s) for k, (s, a, p, l, r) in enumerate(mine[:top])]
    return sorted(out)


def found(df, least, top):
    return sorted(tuple(r) for r in phrases.collocations(df, least=least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["a", "b", "c", "é", "日本", "x\x00y", "don't", "A", "-"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "\v"]) for _ in range(n))
    return [(k, text(rng.randint(0, 80)), rng.choice(["en", "de", None, "und", "a\tb", ""]), "s") for k in range(150)]


@pytest.mark.parametrize("least, top", [(2, 10_000), (5, 7)])
def test_collocations_against_brute_force(make, rows, odd_rows, least, top):
    every = rows + odd_rows
    assert found(make(every), least, top) == brute(every, least, top)


def test_chunks_and_segments_change_nothing(make, rows, monkeypatch):
    long = [(9000, " ".join(t or "" for _, t, _, _ in rows), "en", "s"), (9001, "word " * 500, "en", "s"), (9002, "q" * 900 + " r", "en", "s")]
    want = brute(rows + long, 3, 50)
    for chunk, segment in ((50, 10), (1000, 200)):
        monkeypatch.setattr(phrases, "CHUNK", chunk)
        monkeypatch.setattr(phrases, "SEGMENT", segment)
        tables = []
        for _, text, of, _ in rows + long:
            c = phrases._Chunk(frozenset([b"a", b"word"]))
            for b in [*c.add(("und" if of is None else of).encode(), (text or "").encode().translate(phrases._FOLD)), *c.counted()]:
                for word, rest in zip(b.column("word").to_pylist(), b.column("rest").to_pylist()):
                    w1, lang = word.split(b"\t", 1)
                    for line in rest.split(b"\n"):
                        head, *entries = line.split(b",")
                        w2, total = head.split(b" ")
                        entries = [e.split(b" ") for e in entries]
                        tables += [(lang.decode(), w1, w2, w3, w4, int(n[0]) if n else 1) for w3, w4, *n in entries]
                        assert int(total) == sum(int(n[0]) if n else 1 for _, _, *n in entries)
        counted = Counter()
        for lang, *w, n in tables:
            words = [x for x in w if x]
            for k in range(1, len(words) + 1):
                counted[lang, " ".join(x.decode() for x in words[:k])] += n
        for lang, _, phrase, a, *_ in want:
            assert counted[lang, phrase] == a


def test_products_beyond_64_bits(spark):
    row = spark.range(1).select(phrases.F.expr("cast(2000000 as decimal(19,0)) * cast(9000000000000000000 as decimal(19,0)) div (cast(9000000000000000000 as decimal(19,0)) + cast(9000000000000000000 as decimal(19,0)))")).first()
    assert row[0] == 1_000_000


def test_no_rows(none, make):
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(make([(1, None, "en", "s"), (2, "a b a b", None, "s")])).count() == 0


@pytest.mark.parametrize("held", [0, 300])
def test_words_too_large_to_hold_are_counted_alike(make, rows, monkeypatch, held):
    monkeypatch.setattr(phrases, "HELD", held)
    c, out = phrases._Chunk(frozenset([b"b"])), Counter()
    for _, text, of, _ in rows:
        sent = [*c.add(("und" if of is None else of).encode(), lower(text).encode()), *c.counted()]
        assert len(sent) < 2
        out.update({(w, s, n, r): 1 for b in sent for w, s, n, r in zip(*(b.column(k).to_pylist() for k in b.schema.names))})
    ordered = sorted(out.elements())
    batch = pa.RecordBatch.from_pylist([dict(zip(("word", "salt", "n", "rest"), r)) for r in ordered])
    f = Counter()
    for b in phrases._merged(iter([batch, batch.slice(0, 0)]), 5):
        for word, *rest, n in zip(*(b.column(k).to_pylist() for k in b.schema.names)):
            w = [word.split(b"\t")[0], *[x for x in rest if x]]
            f.update({(word.split(b"\t", 1)[1].decode(), b" ".join(w[:k]).decode()): n for k in range(1, len(w) + 1)})
    want = brute(rows, 5, 10**6)
    assert want and all(f[g, p] == a for g, _, p, a, *_ in want)


def test_windows_move_once_by_their_first_word(make, rows):
    plan = phrases.windows(make(rows), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(word") == 2  # the lines, and what is left of them
