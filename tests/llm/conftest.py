import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, row int, hash string, part string, n int, kept string, "
          "size string, rest string, line string, band string, fp string, n_words string, score string")


def build(spark, rows):
    extra = (1, "h", "p", 2, "k", "s", "r", "l", "b", "f", "w", "z")
    return spark.createDataFrame([(i, t, g, s, len(t or ""), *extra) for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source), with columns whose names operators use themselves."""
    return lambda rows: build(spark, rows)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, white space, scripts without spaces."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    long = " ".join(word() for _ in range(30_000))
    base = " ".join(word() for _ in range(120))
    rows = [(0, "Hello World foo", "en", "s1"), (1, "hello world FOO", "en", "s1"), (2, None, None, None), (3, "", "de", "s2"),
            (None, "orphan text", "en", "s1"), (4, long, "en", "s2"), (5, "  \n\n x\t y ", "en", "s2"), (1, "hello world FOO", "en", "s1"),
            (6, "日本語のテキスト、空白なし。" * 4, "ja", "s3"), (7, "don't  stop\n> me <|endoftext|> now", "en", "s3"), (8, base, "en", "s1"),
            (9, base.replace(" ", "  "), "en", "s1"), (10, base + " tail", "en", None), (11, "É à ê\nÉ à ê\n", "fr", "s4")]
    return rows + [(100 + i, " ".join(word() for _ in range(rng.randint(1, 60))), rng.choice(["en", "de"]), f"s{rng.randint(1, 6)}") for i in range(80)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return build(spark, odd_rows)


@pytest.fixture(scope="session")
def stored(spark, odd, tmp_path_factory):
    """The same as a table, which is read alike each time."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    odd.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return build(spark, [(0, "x", "en", "s")]).where("doc_id = 1")
