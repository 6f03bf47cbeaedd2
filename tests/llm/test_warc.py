import base64
import glob
import hashlib
import random
from collections import Counter, defaultdict

import pytest
import zstandard

from tallyroom.llm import warc

SCHEMA = "page_id bigint, url string, html string, key string, size string, payload int, copy string, best string, n int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "k", "s", 1, "c", "b", 2) for r in rows], SCHEMA)


def rank(i):
    return (i is not None, i or 0)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    page = lambda n: "<html><p>" + " ".join(word() for _ in range(n)) + "</p></html>"
    hot = page(40)
    rows = [(1, "http://a.example/", "x"), (2, "http://b.example/ü b\r\nX: y", "x"), (3, None, None), (4, "http://c/", ""), (None, "http://d/", "x"),
            (None, None, "lone"), (5, "http://e/", "é日本\r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://f/", page(60_000)), (7, "http://g/", "two"), (7, "http://g/", "two"),
            (7, "http://other/", "two"), (7, "http://g/", "three"), (8, "http://h/", "a\x00b")]
    rows += [(100 + k, f"http://h{k % 7}.example/{k}", hot) for k in range(150)]
    return rows + [(1000 + k, f"http://i.example/{k}", page(rng.randint(1, 200))) for k in range(200)]


def expected(rows, least=0):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    want = Counter()
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        best = max(ids, key=rank)
        stays = ids.index(best)
        for k, i in enumerate(ids):
            again = k != stays and len(payload) >= least
            want[(i, len(payload), digest, "revisit" if again else "response", best if again else None)] += 1
    return want


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, rows, tmp_path, least):
    folder = str(tmp_path / "warc")
    warc.write_archives(pages_of(spark, rows).repartition(3), folder, least=least, most=20_000)
    got = warc.read_archives(spark, folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows, least)
    payloads = {r.record_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert len({r.record_id for r in got}) == len(got)
    stored = {r.record_id: r.page_id for r in got}
    for r in got:
        if r.record_type == "revisit":
            assert r.payload is None and stored[r.refers_to_id] == r.refers_to
            assert base64.b32encode(hashlib.sha1(payloads[r.refers_to_id]).digest()).decode() == r.payload_digest
    assert Counter(payloads.values()) == Counter({p: 1 for p in {(h or "").encode() for _, _, h in rows} if len(p) >= least}) + Counter((h or "").encode() for _, _, h in rows if len((h or "").encode()) < least)


def test_files_are_frames_that_any_reader_opens(spark, rows, tmp_path):
    folder = str(tmp_path / "warc")
    dictionary = warc.write_archives(pages_of(spark, rows), folder, most=20_000)
    files = [p for p in glob.glob(f"{folder}/part-*")]
    assert dictionary and len(files) > 3
    for path in files:
        raw = open(path, "rb").read()
        if not raw:
            continue
        assert raw.startswith(warc.dictionary_frame(dictionary))
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).stream_reader(raw, read_across_frames=True).read()
        assert plain == b"".join(warc.frames(raw)) and plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")


def test_addresses_cannot_add_fields():
    raw = warc.record("response", "urn:x", 1, "http://b.example/ü b\r\nX: y", warc.bare_digest(b""), 0)
    assert b"\r\nX: y" not in raw and warc.parsed(raw)[3] == "http://b.example/%C3%BC%20b%0D%0AX:%20y"


def test_damage_is_an_error():
    raw = warc.record("response", "urn:x", 1, None, warc.bare_digest(b"abc"), 3, b"abc")
    assert warc.parsed(raw)[-1] == b"abc"
    for bad in (raw.replace(b"abc\r\n", b"abd\r\n"), raw[:-2], raw + b"x"):
        with pytest.raises(ValueError):
            warc.parsed(bad)
    archive = next(warc.archives(iter([raw, raw]), b""))
    assert list(warc.frames(archive)) == [raw, raw]
    with pytest.raises(ValueError):
        list(warc.frames(archive[:-3]))


def test_few_and_no_pages(spark, tmp_path):
    few = pages_of(spark, [(1, "http://a/", "x"), (2, "http://b/", None)])
    assert warc.write_archives(few, str(tmp_path / "few")) == b""
    assert warc.read_archives(spark, str(tmp_path / "few")).count() == 2
    warc.write_archives(few.where("page_id = 9"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
