import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyroom.llm import orc_tokens, packing
from tallyroom.llm.tokens import Encoder, vocabulary_path
from tallyroom.workspace import new_folder


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    return lambda texts: [np.array(e.ids, "<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def coder():
    return Encoder(vocabulary_path(), known=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abZé1.,!<|> 　\x85\x1c日"), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_ids_are_the_librarys(coder, library, texts):
    ids, ends = coder.encode(pa.array([t.encode() for t in texts], pa.binary()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [x.tolist() for x in library(texts)]


def test_added_tokens_are_the_librarys(coder, library):
    texts = ["end <|endoftext|> of", "<|endoftext|>", "a<|endoftext|><|endoftext|>\nb c", "no <|endoftext |> here", "", "plain text"]
    ids, ends = coder.encode(pa.array([*[t.encode() for t in texts], None], pa.binary()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [x.tolist() for x in library(texts)] + [[]]
    assert 50256 in ids[: ends[1]]


def wanted(rows, library):
    out = defaultdict(list)
    for (i, *_), ids in zip(rows, library([t or "" for _, t, *_ in rows])):
        out[i].append(np.append(ids, 0).astype("<u4"))
    return out


def test_orc_round_trip(spark, stored, odd_rows, library, none):
    path = new_folder(spark, "ids")
    orc_tokens.write(stored, path, options={"orc.row.index.stride": "1000"})
    got = orc_tokens.digests(spark, path).orderBy("start").collect()
    by_id = wanted(odd_rows, library)
    assert [r.doc_id for r in got] == sorted((i for i, *_ in odd_rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    for r in got:
        assert r.ids_crc32 in {zlib.crc32(x.tobytes()) for x in by_id[r.doc_id]}
    assert sorted(x.ids for x in orc_tokens.read(spark, path).where("doc_id = 3").collect()) == [[0]]
    found = orc_tokens.look_up(spark, path, [6, 999])
    assert [r.doc_id for r in found.collect()] == [6]
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan
    empty = new_folder(spark, "ids")
    orc_tokens.write(none, empty)
    assert orc_tokens.digests(spark, empty).count() == 0


def test_files_hold_bloom_filters_and_indexes(spark, stored):
    path = new_folder(spark, "ids")
    orc_tokens.write(stored, path)
    jvm = spark._jvm
    file = [r.f for r in spark.read.orc(path).selectExpr("_metadata.file_path f").distinct().collect()][0]
    conf = spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0)) if hasattr(reader.rows(), "readStripeFooter") else None
    kinds = {str(footer.getStreams(k).getKind()) for k in range(footer.getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    assert "DIRECT_V2" in {str(footer.getColumns(k).getKind()) for k in range(footer.getColumnsCount())}


def test_packing(spark, stored, odd_rows, library, none):
    by_id = wanted(odd_rows, library)
    pieces = packing.pack(stored, together=4).collect()
    total, whole, sequences = defaultdict(int), defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = [x for x in by_id[p.doc_id] if len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32]
        assert ids
        whole[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for i, docs in by_id.items():
        assert sum(n for _, n in whole[i]) == sum(map(len, docs))
    for i in (i for i, docs in by_id.items() if len(docs) == 1):
        at = 0
        for start, length in sorted(whole[i]):
            assert start == at
            at += length
    assert packing.pack(none).count() == 0


def test_differencing_evens_out_and_windows_rise():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 257, 600).tolist()
    where = packing.windows(sizes, 1024)
    sums = np.bincount(where, sizes)
    assert sums.max() <= 1024 and sums.sum() / 1024 / len(sums) > 0.97
    assert sorted(packing.divide([8, 7, 6, 5, 4], 2)) == [0, 0, 0, 1, 1] or sum(packing.divide([8, 7, 6, 5, 4], 2)) in (2, 3)
    assert len(set(packing.windows([600, 600, 600], 1024))) == 3  # two windows would exceed the capacity
