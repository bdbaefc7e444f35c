import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import EDGE, LONG, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexmill.llm import packing, token_output
from codexmill.llm.tokens import PieceEncoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def own(coder, texts):
    ids, counts = coder.encode(pa.array(texts, pa.string()), 7)
    stops = np.cumsum(counts)
    assert len(ids) == counts.sum() and all(ids[k - 1] == 7 for k in stops)
    return [ids[k - n : k - 1].tolist() for k, n in zip(stops, counts, strict=True)]


PARTS = st.one_of(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'s!12aéñБ中x́  \x1c"), st.characters(codec="utf-8")), max_size=60), st.sampled_from(["<|endoftext|>", "<|endof", "wörds", "\n", " "]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=4).map("".join), min_size=1, max_size=4))
def test_pieces_give_the_library_s_ids(plain, texts):
    assert own(encoder(PATH), texts) == plain(texts)


SPECIAL = ["<|endoftext|>", "a b<|endoftext|> c", "<|endoftext|><|endoftext|>", "a <|endoftext|>", "<|endoftext|>\nA b", "x\n<|endoftext|> \n<|endoftext|>y."]
SHAPES = ["a b c, d.\ne f's 'll don't", "", " ", "\n", "a  b\n\nc", "é" * 300 + " y", "Ünïcode, wörds. \x1c z", "a\nB, c.\nÜb", LONG[:2000], "中文 Б, в.\nГ", *SPECIAL]


def test_known_shapes_in_small_runs(plain, monkeypatch):
    monkeypatch.setattr("codexmill.llm.tokens.GATHER_PIECES", 3)
    assert own(PieceEncoder(PATH), SHAPES) == plain(SHAPES)
    assert own(PieceEncoder(PATH), []) == [] and own(PieceEncoder(PATH), [None]) == [[]]


def test_special_tokens_are_the_library_s(spark, plain, tmp_path):
    assert all(50256 in x for x in plain(SPECIAL))
    docs = documents(spark, SPECIAL)
    token_output.write(docs, str(tmp_path / "ids"), PATH, end_id=2)
    assert [list(r.ids)[:-1] for r in token_output.read(spark, str(tmp_path / "ids")).orderBy("doc_id").collect()] == plain(SPECIAL)
    packed = packing.pack(docs, PATH, end_id=1).orderBy("doc_id", "start").collect()
    assert [[i for r in packed if r.doc_id == k for i in r.ids][:-1] for k in range(len(SPECIAL))] == plain(SPECIAL)


def test_buckets_hold_one_length_each(spark, tmp_path):
    path = str(tmp_path / "buckets")
    packing.write_buckets(packing.pack(documents(spark, EDGE), PATH, end_id=1), path)
    for n in (1, 2, 2048):
        rows = packing.read_bucket(spark, path, n).collect()
        assert rows and all(len(r.ids) == n == r.length for r in rows)


def expected(rows, plain, end):
    return sorted(((i, ids + [end]) for (i, _), ids in zip(rows, plain([t or "" for _, t in rows]), strict=True)), key=lambda x: (x[0] is not None, x[0] or 0))


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def test_orc_round_trip(spark, plain, tmp_path):
    docs = documents(spark, EDGE)
    path = str(tmp_path / "ids")
    token_output.write(docs, path, PATH, end_id=2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    back = token_output.read(spark, path).orderBy("part", "pos").collect()
    assert [(r.doc_id, sorted([tuple(r.ids)])) for r in back if r.doc_id != 5] == [(i, [tuple(x)]) for i, x in expected(rows, plain, 2) if i != 5]
    assert [r.doc_id for r in back] == [i for i, _ in expected(rows, plain, 2)]
    at, want = 0, []
    for r in back:
        want.append((r.doc_id, at, len(r.ids), crc(r.ids)))
        at += len(r.ids)
    got = [tuple(r) for r in token_output.index(spark, path).orderBy("start").collect()]
    assert got == want
    assert sorted(len(r.ids) for r in token_output.lookup(spark, path, 5).collect()) == sorted(len(x) for i, x in expected(rows, plain, 2) if i == 5)


def test_orc_lookup_reaches_the_files(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_output.write(documents(spark, ["a b", "c"]), path, PATH, end_id=2)
    plan = token_output.lookup(spark, path, 1)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,1)]" in plan


def test_empty_tables(spark, tmp_path):
    none = documents(spark, ["x"]).where("false")
    token_output.write(none, str(tmp_path / "none"), PATH, end_id=2)
    assert token_output.index(spark, str(tmp_path / "none")).count() == 0
    assert packing.pack(none, PATH, end_id=1).count() == 0


def test_packing(spark, plain):
    docs = documents(spark, EDGE)
    rows = packing.pack(docs, PATH, end_id=1, largest=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    assert all(r.length == 1 << r.bucket and r.length <= 64 and len(r.ids) == r.length and crc(r.ids) == r.ids_crc32 for r in rows)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((i is None, i or 0, x) for i, x in expected(texts, plain, 1))
    docs_of = {}
    for r in sorted(rows, key=lambda r: r.sequence_id):
        if r.start == 0:
            docs_of[r.sequence_id] = last = (r.doc_id, [])
        assert r.start == len(last[1])
        last[1].extend(r.ids)
    assert sorted((i is None, i or 0, x) for i, x in docs_of.values()) == want


@given(st.lists(st.integers(1, 20_000), max_size=6))
def test_decomposition(counts):
    rows, starts, sizes = packing.decompose(np.array(counts, np.int64), 2048)
    for k, n in enumerate(counts):
        lengths, at = sizes[rows == k].tolist(), starts[rows == k].tolist()
        assert sum(lengths) == n and all(x & (x - 1) == 0 for x in lengths) and lengths == sorted(lengths, reverse=True)
        assert at == [sum(lengths[:i]) for i in range(len(lengths))]
        small = [x for x in lengths if x < 2048]
        assert len(set(small)) == len(small)


def test_ids_are_unsigned(spark):
    assert packing.pack(documents(spark, ["x"]), PATH, 1, with_ids=False).where(F.col("ids_crc32") < 0).count() == 0
