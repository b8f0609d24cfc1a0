"""Words and merges against the public tokenizer, text by text."""

import base64
import random

import numpy as np
import pyarrow as pa
import pytest

tiktoken = pytest.importorskip("tiktoken")
tables = pytest.importorskip("public_tokenizers")

from seriesmill.llm import encode, merges, pretokens  # noqa: E402


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tables.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=tables.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    w, n = pretokens.words(pa.array(texts, pa.string()))
    ids, offsets = merges.replay(w, merges.load("byte_bpe_50k"))
    ends = np.concatenate(([0], np.cumsum(n)))
    return [ids[offsets[a] : offsets[b]].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


EDGES = ["", " ", "  ", "\n\n a", "a  b", "a \n b", "don't we'll they've I'm you're 'tis 's's", "'", "''s", " 's", "x.'s", "!'s", "a'S", "　a", "\xa0 a", "a​b", "é́", "中文 12٣4", "🔒🔒", "<|endoftext|>", "\r\n\t", "a" * 5000, " " * 3000 + "b", "1" * 999, "\u0000\u0001", "ﬁled​"]


def test_edges(public):
    assert encoded(EDGES) == [public.encode_ordinary(t) for t in EDGES]


def test_random(public):
    rng = random.Random(4)
    alphabets = ["aB1 \n\t\r'.sdtmrevl'’é中\xa0　 '", "абв гд. «»12", "".join(map(chr, range(32, 1200)))]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(700)]
    assert encoded(texts) == [public.encode_ordinary(t) for t in texts]


def test_every_assigned_character(public):
    """One text of each character between two letters: the classes agree with the public pattern."""
    import unicodedata

    texts = [f"a{c}b {c}1" for c in map(chr, range(0x30000)) if unicodedata.category(c) not in ("Cn", "Cs")]
    got = encoded(texts)
    wrong = [t for t, g in zip(texts, got, strict=True) if g != public.encode_ordinary(t)]
    assert len(wrong) == 0, wrong[:20]


def test_slices_and_pieces():
    texts = pa.array(["xx", "a b", "", "c" * 100, "d"])
    part = texts.slice(1, 3)
    assert [p for p in pretokens.pieces(part, 10)] == [(0, 2), (2, 3)]
    w, n = pretokens.words(part)
    assert w.to_pylist() == ["a", " b", "c" * 100] and n.tolist() == [2, 0, 1]
    assert pretokens.words(pa.array([], pa.string()))[0].to_pylist() == []


@pytest.mark.parametrize("most", [0, 40, 1 << 17])
def test_operator(spark, public, most):
    """The same ids whatever is in the head; nulls, empty texts, repeated keys and extra columns of clashing names."""
    from pyspark.sql import functions as F

    rng = random.Random(1)
    vocabulary = ["the", "court", "of", "Müller's", "42", "--", "кодекс", "裁判"]
    texts = [None, "", " ", "x" * 100000, *[" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(60)]]
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumns({"key": F.lit(1), "ids": F.lit(2), "out": F.lit(3)})
    rows = encode.encode(df, most=most).collect()
    want = sorted((i % 50, public.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert sorted((r.doc_id, r.ids) for r in rows) == want
    assert sorted((r.doc_id, r.tokens) for r in encode.token_counts(df, most=most).collect()) == sorted((k, len(v)) for k, v in want)


def test_head_keeps_its_bound(spark):
    rows = spark.range(1000).selectExpr("concat('w', id) word", "id + 1 n")
    for most in (1, 100, 500, 5000):
        got = [r.n for r in encode.head(rows, most).collect()]
        assert len(got) <= most and (not got or min(got) > 1)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode.encode(df).count() == 0


@pytest.mark.parametrize("most", [3, 1 << 16])
def test_tail_is_remembered(public, monkeypatch, most):
    """Words outside the head come out alike whether a task has met them before or not."""
    monkeypatch.setattr(encode, "MEMO_WORDS", most)
    e = encode.Encoder(pa.array(["the"]), np.array([7], np.int32), np.array([0, 1]), "byte_bpe_50k", merges.TOKENIZERS)
    for texts in (["one two the", "zwölf", ""], ["two  three two", "zwölf one"], ["the"], ["four two " + "x" * 5000]):
        ids, n = e(pa.array(texts))
        ends = np.concatenate(([0], np.cumsum(n)))
        got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert got == [[7] if t == "the" else public.encode_ordinary(t) for t in texts]
