import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm import bpe

ODD = [" ", "  a", "a  ", "\n\n x\n \n y", "a b", "　 a", " \x1cb", "a \x85b", "<|endoftext|> <s>", "x" * 20_000, " " * 5_000, "don't DON'T 'll ''s", "a\r\n b\t c", "ñandú 12 34,5", "\x00 \x01 a", "é ​ x", "日本語 テキスト", "😀👍🏽 ok", "a\n b\n\n c ", "1234567890 " * 300]


@pytest.fixture(scope="module")
def tools():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return bpe.Encoder(bpe.load_ranks()), t


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(tools, text):
    mine, other = tools
    assert mine.encode(text) == other.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text_and_back(tools, text):
    mine, other = tools
    ids = mine.encode(text)
    assert ids == other.encode(text, add_special_tokens=False).ids
    assert bpe.decode(ids, {v: k for k, v in mine.ranks.items()}) == text


def test_caches_start_anew(tools, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    e = bpe.Encoder(tools[0].ranks)
    text = " ".join(f"w{i}x q{i} tail" for i in range(50))
    assert e.encode(text) == tools[1].encode(text, add_special_tokens=False).ids and len(e.later) <= 3


def test_frame(spark, tools):
    rows = [(1, None), (2, ""), (3, " "), (4, "hello world"), (4, "hello world"), (None, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id or 0, r.ids) for r in bpe.encode_texts(df, "doc_id", "text").collect()), key=str)
    want = sorted(((i or 0, tools[1].encode(t, add_special_tokens=False).ids if t else []) for i, t in rows), key=str)
    assert got == want
    n = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df.drop("ids"), "text").collect()}
    assert n[1] == n[2] == 0 and n[4] == 2
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").count() == 0
