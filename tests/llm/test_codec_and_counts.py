"""Encoding, decoding and counting against the libraries, on odd and planted texts."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm.common import read, tokenizer_path
from docloom.llm.sentencepiece_codec import ChunkTable, codec, decode, encode
from docloom.llm.token_counts import CountTable, merges, token_count

PIECES, BYTES = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "\n\n x\n", "▁", "a▁b", "\x00a", "<s>x</s> <0x0A>", "日本 テキスト　x 😀👍🏽", "\t a\r\n b;\r\n", "a" * 4000, "ab" * 2000, "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "it's we'll", "\x1c x\x85y\xa0z", "aaa aaaa aaaaa"]


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def random_texts(n):
    rnd = random.Random(3)
    return ["".join(rnd.choice("ab ▁\n\t\r <>|é日😀'\x001.") for _ in range(rnd.randint(0, 50))) for _ in range(n)]


def test_chunks_encode_as_the_library(pieces):
    texts = ODD + random_texts(2000)
    ids, counts = ChunkTable(codec(PIECES)).look_up(texts)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        own = ids[at : at + n].tolist()
        at += n
        assert own == pieces.encode(text)
        assert codec(PIECES).decode(own) == pieces.decode(own)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_the_library(text):
    import sentencepiece

    ids, _ = ChunkTable(codec(PIECES)).look_up([text])
    assert ids.tolist() == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(3, 31999), max_size=20))
def test_any_ids_decode_as_the_library(ids):
    import sentencepiece

    assert codec(PIECES).decode(ids) == sentencepiece.SentencePieceProcessor(model_file=PIECES).decode(ids)


def test_counts_as_the_library(tokenizer):
    texts = ODD + random_texts(2000)
    assert CountTable(merges(BYTES)).counts(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_full_table_starts_anew(monkeypatch, pieces):
    from docloom.llm import sentencepiece_codec, token_counts

    monkeypatch.setattr(sentencepiece_codec, "TABLE_SIZE", 2)
    monkeypatch.setattr(token_counts, "TABLE_SIZE", 2)
    table, counts = ChunkTable(codec(PIECES)), CountTable(merges(BYTES))
    for text in ("one two three", "four five six", "one two"):
        assert table.look_up([text])[0].tolist() == pieces.encode(text)
        assert counts.counts([text])[0] > 0


def test_columns_of_the_whole_table(spark, small, pieces, tokenizer):
    docs = read(spark, small, "documents").select("doc_id", "text", F.lit(1).alias("ids"))
    rows = docs.select("text", encode(F.col("text"), PIECES).alias("e"), token_count(F.col("text"), BYTES).alias("n")).withColumn("d", decode(F.col("e"), PIECES)).collect()
    assert [list(r.e) for r in rows] == pieces.encode([r.text for r in rows])
    assert [r.d for r in rows] == [r.text for r in rows]
    assert [r.n for r in rows] == [len(e.ids) for e in tokenizer.encode_batch([r.text for r in rows], add_special_tokens=False)]


def test_null_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a")], "doc_id long, text string")
    rows = docs.select(encode(F.col("text"), PIECES).alias("e"), token_count(F.col("text"), BYTES).alias("n")).withColumn("d", decode(F.col("e"), PIECES)).collect()
    assert [(len(r.e), r.n, r.d) for r in rows][:2] == [(0, 0, ""), (0, 0, "")]
    assert docs.filter("false").select(encode(F.col("text"), PIECES)).count() == 0


def test_query_digests(spark, small, pieces):
    from docloom.llm.queries import op1_sentencepiece

    texts = dict(read(spark, small, "documents").select("doc_id", "text").collect())
    for r in op1_sentencepiece(spark, small).collect():
        ids = pieces.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()


def test_round_trip_is_both(spark, small):
    from docloom.llm.sentencepiece_codec import round_trip

    docs = read(spark, small, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    one = docs.select("doc_id", round_trip(F.col("text"), PIECES).alias("t")).select("doc_id", "t.ids", "t.decoded")
    two = docs.select("doc_id", encode(F.col("text"), PIECES).alias("ids")).withColumn("decoded", decode(F.col("ids"), PIECES))
    assert one.exceptAll(two).count() == 0 and one.count() == docs.count()
