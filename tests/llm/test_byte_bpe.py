"""The distributed encoder against the tokenizer library, text by text."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
import public_tokenizers
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tallymill.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string, `a.b` int, word string, chunk long"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    letters = "abcdefgäöüßñéабв東京١٢३'.,!? \n\t  0123456789  ́😀"
    rows = [
        (1, None), (2, ""), (3, " "), (4, "   leading and trailing   "), (5, "it's we'll THEY'RE don't 'd"), (6, "x" * 30_000),
        (7, "the " * 5_000), (8, "\n\n\n\r\n  \t a b"), (9, "<|endoftext|> is text"), (10, "naïve 東京 100% ½ ² Ⅷ"), (None, "no id"),
        (11, "꟎\U00016ea0 new ࢏ letters1₏"), (1, "an id again"), (12, "same"), (12, "same"), (13, "\0null\x1c\x85"),
    ]
    rows += [(100 + i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 400)))) for i in range(150)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1, "w", 9) for k, t in texts], SCHEMA)


def expected(library, texts):
    out = []
    for doc_id, text in texts:
        ids = library.encode_ordinary(text or "")
        listed = " ".join(map(str, ids)).encode()
        out.append((doc_id, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_every_character_is_split_as_the_library_does():
    ranks = {bytes([i]): i for i in range(256)} | {bytes([i >> 8, i & 255]): 256 + i for i in range(65536)}
    pairs = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = byte_bpe.whole_word_encoding(ranks)
    split = byte_bpe.Splitter(PATTERN)
    usual = regex.compile(PATTERN)
    points = [i for i in [*range(0x3000), *range(0xA000, 0xB000), *range(0xE000, 0x20000, 3)] if not 0xD800 <= i < 0xE000]
    differing = 0
    for c in map(chr, points):
        text = f"a{c}b1{c}2!{c}? {c}a  {c}{c}x's {c}"
        found = split(text)
        assert [i for w in found for i in words.encode_ordinary(w)] == pairs.encode_ordinary(text), hex(ord(c))
        differing += found != usual.findall(text)
    assert "".join(found) == text and differing < len(points)


@pytest.mark.parametrize("head", [0, 7, byte_bpe.HEAD])
def test_digests(docs, library, texts, head, monkeypatch):
    # chunks of few texts, so that words meet in several, and batches of few ids
    monkeypatch.setattr(byte_bpe, "CHUNK", 3_000)
    monkeypatch.setattr(byte_bpe, "OUT", 1_000)
    tables = byte_bpe.digests(docs, RANKS, PATTERN) if head == byte_bpe.HEAD else None
    if tables is not None:
        assert got(tables) == expected(library, texts)
    ids = byte_bpe.encode(docs.repartition(3, "doc_id"), RANKS, PATTERN, head)
    assert got(ids) == sorted(((k, library.encode_ordinary(t or "")) for k, t in texts), key=repr)


def test_round_trip(docs, texts):
    decoded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, PATTERN), RANKS)
    assert decoded.columns == ["doc_id", "ids", "decoded"]
    assert sorted(bytes(r.decoded) for r in decoded.collect()) == sorted((t or "").encode() for _, t in texts)


def test_decoding_of_no_ids(spark):
    lists = spark.createDataFrame([(1, None), (2, []), (3, [0, 50255])], "doc_id long, ids array<int>")
    table = {r: t for t, r in byte_bpe.read_ranks(RANKS).items()}
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(lists, RANKS).collect()} == {1: b"", 2: b"", 3: table[0] + table[50255]}


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    out = byte_bpe.digests(empty, RANKS, PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_rows_that_change_between_readings_are_noticed(spark):
    moving = spark.range(200).select(F.col("id").alias("doc_id"), F.udf(lambda i: f"w{time.time_ns()}")("id").alias("text"))
    with pytest.raises(PythonException, match="read again"):
        byte_bpe.encode(moving, RANKS, PATTERN).collect()


def test_each_rare_word_is_encoded_once(docs):
    plan = byte_bpe.encode(docs, RANKS, PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(word") == 1


def test_a_chunk_takes_the_numbers_of_the_head_at_once():
    head = {"a": 0, "b": 1}
    numbers = byte_bpe._Numbers(head)
    # the words of the head cost no call; new ones go on from there, each once
    assert [dict.get(numbers, w) for w in "ab"] == [0, 1]
    assert [numbers[w] for w in ["b", "y", "a", "x", "y"]] == [1, 2, 0, 3, 2]
    assert list(numbers)[len(head):] == ["y", "x"] and head == {"a": 0, "b": 1}


def test_words_are_encoded_in_their_order(library):
    encoding = byte_bpe.whole_word_encoding(byte_bpe.read_ranks(RANKS))
    words = [" same", "東京", "x" * 300, " same", "", "\n\n"]
    for kind in ("<u2", "<u4"):
        found = byte_bpe._encode_words(pa.array(words, pa.string()), encoding, kind).to_pylist()
        assert [np.frombuffer(i, kind).tolist() for i in found] == [library.encode_ordinary(w) for w in words]
        assert len(byte_bpe._encode_words(pa.array([], pa.string()), encoding, kind)) == 0
