"""Problem 8: encoding."""

import random

import pytest
import tiktoken

from quarrystone.llm.bpe import PATTERN, Encoder, encode_texts, load_ranks, pair_table
from quarrystone.llm.text_queries import VOCABULARY


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(VOCABULARY)


def _texts():
    rng = random.Random(0)
    wild = ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 300))) for _ in range(300)]
    return [*wild, None, "", " ", "a" * 5000, "ab" * 3000, "aaa", "<|endoftext|> x", " \n\n\t ", "é" * 700, "漢字" * 400, "\x00\x01", "it's we'll I'd", "0" * 600, "=-" * 800]


def test_same_ids_as_the_public_library(ranks):
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = _texts()
    ids, counts = Encoder(pair_table(ranks), PATTERN).encode(texts)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == (known.encode_ordinary(text) if text else []), text
        at += n


def test_round_trip_and_edges(spark, ranks):
    texts = _texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    back = {v: k for k, v in ranks.items()}
    out = {r["doc_id"]: r["ids"] for r in encode_texts(df, "doc_id", "text", VOCABULARY).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert b"".join(back[x] for x in out[i]).decode() == (t or "")
    assert encode_texts(df.where("false"), "doc_id", "text", VOCABULARY).count() == 0


def test_ids_beyond_16_bits():
    """A vocabulary of more than 65,536 ids: pairs whose halves would share a 16-bit key stay apart."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xy": 65_536 + 97, b"abc": 70_000, b"xyb": 70_001}
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["abc", "xyb", "xyabc ab", "abxyb", "cab" * 300]
    ids, counts = Encoder(pair_table(ranks), PATTERN).encode(texts)
    assert ids.tolist() == [i for t in texts for i in known.encode_ordinary(t)] and counts.sum() == len(ids)
