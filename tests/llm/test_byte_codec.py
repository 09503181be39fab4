"""Byte-level BPE against the tiktoken library: odd texts, long runs, all Unicode classes, the operator on edge rows."""

import hashlib
import random

import numpy as np
import pytest

from lexmill.llm import byte_codec as module
from lexmill.llm.byte_codec import ByteCodec, byte_codec, class_differences, read_ranks
from lexmill.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return ByteCodec(read_ranks(f.read()), P.PATTERN, class_differences())


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_equals_library(codec):
    rng = random.Random(1)
    odd = "abcs'tr e  \n\té😀中ß1²_#٣\x00\x1c\x85　​\U000323e7\U00018da7 "
    texts = ["", " ", "'s", "it's  fine\n\n", "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 4000 + "x", "中文" * 900]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(rng.choice("aeinrstlo") for _ in range(rng.randrange(1, 60))) for _ in range(1000)]
    for text, (ids, decoded) in zip(texts, codec.code(texts)):
        assert ids_of(ids) == codec.library.encode_ordinary(text)
        assert decoded == text.encode()


def test_splits_every_character_as_the_library_does(codec):
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    for low in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}a1{chr(c)}1#{chr(c)}# {chr(c)} " for c in points[low : low + 4096])
        assert [i for u in codec.cut(text) for i in codec.library.encode_ordinary(u)] == codec.library.encode_ordinary(text)


def test_windows_and_backtracking_equal_merges():
    """A small vocabulary in which greedy longest matches fail, over windows of a few bytes."""
    rng = random.Random(5)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 300:
            left, right = rng.choice([b"a", b"b", b"c", *list(ranks)[256:]]), rng.choice([b"a", b"b", b"c", *list(ranks)[256:]])
            ranks.setdefault(left + right, len(ranks))
        codec = ByteCodec(ranks, r".+", check=False)
        held, module.WINDOW = module.WINDOW, 7
        try:
            for _ in range(40):
                data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 50)))
                parts = [data[i : i + 1] for i in range(len(data))]
                while data not in ranks and len(parts) > 1:
                    rank, at = min((ranks.get(x + y, 1 << 40), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                    if rank == 1 << 40:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                assert codec.encode_unit(data) == ([ranks[data]] if data in ranks else [ranks[p] for p in parts])
        finally:
            module.WINDOW = held


def test_operator(spark, codec):
    rows = [(1, "It's 42 Öfen", "x", "own"), (1, "It's 42 Öfen", "x", "own"), (None, None, None, None), (2, "", "", ""), (3, "z" * 20000, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, _lm_coded string")
    got = byte_codec(docs, RANKS, P.PATTERN).collect()
    assert sorted(((r.doc_id, r.text, r._lm_coded) for r in got), key=repr) == sorted(((r[0], r[1], r[3]) for r in rows), key=repr)
    for r in got:
        assert ids_of(r.token_ids) == codec.library.encode_ordinary(r.text or "")
        assert r.decoded == (r.text or "").encode()
    assert byte_codec(docs.limit(0), RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        ByteCodec({b"a": 0}, P.PATTERN)


def test_query_equals_library(spark, codec):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_byte_codec"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = codec.library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(codec.library.decode_bytes(ids)).hexdigest()
