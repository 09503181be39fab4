"""Tokenizers and the toxicity model: library comparisons, round trips and held-out accuracy."""

import itertools
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm.piece_codec import PieceCodec, piece_codec, unpack
from lexmill.llm.token_count import LongestMatch, token_count, word_pieces
from lexmill.llm.toxicity import CODE, SIZE, Restorer, letter_model, toxicity

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


def odd_texts(n=300):
    rng = random.Random(2)
    letters = "abth ▁  \n\té😀<s>0x中\x00ß"
    texts = ["", " ", "  ", " a", "a ", "a  b", "▁", "▁▁ x", "<s> </s> <unk>", "\x00", "a" * 500, "中文" * 300]
    return texts + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 100))) for _ in range(n)]


def test_codec_equals_library():
    codec = PieceCodec(open(MODEL, "rb").read())
    texts = odd_texts()
    for text, (ids, decoded) in zip(texts, codec.code(texts)):
        theirs = codec.library.encode(text, add_bos=True, add_eos=True)
        assert list(unpack(ids)) == theirs
        assert decoded == codec.library.decode(theirs)


def test_codec_agendas_agree():
    codec = PieceCodec(open(MODEL, "rb").read(), check=False)
    units = ["▁" + w for w in "the internationalisation of Straßenbahnen aaaaaaaa élan".split()] * 20
    assert [list(unpack(x)) for x in codec.encode_units(units)] == [codec.encode_unit(u) for u in units]


def test_codec_operator(spark):
    rows = [(i, t, "c") for i, t in enumerate([*odd_texts(20), None])]
    got = piece_codec(spark.createDataFrame(rows, "doc_id long, text string, decoded string"), MODEL).collect()
    assert len(got) == len(rows)
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in got)
    assert [r for r in got if r.text is None][0].token_ids == struct.pack("<2I", 1, 2)
    assert piece_codec(spark.createDataFrame([], "text string"), MODEL).count() == 0


def test_token_count_equals_greedy_word_piece(spark):
    models = pytest.importorskip("tokenizers.models")
    initial, continuing = word_pieces(MODEL)
    vocabulary = {}
    for p in initial:
        vocabulary.setdefault(p.decode(), len(vocabulary))
    for p in continuing:
        vocabulary.setdefault("##" + p.decode(), len(vocabulary))
    vocabulary.setdefault("[UNK]", len(vocabulary))
    greedy = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**9)
    texts = odd_texts()
    words, tokens = LongestMatch(initial, continuing).count_texts(pa.array(texts, pa.string()))
    for text, w, n in zip(texts, words, tokens):
        found = re.findall("[^\x20\x09-\x0d]+", text)
        assert (w, n) == (len(found), sum(len(greedy.tokenize(x)) for x in found))
    rows = spark.createDataFrame([(1, None, 3), (2, "", 4), (2, "", 4), (3, "word " * 4000, 5)], "doc_id long, text string, n_words long")
    got = sorted((r.doc_id, r.n_words) for r in token_count(rows, initial, continuing).collect())
    assert got == [(1, 0), (2, 0), (2, 0), (3, 4000)]


def corpus(n=600):
    rng = random.Random(4)
    plain = "house river garden letter morning window mountain paper answer station".split()
    bad = "idiot moron clown".split()
    hidden = {"idiot": ["1d10t", "i d i o t", "idiooot", "i.d.i.o.t"], "moron": ["m0r0n", "mor0n", "m o r o n"], "clown": ["c1own", "clooown"]}
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            w = rng.choice(bad)
            words[rng.randrange(30)] = rng.choice(hidden[w]) if i % 12 == 0 else w
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows + [(9001, None), (9002, ""), (None, "idiot")], labels


def test_toxicity_held_out(spark):
    rows, labels = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(frame, marks).collect()}
    truth = dict(labels)
    held = [r for i, r in got.items() if r.held_out and i in truth]
    assert len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert 0 <= got[9001].score < 0.7 and got[9001].score == got[9002].score
    none = toxicity(frame, marks.filter("false")).collect()
    assert len(none) == len(rows) and len({r.score for r in none}) == 1


def test_restorer(spark):
    rows, _ = corpus()
    restorer = Restorer(letter_model(spark.createDataFrame(rows, "doc_id long, text string"), "text"))
    for written, meant in [("1d10t", "idiot"), ("m0r0n", "moron"), ("idiooot", "idiot"), ("c1own", "clown"), ("id*ot", "idiot")]:
        assert meant in restorer.restore(written)


def test_viterbi_equals_enumeration(spark):
    """The best reading of short words, out of all readings of the lattice scored one by one."""
    rows, _ = corpus()
    restorer = Restorer(letter_model(spark.createDataFrame(rows, "doc_id long, text string"), "text"))

    def score(letters, cost):
        a = b = 0
        total = -cost
        for c in [*(CODE[x] for x in letters), 0]:
            total += restorer.model[(a * SIZE + b) * SIZE + c]
            a, b = b, c
        return total

    rng = random.Random(9)
    words = ["1d10t", "m0r0n", "i.d.i.o.t", "cl0wn", "aabb", "a@@b"] + ["".join(rng.choice("aio10@.$l") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    for word in words:
        lattice = [restorer.readings(c, len(list(run))) for c, run in itertools.groupby(word)]
        paths = [("".join(x for x, _ in path), sum(c for _, c in path)) for path in itertools.product(*lattice)]
        best = max(score(*p) for p in paths)
        found = restorer.decode(word)
        assert any(text == found and abs(score(text, cost) - best) < 1e-9 for text, cost in paths), word


def test_toxicity_edges(spark):
    rows, labels = corpus(300)
    schema = "doc_id long, text string"
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    frame = spark.createDataFrame(rows + rows + [(7, "word " * 50_000)], schema).withColumns({"score": F.lit("mine"), "toxic": F.lit(1)})
    got = toxicity(frame, marks, sample=100).collect()
    assert len(got) == 2 * len(rows) + 1 and all(0 <= r.score <= 1 for r in got)
    assert len({(r.doc_id, r.text, r.score) for r in got}) == len(set(rows)) + 1
    assert toxicity(spark.createDataFrame([], schema), marks).count() == 0


def test_token_count_of_an_empty_table(spark):
    initial, continuing = word_pieces(MODEL)
    assert token_count(spark.createDataFrame([], "text string, n_words int"), initial, continuing).count() == 0
