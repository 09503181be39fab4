"""Collocations against brute force: small bucket counts (every bucket shared), languages, pieces, covered phrases, ties."""

import random
import re
from collections import Counter

import pytest

from lexmill.llm.collocations import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, bucket int"


def brute(rows, least, percent, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, " ".join(words[i : i + k])] += 1
    out = {}
    frequent = {key: a for key, a in f.items() if a >= least and " " in key[1]}
    covered = {}
    for (lang, phrase), a in frequent.items():
        words = phrase.split(" ")
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                key = lang, " ".join(words[i : i + k])
                covered[key] = max(covered.get(key, 0), a)
    for (lang, phrase), a in frequent.items():
        words = phrase.split(" ")
        cuts = []
        for k in range(1, len(words)):
            l, r = f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]
            cuts.append((2000000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        if 100 * covered.get((lang, phrase), 0) < percent * a:
            out.setdefault(lang, []).append((-score, -a, phrase.encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)}


def made(seed):
    rng = random.Random(seed)
    words = ["the", "The", "new", "york", "stock", "exchange", "of", "Ähre", "ähre", "a", "\x00b", "c\x85d", "e f"]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            parts.append(rng.choice(["new york stock exchange", "new york", "of the", rng.choice(words), rng.choice(words)]))
            parts.append(rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r\n", "!", "?x ", "\x0b"]))
        rows.append((i, "".join(parts), rng.choice(["en", "en", "de", None, ""]), "p", 1, 2))
    return rows + [(None, None, None, None, None, None), (500, "", "en", "", 0, 0), (501, " ".join(["so it goes"] * 3000), "xx", "", 0, 0), rows[0], rows[0]]


@pytest.mark.parametrize("least,percent,top,bits", [(5, 80, 2000, 24), (3, 60, 7, 5), (30, 80, 2000, 10), (300, 100, 3, 8)])
def test_collocations(spark, least, percent, top, bits):
    rows = made(least)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in collocations(docs, least=least, percent=percent, top=top, bits=bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    want = brute([(r[1], r[2]) for r in rows], least, percent, top)
    assert len(got) == len(set(got)) and set(got) == want and want


def test_small_blocks_and_forgotten_words(spark, monkeypatch):
    from lexmill.llm import collocations as module

    rows = made(9)
    whole = module.Pass(1, 5, 12, [], None)
    monkeypatch.setattr(module, "BLOCK_WORDS", 40)
    monkeypatch.setattr(module, "TASK_WORDS", 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in rows], "text": [r[1] or "" for r in rows]})
    counts = Counter()
    for out in whole.rows([batch]):
        for row in out.to_pylist():
            if row["phrase"] is not None:
                counts[row["lang"], row["phrase"]] += row["n"]
    plain = Counter()
    for r in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")):
            plain.update((r[2] or "und", w) for w in re.findall("[^\x20\x09]+", piece))
    assert counts == plain


def test_no_rows(spark):
    docs = spark.createDataFrame(made(1), SCHEMA)
    assert collocations(docs.limit(0), bits=8).count() == 0
    assert collocations(docs.selectExpr("cast(null as string) text", "lang"), bits=8).count() == 0


def test_counts_past_64_bits(spark):
    """The score's product is exact where it passes 64 bits."""
    row = spark.range(1).selectExpr("cast(9000000000000000000 as bigint) n", "cast(9000000000000000000 as bigint) l", "cast(9000000000000000001 as bigint) r")
    text = "(cast(n as decimal(19, 0)) * 2000000) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))"
    assert row.selectExpr(f"{text} as s").collect()[0].s == 2000000 * 9000000000000000000 // 18000000000000000001
