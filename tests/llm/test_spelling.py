"""Spelling variants against brute force: random dictionaries, buckets dealt again to the last position, edge rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexmill.llm.queries import QUERIES
from lexmill.llm.spelling import WaveletTree, neighbours, spelling_groups

SCHEMA = "doc_id long, text string, word string, n long, form string, bucket int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(w, letters):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    return (out | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}) - {w}


def brute(rows, min_length=5, min_count=3, every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    letters = sorted(set("".join(counts)))
    out = {}
    for w, n in counts.items():
        found = [v for v in variants(w, letters) if v in counts]
        top = min(found, key=lambda v: (-counts[v], v), default=None)
        out[w] = [top if top and counts[top] >= 2 * n else None, None, n, len(found)]
    for w in out:
        last = w
        while out[last][0]:
            last = out[last][0]
        out[w][1] = last
    return {(w, f, r, n, k, counts[f] if f else None) for w, (f, r, n, k) in out.items()}


def result(df):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, n=40, letters="abé"):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(60)]
        words += ["Strasse", "Strase", "STRASSE", "Straßse", "straßse"] * rng.randint(0, 4)
        rows.append((i, " ".join(words), "x", 1, None, 2))
    rows.append((92, "grundlage " * 3 + "grundlagen " * 9 + "grundlagens " * 20, "x", 1, None, 2))
    long = "ab" * 3000
    rows += [(90, f"{long} {long}x " * 4, "x", 1, None, 2), (None, None, None, None, None, None), (None, "Wörter, wörter; wörtern! " * 5, "", 0, "", 0)]
    return rows + [rows[0], rows[0], (91, "", "", 0, "", 0)]


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.permutation(n)
        tree = WaveletTree(values)
        box = np.sort(rng.integers(0, n + 1, (50, 2)), axis=1), np.sort(rng.integers(0, n + 1, (50, 2)), axis=1)
        query, value = tree.report(box[0][:, 0], box[0][:, 1], box[1][:, 0], box[1][:, 1])
        want = {(q, v) for q in range(50) for v in values[box[0][q, 0] : box[0][q, 1]] if box[1][q, 0] <= v < box[1][q, 1]}
        assert set(zip(query.tolist(), value.tolist())) == {(q, int(v)) for q, v in want} and len(query) == len(want)


def test_neighbours_once_each():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.randint(2, 6)
        words = sorted({"".join(rng.choice("ab") for _ in range(length - rng.randint(0, 1))).encode() for _ in range(rng.randint(1, 25))})
        query, found = neighbours(np.zeros(len(words), int), words, length, 0, length)
        got = list(zip(query.tolist(), found.tolist()))
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if len(b) == length and near(a.decode(), b.decode())}


@pytest.mark.parametrize("limit", [1, 60, 1 << 18])
def test_spelling_groups(spark, limit):
    rows = made(limit)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = result(spelling_groups(docs, limit=limit))
    assert got == brute([r[:2] for r in rows])
    assert any(r[1] and r[1] != r[2] for r in got)  # some chain has more than one step


def test_no_rows_and_no_words(spark):
    docs = spark.createDataFrame(made(1)[:3], SCHEMA)
    assert spelling_groups(docs.limit(0)).count() == 0
    assert spelling_groups(docs.selectExpr("doc_id", "cast(null as string) text")).count() == 0
    with pytest.raises(ValueError):
        spelling_groups(docs, ratio=1)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(QUERIES["op12_spelling"](spark, sf)) == brute(rows)
