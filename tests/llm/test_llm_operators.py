"""Each operator against brute force on tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm.chat_format import assembled, chat_format
from lexmill.llm.components import components
from lexmill.llm.exact_dedup import exact_dedup
from lexmill.llm.hashing import shingle_sets
from lexmill.llm.line_dedup import line_dedup
from lexmill.llm.mixing import mix_sources
from lexmill.llm.ngram_join import Block, count_vector, folded, linked, ngram_join, prefixes
from lexmill.llm.quality import GRIDS, quality_rules
from lexmill.llm.queries import ORACLE_SQL, QUERIES
from lexmill.llm.shared import drop_written
from lexmill.llm.suffix_dedup import suffix_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, rid string, kept string, node int"


def made(n=60, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(n)]
    passage = " ".join(word() for _ in range(40))
    for i in range(0, n, 5):
        texts[i] = texts[i] + "\n" + passage + "\n" + texts[(i + 7) % n]
    for i in range(1, n, 6):
        words = texts[i - 1].split(" ")
        words[len(words) // 2] = "changed"
        texts[i] = " ".join(words)
    texts[10] = texts[20] = texts[30]
    texts += ["", "   \n ", "x", "Ünï " * 3, "long " * 5000 + "end", "long " * 5000 + "end!"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, texts[3]), (None, None), (500, None), (501, ""), (7, texts[7]), (7, texts[7])]
    return [(i, t, ["en", "de", None][k % 3], ["a", "b", None, "a"][k % 4], None, k, "r", "no", 1) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = made()
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs):
    frame, rows = docs
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = Counter((r.doc_id, r.text, r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame, first_digit=8, widen=4).collect())
    want = Counter()
    for r in rows:
        ids = groups[r[1] or ""]
        top = max((i for i in ids if i is not None), default=None)
        want[(r[0], r[1], top, len(ids), r[0] == top)] += 1
    assert got == want
    assert exact_dedup(empty(spark)).count() == 0
    assert {"hash", "rid", "node"} <= set(exact_dedup(frame).columns)


def base(text):
    words = WORD.findall(text)
    found = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    near = set()
    for i in range(len(words) - 4):
        if found[tuple(words[i : i + 5])] > 1:
            near.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(near)


def test_quality_rules(spark, docs):
    frame, rows = docs
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(None, 1), (900, 0)], "doc_id long, quality int")
    got = quality_rules(frame, labels).collect()
    assert Counter((r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter(
        (r[0], r[1], *base(r[1] or "")) for r in rows
    )
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert quality_rules(empty(spark), labels).count() == 0


def test_learned_cutoffs_respect_the_risk(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(3000):
        junk = i % 10 == 0
        words = ["w" + str(rng.randrange(10**6)) + ("$$$" if junk else "") for _ in range(12)]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 0 if junk else 1))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_rules(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r.kept == (r.doc_id % 10 != 0) for r in got)


def test_the_union_of_the_rules_keeps_to_the_risk(spark):
    """Six rules that each reject 0.8 percent of clean documents reject 4.8 together: none may be chosen at that level."""
    rng = random.Random(2)
    marks = {0: "$$$$", 1: "wow!!", 2: "ABCDE", 3: "12345"}
    rows = []
    for i in range(6000):
        words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(12)]
        if i % 125 < 4:  # four rules, other documents each
            words[:6] = [w + marks[i % 125] for w in words[:6]]
        rows.append((i, " ".join(words), "en"))
    rows += [(9000 + i, " ".join(["w$$$$$$$$" + str(rng.randrange(10**6)) for _ in range(12)]), "en") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("_lm_words", F.lit(7))
    clean = spark.createDataFrame([(i, 1) for i in range(6000)], "doc_id long, quality int")
    got = quality_rules(frame, clean).collect()
    assert sum(not r.kept for r in got if r.doc_id < 6000) <= 60  # 1 percent of 6000
    assert all(not r.kept for r in got if r.doc_id >= 9000)
    assert got[0]._lm_words == 7
    none = quality_rules(frame, clean.filter("false")).collect()
    assert all(r.kept != r.base_failed and not r.failed_rules for r in none)
    assert len({len(g) for g in GRIDS.values()}) == 1


def test_a_null_stratum_is_its_own(spark):
    rows = [(i, " ".join(f"v{i}x{k}" for k in range(12)) + ("".join(f" {i}0{k}123456" for k in range(12)) if i >= 2000 else ""), [None, "", "null"][i % 3]) for i in range(2010)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 2000) if i % 3], "doc_id long, quality int")
    got = quality_rules(frame, labels).collect()
    assert len(got) == 2010 and all(r.kept for r in got if r.lang is None)
    assert all(r.doc_id >= 2000 for r in got if not r.kept)


def test_mixing(spark, docs):
    frame, rows = docs
    mixed = mix_sources(frame).collect()
    counts = Counter((r.doc_id, r.text, r.copy_no) for r in mixed)
    repeats = Counter((r[0], r[1]) for r in rows)
    assert all(n <= repeats[k[:2]] for k, n in counts.items())
    again = Counter((r.doc_id, r.text, r.copy_no) for r in mix_sources(frame).collect())
    assert again == counts
    assert mix_sources(empty(spark)).count() == 0
    many = spark.range(20000).selectExpr("id as doc_id", "'t' as text", "if(id % 4 = 0, 'a', 'b') as source")
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, weight double")
    sizes = {r.source: r["count"] for r in mix_sources(many, weights).groupBy("source").count().collect()}
    assert abs(sizes["a"] - 10000) < 400 and abs(sizes["b"] - 10000) < 400


def test_mixing_counts_invert_the_poisson_distribution(spark):
    rows = [(i, "t", "tiny") for i in range(20)] + [(100 + i, "b" * 9999, "big") for i in range(20)] + [(200, "x", "mid"), (201, "y" * 60, None), (None, "z", "mid")]
    # Repeated sources add up; null, negative and NaN weights are 0.
    weights = [("tiny", 0.25), ("tiny", 0.25), ("big", 0.5), ("mid", None), ("mid", -3.0), (None, float("nan")), ("unknown", 0.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_lm_unit", F.lit("mine"))
    mixed = mix_sources(frame, spark.createDataFrame(weights, "source string, weight double")).collect()
    counts = Counter(r.doc_id for r in mixed)
    assert {r.source for r in mixed} == {"tiny", "big"} and all(r._lm_unit == "mine" for r in mixed)
    chars = sum(len(t) for _, t, _ in rows)
    rates = {"tiny": chars / 2 / 20, "big": chars / 2 / 199_980}
    assert rates["tiny"] > 4000
    for i, _, source in rows[:40]:
        u = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:13], 16) / 2**52
        rate, k, cdf = rates[source], 0, 0.0
        while (cdf := cdf + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))) <= u:
            k += 1
        assert abs(counts[i] - k) <= (source == "tiny")  # at rate 5000 the sums may differ in the last bits


def test_line_dedup(spark):
    rows = []
    for i in range(40):
        body = f"own line {i}\nCookie notice of all sites\nanother own line {i * 7}"
        rows.append((i, body, f"s{i % 20}"))
    copy = "first copied line\nsecond copied line\nthird copied line"
    rows += [(100 + i, copy, f"s{i % 20}") for i in range(40)]
    rows += [(200, None, "s1"), (201, "", None), (202, "\n\n", "s2")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in line_dedup(frame, around=24).collect()}
    plain = {r.doc_id: (r.text, r.n_lines, r.n_removed_lines) for r in line_dedup(frame).collect()}
    assert plain[110] == ("", 3, 3) and {i: x for i, x in plain.items() if i not in range(100, 140)} == {i: x for i, x in got.items() if i not in range(100, 140)}
    assert got[3] == ("own line 3\nanother own line 21", 3, 1)
    assert got[110] == (copy, 3, 0)  # lines that only travel with copies stay
    assert got[200] == (None, 0, 0) and got[201] == ("", 0, 0) and got[202] == ("\n\n", 0, 0)
    assert len(got) == len(rows)


def test_line_dedup_judges_blocks(spark):
    block = "Site map\nCookie notice\nAll rights reserved"
    rows = [(i, f"own opening {i}\n\n{block}", f"s{i % 20}") for i in range(40)]  # inside, after blanks, at the end
    rows += [(1000 + 100 * k + i, f"own opening {i}\n\n{block}", f"s{i % 20}") for i in range(40) for k in range(9)]  # crawled ten times
    rows += [(5000 + i, f"{i} unlike\nMirrored footer", "s1") for i in range(40)] + [(6000 + i, "0 unlike\nMirrored footer", f"s{i}") for i in range(20)]
    rows += [(None, "copy one\n \ncopy two", f"s{i % 20}") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup(frame.withColumns({"n_lines": F.lit("x"), "_lm_removed": F.lit(1)}), around=24).collect()
    assert len(got) == len(rows) and got[0]._lm_removed == 1
    own, rest = [r for r in got if r.doc_id is not None and r.doc_id < 5000], [r for r in got if r.doc_id is None or r.doc_id >= 5000]
    assert all((r.text, r.n_lines, r.n_removed_lines) == (f"own opening {r.doc_id % 100}\n", 4, 3) for r in own)
    assert all(r.n_removed_lines == 0 for r in rest)  # one site's footer in copies, and a copied text


def test_line_dedup_near_the_threshold_equals_its_sql(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for k in range(60):  # lines on 4 to 13 sites, many near the limit of 8
        sites = 4 + k % 10
        rows += [(1000 * k + i, f"{rng.random()}\nshared {k}\n \n{rng.random()}", f"s{i % sites}" if i % sites else None) for i in range(sites * 3)]
    rows += [(70_000 + i, None, "s1") for i in range(3)] + [(80_000 + i, "shared 5\nshared 6", f"s{i}") for i in range(12)] + [(90_000, "word " * 100_000, "s2")]
    frame = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op6_line_dedup"](spark, str(tmp_path))
    duckdb.sql(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(ORACLE_SQL["op6_line_dedup"])
    found = Counter(tuple(r[c] for c in want.columns) for r in got.collect())
    assert found == Counter(want.fetchall())
    removed = {r.doc_id // 1000 for r in got.collect() if r.n_removed_lines and r.doc_id < 60_000}
    assert removed == {k for k in range(60) if 4 + k % 10 >= 8}
    assert line_dedup(empty(spark)).count() == 0
    twice = frame.filter("doc_id < 10000").unionAll(frame.filter("doc_id < 10000")).withColumn("doc_id", F.lit(None).cast("long"))
    assert line_dedup(twice).count() == twice.count()
    assert drop_written(spark) > 0


CHAT = [
    (1, 0, "user", "Hello there. How does one wrap\nlong lines in a mail?\n\nSecond line"),
    (1, 1, "assistant", "Answer one"),
    (1, 2, "user", "> Answer  ONE\n>> hello there. how does\n>> one wrap long\n>> lines in a mail?\nI disagree"),
    (1, 3, "assistant", "> Second line\n>\n> never said\nok"),
    (1, 4, "user", "> How does one\n> wrap long lines in a mail?\n  > I disagree"),
    (2, 0, None, None),
    (2, 1, "user", "> later words"),
    (2, 2, "assistant", "later words"),
    (None, 5, "user", "> x"),
    (3, None, "user", "> y"),
    (1, 1, "assistant", "Answer one"),
    *[(4, t, "user", f"> turn {t - 1}\nturn {t}") for t in range(600)],
    *[(5, 7, "user", f"reused id {i}") for i in range(1500)],
    (6, 0, "user", "A first question."),
    (6, 1, "assistant", "Its answer."),
    (6, 2, "user", "Some more of it."),
    (6, 3, "user", "> A first question.\nand another answer"),
    (6, 4, "assistant", "> Some more of it.\nto the third"),
    (6, 5, "user", "goes on"),
    (6, 6, "user", "> and another answer\nto the fourth"),
    (6, 9, "user", "after a gap"),
    *[(7, t, "user", f"> said {t * 7 // 10}\nsaid {t}") for t in range(1600)],
]


def test_chat_format(spark):
    frame = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").repartition(3)
    rows = chat_format(frame).collect()
    got = {(r.conv_id, r.turn): r for r in rows}
    assert len(rows) == len(CHAT)
    assert got[1, 0].reply_to is None and got[1, 1].reply_to == 0
    r = got[1, 2]  # a quotation that was wrapped anew, two levels
    assert (r.reply_to, r.body, r.n_quoted, r.n_linked, r.max_quote_level) == (1, "I disagree", 2, 2, 2)
    assert (got[1, 3].reply_to, got[1, 3].n_quoted, got[1, 3].n_linked, got[1, 3].formatted) == (0, 2, 1, "<|assistant|>\nok")
    assert (got[1, 4].n_quoted, got[1, 4].n_linked, got[1, 4].reply_to) == (1, 1, 0)  # a sentence of it, wrapped anew
    assert got[2, 0].formatted == "<||>\n" and got[None, 5].reply_to is None and got[3, None].n_quoted == 0
    assert (got[2, 1].n_linked, got[2, 1].reply_to) == (0, 0)  # said later only
    assert all(got[4, t].reply_to == t - 1 and got[4, t].n_linked == 1 for t in range(1, 600))
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, body int, _lm_text string")
    assert chat_format(none).count() == 0 and "_lm_text" in chat_format(none).columns
    assert assembled(chat_format(none)).count() == 0


def test_conversations_equal_their_sql(spark, tmp_path):
    frame = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").repartition(3)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op5_chat_format"](spark, str(tmp_path))
    duckdb.sql(f"create or replace view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = duckdb.sql(ORACLE_SQL["op5_chat_format"])
    assert sorted(want.columns) == sorted(got.columns)
    rows = Counter(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows == Counter(want.fetchall())
    by_key = {r[:2]: r for r in want.fetchall()}
    assert by_key[4, 1][2] == 256 and by_key[4, 1][5].startswith("256>255 257>256")
    assert by_key[1, 0][6].startswith("<|user|>\nHello there.") and ">> hello" not in by_key[1, 0][6]
    assert sum(r[2] for r in want.fetchall() if r[0] == 5) == 1500 and len([r for r in want.fetchall() if r[0] == 5]) == 6
    # Chains first, then what branches off them, from the latest message back; a gap begins a thread of its own.
    assert by_key[6, 0][5] == "0>- 1>0 2>1 4>2 5>4 3>0 6>3 9>-"


def test_threads_put_replies_behind_what_they_answer(spark):
    """A walk through the replies against recursion, and every message behind its target however long the conversation."""
    frame = spark.createDataFrame([m for m in CHAT if m[0] in (6, 7)], "conv_id long, turn long, role string, text string")
    done = chat_format(frame)
    target = {(r.conv_id, r.turn): r.reply_to for r in done.collect()}
    children = {}
    for (conv, turn), to in sorted(target.items(), key=lambda x: x[0]):
        children.setdefault((conv, to), []).append(turn)
    for conv in (6, 7):
        walk, open_ = [], list(reversed(children[conv, None]))
        while open_:
            turn = open_.pop()
            walk.append(turn)
            open_.extend(reversed(children.get((conv, turn), [])))
        got = [r for r in assembled(done).orderBy("segment").collect() if r.conv_id == conv]
        assert [int(x.split(">")[0]) for r in got for x in r.replies.split()] == walk
    assert len(walk) == 1600 and walk != sorted(walk)


def shingles(text, width):
    words = WORD.findall(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (2, 60), (1, 40)])
def test_ngram_join(spark, docs, width, percent):
    frame, rows = docs
    sets = [shingles(r[1] or "", width) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    want = Counter()
    for i, r in enumerate(rows):
        ids = [x for x in members[find(i)] if x is not None]
        want[(r[0], r[1], len(sets[i]), min(ids) if ids and sets[i] else r[0])] += 1
    assert Counter((r.doc_id, r.text, r.n_shingles, r.component_id) for r in ngram_join(frame, width, percent).collect()) == want
    assert ngram_join(empty(spark)).count() == 0


def test_ngram_join_counts_every_link(spark, docs):
    frame, rows = docs
    words = [f"w{i}" for i in range(60)]
    dense = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(0, 60, 4)]  # each is linked with all others
    rows = [(r[0], r[1]) for r in rows] + [(2000 + i, t) for i, t in enumerate(dense)]
    sets = [shingles(t or "", 2) for _, t in rows]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 60 * len(a | b)
    want = Counter((r[0], r[1], sum(linked(a, b) for j, b in enumerate(sets) if i != j)) for i, (r, a) in enumerate(zip(rows, sets)))
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 2, 60, links=True)
    assert Counter((r.doc_id, r.text, r.n_links) for r in got.collect()) == want


def test_sets_that_link_share_the_needed_keys():
    rng = np.random.default_rng(5)
    some_linked = 0
    for percent in (30, 40, 50, 60, 80, 85, 100):
        for n in [*range(1, 12), *range(12, 40, 3), 90, 400]:
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            for change in range(1, n * (100 - percent) // 100 + 3):
                for more in {0, change // 2, change}:  # how many of the changed shingles are new ones
                    b = np.unique(np.concatenate([a[change - more :], rng.integers(0, 2**63, more, dtype=np.uint64)]))
                    if not len(b) or not linked(a, b, percent) or np.array_equal(a, b):
                        continue
                    some_linked += 1
                    key, owner, need = prefixes(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]), percent)
                    assert len(np.intersect1d(key[owner == 0], key[owner == 1])) >= need.max(), (percent, n, change, more)
    assert some_linked > 500


def test_blocks_find_every_link_and_prune():
    rng = np.random.default_rng(6)
    sets = []
    for _ in range(30):
        common = rng.integers(0, 2**63, 40, dtype=np.uint64)
        for _ in range(10):
            sets.append(np.unique(np.concatenate([common[: rng.integers(30, 41)], rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)])))
    truth = {(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j], 80)}
    whole = Block(80, True, True)
    for i, s in enumerate(sets):
        whole.add(i, i, False, len(s), s)
    whole.close()
    assert set(whole.found) == truth and len(truth) > 100
    assert whole.bounded < whole.pairs / 10
    halves = [Block(80, True, True), Block(80, True, True)]
    for i, s in enumerate(sets):
        halves[i % 2].add(i, i, False, len(s), s)
    for i, s in enumerate(sets):
        halves[1 - i % 2].visit(i, i, 1 - i % 2 > i % 2, len(s), s)
    assert {(max(p), min(p)) for h in halves for p in h.found} == truth
    points = Block(80, False)
    for i, s in enumerate(sets):
        points.add(i, i, False, len(s), count_vector(s))
    points.close()
    assert all(points.label[i] == points.label[j] for i, j in truth) and len(points.found) < len(sets)


def test_count_vectors_bound_the_overlap():
    rng = np.random.default_rng(7)
    for n in (3, 250, 300, 1000, 70_000, 600_000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], rng.integers(0, 2**63, n // 4, dtype=np.uint64)]))
        one, two = count_vector(a), count_vector(b)
        d = min(len(one), len(two))
        assert np.minimum(folded(one, d), folded(two, d)).sum() >= len(np.intersect1d(a, b))
        assert one.sum(dtype=np.int64) == n


def test_shingle_sets_match_words():
    texts = ["a b c d e", "", " A  b c d e\n", "a b", "b a", "a\x0bb c d e f"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    cuts = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    hashes, _, sizes = shingle_sets(data, cuts, 4)
    found = [frozenset(x.tolist()) for x in np.split(hashes, np.cumsum(sizes)[:-1])]
    assert [len(f) for f in found] == [2, 0, 2, 1, 1, 3]
    assert found[0] == found[2] and found[3] != found[4] and found[0] < found[5]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(5, 900), (900, 7), (7, 7), (8, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, 5: 5, 7: 5, 900: 5, 8: 8, 9: 8}


def test_suffix_dedup(spark, docs, monkeypatch):
    import lexmill.llm.suffix_dedup as module

    frame, rows = docs
    first = defaultdict(lambda: 2**63)
    order = lambda i: -(2**63) if i is None else i
    for r in rows:
        b = (r[1] or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first[b[p : p + 50]], order(r[0]))
    want = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < order(r[0]):
                gone[p : p + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[(r[0], len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    monkeypatch.setattr(module, "SHARD_BYTES", 10_000)
    monkeypatch.setattr(module, "BUCKET_BYTES", 20_000)
    got = suffix_dedup(frame).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.removed_spans), hashlib.sha256(r.kept_bytes).hexdigest()) for r in got) == want
    assert suffix_dedup(empty(spark)).count() == 0


def test_busy_keys_do_not_change_links(spark, docs, monkeypatch):
    from lexmill.llm import ngram_join as module

    frame, rows = docs
    plain = Counter(map(tuple, ngram_join(frame).select("doc_id", "n_shingles", "component_id").collect()))
    monkeypatch.setattr(module, "BUSY_LEAST", 1)
    monkeypatch.setattr(module, "BUSY_SHARE", 0.0)
    assert Counter(map(tuple, ngram_join(frame).select("doc_id", "n_shingles", "component_id").collect())) == plain
    monkeypatch.setattr(module, "BUSY_KEYS", 40)
    assert Counter(map(tuple, ngram_join(frame).select("doc_id", "n_shingles", "component_id").collect())) == plain


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_structured_texts_are_told_apart(spark):
    """Texts that differ in the order of the Thue-Morse sequence, which sums of powers modulo 2**64 take for equal."""
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    docs = spark.createDataFrame([(1, f"x y {one} z w"), (2, f"x y {two} z w")], "doc_id long, text string")
    got = ngram_join(docs, width=4, percent=20).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(r) for r in got} == {(1, 2, 1), (2, 2, 2)}
    letters = ["abcdefgh"[i : i + 2] for i in (0, 2, 4)]
    first = "".join(thue_morse(1024, *pair) for pair in letters)
    second = "".join(thue_morse(1024, *pair[::-1]) for pair in letters)
    shared = {first[i : i + 50] for i in range(len(first) - 49)}
    want = set()
    for i in range(len(second) - 49):
        if second[i : i + 50] in shared:
            want.update(range(i, i + 50))
    docs = spark.createDataFrame([(1, first), (2, second), (3, "ab" * 400), (4, "ba" * 100)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup(docs).collect()}
    assert got == {1: 0, 2: len(want), 3: 0, 4: 200}
