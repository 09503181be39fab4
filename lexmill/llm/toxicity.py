"""Toxicity scores over deobfuscated text.

A noisy channel restores words written in leetspeak, with repeated letters or spaced out: each suspicious word
spans a lattice of readings, and a Viterbi search under a character trigram model of the whole corpus picks the
likeliest. A logistic model over restored words, learned from labelled rows, scores each document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import row_id, ship, whole_text, written

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
#: What a character of leetspeak may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Marks that may be put between letters, or in a letter's place.
FILLERS = " .-_*'~/\\,:;​­"
#: Channel costs in nats: a substitution, a deleted filler, a masked vowel, a repeated letter read once, read twice.
SUBSTITUTE, DELETE, MASK, ONCE, TWICE = 1.0, 0.5, 3.0, 0.5, 0.7
#: A mark that usually stands for a letter, deleted.
DROP = 5.0
#: A feature must be more frequent in toxic documents by so many standard errors.
SURE = 4.5

SIZE = len(LETTERS) + 1
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_EDGE = re.compile(r"^[^\w@$!|+(€£¡]+|[\W_]+$")
_PLAIN_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_TRIPLE = re.compile(r"(.)\1\1")
_RUN = re.compile(r"(.)\1+")
#: Three or more single characters divided by one space or mark each.
SPACED = re.compile(r"(?<!\S)\S(?:[ ._*-]\S){2,}(?!\S)")
#: Words a Python worker remembers; it forgets all beyond that.
REMEMBERED = 300_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def trigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of letter trigrams over all texts of a partition; anything but a letter is code 0."""
    codes = np.zeros(0x110000, np.uint8)
    for letter, i in CODE.items():
        codes[ord(letter)] = i
    counts = np.zeros(SIZE**3, np.int64)
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for text in batch.column(0):
            c = codes[code_points(f"\n\n{text.as_py().lower()}\n")].astype(np.int32)
            held.append((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:])
            size += len(c)
            if size > 1_000_000:
                counts += np.bincount(np.concatenate(held), minlength=SIZE**3)
                held, size = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=SIZE**3)
    seen = np.nonzero(counts)[0]
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["trigram", "n"])


def letter_model(docs: DataFrame, text_col: str) -> np.ndarray:
    """Log probabilities of a letter (or a word's end) after two, interpolated with shorter histories.

    All texts are counted; what reaches the driver is one row for each of at most ``SIZE ** 3`` trigrams.
    """
    rows = docs.select(whole_text(text_col).alias("text")).mapInArrow(trigram_counts, "trigram long, n long")
    found = rows.groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SIZE**3)
    counts[found["trigram"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    counts = counts.reshape(SIZE, SIZE, SIZE)
    counts[:, 0, :] = counts[:, 0, :].sum(axis=0)  # a word's first letter doesn't depend on the word before
    one = counts.sum(axis=(0, 1)) + 1
    one /= one.sum()
    two = counts.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    three = (counts + 5 * two[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return np.log(three)


class Restorer:
    """Viterbi decoding of obfuscated words."""

    def __init__(self, model: np.ndarray):
        self.model = model.reshape(-1).tolist()

    @staticmethod
    def readings(char: str, times: int) -> list[tuple[str, float]]:
        """What a run of one observed character may stand for, with the channel's cost."""
        if char in CODE:
            if times == 1:
                return [(char, 0.0)]
            kept = [(char * times, 0.0)] if times == 2 else []
            return [(char, ONCE), (char * 2, TWICE), *kept]
        found = [(letter * n, SUBSTITUTE * n) for letter in LEET.get(char, "") for n in {1, min(times, 2)}]
        if char in FILLERS or not found:
            found.append(("", DELETE))
        elif char in "!|+(":
            found.append(("", DROP))
        return found

    def decode(self, word: str, masked: bool = False) -> str:
        model = self.model
        # A state is the last two letters; it keeps its score and a chain of letters back to the start.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for char, run in groupby(word):
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            options = self.readings(char, sum(1 for _ in run))
            if masked and char == "*":
                options = [(vowel, MASK) for vowel in "aeiou"]
            for (a, b), (score, chain) in states.items():
                for letters, cost in options:
                    x, y, s = a, b, score - cost
                    for letter in letters:
                        code = CODE[letter]
                        s += model[(x * SIZE + y) * SIZE + code]
                        x, y = y, code
                    if (x, y) not in following or following[x, y][0] < s:
                        following[x, y] = s, (chain, letters)
            states = following
        _, _, chain = max((s + model[(a * SIZE + b) * SIZE], (a, b), chain) for (a, b), (s, chain) in states.items())
        read = []
        while chain is not None:
            chain, letters = chain
            read.append(letters)
        return "".join(reversed(read))

    def restore(self, token: str) -> tuple[str, ...]:
        """The readings of one lower-case token: its plain core, or what the channel restores."""
        core = _EDGE.sub("", token)
        if core.isalpha() and not _TRIPLE.search(core):
            return (core,)
        plain = _PLAIN_EDGE.sub("", token)
        letters = sum(c in CODE for c in core)
        if letters < 1 or len(core) < 3:
            return (plain,) if plain else ()
        found = {self.decode(core)}
        if "*" in core.strip("*"):  # a masked letter rather than a filler
            found.add(self.decode(core.strip("*"), masked=True))
        if plain and plain != core:
            found.add(plain if plain.isalpha() and not _TRIPLE.search(plain) else self.decode(plain))
        if token[-1:] in LEET and token[-2:-1] in CODE and token[-1] != "!":
            found.add(self.decode(_EDGE.sub("", token[:-1]) + token[-1]))
        return tuple(sorted(w for w in found if w))


def spaced_out(text: str) -> list[str]:
    """Runs of single characters, joined."""
    return [re.sub(r"[ ._*-]", "", m) for m in SPACED.findall(text)]


def collapsed(word: str) -> str:
    return _RUN.sub(r"\1", word)


def blurred(word: str) -> str:
    """What stays of a restored word when the channel's i and l, and repeats, cannot be told apart."""
    return collapsed(word.replace("l", "i"))


class Scorer:
    """The features of a text: which learned words it holds after restoration."""

    def __init__(self, model: np.ndarray, words: list[str]):
        self.restorer = Restorer(model)
        self.index = {w: i for i, w in enumerate(words)}
        self.loose = {collapsed(w): i for i, w in reversed(list(enumerate(words))) if len(w) > 3}
        self.blurred = {blurred(w): i for i, w in reversed(list(enumerate(words))) if len(w) > 3}
        self.long = [(w, i) for i, w in enumerate(words) if len(w) > 3]
        self.known: dict[str, tuple[int, ...]] = {}

    def features_of(self, token: str) -> tuple[int, ...]:
        found = set()
        for word in self.restorer.restore(token):
            i = self.index.get(word)
            if i is None and len(word) > 3:
                if word not in token:
                    i = self.blurred.get(blurred(word))
                elif _RUN.search(word):
                    i = self.loose.get(collapsed(word))
            if i is not None:
                found.add(i)
        return tuple(found)

    def features(self, text: str) -> set[int]:
        text = text.lower()
        known, found = self.known, set()
        if len(known) > REMEMBERED:
            known.clear()
        for token in set(text.split()):
            f = known.get(token)
            if f is None:
                f = self.features_of(token)
                if len(token) <= 64:
                    known[token] = f
            found.update(f)
        for joined in spaced_out(text):
            read = self.restorer.decode(joined)
            found.update(i for w, i in self.long if w in read)
        return found


def fit_logistic(rows: list[list[int]], y: np.ndarray, size: int, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Weights of a ridge-penalised logistic model over 0/1 features, bias last, by Newton steps."""
    x = np.zeros((len(rows), size + 1), np.float64)
    for r, found in enumerate(rows):
        x[r, found] = 1
    x[:, size] = 1
    w = np.zeros(size + 1)
    penalty = np.full(size + 1, ridge)
    penalty[size] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def remainder(id_col: str) -> Column:
    """crc32(id as text) mod 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 20_000,
    words: int = 300,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Learns from ``labels(doc_id, toxic)`` rows whose crc32 remainder is not 1: at most ``sample`` documents, the
    first in the order of a hash, and at most ``words`` features, words that toxic documents surely hold more
    often. Labels null or of unknown ids are ignored; of repeated labels the larger counts. Without labels of both
    kinds the score is the smoothed share of toxic labels everywhere. Null texts score as empty ones. Rows are
    scored independently, so repeats agree. An empty table gives an empty result; columns named like the results are
    replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("held_out", "score", "predicted")
    model = letter_model(docs, text_col)
    sent_model = spark.sparkContext.broadcast(model.astype(np.float32))

    @arrow_udf("array<string>")
    def restored_words(texts: pa.Array) -> pa.Array:
        restorer = Restorer(sent_model.value)
        found = []
        for t in texts:
            text = t.as_py().lower()
            read = {w for token in set(text.split()) for w in restorer.restore(token)}
            read.update(restorer.decode(joined) for joined in spaced_out(text))
            found.append(sorted(read))
        return pa.array(found, pa.list_(pa.string()))

    chosen = written(
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id") != 1))
        .groupBy(F.col("doc_id").cast("long").alias("rid"))
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("rid"), "rid")
        .limit(sample)
    )
    # At most ``sample`` rows of two numbers.
    held = docs.select(row_id(id_col).alias("rid"), whole_text(text_col).alias("text")).join(F.broadcast(chosen), "rid")
    read = written(held.select("rid", F.xxhash64("text").alias("hash"), "toxic", restored_words("text").alias("words")))
    # Of rows that repeat an id one is learned from, so the bound holds; combined before the shuffle.
    held = written(read.groupBy("rid").agg(F.max("toxic").alias("toxic"), F.min_by("words", "hash").alias("words")))
    classes = {r["toxic"]: r["count"] for r in held.groupBy("toxic").count().collect()}
    n1, n0 = classes.get(1, 0), sum(n for k, n in classes.items() if k != 1)
    least = max(3, n1 // 200)
    share = (F.col("n1") + F.col("n0") + 1.0) / (n1 + n0 + 2.0)
    # The two-proportion z statistic.
    surely = (F.col("n1") / F.lit(max(n1, 1.0)) - F.col("n0") / F.lit(max(n0, 1.0))) / F.sqrt(share * (1 - share) * (1.0 / max(n1, 1) + 1.0 / max(n0, 1)))
    counted = (
        held.select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("n0"))
        .filter((F.col("n1") + F.col("n0") >= least) & (F.length("word") > 1) & (surely >= SURE))
    )
    vocabulary = [r["word"] for r in counted.orderBy(surely.desc(), "word").limit(words).select("word").collect()] if n1 and n0 else []
    listed = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    rows = held.select("toxic", F.array_intersect("words", listed).alias("words")).collect() if vocabulary else []
    index = {w: i for i, w in enumerate(vocabulary)}
    if rows:
        y = np.array([float(r["toxic"] == 1) for r in rows])
        weights = fit_logistic([[index[w] for w in r["words"]] for r in rows], y, len(vocabulary))
    else:
        weights = np.array([np.log((n1 + 1) / (n0 + 1))])
    digest = hashlib.sha256(model.tobytes() + repr(vocabulary).encode() + weights.tobytes()).hexdigest()
    learned = spark.sparkContext.broadcast((digest, vocabulary, weights))

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        digest, words, w = learned.value
        scorer = _SCORERS.get(digest)
        if scorer is None:
            _SCORERS.clear()  # a worker keeps one model
            scorer = _SCORERS[digest] = Scorer(sent_model.value, words)
        bias = float(w[-1])
        return pa.array([float(1 / (1 + np.exp(-(bias + sum(w[i] for i in scorer.features(t.as_py())))))) for t in texts], pa.float64())

    return docs.withColumns({"held_out": remainder(id_col) == 1, "score": scored(whole_text(text_col))}).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)
    )


_SCORERS: dict[str, Scorer] = {}
