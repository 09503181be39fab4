"""Phrases of two to four words that occur together more often than their parts, by hashed passes over the texts.

Pass k counts phrases of k words exactly, and in the same pass counts phrases of k + 1 words into hash buckets. Two
bitmaps of fixed size are broadcast to the next pass: the buckets that reached the least count, and the hashes of
the phrases of k words that did. A phrase of k + 1 words is only counted if its bucket is set (PCY/DHP) and both its
parts of k words are (Apriori). Neither loses a frequent phrase: a bucket counts at least what each of its phrases
counts, and a hash that meets another only lets one phrase more be counted. Counts themselves are by the phrases' words.

From the second pass on, a pass also hands on the texts trimmed to the runs of words that can still hold a longer
candidate, and the next pass reads only these.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import mix
from .shared import ship, whole_text, written

LONGEST = 4
#: Buckets of a pass and bits of each broadcast bitmap (2**24 bits are 2 MB, whatever the input).
BUCKET_BITS = 24
#: Words that are counted at a time, and distinct words a task holds; they are forgotten beyond that, none is dropped.
BLOCK_WORDS, TASK_WORDS = 1 << 19, 400_000
#: Parts of a language that are ranked apart before its first phrases are.
RANK_PARTS = 64
#: Ends a piece; no byte of UTF-8.
BREAK = b"\xff"
#: A-Z to lower case, ends of pieces to BREAK; what is left to split at are space and tab.
TABLE = bytes(b + 32 if 65 <= b <= 90 else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
FACTORS = mix(np.arange(1, LONGEST + 1, dtype=np.uint64)) | np.uint64(1)
#: Buckets that are sent as one row: places (2 bytes) and counts of those that are not empty.
ROW_BITS = 12
#: Tasks whose rows of a block of buckets are added up together.
MERGED = 512
COUNTED = "lang string, phrase string, n long, part int, block int, buckets binary, text string"


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang + BREAK + word)


class Words(dict):
    """Numbers of one language's words as they are met; 0 ends a piece, as words do that are known to be rare."""

    def __init__(self, lang: str, held: Vocabulary):
        super().__init__({BREAK: 0})
        self.lang, self.code, self.held, self.known = lang, lang.encode(), held, held.known

    def __missing__(self, word: bytes) -> int:
        code = word_hash(self.code, word)
        if self.known is not None and not self.known(code):
            self[word] = 0
            return 0
        held = self.held
        number = self[word] = len(held.words)
        held.words.append(word)
        held.langs.append(self.lang)
        held.hashes.append(code)
        return number


class Vocabulary:
    """Words of a task by number, each of one language, with 64-bit hashes that are the same in every task.

    ``known`` says of a word's hash whether the word may be frequent; without it every word is.
    """

    def __init__(self, known: Callable[[int], int] | None = None):
        self.known = known
        self.by_lang: dict[str, Words] = {}
        self.words, self.langs, self.hashes = [BREAK], [""], [0]
        self.array = np.zeros(0, np.uint64)

    def size(self) -> int:
        return sum(map(len, self.by_lang.values()))

    def hash_array(self) -> np.ndarray:
        if len(self.hashes) > len(self.array):
            self.array = np.concatenate([self.array, np.array(self.hashes[len(self.array) :], np.uint64)])
        return self.array

    def numbers(self, lang: str, text: str) -> list[int]:
        """The words of a text, with 0 at each end of a piece and of the text."""
        words = self.by_lang.get(lang)
        if words is None:
            words = self.by_lang[lang] = Words(lang, self)
        tokens = text.encode().translate(TABLE).replace(BREAK, b" \xff ").split()
        tokens.append(BREAK)
        return list(map(words.__getitem__, tokens))


def bit_at(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def hashed(word: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the phrases of ``size`` words that start at the places ``at`` of the words' hashes."""
    if size == 1:
        return word[at]
    total = np.full(len(at), size, np.uint64)
    for k in range(size):
        total += word[at + k] * FACTORS[k]
    return mix(total)


class Pass:
    """Counts phrases of ``size`` words, and buckets of those with one more, of successive blocks of numbered words.

    ``frequent`` has a bitmap of the frequent words and, from the third pass, one of the frequent phrases of one word less;
    ``buckets`` is the bitmap of the buckets of this size.
    """

    def __init__(self, size: int, least: int, bits: int, frequent: list[np.ndarray], buckets: np.ndarray | None):
        self.size, self.least, self.bits, self.frequent, self.buckets = size, least, bits, frequent, buckets
        self.vocabulary = self.fresh()
        self.tally = np.zeros(1 << bits, np.min_scalar_type(least)) if size < LONGEST else None

    def fresh(self) -> Vocabulary:
        if self.size == 1:
            return Vocabulary()
        words, shift = self.frequent[0].tobytes(), 64 - self.bits
        return Vocabulary(lambda code: words[code >> shift + 3] >> (code >> shift & 7) & 1)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def count(self, numbers: np.ndarray) -> tuple[list[str], pa.Array, np.ndarray, dict[str, str]]:
        """(languages, phrases, counts, trimmed text by language) of one block; its buckets are added to the tally."""
        word = self.vocabulary.hash_array()[numbers]
        size = self.size
        whole = np.nonzero(numbers)[0]  # where words start that may be counted
        for k in range(1, size):
            if k == size - 1 and size > 2:  # of the phrases with one word less only the frequent ones
                whole = whole[bit_at(self.frequent[1], self.place(hashed(word, k, whole)))]
            # Two phrases of k words that follow each other make one of k + 1.
            whole = whole[:-1][np.diff(whole) == 1]
        if size > 1:
            whole = whole[bit_at(self.buckets, self.place(hashed(word, size, whole)))]
        trimmed: dict[str, str] = {}
        if self.tally is not None and len(whole):
            longer = whole[:-1][np.diff(whole) == 1]
            if size > 1:
                trimmed = self.trimmed(numbers, longer)
            if len(longer):
                at, times = np.unique(self.place(hashed(word, size + 1, longer)), return_counts=True)
                self.tally[at] = np.minimum(self.tally[at] + times, self.least)  # more than enough is enough
        # Phrases are told apart by their words' numbers: a pair of (number of the first words, next word) at a time.
        code = numbers[whole]
        for k in range(1, size):
            code = np.unique(code << 32 | numbers[whole + k], return_inverse=True)[1].reshape(-1)
        _, first, times = np.unique(code, return_index=True, return_counts=True)
        start = whole[first]
        words, langs = self.vocabulary.words, self.vocabulary.langs
        found = [langs[i] for i in numbers[start].tolist()]
        if size == 1:
            return found, pa.array([words[i] for i in numbers[start].tolist()], pa.binary()).cast(pa.string()), times, trimmed
        held = pa.array(words, pa.binary())
        parts = [held.take(pa.array(numbers[start + k])) for k in range(size)]
        return found, pc.binary_join_element_wise(*parts, pa.scalar(b" ")).cast(pa.string()), times, trimmed

    def trimmed(self, numbers: np.ndarray, longer: np.ndarray) -> dict[str, str]:
        """For each language the runs of words that phrases of one word more cover, a line each."""
        edge = np.zeros(len(numbers) + self.size + 2, np.int32)
        np.add.at(edge, longer, 1)
        np.add.at(edge, longer + self.size + 1, -1)
        inside = np.cumsum(edge[: len(numbers)]) > 0
        first = np.nonzero(inside & ~np.concatenate([[False], inside[:-1]]))[0]
        if not len(first):
            return {}
        last = np.nonzero(inside & ~np.concatenate([inside[1:], [False]]))[0]
        langs, words = self.vocabulary.langs, self.vocabulary.words
        runs: dict[str, list[bytes]] = {}
        for low, high in zip(first.tolist(), (last + 1).tolist()):
            run = numbers[low:high].tolist()
            runs.setdefault(langs[run[0]], []).append(b" ".join([words[i] for i in run]))
        return {lang: b"\n".join(lines).decode() for lang, lines in runs.items()}

    def rows(self, batches, part: int = 0):
        """Rows of COUNTED: phrases and counts, words of a language (no phrase), blocks of buckets, trimmed texts."""
        held: list[int] = []
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.extend(self.vocabulary.numbers(lang, text))
                if len(held) > BLOCK_WORDS:
                    yield from self.counted(held)
                    held = []
                    if self.vocabulary.size() > TASK_WORDS:
                        self.vocabulary = self.fresh()
        if held:
            yield from self.counted(held)
        if self.tally is not None:
            at = np.nonzero(self.tally)[0]
            block, edges = np.unique(at >> ROW_BITS, return_index=True)
            packed = [pack_counts(at[i:j] & (1 << ROW_BITS) - 1, self.tally[at[i:j]]) for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(at)])]
            yield made(part=[part] * len(block), block=block.tolist(), buckets=packed)

    def counted(self, held: list[int]):
        langs, phrases, times, trimmed = self.count(np.array(held, np.int64))
        yield made(lang=langs, phrase=phrases, n=times)
        if self.size == 1:
            total: dict[str, int] = {}
            for lang, n in zip(langs, times.tolist()):
                total[lang] = total.get(lang, 0) + n
            yield made(lang=list(total), n=list(total.values()))
        if trimmed:
            yield made(lang=list(trimmed), text=list(trimmed.values()))


def pack_counts(at: np.ndarray, counts: np.ndarray) -> bytes:
    return at.astype("<u2").tobytes() + counts.astype("<u4").tobytes()


def unpack_counts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 6
    return np.frombuffer(packed, "<u2", n), np.frombuffer(packed, "<u4", n, 2 * n)


_TYPES = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "part": pa.int32(), "block": pa.int32(), "buckets": pa.binary(), "text": pa.string()}


def made(**columns) -> pa.RecordBatch:
    """Rows of COUNTED with these columns; the others are null."""
    size = len(next(iter(columns.values())))
    arrays = [(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], kind)) if c in columns else pa.nulls(size, kind) for c, kind in _TYPES.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_TYPES))


def _summed(packed: pa.ChunkedArray) -> np.ndarray:
    total = np.zeros(1 << ROW_BITS, np.int64)
    for one in packed:
        at, counts = unpack_counts(one.as_py())
        total[at] += counts
    return total


def full_buckets(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bitmap of the buckets that reach ``least`` in ``rows(part, block, buckets)``: 2**bits / 8 bytes come to the driver.

    The rows of a block are added up ``MERGED`` tasks at a time, then those sums.
    """

    def partly(key: tuple, rows_: pa.Table) -> pa.Table:
        total = np.minimum(_summed(rows_.column("buckets")), least)
        at = np.nonzero(total)[0]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "buckets": pa.array([pack_counts(at, total[at])], pa.binary())})

    def finally_(key: tuple, rows_: pa.Table) -> pa.Table:
        full = np.packbits(_summed(rows_.column("buckets")) >= least, bitorder="little").tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "set": pa.array([full], pa.binary())})

    merged = rows.groupBy("block", F.expr(f"part div {MERGED}").alias("group")).applyInArrow(partly, "block int, buckets binary")
    found = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
    width = (1 << ROW_BITS) >> 3
    for r in merged.groupBy("block").applyInArrow(finally_, "block int, set binary").toArrow().to_pylist():
        part = np.frombuffer(r["set"], np.uint8)[: len(found) - r["block"] * width]
        found[r["block"] * width : r["block"] * width + len(part)] = part
    return found


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """The bits named by column ``at``, packed: at most 2**bits / 8 bytes come to the driver."""
    words = places.groupBy(F.expr("cast(at div 32 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 32 as int))")).alias("set"))
    packed = np.zeros(max(1, (1 << bits) // 32), np.uint32)
    for table in words.toArrow().to_batches():
        packed[table.column(0).to_numpy()] = table.column(1).to_numpy().astype(np.uint32)
    return packed.view(np.uint8)


def phrase_places(phrases: DataFrame, size: int, bits: int) -> DataFrame:
    """Column ``at``: the bit of each hash of the phrases, all of ``size`` words."""

    def placed(batches):
        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                code = lang.encode()
                found.extend(word_hash(code, w) for w in phrase.encode().split(b" "))
            word = np.array(found, np.uint64)
            at = (hashed(word, size, np.arange(0, len(word), size)) >> np.uint64(64 - bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32())], ["at"])

    return phrases.select("lang", "phrase").mapInArrow(placed, "at int")


def counted(texts: DataFrame, least: int, bits: int) -> list[DataFrame]:
    """Words of each language (lang, n), and tables (lang, phrase, n) of the phrases of 1, 2, 3 and 4 words that occur
    ``least`` times or more in their language.

    ``texts`` has columns (lang, text) without nulls. What a pass makes is written once; its phrases, buckets and trimmed
    texts are read from there.
    """
    context, found = texts.sparkSession.sparkContext, []
    frequent: list[np.ndarray] = []
    buckets = None
    for size in range(1, LONGEST + 1):
        held = context.broadcast((frequent, buckets))

        def run(batches, size=size, held=held):
            yield from Pass(size, least, bits, *held.value).rows(batches, TaskContext.get().partitionId())

        raw = written(texts.mapInArrow(run, COUNTED))
        if size == 1:
            found.append(written(raw.filter("phrase is null and n is not null").groupBy("lang").agg(F.sum("n").alias("n"))))
        sums = raw.filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        found.append(written(sums.filter(F.col("n") >= least)))
        if size < LONGEST:
            frequent = [*frequent[:1], bitmap(phrase_places(found[-1], size, bits), bits)]
            buckets = full_buckets(raw.filter("block is not null").select("part", "block", "buckets"), least, bits)
        if size > 1:
            texts = raw.filter("text is not null").select("lang", "text")
    return found


def _ends(phrase: str, k: str) -> tuple[Column, Column]:
    """The first ``k`` words and the rest of a phrase."""
    return F.expr(f"substring_index({phrase}, ' ', {k})"), F.expr(f"substring_index({phrase}, ' ', {k} - size)")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, percent: int = 80, top: int = 2000, bits: int = BUCKET_BITS
) -> DataFrame:
    """The first ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A-Z is lower-cased; texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at space and tab.
    A null text has no words; a null language is ``und``. ``n`` counts the words of a language, ``a`` a phrase of 2 to 4
    words, at least ``least``; of its cuts into two parts that occur ``l`` and ``r`` times the one of lowest score
    ``2000000 * a div (l + r)`` counts, of equals the first. A phrase goes if a longer one that contains it occurs at
    least ``percent`` of its times. Order: score and a descending, phrase in byte order. Repeated rows count again;
    other columns are not read; an empty table gives no rows. A text of any length is read at once by one task.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    totals, words, *phrases = counted(texts, least, bits)
    parts = words
    for p in phrases[:-1]:
        parts = parts.unionByName(p)
    candidates = None
    for size, p in enumerate(phrases, 2):
        p = p.withColumn("size", F.lit(size))
        candidates = p if candidates is None else candidates.unionByName(p)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    first, rest = _ends("phrase", "k")
    cuts = cuts.withColumns({"first": first, "rest": rest})
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("(cast(n as decimal(19, 0)) * 2000000) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.max("n").alias("a"))
    inner = candidates.filter("size > 2").select(
        "lang",
        F.explode(
            F.expr("""flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1),
                s -> array_join(slice(split(phrase, ' '), s, m), ' '))))""")
        ).alias("phrase"),
        F.col("n").alias("longer"),
    )
    covered = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    whole = F.expr(f"cast(longer as decimal(19, 0)) * 100 >= cast(a as decimal(19, 0)) * {int(percent)}")
    kept = scored.join(covered, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~whole)
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))  # so that a language is first ranked by many tasks
    kept = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
