"""Words grouped with their commoner spellings: neighbours at one inserted, deleted or replaced code point.

Neighbours are found by two-dimensional range reporting. In a block of words of one length, a word is the point
(place in forward order, place in order of the reversed words). For each edit position of a query the words with
its prefix are an interval of the first order and the words with its suffix one of the second, and a wavelet tree
over the points reports those in both.

No dictionary is held whole. A pair of neighbours has its edit in one half of the word and shares the other half,
so words meet in buckets of equal length and equal outer part; buckets with too much text are dealt again by the
halves of their range of positions, until one position is left, where a bucket has no more words than the alphabet
has letters. A pair is reported in exactly one bucket at exactly one position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ship, whole_text, written

#: Maximal runs of these are words.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words that may meet in a bucket, and (words x positions) that are searched at a time.
BUCKET_BYTES, BLOCK_CELLS = 256 << 10, 1 << 19
FOUND = "word string, n_near long, rank long, form string"


def runs(text: Column) -> Column:
    """Runs of letters, A-Z lower-cased and nothing else."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z\\u00C0-\\u00FF]+"), 0)


def damaged(doc_id: Column, run: Column, every: int) -> Column:
    """The run without one code point where the crc32 of ``<doc_id>:<run>`` is a multiple of ``every``."""
    h = F.crc32(F.concat_ws(":", doc_id.cast("string"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


class WaveletTree:
    """Bits of a permutation by level, highest first; each level is stably parted into zeros and ones."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            counted = np.zeros(len(values) + 1, np.int64)
            np.cumsum(1 - bit, out=counted[1:])
            self.zeros.append(counted)
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [least, most) at the places [low, high) of each query."""
        query, value = np.arange(len(low)), np.zeros(len(low), np.int64)
        for level, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            zero_low, zero_high, n = zeros[low], zeros[high], zeros[-1]
            one = value + (1 << level)
            low, high = np.concatenate([zero_low, low - zero_low + n]), np.concatenate([zero_high, high - zero_high + n])
            query, value = np.concatenate([query, query]), np.concatenate([value, one])
            live = (low < high) & (value < most[query]) & (value + (1 << level) > least[query])
            low, high, query, value = low[live], high[live], query[live], value[live]
        return query, value


def _groups(order: np.ndarray, shared: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word and each length in first..last-1 of a shared end: the interval of the sorted words that share it.

    ``shared`` has for each place in order the length shared with the word before (-1 across buckets).
    """
    n, place = len(order), np.arange(len(order), dtype=np.int32)[:, None]
    new = shared[:, None] < np.arange(first, last)
    low = np.maximum.accumulate(np.where(new, place, 0), axis=0)
    ends = np.full(new.shape, n, np.int32)
    ends[:-1] = np.where(new[1:], place[1:], n)
    high = np.minimum.accumulate(ends[::-1], axis=0)[::-1]
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    return low[at], high[at]


def _shared(keys: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Length of the common start of each row of letters with the row before; -1 if the keys differ."""
    found = np.full(len(keys), -1, np.int32)
    same = letters[1:] == letters[:-1]
    length = np.where(same.all(axis=1), letters.shape[1], same.argmin(axis=1))
    found[1:] = np.where(keys[1:] == keys[:-1], length, -1)
    return found


def neighbours(keys: np.ndarray, words: list[bytes], length: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) pairs of places in ``words`` (Latin-1; of ``length`` letters, or one less) with equal keys: found is
    of ``length`` letters and is the query with the letter at a position in first..last-1 replaced or inserted there."""
    sizes = np.array([len(w) for w in words])
    long = sizes == length
    if not long.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    front = np.frombuffer(b"".join([w.ljust(length, b"\0") for w in words]), np.uint8).reshape(-1, length)
    back = np.frombuffer(b"".join([w[::-1].ljust(length, b"\0") for w in words]), np.uint8).reshape(-1, length)
    # Both orders are over all the words; points are those of full length.
    forward = np.array(sorted(range(len(words)), key=lambda i: (keys[i], words[i])))
    reverse = np.array(sorted(range(len(words)), key=lambda i: (keys[i], words[i][::-1])))
    low, high = _groups(forward, _shared(keys[forward], front[forward]), first, last)
    # A query at position i shares length - 1 - i letters at its end: from length - last to length - 1 - first.
    least, most = _groups(reverse, _shared(keys[reverse], back[reverse]), length - last, length - first)
    least, most = least[:, ::-1], most[:, ::-1]
    counted = [np.concatenate([[0], np.cumsum(long[order])]) for order in (forward, reverse)]
    low, high, least, most = counted[0][low], counted[0][high], counted[1][least], counted[1][most]
    own = long[:, None].astype(np.int64)  # a query of full length lies in its own intervals
    query, position = np.nonzero((high - low > own) & (most - least > own))
    points, values = forward[long[forward]], reverse[long[reverse]]
    place = np.empty(len(words), np.int64)
    place[values] = np.arange(len(values))
    at = query, position
    found, value = WaveletTree(place[points]).report(low[at], high[at], least[at], most[at])
    query, position, other = query[found], position[found] + first, values[value]
    # Not the word itself; and of a run of equal letters only the first is the inserted one.
    true = (query != other) & (long[query] | (position == 0) | (front[other, position] != front[other, position - 1]))
    return query[true], other[true]


def best(words: list[str], counts: np.ndarray, query: np.ndarray, other: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """For each word with neighbours: (word, number of them, the one of largest count, first in code-point order)."""
    place = np.empty(len(words), np.int64)
    place[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    order = np.lexsort((place[other], -counts[other], query))
    query, other = query[order], other[order]
    start = np.nonzero(np.concatenate([[True], query[1:] != query[:-1]]))[0]
    return query[start], np.diff(np.append(start, len(query))), other[start]


def _search(length: int, first: int, last: int, keys: list, words: list[str], counts: list[int]) -> pa.RecordBatch:
    numbers = np.unique(np.array(keys), return_inverse=True)[1]
    query, other = neighbours(numbers, [w.encode("latin-1") for w in words], length, first, last)
    n = np.array(counts, np.int64)
    inserted = np.array([len(w) for w in words])[query] < length
    query, other = np.concatenate([query, other[inserted]]), np.concatenate([other, query[inserted]])
    if len(query):
        word, near, form = best(words, n, query, other)
    else:
        word = near = form = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([words[i] for i in word], pa.string()), pa.array(near, pa.int64()), pa.array(-n[form], pa.int64()), pa.array([words[i] for i in form], pa.string())],
        ["word", "n_near", "rank", "form"],
    )


def _searched(batches):
    """Rows in order of (length, first, last, bucket): whole buckets of one kind are searched together, a block at a time."""
    kind, bucket, cells = None, None, 0
    keys: list = []
    words: list[str] = []
    counts: list[int] = []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for length, first, last, key, word, n in zip(*columns):
            now = length, first, last
            if now != kind or (key != bucket and cells > BLOCK_CELLS):
                if words:
                    yield _search(*kind, keys, words, counts)
                kind, cells, keys, words, counts = now, 0, [], [], []
            bucket = key
            keys.append(key)
            words.append(word)
            counts.append(n)
            cells += length
    if words:
        yield _search(*kind, keys, words, counts)


def _bucket() -> Column:
    """Hash of what the words of a bucket share: the letters before the first position and those behind the last.
    Words that meet by a chance equality are not taken for neighbours, as their letters are compared."""
    tail = F.col("length") - F.col("last")
    return F.xxhash64("length", "first", "last", F.expr("substring(word, 1, first)"), F.when(tail > 0, F.expr("right(word, length - last)")))


def _halves(df: DataFrame) -> DataFrame:
    middle = F.expr("first + (last - first) div 2").cast("int")
    parts = F.filter(
        F.array(F.struct(F.col("first").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("last").alias("b"))), lambda p: p.a < p.b
    )
    split = df.select("word", "n", "length", F.explode(parts).alias("part"))
    return split.select("word", "n", "length", F.col("part.a").alias("first"), F.col("part.b").alias("last")).withColumn("bucket", _bucket())


def bucketed(words: DataFrame, limit: int = BUCKET_BYTES) -> DataFrame:
    """Rows (word, n, length, first, last, bucket): each word as one of full length and as one that misses a letter, in a
    bucket for each range of positions; buckets of over ``limit`` letters are halved, level by level."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("length")
    open_ = _halves(words.select("word", "n", lengths).withColumns({"first": F.lit(0), "last": F.col("length")}))
    done = None
    while True:
        sizes = open_.groupBy("bucket").agg(F.sum("length").alias("letters"), F.max(F.expr("last - first")).alias("wide"))
        full = written(sizes.filter((F.col("letters") > limit) & (F.col("wide") > 1)).select("bucket"))
        if full.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        rest = open_.join(full, "bucket", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        open_ = written(_halves(open_.join(full, "bucket", "left_semi")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last, twice as far in each round.

    A form is at least twice as frequent as its word, so a chain has at most 63 words and six rounds end it.
    """
    held = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = written(held.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if stepped.filter("moved").isEmpty():
            return stepped.select("word", "root")
        held = stepped.select("word", "root")


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, ratio: int = 2, every: int = 97, limit: int = BUCKET_BYTES
) -> DataFrame:
    """Words of the texts with ``form`` (the commoner spelling a word stands for, or null) and ``root`` (the last form).

    A word is a run of Latin letters, A-Z lower-cased; a run whose crc32 with its document's id is a multiple of
    ``every`` loses a code point first. Words have at least ``min_length`` code points and ``min_count`` occurrences
    (``n``). ``n_near`` counts the words at one inserted, deleted or replaced code point; ``form`` is the most frequent of
    them (ties: the first in code-point order) if its count ``form_n`` is at least ``ratio`` (2 or more) times ``n``.
    A null text has no words; a null id counts as the empty string; repeated rows count again; other columns are not
    read. An empty table gives no rows. A very long run is one word like others.
    """
    if min_length < 2 or ratio < 2:
        raise ValueError("words have two letters or more, and a form is at least twice as frequent as its word")
    ship(docs.sparkSession)
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs(whole_text(text_col))).alias("run"))
    words = found.select(damaged(F.col("id"), F.col("run"), every).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = written(words.filter((F.length("word") >= min_length) & (F.col("n") >= min_count)))
    dealt = bucketed(words, limit).select("length", "first", "last", "bucket", "word", "n")
    order = ["length", "first", "last", "bucket"]
    pairs = dealt.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_searched, FOUND)
    near = pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("rank", "form")).alias("top"))
    all_words = written(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(-F.col("top.rank") >= ratio * F.col("n"), F.col("top")).alias("top"),
        )
    )
    last = roots(all_words.filter("top is not null").select("word", F.col("top.form").alias("form")))
    return all_words.join(last, "word", "left").select(
        "word", F.col("top.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("top.rank")).alias("form_n")
    )
