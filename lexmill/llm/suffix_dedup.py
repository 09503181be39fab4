"""Removal of long byte strings repeated from earlier documents, by blockwise suffix sorting with a difference cover.

Suffixes are compared to the depth of ``length`` bytes. Documents are dealt to shards, whose suffixes are handled
in memory; what must be known of other shards is exchanged as sorted names in buckets, one bucket sorted at a time.

1. Content-defined pieces of text, each with the ``length - 1`` bytes after it, are named. Of equal pieces only the
   earliest document's stays open; the suffixes that start in the others are repeats.
2. Difference cover: in open text the strings at cover positions (5 of each 21) are named. Two equal windows of
   50 bytes have a cover position at the same place within 21 bytes, so a suffix all of whose cover names in reach
   are found in one document alone is unique and leaves the sort.
3. The suffixes that are left, long ties all, are sorted by their names to full depth, bucket by bucket; each
   class of equal ones gets its earliest document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import digests, powers, prefix_sums, spans
from .shared import release, row_id, ship, whole_text, written

#: A perfect difference set modulo 21: every non-zero residue is the difference of one pair.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Low bytes that sample names leave out: they only choose what is sorted, and a chance equality adds a candidate.
SHORT = 2
#: Bytes looked at to cut pieces, and one cut in so many places.
CUT_WIDTH, CUT_EVERY = 16, 64
#: Bytes of text in a shard, and bytes of text whose names meet in a bucket.
SHARD_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
PIECES, SAMPLES, WINDOWS = 0, 1, 2
NAMES = "bucket int, shard int, kind int, names binary"
FOUND = "shard int, kind int, n long, names binary"


class Shard:
    """The texts of one shard laid end to end, in the order of their ids."""

    def __init__(self, rows: pa.Table, length: int):
        rows = rows.sort_by([("rid", "ascending")]).combine_chunks()
        texts = rows.column("bytes").combine_chunks() if rows.num_rows else pa.array([], pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        self.rid = rows.column("rid").to_numpy()
        self.hash = rows.column("hash")
        self.cuts = (offsets - offsets[0]).astype(np.int64)
        self.data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(texts) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.length = length
        n = len(self.data)
        self.sums = prefix_sums(self.data)
        sizes = np.diff(self.cuts)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        #: Where a window of ``length`` bytes starts within its text.
        self.start = np.zeros(n, bool)
        for low, high in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist()):
            self.start[low : max(low, high - length + 1)] = True

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last suffix (exclusive) of each piece that holds suffixes, and the piece's name."""
        n = len(self.data)
        cut = np.zeros(n, bool)
        if n > CUT_WIDTH:
            rolled = (self.sums[CUT_WIDTH:-1] - self.sums[: -CUT_WIDTH - 1]) * powers(n)[1][: n - CUT_WIDTH]
            cut[CUT_WIDTH:] = (rolled * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58) == 0
        cut[self.cuts[:-1][np.diff(self.cuts) > 0]] = True
        begin = np.nonzero(cut & self.start)[0]
        stop = np.concatenate([np.nonzero(cut)[0], [n]])
        stop = stop[np.searchsorted(stop, begin, "right")]
        text_end = self.cuts[1:][self.doc[begin]]
        stop = np.minimum(stop, text_end)
        return begin, np.minimum(stop, text_end - self.length + 1), digests(self.data, begin, np.minimum(stop + self.length - 1, text_end))

    def open_suffixes(self, found: "Found") -> np.ndarray:
        """Suffixes that start in pieces of which no earlier document has a copy."""
        begin, stop, names = self.pieces()
        earliest = found.least(PIECES, names)
        mine = earliest >= self.rid[self.doc[begin]]
        depth = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(depth, begin[mine], 1)
        np.add.at(depth, stop[mine], -1)
        return np.cumsum(depth[:-1]) > 0

    def samples(self, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions in reach of open suffixes, and the short names (48 bits) of the strings there."""
        size = self.length - PERIOD + 1
        within = np.arange(len(self.data)) - self.cuts[self.doc] if len(self.data) else np.zeros(0, np.int64)
        wanted = np.zeros(PERIOD, bool)
        wanted[list(COVER)] = True
        count = np.concatenate([np.zeros(PERIOD, np.int32), np.cumsum(open_, dtype=np.int32)])
        near = count[PERIOD:] > count[:-PERIOD]
        at = np.nonzero(wanted[within % PERIOD] & near)[0]
        return at, spans(self.sums, at, at + size) & ~np.uint64((1 << 8 * SHORT) - 1)

    def candidates(self, open_: np.ndarray, found: "Found") -> tuple[np.ndarray, np.ndarray]:
        """Open suffixes with a repeated cover name in reach, and their names to full depth."""
        at, names = self.samples(open_)
        repeated = np.zeros(len(self.data) + PERIOD + 1, np.int32)
        repeated[at[found.has(SAMPLES, names)] + 1] = 1
        repeated = np.cumsum(repeated)
        i = np.arange(len(self.data))
        chosen = np.nonzero(open_ & (repeated[i + PERIOD] > repeated[i]))[0]
        return chosen, spans(self.sums, chosen, chosen + self.length)


class Found:
    """What the exchange says of this shard's names: those known in two documents or more, and the earliest id."""

    def __init__(self, rows: pa.Table):
        self.names: dict[int, np.ndarray] = {}
        self.ids: dict[int, np.ndarray] = {}
        for kind in (PIECES, SAMPLES, WINDOWS):
            names, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for k, n, blob in zip(rows.column("kind").to_pylist(), rows.column("n").to_pylist(), rows.column("names")):
                if k == kind:
                    raw = blob.as_buffer()
                    names.append(np.frombuffer(raw, np.uint64, n))
                    if kind != SAMPLES:
                        ids.append(np.frombuffer(raw, np.int64, n, 8 * n))
            name = np.concatenate(names)
            order = np.argsort(name)
            self.names[kind] = name[order]
            if kind != SAMPLES:
                self.ids[kind] = np.concatenate(ids)[order]

    def _spots(self, kind: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = self.names[kind]
        if not len(held):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rough = np.zeros(1 << 22, bool)
        rough[held >> np.uint64(42)] = True
        maybe = np.nonzero(rough[names >> np.uint64(42)])[0]
        spot = np.searchsorted(held, names[maybe])
        spot[spot == len(held)] = 0
        hit = held[spot] == names[maybe]
        return maybe[hit], spot[hit]

    def has(self, kind: int, names: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), bool)
        out[self._spots(kind, names)[0]] = True
        return out

    def least(self, kind: int, names: np.ndarray) -> np.ndarray:
        """The earliest id that has each name; the largest number where only this document has it."""
        out = np.full(len(names), np.iinfo(np.int64).max)
        at, spot = self._spots(kind, names)
        out[at] = self.ids[kind][spot]
        return out


def packed(shard: int, kind: int, names: np.ndarray, rid: np.ndarray, buckets: int) -> pa.Table:
    """A shard's names, once each, in sorted blocks by bucket with the least id and whether several documents have it."""
    order = np.argsort(names)
    names, rid = names[order], rid[order]
    new = np.ones(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    first = np.nonzero(new)[0]
    if len(first):
        least = np.minimum.reduceat(rid, first)
        several = np.maximum.reduceat(rid, first) > least
        names = names[first]
    else:
        least, several = rid, np.zeros(0, bool)
    bucket = ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    held, edges = np.unique(bucket, return_index=True)  # only buckets that this shard has names for
    blobs, of = [], held.tolist()
    for low, high in zip(edges.tolist(), [*edges[1:].tolist(), len(names)]):
        step = np.diff(names[low:high], prepend=np.uint64(0))
        planes = [step.view(np.uint8).reshape(-1, 8).T[SHORT if kind == SAMPLES else 0 :].tobytes(), np.packbits(several[low:high]).tobytes()]
        if kind != SAMPLES:
            planes.append(np.ascontiguousarray(least[low:high].view(np.uint8).reshape(-1, 8).T).tobytes())
        raw = b"".join(planes)
        blobs.append(np.int64([high - low, len(raw)]).tobytes() + pa.compress(raw, "zstd", asbytes=True))
    n = len(of)
    return pa.table({"bucket": pa.array(of, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "names": pa.array(blobs, pa.binary())})


def unpacked(blob: bytes, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size = np.frombuffer(blob, np.int64, 2).tolist()
    raw = np.frombuffer(pa.decompress(blob[16:], size, "zstd", asbytes=True), np.uint8)
    planes = 8 - SHORT if kind == SAMPLES else 8
    step = np.zeros((n, 8), np.uint8)
    step[:, 8 - planes :] = raw[: planes * n].reshape(planes, n).T
    names = np.cumsum(step.reshape(-1).view(np.uint64), dtype=np.uint64)
    bits = (n + 7) // 8
    several = np.unpackbits(raw[planes * n : planes * n + bits], count=n).astype(bool)
    if kind == SAMPLES:
        return names, several, np.zeros(0, np.int64)
    least = np.ascontiguousarray(raw[planes * n + bits :].reshape(8, n).T).reshape(-1).view(np.int64)
    return names, several, least


def sort_bucket(rows: pa.Table) -> pa.Table:
    """Sort one bucket: the names of two or more documents go back to every shard that has them."""
    kind = rows.column("kind")[0].as_py()
    names, several, least, shard = [], [], [], []
    for s, blob in zip(rows.column("shard").to_pylist(), rows.column("names")):
        a, b, c = unpacked(blob.as_py(), kind)
        names.append(a), several.append(b), least.append(c), shard.append(np.full(len(a), s, np.int32))
    name = np.concatenate(names)
    order = np.argsort(name)
    name, of = name[order], np.concatenate(shard)[order]
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    first = np.nonzero(new)[0]
    group = np.cumsum(new) - 1
    shared = (np.diff(np.append(first, len(name))) > 1) | np.logical_or.reduceat(np.concatenate(several)[order], first)
    keep = shared[group]
    ids = np.minimum.reduceat(np.concatenate(least)[order], first)[group][keep] if kind != SAMPLES else None
    name, of = name[keep], of[keep]
    out_shard, out_n, out_names = [], [], []
    by_shard = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[by_shard], np.unique(of))
    for at in np.split(by_shard, cuts[1:]) if len(of) else []:
        out_shard.append(int(of[at[0]]))
        out_n.append(len(at))
        out_names.append(name[at].tobytes() + (ids[at].tobytes() if ids is not None else b""))
    n = len(out_shard)
    return pa.table({"shard": pa.array(out_shard, pa.int32()), "kind": pa.array([kind] * n, pa.int32()), "n": pa.array(out_n, pa.int64()), "names": pa.array(out_names, pa.binary())})


def _namer(kind: int, length: int, buckets: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        shard = Shard(texts, length)
        if kind == PIECES:
            at, _, names = shard.pieces()
        else:
            known = Found(found)
            open_ = shard.open_suffixes(known)
            at, names = shard.samples(open_) if kind == SAMPLES else shard.candidates(open_, known)
        return packed(key[0].as_py(), kind, names, shard.rid[shard.doc[at]], buckets)

    return run


def _remover(length: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        shard, known = Shard(texts, length), Found(found)
        begin, stop, names = shard.pieces()
        before = known.least(PIECES, names) < shard.rid[shard.doc[begin]]
        open_ = shard.open_suffixes(known)
        at = np.nonzero(open_)[0]
        repeat = at[known.least(WINDOWS, spans(shard.sums, at, at + length)) < shard.rid[shard.doc[at]]]
        depth = np.zeros(len(shard.data) + 1, np.int64)
        np.add.at(depth, begin[before], 1)
        np.add.at(depth, stop[before] + length - 1, -1)
        np.add.at(depth, repeat, 1)
        np.add.at(depth, repeat + length, -1)
        gone = np.cumsum(depth[:-1]) > 0
        sizes, removed, spans_, kept = [], [], [], []
        for low, high in zip(shard.cuts[:-1].tolist(), shard.cuts[1:].tolist()):
            mask = gone[low:high]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            sizes.append(high - low)
            removed.append(int(mask.sum()))
            spans_.append([{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])])
            kept.append(shard.data[low:high][~mask].tobytes())
        return pa.table(
            {
                "rid": pa.array(shard.rid),
                "hash": shard.hash,
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "removed_spans": pa.array(spans_, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                "kept_bytes": pa.array(kept, pa.binary()),
            }
        )

    return run


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, removed_spans, kept_bytes) for each row of ``docs``.

    Removed is each byte covered by a string of ``length`` bytes that also starts in a document with a smaller id;
    spans are the maximal removed runs as byte offsets. Matches are sought in the texts as given, never across
    them. A null text is empty; texts shorter than ``length`` keep all. A null id orders before all others. Rows
    with the same id are no earlier documents to each other. An empty table gives an empty result; other columns
    of ``docs`` are not used, whatever their names.
    """
    if length < PERIOD + 8:
        raise ValueError(f"length must be at least {PERIOD + 8}")
    ship(docs.sparkSession)
    text = whole_text(text_col)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards, buckets = -(-total // SHARD_BYTES) + 1, -(-total // BUCKET_BYTES) + 1
    rows = docs.select(
        # By id and text, so that rows without id, or that repeat one, do not meet in one shard.
        F.pmod(F.xxhash64(row_id(id_col), text), F.lit(shards)).cast("int").alias("shard"),
        row_id(id_col).alias("rid"),
        F.xxhash64(text).alias("hash"),
        text.cast("binary").alias("bytes"),
    )
    found = docs.sparkSession.createDataFrame([], FOUND)

    def by_shard(known: DataFrame, run: Callable, schema: str) -> DataFrame:
        return rows.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(run, schema)

    known: list[DataFrame] = []
    for kind in (PIECES, SAMPLES, WINDOWS):
        known.append(written(by_shard(found, _namer(kind, length, buckets), NAMES).groupBy("bucket").applyInArrow(sort_bucket, FOUND)))
        release(docs.sparkSession)
        found = known[0] if kind == PIECES else known[0].unionByName(known[kind])
    schema = "rid long, hash long, n_bytes long, n_removed long, removed_spans array<struct<start:long,stop:long>>, kept_bytes binary"
    cleaned = by_shard(found, _remover(length), schema)
    ids = F.when(F.col("rid") != F.lit(-(2**63)), F.col("rid"))
    return cleaned.select(ids.alias(id_col), "n_bytes", "n_removed", "removed_spans", "kept_bytes")
