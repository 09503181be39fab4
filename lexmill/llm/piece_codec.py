"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut where no merge can cross: before each run of the space mark, since no piece holds a mark
after another character. Each distinct unit is encoded once per Arrow batch by an agenda of adjacent symbol
pairs ordered by score, leftmost first, and checked against the sentencepiece library before use.
"""

from __future__ import annotations

import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import own_columns, ship, whole_text

MARK = "▁"
#: Units held in a Python worker's cache (about 330 bytes each); it is emptied beyond that, no unit is dropped.
CACHE_UNITS = 400_000
#: Longer units are encoded but not cached.
CACHE_LENGTH = 64
#: Units of up to so many characters have their agendas worked off together, as rows of a matrix; longer ones by a heap each.
SHORT = 40
NO_MERGE = np.iinfo(np.int32).max

_UNITS = re.compile(f"{MARK}+[^{MARK}]*")


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unpack(ids: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(ids) // 4}I", ids)


class PieceCodec:
    """Encodes and decodes with the pieces and scores of one serialized model."""

    def __init__(self, model: bytes, check: bool = True):
        import sentencepiece  # only where it is used: the other operators do without it

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.vocab_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        if any(self.library.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds a space mark after another character")
        self.ids = {pieces[i]: i for i in plain}
        self.cost = {pieces[i]: -self.library.get_score(i) for i in plain if len(pieces[i]) > 1}
        self.byte_ids = {int(pieces[i][3:-1], 16): i for i in range(size) if self.library.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.size = size
        self.pieces = [pieces[i].encode() for i in range(size)]
        for value, i in self.byte_ids.items():
            self.pieces[i] = bytes([value])
        self.check = check
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.cache: dict[str, tuple[bytes, str]] = {}
        self._pair_table()

    def merge(self, unit: str) -> list[str]:
        """The symbols left when no adjacent pair is a piece: the best-scored pair merges first, leftmost of equals."""
        symbols, cost = list(unit), self.cost.get
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < n:
                pair = symbols[left] + symbols[right]
                if (c := cost(pair)) is not None:
                    agenda.append((c, left, right, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            for a, b in ((before[left], left), (left, after[left])):
                held = len(agenda)
                offer(a, b)
                if len(agenda) > held:
                    heapq.heappush(agenda, agenda.pop())
        return [s for s in symbols if s]

    def encode_unit(self, unit: str) -> list[int]:
        found: list[int] = []
        for symbol in self.merge(unit):
            i = self.ids.get(symbol)
            if i is None:
                found.extend(self.byte_ids[b] for b in symbol.encode())
            else:
                found.append(i)
        return found

    def _pair_table(self) -> None:
        """Merges of symbol pairs as an open-addressing table: (left, right) -> rank of the score, piece."""
        scores = sorted({c for c in self.cost.values()})
        rank_of = {c: r for r, c in enumerate(scores)}
        found = {}
        for piece, c in self.cost.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    found[left * self.size + right] = rank_of[c], self.ids[piece]
        bits = max(4, (4 * len(found)).bit_length())
        self.mask = (1 << bits) - 1
        self.pair_key = np.full(1 << bits, -1, np.int64)
        self.pair_rank = np.full(1 << bits, NO_MERGE, np.int32)
        self.pair_piece = np.zeros(1 << bits, np.int32)
        self.probes = 1
        for key, (rank, piece) in found.items():
            slot, probes = self._slot(key), 1
            while self.pair_key[slot] >= 0:
                slot, probes = (slot + 1) & self.mask, probes + 1
            self.pair_key[slot], self.pair_rank[slot], self.pair_piece[slot] = key, rank, piece
            self.probes = max(self.probes, probes)
        # A symbol for each character: its piece, or the byte it falls back to if that is one; else -1.
        self.symbol = np.full(0x110000, -1, np.int32)
        for value in range(128):
            self.symbol[value] = self.byte_ids[value]
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i

    def _slot(self, key):
        return ((key * 0x9E3779B1) >> 15) & self.mask

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.size + right
        slot = self._slot(key)
        rank, piece = np.full(key.shape, NO_MERGE, np.int32), np.zeros(key.shape, np.int32)
        live = np.arange(key.size)
        flat_rank, flat_piece, key, slot = rank.reshape(-1), piece.reshape(-1), key.reshape(-1), slot.reshape(-1)
        for _ in range(self.probes):
            held = self.pair_key[slot]
            hit = held == key
            flat_rank[live[hit]], flat_piece[live[hit]] = self.pair_rank[slot[hit]], self.pair_piece[slot[hit]]
            more = ~hit & (held >= 0)
            if not more.any():
                break
            live, key, slot = live[more], key[more], (slot[more] + 1) & self.mask
        return rank, piece

    def _merge_rows(self, symbols: np.ndarray):
        """Agendas of many units of one length at a time; yields row numbers and their final symbols.

        Every round merges the best pair of each unit that has one, so all units still open stay equally long.
        """
        rows = np.arange(len(symbols))
        rank, piece = self._ranks(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if not rank.shape[1]:
                yield rows, symbols
                return
            at = rank.argmin(axis=1)
            line = np.arange(len(rows))
            open_ = rank[line, at] != NO_MERGE
            if not open_.all():
                yield rows[~open_], symbols[~open_]
                rows, symbols, rank, piece, at = rows[open_], symbols[open_], rank[open_], piece[open_], at[open_]
                line = np.arange(len(rows))
                if not len(rows):
                    return
            merged = piece[line, at]
            column = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, column + (column > at[:, None]), axis=1)
            symbols[line, at] = merged
            column = np.arange(rank.shape[1] - 1)
            keep = column + (column >= at[:, None])
            rank, piece = np.take_along_axis(rank, keep, axis=1), np.take_along_axis(piece, keep, axis=1)
            for first, some in ((at - 1, at > 0), (at, at < rank.shape[1])):
                left, r = first[some], line[some]
                rank[r, left], piece[r, left] = self._ranks(symbols[r, left], symbols[r, left + 1])

    def encode_units(self, units: list[str]) -> list[bytes]:
        coded: list = [None] * len(units)
        by_length: dict[int, list[int]] = {}
        for i, unit in enumerate(units):
            by_length.setdefault(len(unit), []).append(i)
        for length, places in by_length.items():
            if length <= SHORT and len(places) >= 16:
                chars = np.frombuffer("".join([units[i] for i in places]).encode("utf-32-le", "surrogatepass"), np.uint32)
                symbols = self.symbol[chars].reshape(-1, length)
                known = (symbols >= 0).all(axis=1)
                index = np.asarray(places)[known]
                for rows, found in self._merge_rows(symbols[known]):
                    packed, width = found.astype("<u4").tobytes(), 4 * found.shape[1]
                    for at, i in enumerate(index[rows].tolist()):
                        coded[i] = packed[at * width : (at + 1) * width]
                places = np.asarray(places)[~known].tolist()
            for i in places:
                coded[i] = pack(self.encode_unit(units[i]))
        return coded

    def decode_unit(self, ids: tuple[int, ...]) -> str:
        return b"".join([self.pieces[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")

    def learn(self, keys: list[str], into: dict[str, tuple[bytes, str]]) -> None:
        """Encode and decode the units ``MARK + key`` and check them against the library."""
        coded = self.encode_units([MARK + key for key in keys])
        if self.check:
            theirs = self.library.encode(keys, num_threads=1)
            for key, own, other in zip(keys, coded, theirs):
                if key and own != pack(other):
                    raise RuntimeError(f"unit {key!r}: agenda {unpack(own)}, library {other}")
        for key, own in zip(keys, coded):
            into[key] = own, self.decode_unit(unpack(own))

    def code(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text: little-endian 32-bit ids with begin and end, and the decoded text."""
        units = [self.keys(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHE_UNITS:
            cache.clear()
        missing = [k for k in set().union(*units) if k not in cache]
        self.learn([k for k in missing if len(k) <= CACHE_LENGTH], cache)
        if long := [k for k in missing if len(k) > CACHE_LENGTH]:
            cache = dict(cache)
            self.learn(long, cache)
        begin, end = pack([self.begin]), pack([self.end])
        coded = []
        for keys in units:
            found = [cache[k] for k in keys]
            decoded = "".join([f[1] for f in found])
            coded.append((b"".join([begin, *[f[0] for f in found], end]), decoded[1:]))
        return coded

    @staticmethod
    def keys(text: str) -> list[str]:
        """The text's units, each without its first mark."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [u[1:] for u in _UNITS.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")


def blocks(texts: pa.Array, chars: int = 1_000_000):
    """Lists of successive texts of about ``chars`` characters, so a batch of long texts stays small."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


_CODECS: dict[tuple[int, bool], PieceCodec] = {}


@own_columns
def piece_codec(docs: DataFrame, model_path: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with ``token_ids`` (binary: little-endian unsigned 32-bit ids, begin and end included) and ``decoded``.

    ``model_path`` is a local file on the driver; its bytes (a fixed vocabulary) are broadcast. A null text
    is encoded as the empty one. Rows are independent: repeats, other columns and empty tables pass through;
    columns named like the two results are replaced. With ``check`` every distinct unit of a batch is compared
    with the library's ids, and a difference raises.
    """
    ship(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    @arrow_udf("struct<ids:binary,decoded:string>")
    def coded(texts: pa.Array) -> pa.Array:
        key = (hash(model.value), check)
        codec = _CODECS.get(key)
        if codec is None:
            _CODECS.clear()  # a worker keeps one
            codec = _CODECS[key] = PieceCodec(model.value, check)
        found = [c for block in blocks(texts) for c in codec.code(block)]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())], ["ids", "decoded"]
        )

    docs = docs.drop("token_ids", "decoded")
    return docs.withColumn("_lm_coded", coded(whole_text(text_col))).select(
        *docs.columns, F.col("_lm_coded.ids").alias("token_ids"), F.col("_lm_coded.decoded").alias("decoded")
    )
