"""Byte-level BPE encoding and decoding by a vocabulary of ranked byte strings.

A text is split by the vocabulary's pattern, and each distinct unit is encoded without running its merges: the
bytes of a unit, as Latin-1 characters, pass an Aho-Corasick automaton once for the longest token at each place;
tokens are then taken longest first, and given up again where a neighbour is not compatible. Two tokens are
compatible if the merges of their joined bytes end in just these two, which is remembered for each pair. A row of
tokens whose neighbours are all compatible is the row that the merges of the whole unit give: the first merge
across a border would also be made when the two tokens at that border stand alone.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .piece_codec import blocks
from .shared import own_columns, ship, whole_text

#: Units and pairs held in a Python worker; they are forgotten beyond that, none is dropped.
CACHE_UNITS, CACHE_PAIRS = 400_000, 1_000_000
#: Longer units (code points) are encoded but not held.
CACHE_LENGTH = 64
#: Bytes of a long unit that are matched at a time.
WINDOW = 1 << 16
#: Above all ranks.
NEVER = 1 << 31
#: Characters that stand for others of their class while a text is split: letter, number, white space, none of these.
STAND_INS = {"L": "x", "N": "0", "S": " ", "": "#"}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def class_differences() -> dict[int, str]:
    """Code points whose class (letter, number, white space) differs between the ``regex`` module and the tiktoken
    library, which come with different versions of Unicode, each with a character that has the library's class."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    ranks = {bytes([b]): b for b in range(256)}
    theirs: dict[str, str] = {}
    ours: dict[str, str] = {}
    for name, pattern in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        library = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        theirs |= dict.fromkeys(bytes(library.encode_ordinary(every)).decode(), name)
        ours |= dict.fromkeys(regex.findall(pattern, every), name)
    return {ord(c): STAND_INS[theirs.get(c, "")] for c in theirs.keys() | ours.keys() if theirs.get(c) != ours.get(c)}


class ByteCodec:
    """Encodes and decodes by ``ranks``; every byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, differences: dict[int, str] | None = None, check: bool = True):
        import ahocorasick
        import regex

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary without some single byte is not supported")
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(self.size.values())
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.split = regex.compile(pattern).findall
        self.spans = regex.compile(pattern).finditer
        self.stand_in = differences or {}
        self.odd = frozenset(map(chr, self.stand_in))
        self.high = re.compile(f"[{chr(min(self.stand_in, default=0x10FFFF))}-\U0010ffff]").search
        self.library = None
        if check:
            import tiktoken

            self.library = tiktoken.Encoding("checked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.stories: dict[int, tuple[list[int], list[int], list[int]]] = {}
        self.units = _Units(self)

    def story(self, token: int) -> tuple[list[int], list[int], list[int]]:
        """The merges that a token's bytes go through when they stand alone: of adjacent pairs the one of lowest rank,
        leftmost of equals. Ranks of the merges (ended by NEVER), and the first and the last symbol before each.

        A token that merges don't make (its own bytes end in other symbols) has an empty story of no symbols.
        """
        found = self.stories.get(token)
        if found is None:
            data, ranks = self.tokens[token], self.ranks
            parts = [data[i : i + 1] for i in range(len(data))]
            order, first, last = [], [ranks[parts[0]]], [ranks[parts[-1]]]
            while len(parts) > 1:
                rank, at = min((ranks.get(x + y, NEVER), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    order, first, last = [], [], []
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                order.append(rank)
                first.append(ranks[parts[0]])
                last.append(ranks[parts[-1]])
            found = self.stories[token] = order + [NEVER], first, last
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' joined bytes end in these two: no merge crosses the border before
        both stories have ended. Until one does, the stories go on as if each stood alone, the lower rank first.
        ``left`` is -1 at the start of a unit; a token with an empty story is compatible with nothing."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            (here, _, ends), (there, starts, _) = self.story(left) if left >= 0 else ([NEVER], [], [-1]), self.story(right)
            found, i, j, x, y, across = bool(ends) and bool(starts), 0, 0, None, None, NEVER
            while found:
                if ends[i] != x or starts[j] != y:
                    x, y = ends[i], starts[j]
                    across = self.ranks.get(self.tokens[x] + self.tokens[y], NEVER) if x >= 0 else NEVER
                if across < here[i] and across <= there[j] and across != NEVER:
                    found = False
                elif here[i] <= there[j]:
                    if here[i] == NEVER:
                        break
                    i += 1
                else:
                    j += 1
            self.pairs[key] = found
        return found

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            data = self.tokens[token]
            found = self.shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
        return found

    def longest_at(self, data: bytes) -> list[int] | array:
        """The longest token that starts at each place."""
        text, size = data.decode("latin-1"), self.size
        found = [0] * len(text) if len(text) < WINDOW else array("i", [0]) * len(text)
        for low in range(0, len(text), WINDOW):
            # A window also sees what starts in it and ends behind it; ends come in order, so the longest is set last.
            for end, token in self.automaton.iter(text, low, min(len(text), low + WINDOW + self.longest)):
                found[end + 1 - size[token]] = token
        return found

    def encode_unit(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        best, size, known, n = self.longest_at(data), self.size, self.pairs, len(data)
        dead = bytearray(n + 1)  # places from which no compatible row of tokens reaches the end
        tokens: list[int] = []
        at, last, token = 0, -1, best[0]
        while True:
            while token >= 0:
                end = at + size[token]
                if not dead[end] and (known[k] if (k := last << 32 | token) in known else self.compatible(last, token)):
                    break
                token = self.next_shorter(token)
            if token >= 0:
                tokens.append(token)
                if end == n:
                    return tokens
                at, last, token = end, token, best[end]
            else:
                dead[at] = 1
                token = tokens.pop()  # its end is dead now: the loop goes on to its next shorter prefix
                at -= size[token]
                last = tokens[-1] if tokens else -1

    def cut(self, text: str) -> list[str]:
        """The text's units."""
        if text.isascii() or self.high(text) is None or self.odd.isdisjoint(text):
            return self.split(text)
        return [text[m.start() : m.end()] for m in self.spans(text.translate(self.stand_in))]

    def code(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text: little-endian 32-bit ids, and the bytes that these ids decode to."""
        if len(self.units) > CACHE_UNITS:
            self.units.clear()
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        coded = []
        for text in texts:
            ids = b"".join(map(self.units.__getitem__, self.cut(text)))
            coded.append((ids, self.decode(ids)))
        return coded

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Units(dict):
    """Packed ids by unit, found when first asked for."""

    def __init__(self, codec: ByteCodec):
        super().__init__()
        self.codec = codec

    def __missing__(self, unit: str) -> bytes:
        own = self.codec.encode_unit(unit.encode())
        if self.codec.library is not None and own != (theirs := self.codec.library.encode_ordinary(unit)):
            raise RuntimeError(f"unit {unit!r}: backtracking {own}, library {theirs}")
        packed = np.asarray(own, "<u4").tobytes()
        if len(unit) <= CACHE_LENGTH:
            self[unit] = packed
        return packed


_CODECS: dict[tuple, ByteCodec] = {}


def _codec(ranks: bytes, pattern: str, differences: dict[int, str], check: bool) -> ByteCodec:
    key = (hash(ranks), pattern, check)
    codec = _CODECS.get(key)
    if codec is None:
        _CODECS.clear()  # a worker keeps one
        codec = _CODECS[key] = ByteCodec(read_ranks(ranks), pattern, differences, check)
    return codec


@own_columns
def byte_codec(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with ``token_ids`` (binary: little-endian unsigned 32-bit ids) and ``decoded`` (binary: their bytes).

    ``ranks_path`` is a local file on the driver, a base64 token and a rank on each line; it is a fixed vocabulary and
    is broadcast. Each match of ``pattern`` is encoded separately; there are no special tokens. A null text is encoded
    as the empty one, to no ids. Rows are independent: repeats, ties, other columns and empty tables pass through;
    columns named like the two results are replaced. A text of any length is one row of work whose memory is about
    50 bytes for each of its bytes. With ``check`` each distinct unit of a worker is compared with the tiktoken
    library's ids, and a difference raises.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(ranks_path, "rb") as f:
        held = spark.sparkContext.broadcast((f.read(), pattern, class_differences(), check))

    @arrow_udf("struct<ids:binary,decoded:binary>")
    def coded(texts: pa.Array) -> pa.Array:
        codec = _codec(*held.value)
        found = [c for block in blocks(texts) for c in codec.code(block)]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary())], ["ids", "decoded"]
        )

    docs = docs.drop("token_ids", "decoded")
    return docs.withColumn("_lm_coded", coded(whole_text(text_col))).select(
        *docs.columns, F.col("_lm_coded.ids").alias("token_ids"), F.col("_lm_coded.decoded").alias("decoded")
    )
