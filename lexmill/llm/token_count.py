"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's trie is closed under failure links: on a byte that does not continue the current match, the
automaton pops the pieces that the longest match would have taken, whose number is stored, and goes on from
what is left. With all links resolved each byte is one table step, and a word's greedy longest-match length is
a sum of stored numbers; no piece is built. The words of a block step through the table side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .shared import own_columns, ship, whole_text

#: A table entry holds the next state above these bits and the number of popped pieces in them.
POP_BITS = 10
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Words are stepped side by side up to this length; what is left of longer ones is walked one by one.
SIDE_BY_SIDE = 256


class LongestMatch:
    """The automaton of a vocabulary of word-initial and continuing pieces, over UTF-8 bytes."""

    def __init__(self, initial: list[bytes], continuing: list[bytes]):
        root, inner = 0, 1
        edges: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        depth_order: list[tuple[int, int, int]] = []  # parent, byte, node
        for top, pieces in ((root, initial), (inner, continuing)):
            for piece in pieces:
                at = top
                for b in piece:
                    if b not in edges[at]:
                        edges[at][b] = len(edges)
                        edges.append({})
                        ends.append(False)
                    at = edges[at][b]
                ends[at] = at != top
        n = len(edges)
        self.dead = n
        fail, pops = [-1] * n, [0] * n
        level = [root, inner]
        while level:  # breadth first: a failure link leads to a node of smaller depth or of the other trie's top
            following = []
            for parent in level:
                for b, node in edges[parent].items():
                    if ends[node]:
                        fail[node], pops[node] = inner, 1
                    else:
                        at, popped = fail[parent], pops[parent]
                        while at >= 0 and b not in edges[at]:
                            at, popped = fail[at], popped + pops[at]
                        if at >= 0:
                            fail[node], pops[node] = edges[at][b], popped
                    following.append(node)
                    depth_order.append((parent, b, node))
            level = following
        table = np.full((n + 1, 256), self.dead << POP_BITS, np.int32)
        left = np.full(n + 1, -1, np.int32)  # pieces popped from a state to the end of the word; -1: unknown word
        left[inner] = 0
        for node in [inner, root, *(node for _, _, node in depth_order)]:
            f = fail[node]
            if f >= 0:
                row = table[f].copy()
                alive = row >> POP_BITS != self.dead
                row[alive] += pops[node]
                table[node] = row
                if left[f] >= 0:
                    left[node] = left[f] + pops[node]
            for b, child in edges[node].items():
                table[node, b] = child << POP_BITS
        if max(pops, default=0) >= (1 << POP_BITS) // 4:
            raise ValueError("a piece is too long for the table's counts")
        self.table, self.left = table.reshape(-1), left

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word ``data[start:end]``; 1 for a word the vocabulary cannot spell."""
        lengths = ends - starts
        order = np.argsort(-np.minimum(lengths, SIDE_BY_SIDE), kind="stable")
        begins, lengths = starts[order], lengths[order]
        state = np.zeros(len(order), np.int32)
        total = np.zeros(len(order), np.int32)
        longest = int(min(lengths.max(initial=0), SIDE_BY_SIDE))
        # How many words are longer than t, for each t.
        open_ = len(order) - np.cumsum(np.bincount(np.minimum(lengths, SIDE_BY_SIDE), minlength=longest + 1))
        live = len(order) - int((lengths == 0).sum())
        for t in range(longest):
            entry = self.table[(state[:live] << 8) | data[begins[:live] + t]]
            state[:live] = entry >> POP_BITS
            total[:live] += entry & ((1 << POP_BITS) - 1)
            live = int(open_[t + 1]) if t + 1 < len(open_) else 0
        for i in np.nonzero(lengths > SIDE_BY_SIDE)[0]:
            at, sum_ = int(state[i]), int(total[i])
            for b in data[begins[i] + SIDE_BY_SIDE : begins[i] + lengths[i]].tolist():
                entry = int(self.table[at << 8 | b])
                at, sum_ = entry >> POP_BITS, sum_ + (entry & ((1 << POP_BITS) - 1))
                if at == self.dead:
                    break
            state[i], total[i] = at, sum_
        rest = self.left[state]
        counts = np.empty(len(order), np.int64)
        counts[order] = np.where(rest < 0, 1, total + rest)
        return counts

    def count_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and pieces of each text (a string array without nulls)."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        n_words, n_pieces = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        first = 0
        while first < len(texts):  # blocks of about 4 MB: a longer text is a block of its own
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 22), "right")) - 1)
            low, high = int(offsets[first]), int(offsets[last])
            block = data[low:high]
            cut = (offsets[first : last + 1] - low).astype(np.int64)
            inside = np.zeros(len(block) + 2, np.int8)
            inside[1:-1] = ~SPACES[block]
            edge = np.diff(inside)
            starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
            # A word that runs over a text's end is cut there.
            joined = cut[1:-1][(inside[cut[1:-1]] > 0) & (inside[cut[1:-1] + 1] > 0)] if len(cut) > 2 else cut[:0]
            joined = np.unique(joined)
            starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
            doc = np.searchsorted(cut, starts, "right") - 1
            counts = self.count(block, starts, ends)
            n_words[first:last] = np.bincount(doc, minlength=last - first)[: last - first]
            n_pieces[first:last] = np.bincount(doc, counts, minlength=last - first)[: last - first].astype(np.int64)
            first = last
        return n_words, n_pieces


def word_pieces(model_path: str) -> tuple[list[bytes], list[bytes]]:
    """Word-initial and continuing pieces of a SentencePiece model's vocabulary, which marks word starts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    initial, continuing = [], []
    for i in range(model.vocab_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        if piece.strip("▁"):
            (initial if piece[0] == "▁" else continuing).append(piece.removeprefix("▁").encode())
    # A word may start with any single character the vocabulary knows.
    single = [p for p in continuing if len(p.decode()) == 1]
    return sorted({*initial, *single}), continuing


_AUTOMATA: dict[int, LongestMatch] = {}


@own_columns
def token_count(docs: DataFrame, initial: list[bytes], continuing: list[bytes], text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens``: greedy longest-match word-piece counts of the whole text.

    Words are runs of other than space, tab, LF, VT, FF and CR. A word that cannot be spelled counts as one
    unknown token, as word-piece models have it. Null and empty texts have 0 of both. Rows are independent: repeats
    agree and an empty table gives an empty result;
    other columns pass through, ones named like the two results are replaced. The vocabulary (of fixed size) is
    broadcast; each Python worker builds its table once.
    """
    ship(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast((initial, continuing))

    @arrow_udf("struct<words:long,tokens:long>")
    def counted(texts: pa.Array) -> pa.Array:
        key = hash((len(vocabulary.value[0]), *vocabulary.value[0], *vocabulary.value[1]))
        automaton = _AUTOMATA.get(key)
        if automaton is None:
            _AUTOMATA.clear()  # a worker keeps one
            automaton = _AUTOMATA[key] = LongestMatch(*vocabulary.value)
        words, tokens = automaton.count_texts(texts.cast(pa.string()))
        return pa.StructArray.from_arrays([pa.array(words), pa.array(tokens)], ["words", "tokens"])

    docs = docs.drop("n_words", "n_tokens")
    return docs.withColumn("_lm_counted", counted(whole_text(text_col))).select(
        *docs.columns, F.col("_lm_counted.words").alias("n_words"), F.col("_lm_counted.tokens").alias("n_tokens")
    )
