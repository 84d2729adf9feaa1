"""Token counts by rank-synchronous array merging.

Each different pre-token of a batch is a row of a ragged numpy array. A round finds the lowest-ranked adjacent pair of
every row, merges all its occurrences in that row (left to right, without overlap) and drops rows that have no pair
left; what survives is counted. The tokenizers library gives the vocabulary and the cuts, and never encodes.

Defined cases: a null text counts as empty (0 tokens, 0 bytes); special strings in a text count one token each, as the
library does by default; a very long text is counted whole, from parts cut where a pre-token starts for certain, and a
pre-token of any length is merged whole; repeated rows give repeated rows; an empty table gives an empty result; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.pretokens import CHUNK, Cutter, WordCache, byte_characters, checked
from quire.llm.shared import HashTable, flat, ragged, slices

NEVER = np.int32(2**31 - 1)


class Merges:
    """The merge table of a byte-level BPE file."""

    def __init__(self, path: str):
        model = checked(path)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, whole = (np.fromiter(map(vocab.__getitem__, x), np.int64, len(pairs)) for x in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.bytes = np.array([vocab[c] for c in byte_characters()], np.int32)
        keys, first = np.unique(self.key(left, right), return_index=True)
        self.table, self.whole = HashTable(max(10, (2 * len(keys)).bit_length())), whole.astype(np.int32)
        self.table.put(keys, first)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) + np.uint64(1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.table.get(self.key(left, right), missing=NEVER).astype(np.int32)

    def count(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many symbols are left of each row of the ragged array (rows of at least one symbol)."""
        counts, alive = np.zeros(len(lengths), np.int32), np.arange(len(lengths))
        rank = np.full(len(symbols), NEVER, np.int32)
        ends = np.cumsum(lengths)
        inner = np.ones(len(symbols), bool)
        inner[ends - 1] = False
        stale = np.flatnonzero(inner)
        while len(alive):
            rank[stale] = self.ranks(symbols[stale], symbols[stale + 1])
            starts = ends - lengths
            least = np.minimum.reduceat(rank, starts)
            on = least != NEVER
            if not on.all():
                counts[alive[~on]] = lengths[~on]
                keep = np.repeat(on, lengths)
                symbols, rank = symbols[keep], rank[keep]
                alive, lengths, least = alive[on], lengths[on], least[on]
                if not len(alive):
                    break
                ends = np.cumsum(lengths)
                starts = ends - lengths
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            if len(hit) > 1 and (close := np.diff(hit) == 1).any():
                # neighbours can only be one pair overlapping itself: of each such run take every second
                head = np.append(True, ~close)
                hit = hit[(np.arange(len(hit)) - np.flatnonzero(head)[np.cumsum(head) - 1]) % 2 == 0]
            symbols[hit] = self.whole[rank[hit]]
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            row = np.searchsorted(ends, hit, "right")
            lengths = lengths - np.bincount(row, minlength=len(lengths))
            place = np.cumsum(~gone) - 1
            keep = ~gone
            symbols, rank = symbols[keep], rank[keep]
            ends = np.cumsum(lengths)
            at = place[hit]
            rank[at] = NEVER
            first = np.zeros(len(symbols), bool)
            first[ends - lengths] = True
            before = at[~first[at]] - 1
            final = np.zeros(len(symbols), bool)
            final[ends - 1] = True
            stale = np.concatenate([at[~final[at]], before])
        return counts


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str):
        self.cutter, self.merges = Cutter(path), Merges(path)
        self.cache = WordCache(self._counts)

    def _counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.merges.bytes[np.frombuffer(b"".join(words), np.uint8)]
        return self.merges.count(symbols, lengths), np.ones(len(words), np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        a, b, _, found = self.cutter.pieces(data, offsets)
        s, e = self.cutter.tokens(data, a, b)
        at = self.cache.of(data, s, e)
        sums = np.concatenate([[0], np.cumsum(self.cache.flat[self.cache.starts[at]], dtype=np.int64)])
        out = np.diff(sums[np.searchsorted(s, offsets)])
        np.add.at(out, [row for row, _, _ in found], 1)
        return out


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_texts(texts: pa.Array, path: str) -> np.ndarray:
    """Token counts of an Arrow string column."""
    data, offsets = flat(texts)
    parts = [counter(path).count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, CHUNK)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text; a narrow map over the scan, no shuffle."""

    def count(batches):
        for batch in batches:
            n = count_texts(batch.column(1), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(flat(batch.column(1))[1])), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
