"""Packing by shortest pack first over the length histogram.

Documents are cut into whole sequences and a rest. Only the histogram of the pieces' lengths, at most `size` counts,
reaches the driver: lengths are placed longest first, each into the emptiest packs that still take it, and whole
counts of a packing pattern move at once. Pieces then find their pattern by their rank among the pieces of equal
length; no group of equal lengths ever meets in a task.

Defined cases: a null or empty text is the end id alone; a very long text is cut into as many pieces as it needs; repeated
documents are packed each for itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.pretokens import encoded
from quire.llm.shared import materialise, ragged

PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local long"


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern; every counted length is placed exactly once."""
    open_packs: list[list[list]] = [[] for _ in range(size + 1)]  # by tokens used: [count, lengths]
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left = counts[length]
        if not 0 < length <= size:
            raise ValueError(f"length {length} isn't in 1..{size}")
        grown: list[tuple[int, tuple[int, ...]]] = []
        used = 1  # the emptiest packs come first; packs of one token at least exist
        while left and used <= size - length:
            if not open_packs[used]:
                used += 1
                continue
            n, lengths = open_packs[used].pop()
            take = min(n, left)
            if take < n:
                open_packs[used].append([n - take, lengths])
            if used + 2 * length <= size:
                open_packs[used + length].append([take, (*lengths, length)])
            else:
                grown.append((take, (*lengths, length)))
            left -= take
        for n, lengths in grown:
            open_packs[sum(lengths)].append([n, lengths])
        per = size // length  # what is left fills packs of its own
        if left >= per:
            open_packs[per * length].append([left // per, (length,) * per])
        if left % per:
            open_packs[length * (left % per)].append([1, (length,) * (left % per)])
    merged: dict[tuple[int, ...], int] = {}
    for packs in open_packs:
        for n, lengths in packs:
            merged[lengths] = merged.get(lengths, 0) + n
    return [(n, lengths) for lengths, n in sorted(merged.items(), reverse=True)]


class Places:
    """Where the piece of a given length and rank goes."""

    def __init__(self, patterns: list[tuple[int, tuple[int, ...]]]):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        for n, lengths in patterns:
            offset = 0
            for length in lengths:
                slots.setdefault(length, []).append((n, first, offset))
                offset += length
            first += n
        self.sequences, self.by = first, {}
        for length, rows in slots.items():
            x = np.array(rows, np.int64)
            self.by[length] = (np.cumsum(x[:, 0]) - x[:, 0], x[:, 1], x[:, 2])

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            begin, first, at = self.by[int(lengths[rows[0]])]
            k = np.searchsorted(begin, ranks[rows], "right") - 1
            sequence[rows], offset[rows] = first[k] + ranks[rows] - begin[k], at[k]
        return sequence, offset


def pieces(docs: DataFrame, path: str, size: int, end_id: int = 0) -> DataFrame:
    """A row for each piece, with its part (task) and its number among the task's pieces of equal length."""

    def cut(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for first, ids, off in encoded(batch.column(1), path):
                ids, tokens = np.insert(ids, off[1:], end_id), np.diff(off) + 1
                begin = np.cumsum(tokens) - tokens
                n = -(-tokens // size)
                row = np.repeat(np.arange(len(tokens)), n)
                start = ragged(np.zeros(len(n), np.int64), n) * size
                length = np.minimum(tokens[row] - start, size)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((begin[row] + start).tolist(), (begin[row] + start + length).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                sizes, heads, counts = np.unique(length[order], return_index=True, return_counts=True)
                local = np.empty(len(length), np.int64)
                local[order] = np.arange(len(order)) - np.repeat(heads, counts) + seen[length[order]]
                seen[sizes] += counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), part, np.int32)), batch.column(0).take(pa.array(row + first)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[row]), pa.array(local)],
                    ["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "local"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    cut = materialise(pieces(docs, path, size, end_id), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places(pack_histogram(histogram, size))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches):
        for batch in batches:
            length, local, more = (batch.column(n).to_numpy() for n in ("length", "local", "before"))
            sequence, offset = places.of(length, local + more)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = cut.join(before, ["part", "length"]).select(*names, "local", "before")
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
