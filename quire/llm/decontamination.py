"""Benchmark decontamination by winnowing.

An item's windows are its runs of `window` words, or all its words if it has fewer. Of every run of window - k + 1
successive k-grams, which is as long as a window, both sides keep the rightmost least hash: so each shared window has
a shared fingerprint at the same place in it. Fingerprints of documents that a bitmap of the items' fingerprints
rules out are dropped where they are made; the others are joined, and each hit is extended within the words around it
that it carries, which decides every window with this fingerprint in it. Items that share a fingerprint with the words
around it are one row there, and sets of items are named by a hash until each document has its own, so a passage of
many items costs its documents one row each. The bitmap has a fixed size for benchmarks of any size. Words are compared
by 64-bit hashes.

Defined cases: null or wordless texts have no words and no windows, and their sha256 is that of the empty string;
documents of equal or null id, and very long ones, are judged each for itself and whole; items of equal id count once, items of null id not at all;
an empty benchmark leaves all documents clean; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import BITS, bitmap, flat, fresh, materialise, mix, slices
from quire.llm.words import ALNUM, gram_hashes, spans, word_hashes

CHUNK = 1_000_000


def winnow(words: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): the selected k-grams of the texts whose words lie between the offsets."""
    w = window - k + 1
    grams = gram_hashes(words, k)
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = grams[j : j + n]
        less = other <= best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.unique(at[np.arange(n) + window <= ends[:n]])
    return at, grams[at]


def context(words: np.ndarray, offsets: np.ndarray, at: np.ndarray, k: int, window: int, outside: int) -> np.ndarray:
    """The words of each k-gram with window - k on either side; `outside` where the text has none."""
    text = np.searchsorted(offsets, at, "right") - 1
    place = at[:, None] + np.arange(k - window, window)[None, :]
    held = (place >= offsets[text][:, None]) & (place < offsets[text + 1][:, None])
    return np.where(held, words[np.clip(place, 0, max(len(words) - 1, 0))], np.uint64(outside))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), _long(x.reshape(-1)))


def _texts(array):
    data, offsets = flat(array)
    for first, last in slices(offsets, CHUNK):
        part = data[offsets[first] : offsets[last]]
        s, e, w = spans(part, offsets[first : last + 1] - offsets[first], ALNUM)
        yield first, last, word_hashes(part, s, e), w


def item_prints(items: DataFrame, k: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """(print, size, item_id, around): size is the window's words, around the k-gram's words with those beside it."""

    def make(batches):
        for batch in batches:
            names = batch.column(0)
            for first, _, words, w in _texts(batch.column(1)):
                n = np.diff(w)
                at, h = winnow(words, w, k, window)
                text = np.searchsorted(w, at, "right") - 1
                yield pa.RecordBatch.from_arrays([_long(h), pa.array(np.full(len(at), window, np.int32)), names.take(pa.array(text + first)), _lists(context(words, w, at, k, window, 1))], list(PRINT))
                for size in np.unique(n[(n > 0) & (n < window)]).tolist():
                    text = np.flatnonzero(n == size)
                    h = short_prints(gram_hashes(words, size)[w[text]], size)
                    yield pa.RecordBatch.from_arrays([_long(h), pa.array(np.full(len(text), size, np.int32)), names.take(pa.array(text + first)), pa.array([[]] * len(text), pa.list_(pa.int64()))], list(PRINT))

    PRINT = {"print": "long", "size": "int", "item_id": "string", "around": "array<long>"}
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(make, ", ".join(f"{n} {t}" for n, t in PRINT.items())).distinct()


def short_prints(h: np.ndarray, size: int) -> np.ndarray:
    """Apart from the prints of whole windows and of other sizes."""
    return mix(h ^ np.uint64(0xA0761D6478BD642F + size))


def candidates(docs: DataFrame, bits: np.ndarray, sizes: list[int], k: int, window: int) -> DataFrame:
    """A row for each document with the fingerprints that the bitmap lets pass."""
    packed = np.packbits(bits)

    def make(batches):
        from pyspark import TaskContext

        known, part, count = np.unpackbits(packed).astype(bool), TaskContext.get().partitionId(), 0
        near = lambda h: known[(h >> np.uint64(64 - BITS)).astype(np.int64)]
        for batch in batches:
            for first, last, words, w in _texts(batch.column(1)):
                at, h = winnow(words, w, k, window)
                at, h = at[on := near(h)], h[on]
                found = [(at, h, np.full(len(at), window), context(words, w, at, k, window, 0))]
                for size in sizes:
                    grams = short_prints(gram_hashes(words, size), size)
                    ends = np.repeat(w[1:], np.diff(w))[: len(grams)]
                    at = np.flatnonzero(near(grams) & (np.arange(len(grams)) + size <= ends))
                    found.append((at, grams[at], np.full(len(at), size), np.zeros((len(at), 2 * window - k), np.uint64)))
                at, h, size, around = (np.concatenate(x) for x in zip(*found, strict=True))
                text = np.searchsorted(w, at, "right") - 1
                order = np.argsort(text, kind="stable")
                text = text[order]
                offsets = pa.array(np.searchsorted(text, np.arange(last - first + 1)).astype(np.int32))
                hits = pa.StructArray.from_arrays([_long(h[order]), pa.array(size[order].astype(np.int32)), pa.array(at[order] - w[text]), _lists(around[order])], ["print", "size", "place", "words"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(last - first, part, np.int32)), pa.array(np.arange(count, count + last - first)), batch.column(0).slice(first, last - first), pa.array(np.diff(w)), pa.ListArray.from_arrays(offsets, hits)], ["part", "row", "doc_id", "n_words", "hits"])
                count += last - first

    schema = "part int, row long, doc_id long, n_words long, hits array<struct<print: long, size: int, place: long, words: array<long>>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(make, schema)


def extended(k: int, window: int):
    """Of joined fingerprints those within a shared window, with the run of words that they show as hit."""
    side = window - k

    def extend(batches):
        for batch in batches:
            size, place = batch.column("size").to_numpy(), batch.column("place").to_numpy()
            low, high = place.copy(), place + size
            whole = np.flatnonzero(size == window)
            keep = size < window
            if len(whole):
                a, b = (np.asarray(pc.list_flatten(batch.column(n).take(pa.array(whole)))).reshape(len(whole), -1) for n in ("words", "around"))
                same = a == b
                left = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(axis=1)
                right = np.cumprod(same[:, side + k :], axis=1).sum(axis=1)
                keep[whole] = same[:, side : side + k].all(axis=1) & (left + right >= side)
                low[whole], high[whole] = place[whole] - left, place[whole] + k + right
            rows = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(rows) for n in ("part", "row", "those")), pa.array(low[keep]), pa.array(high[keep])], ["part", "row", "those", "low", "high"])

    return extend


def covered(runs):
    """Words in the union of an array of (low, high) runs."""
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["high"] - F.greatest(x["low"], a["end"]))).alias("n"), F.greatest(a["end"], x["high"]).alias("end"))
    return F.aggregate(F.array_sort(runs), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated) of every document."""
    prints = item_prints(items, k, window, item_col, item_text).groupBy("print", "size", "around").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    prints = materialise(prints.withColumn("those", F.xxhash64("items")), "prints")
    sizes = sorted(r[0] for r in prints.where(F.col("size") < window).select("size").distinct().collect())
    seen = materialise(candidates(docs, bitmap(prints, "print"), sizes, k, window), "seen")
    hits = seen.where(F.size("hits") > 0).select("part", "row", F.inline("hits"))
    joined = hits.join(prints.drop("items"), ["print", "size"]).select("part", "row", "those", "size", "place", "words", "around")
    runs = joined.mapInArrow(extended(k, window), "part int, row long, those long, low long, high long")
    by_doc = runs.groupBy("part", "row").agg(F.collect_set("those").alias("sets"), F.collect_set(F.struct("low", "high")).alias("runs"))
    by_doc = materialise(by_doc.select("part", "row", "sets", covered(F.col("runs")).alias("n_hit")), "found")
    sets = prints.select("those", "items").dropDuplicates(["those"])
    named = by_doc.select("part", "row", F.explode("sets").alias("those")).join(sets, "those").select("part", "row", F.explode("items").alias("item"))
    named = named.groupBy("part", "row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    by_doc = by_doc.join(named, ["part", "row"]).select("part", "row", "items", "n_hit")
    out = seen.select("part", "row", "doc_id", "n_words").join(by_doc, ["part", "row"], "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, whose id no contaminated text has (rows without an id stay)."""
    name = fresh(docs, "hit")
    hit = contamination(docs, items, window, k).where("contaminated").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, docs["doc_id"] == F.col(name), "left_anti")
