"""Quality classifier: gated-attention multiple-instance learning over the passages of whole texts.

A document is a bag of passages of PASSAGE words. Every passage is encoded (shares of byte kinds, word shapes,
repetition, hashed byte pairs); a gated attention weighs the passages; the weighted representation gives the score. Only
document labels teach it. Training takes at most `sample` labelled documents outside the held-out fold (the lowest by
a hash of their id, and of rows of one id by a hash of their passages) to the driver as passage features, of longer
documents BAG passages spread evenly; scoring is a map over all passages of all texts with the weights in it.

Defined cases: a null or wordless text is one passage of zeros and is scored like any other; without labels outside
the held-out fold every score is 0.5; several labels of a document count as their mean; a null id is not held out;
repeated rows are scored each; very long texts have as many passages as they need; an empty table gives an empty
result; other columns never enter a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import flat, mix, slices
from quire.llm.words import UNSPACED, spans, word_hashes

CHUNK = 1_000_000
PASSAGE = 48
PAIRS = 64
#: Documents that training takes at most.
SAMPLE = 4000
#: Passages of a document that training takes at most; scoring takes all.
BAG = 512
FOLDS = 5
HIDDEN, GATE = 24, 12


def _kinds() -> np.ndarray:
    """The kind of each byte, 0 to 11."""
    kind = np.full(256, 11, np.uint8)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "#$%&*", "|<>~^`\\", "'\"()[]{}", "-_/+=@")):
        kind[list(chars.encode())] = k
    return kind


KINDS, N_KINDS = _kinds(), 12
N_FEATURES = N_KINDS + 8 + PAIRS


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages x N_FEATURES, offsets of each text's passages); each text has one passage at least."""
    s, e, w = spans(data, offsets, UNSPACED)
    n = np.diff(w)
    per = np.maximum(1, -(-n // PASSAGE))
    off = np.concatenate([[0], np.cumsum(per)])
    total = int(off[-1])
    out = np.zeros((total, N_FEATURES), np.float32)
    if not len(s):
        return out, off
    doc = np.repeat(np.arange(len(n)), n)
    of = off[doc] + (np.arange(len(s)) - w[doc]) // PASSAGE  # of each word
    words = np.bincount(of, minlength=total)
    full = np.flatnonzero(words)
    head = np.searchsorted(of, full)
    begin, end = s[head], np.append(s[head[1:]], len(data))
    end = np.minimum(end, offsets[1:][np.searchsorted(off, full, "right") - 1])
    length = np.maximum(end - begin, 1).astype(np.float32)
    kind = KINDS[data]
    for k in range(N_KINDS):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        out[full, k] = (sums[end] - sums[begin]) / length
    h = word_hashes(data, s, e)
    count = np.maximum(words, 1).astype(np.float32)
    mean = lambda x: (np.bincount(of, x, total) / count).astype(np.float32)
    size = (e - s).astype(np.float32)
    same = np.zeros(len(s), np.float32)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    key = np.sort(mix(h ^ mix(of.astype(np.uint64))) & ~np.uint64(0xFFFFF) | of.astype(np.uint64) & np.uint64(0xFFFFF))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] & np.uint64(0xFFFFF)).astype(np.int64), minlength=total)[:total]
    k = N_KINDS
    out[:, k] = mean(size) / 10
    out[:, k + 1] = np.sqrt(np.maximum(mean(size * size) - mean(size) ** 2, 0)) / 10
    out[:, k + 2] = mean(same)
    out[:, k + 3] = distinct / count
    out[:, k + 4] = np.log1p(words) / 5
    out[:, k + 5] = mean((kind[s] == 1).astype(np.float32))
    out[:, k + 6] = mean(((kind[e - 1] >= 5) & (kind[e - 1] < 11)).astype(np.float32))
    out[:, k + 7] = mean((size == 1).astype(np.float32))
    low = data | 0x20
    pair = (low[:-1].astype(np.int64) * 31 + low[1:].astype(np.int64) * 7) % PAIRS
    at = np.repeat(full, end - begin)
    # bytes before a text's first word belong to no passage
    covered = np.zeros(len(data) + 1, np.int8)
    np.add.at(covered, begin, 1)
    np.add.at(covered, end, -1)
    inside = np.flatnonzero(np.cumsum(covered[:-1], dtype=np.int8) > 0)
    inside, at = (inside[:-1], at[:-1]) if len(inside) and inside[-1] == len(data) - 1 else (inside, at)
    pairs = np.bincount(at * PAIRS + pair[inside], minlength=total * PAIRS).reshape(total, PAIRS)
    out[full, k + 8 :] = np.sqrt(pairs[full] / length[:, None])
    return out, off


class AttentionModel:
    """Encoder, gated attention and output, trained with Adam on the log loss of documents."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": g(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": g(HIDDEN, GATE), "U": g(HIDDEN, GATE), "a": g(GATE, 1)[:, 0], "o": g(HIDDEN, 1)[:, 0], "c": np.zeros(1, np.float32)}
        self.mean, self.scale, self.trained = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), False

    def forward(self, x: np.ndarray, off: np.ndarray) -> dict:
        p, starts, lengths = self.p, off[:-1], np.diff(off)
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (v * u) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), lengths))
        a = e / np.repeat(np.add.reduceat(e, starts), lengths)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))}

    def scores(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(off) - 1, 0.5)
        return self.forward(x, off)["y"].astype(np.float64)

    def gradients(self, x: np.ndarray, off: np.ndarray, y: np.ndarray) -> dict:
        f, p, lengths = self.forward(x, off), self.p, np.diff(off)
        d = (f["y"] - y) / len(y)
        dz = np.repeat(d[:, None] * p["o"], lengths, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, off[:-1]), lengths))
        gate = de[:, None] * p["a"]
        dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T
        dh *= 1 - f["h"] ** 2
        return {"W": ((x - self.mean) / self.scale).T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "a": (f["v"] * f["u"]).T @ de, "o": f["z"].T @ d, "c": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, off: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> AttentionModel:
        if not len(y):
            return self
        self.mean, self.scale, self.trained = x.mean(axis=0), x.std(axis=0) + 0.02, True
        r, m, s, t = np.random.default_rng(seed), {}, {}, 0
        starts, lengths = off[:-1], np.diff(off)
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                docs = order[i : i + batch]
                rows = np.concatenate([np.arange(a, a + k) for a, k in zip(starts[docs].tolist(), lengths[docs].tolist(), strict=True)])
                g = self.gradients(x[rows], np.concatenate([[0], np.cumsum(lengths[docs])]), y[docs])
                t += 1
                for k, v in g.items():
                    v = v + decay * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * v
                    s[k] = 0.999 * s.get(k, 0) + 0.001 * v * v
                    step = rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
                    self.p[k] = (self.p[k] - step).astype(np.float32)
        return self


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionModel:
    """The model of a bounded sample of the labelled documents outside the held-out fold."""

    def encode(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for first, last in slices(offsets, CHUNK):
                x, off = passage_features(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                raw = [x[a : b : -((a - b) // BAG)].astype(np.float16).tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), pa.array(raw, pa.binary())], ["doc_id", "label", "x"])

    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = _rows(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(encode, "doc_id long, label double, x binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(sample).toArrow()
    order = sorted(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), rows["x"].to_pylist(), strict=True))
    bags = [np.frombuffer(x, np.float16).reshape(-1, N_FEATURES).astype(np.float32) for _, _, x in order]
    off = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    x = np.concatenate([np.zeros((0, N_FEATURES), np.float32), *bags])
    return AttentionModel().fit(x, off, np.array([y for _, y, _ in order], np.float32))


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """(doc_id, score) of every document."""

    def judge(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for first, last in slices(offsets, CHUNK):
                x, off = passage_features(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(model.scores(x, off))], ["doc_id", "score"])

    return _rows(docs).mapInArrow(judge, "doc_id long, score double")


def accepted(docs: DataFrame, model: AttentionModel, cut: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores `cut` or more."""

    def judge(batches):
        for batch in batches:
            data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
            good = [np.zeros(0, bool)]
            for first, last in slices(offsets, CHUNK):
                good.append(model.scores(*passage_features(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])) >= cut)
            yield batch.filter(pa.array(np.concatenate(good)))

    return docs.mapInArrow(judge, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = score(docs, train(docs, labels, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
