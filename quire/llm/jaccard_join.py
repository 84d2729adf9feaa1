"""N-gram Jaccard join over whole texts, with a count-vector R-tree.

A document's set is its distinct word shingles, as 64-bit hashes; documents of equal sets share a node (a hash of the
set). Two sets with Jaccard similarity of t or more share one of their first n - ceil(t n) + 1 shingles in any common
order; the order used puts shingles that many documents hold last, by a frequency sketch that every shingle of every
document is counted in. So each link's two nodes meet in the group of a shared prefix shingle.

Each group has a centre, the node whose groups are largest taken together: copies that differ from each other are
mostly near one original, and its shingles are those that the others kept. Groups of one centre are one family, so a
node goes to few families, not to each of its groups.

1. Families are dealt to tasks, larger ones in parts by size class and salt, every part with the centre. Shingles are
   hashed to lanes, and a node's counts by lane are a point: the sum of coordinate minima of two points bounds the
   overlap of their sets, and that with the upper corner of an R-tree's box the overlap with all points in it. Tasks
   of points alone find the nodes that have a partner within the bound, and only these go on with a text each.
2. A task then tests all nodes against the centre, and builds a tree of finer points, about two lanes for each shingle.
   Pairs that survive are verified by their sets, the best bounds first, and those of one component are passed over.
   A task hands out the links that joined components, less than it has nodes.
3. Only families of several parts can have open pairs then. Nodes outside a family's largest component meet the
   parts they haven't met, as before; what is in that component already isn't tested among itself.

Groups are never collected: parts have at most PART nodes and VOLUME shingles (or one node). No pair is capped or
dropped.

Defined cases: null or wordless texts have the empty set, n_shingles 0 and their own id as component; fewer words than
a shingle make one shingle; a text of any length is one set (a longer one than VOLUME is a part by itself); documents
of equal id or null id keep their rows (a null never is the least id); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.shared import discard, flat, folded, fresh, materialise, mix, partitions, ragged, slices
from quire.llm.words import UNSPACED, gram_hashes, spans, word_hashes

CHUNK = 1_000_000
#: The frequency sketch has 2 ** SKETCH counters up to a million sets and twice as many for each doubling, 2 ** MOST at
#: most; they are sent in segments of one byte a counter.
SKETCH, MOST, SEGMENT = 22, 24, 1 << 16
#: Nodes and shingles of a part.
PART, VOLUME = 1500, 1_000_000
FANOUT = 12
#: Points of the first bound: (members up to which, binary logarithm of the lanes).
COARSE = ((2048, 8), (16384, 10), (1 << 62, 12))
#: Binary logarithm of the buckets of keys.
BUCKETS = 20
#: Pairs that trees of one call may find at most, but for one part by itself.
PAIRS = 4_000_000
#: Nodes that a task remembers, so that it gives the prefix of equal sets once.
KNOWN = 1 << 20


def shingle_sets(texts: pa.Array, words_each: int):
    """(number of texts, distinct hashes ascending within each text, offsets) by chunks."""
    data, offsets = flat(texts)
    for first, last in slices(offsets, CHUNK):
        part = data[offsets[first] : offsets[last]]
        s, e, w = spans(part, offsets[first : last + 1] - offsets[first], UNSPACED)
        words, n = word_hashes(part, s, e), np.diff(w)
        grams = gram_hashes(words, words_each)
        sets, lengths = [], []
        for i, (a, k) in enumerate(zip(w[:-1].tolist(), n.tolist(), strict=True)):
            if k >= words_each:
                x = np.unique(grams[a : a + k - words_each + 1])
            else:
                x = gram_hashes(words[a : a + k], k) if k else np.zeros(0, np.uint64)
            sets.append(x)
            lengths.append(len(x))
        yield first, last, np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def set_nodes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set: of its size, its sum and the sum of other hashes of its members."""
    sums = lambda x: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])[offsets])
    return mix(sums(hashes) + mix(sums(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)))) + mix(np.diff(offsets).astype(np.uint64)))


def lanes(ids: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """How many members (numbers or hashes) of each set fall into each of 2 ** bits lanes."""
    sets, width = len(offsets) - 1, 1 << bits
    row = np.repeat(np.arange(sets), np.diff(offsets))
    at = row * width + (mix(ids.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    counts = np.bincount(at, minlength=sets * width).reshape(-1, width)
    return counts.astype(np.uint16 if not sets or counts.max() < 1 << 16 else np.int32)


def coarse_points(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The counts by lane of each set; how many lanes there are follows from its size."""
    n, out = np.diff(offsets), [b""] * (len(offsets) - 1)
    level = np.searchsorted([most for most, _ in COARSE], n)
    for c in np.unique(level).tolist():
        rows = np.flatnonzero(level == c)
        points = lanes(hashes[ragged(offsets[rows], n[rows])], np.append(0, np.cumsum(n[rows])), COARSE[c][1])
        high = points.max(axis=1)
        for i, p, top in zip(rows.tolist(), points, high.tolist(), strict=True):
            out[i] = p.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()
    return out


def _unpacked(points: list[bytes], level: np.ndarray, c: int) -> np.ndarray:
    """Points of level c or above, folded to the lanes of c."""
    out = np.zeros((len(points), 1 << COARSE[c][1]), np.int32)
    for i, (raw, k) in enumerate(zip(points, level.tolist(), strict=True)):
        width = 1 << COARSE[k][1]
        x = np.frombuffer(raw, {1: "u1", 2: "<u2", 4: "<u4"}[len(raw) // width])
        out[i] = x if k == c else x.reshape(out.shape[1], -1).sum(axis=1, dtype=np.int32)
    return out if out.size and out.max() >= 1 << 16 else out.astype(np.uint16)


def _with_centre(group: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, the centre of each) in groups, whose numbers ascend, that have one."""
    centres = np.flatnonzero(first)
    if not len(centres):
        return centres, centres
    at = np.minimum(np.searchsorted(group[centres], group), len(centres) - 1)
    a = np.flatnonzero(group[centres[at]] == group)
    b = centres[at[a]]
    return a[a != b], b[a != b]


def hopeful(group: np.ndarray, root: np.ndarray, side: np.ndarray, first: np.ndarray, n: np.ndarray, points: list[bytes], percent: int) -> np.ndarray:
    """Which nodes have another one in their group (ascending numbers), of another component, whose bound allows a link."""
    level = np.searchsorted([most for most, _ in COARSE], n)
    out = np.zeros(len(group), bool)
    a, b = _with_centre(group, first)
    for c in np.unique(level).tolist():
        rows = np.flatnonzero(level >= c)
        p = _unpacked([points[i] for i in rows.tolist()], level[rows], c)
        place = np.cumsum(level >= c) - 1
        mine = (np.minimum(level[a], level[b]) == c) & (root[a] != root[b])
        x, y = a[mine], b[mine]
        for i in range(0, len(x), 20_000):
            u, v = x[i : i + 20_000], y[i : i + 20_000]
            near = (100 + percent) * np.minimum(p[place[u]], p[place[v]]).sum(axis=1, dtype=np.int64) >= percent * (n[u] + n[v])
            out[u[near]] = out[v[near]] = True
        for here, there in ((0, 1), (1, 0)):
            tree_rows, asks = rows[side[rows] != 1 - here], rows[(side[rows] != 1 - there) & ~out[rows]]
            if not len(tree_rows) or not len(asks):
                continue
            tree = CountTrees(group[tree_rows], root[tree_rows], p[place[tree_rows]])
            q, found, _ = tree.near(group[asks], root[asks], p[place[asks]], percent)
            u, v = asks[q], tree_rows[found]
            mine = np.minimum(level[u], level[v]) == c
            out[u[mine]] = out[v[mine]] = True
            if (side[rows] == 2).all():
                break
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): key is a hash of the two, which tells rows apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def scan(docs: DataFrame, words_each: int, bits: int) -> DataFrame:
    """A row for each document (doc_id, key, n, node, points), and each task's counters as rows (segment, counts)."""

    def make(batches):
        counts = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for first, last, hashes, off in shingle_sets(batch.column(1), words_each):
                at, times = np.unique(_place(hashes, bits), return_counts=True)
                counts[at] = np.minimum(counts[at] + times, 255)
                n = np.diff(off)
                node = pa.array(set_nodes(hashes, off).view(np.int64), mask=n == 0)
                nothing = pa.nulls(last - first)
                points = pa.array(coarse_points(hashes, off), pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, last - first) for i in (0, 2)), pa.array(n), node, points, nothing.cast(pa.int32()), nothing.cast(pa.binary())], names)
        low = counts.reshape(-1, min(SEGMENT, 1 << bits))
        full = np.flatnonzero(low.any(axis=1))
        if len(full):
            none = pa.nulls(len(full)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(full), pa.binary()), pa.array(full.astype(np.int32)), pa.array([low[i].tobytes() for i in full], pa.binary())], names)

    names = ["doc_id", "key", "n", "node", "points", "segment", "counts"]
    return _rows(docs).mapInArrow(make, "doc_id long, key long, n long, node long, points binary, segment int, counts binary")


def frequency_classes(scanned: DataFrame, bits: int) -> np.ndarray:
    """A byte for each counter: how often its shingles occur, four steps for each doubling. 4 to 16 MB."""

    def steps(total: np.ndarray) -> np.ndarray:
        return np.minimum(np.round(4 * np.log2(1 + total.astype(np.float64))), 255)

    out = np.zeros(((1 << bits) // SEGMENT, SEGMENT), np.uint8)
    for segment, classes in folded(scanned.where(F.col("segment").isNotNull()).select("segment", "counts"), np.uint64, np.add, steps):
        out[segment] = classes
    return out.reshape(-1)


def prefixes(docs: DataFrame, classes: np.ndarray, words_each: int, percent: int) -> DataFrame:
    """(shingle, node, n): the prefix of each set in the order of frequency class and hash."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    bits = len(classes).bit_length() - 1

    def make(batches):
        known, seen = shared.value, set()
        for batch in batches:
            for _, _, hashes, off in shingle_sets(batch.column(1), words_each):
                n = np.diff(off)
                order = known[_place(hashes, bits)]
                nodes = set_nodes(hashes, off)
                # equal sets give their prefix once; sets below 100 / (100 - percent) - 1 members can't have another neighbour
                _, one = np.unique(nodes, return_index=True)
                one = one[n[one] * (100 - percent) >= percent] if percent < 100 else one[:0]
                one = one[np.fromiter((x not in seen for x in nodes[one].tolist()), bool, len(one))]
                if len(seen) + len(one) > KNOWN:
                    seen.clear()
                seen.update(nodes[one].tolist())
                keep = n[one] - (percent * n[one] + 99) // 100 + 1
                taken = []
                for i, k in zip(one.tolist(), keep.tolist(), strict=True):
                    a, b = off[i], off[i + 1]
                    x = order[a:b]
                    if k < b - a:
                        cut = np.partition(x, k - 1)[k - 1]
                        low, ties = np.flatnonzero(x < cut), np.flatnonzero(x == cut)
                        taken.append(a + np.concatenate([low, ties[: k - len(low)]]))  # hashes ascend, so ties do
                    else:
                        taken.append(np.arange(a, b))
                at = np.concatenate([np.zeros(0, np.int64), *taken])
                if len(at):
                    yield pa.RecordBatch.from_arrays([_long(hashes[at]), _long(np.repeat(nodes[one], keep)), pa.array(np.repeat(n[one], keep))], ["shingle", "node", "n"])

    return _rows(docs).select("doc_id", "text").mapInArrow(make, "shingle long, node long, n long")


def groups(prefix: DataFrame, parts: int) -> DataFrame:
    """(shingle, node, n) of shingles that two nodes share, each once; a stream over sorted partitions that holds one row."""

    def stream(batches):
        held = np.zeros((3, 0), np.int64)
        matched = False  # whether the held row's shingle has had another node
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(3)])], axis=1)
            s, node = rows[0], rows[1]
            new = np.append(True, (s[1:] != s[:-1]) | (node[1:] != node[:-1]))
            rows = rows[:, new]
            same = rows[0, 1:] == rows[0, :-1]
            keep = np.append(matched, same) | np.append(same, False)
            held, matched = rows[:, -1:], bool(keep[-1])
            out = rows[:, :-1][:, keep[:-1]]
            if out.shape[1]:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names)
        if matched:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), names)

    names = ["shingle", "node", "n"]
    return prefix.repartition(parts, "shingle").sortWithinPartitions("shingle", "node").mapInArrow(stream, "shingle long, node long, n long")


def families(grouped: DataFrame) -> DataFrame:
    """(centre, node, n): the nodes of all groups that have the same centre."""
    sizes = grouped.groupBy("shingle").agg(F.count("*").alias("c"))
    scores = grouped.join(sizes, "shingle").groupBy("node").agg(F.sum("c").alias("score"))
    centres = grouped.join(scores, "node").groupBy("shingle").agg(F.max(F.struct("score", "node")).alias("m")).select("shingle", F.col("m.node").alias("centre"))
    return grouped.join(centres, "shingle").groupBy("centre", "node").agg(F.first("n").alias("n"))


def dealt(family: DataFrame, percent: int) -> DataFrame:
    """(centre, node, n, k, part): families of one part have class 0, others a class for each step of sizes that rules links out."""
    parts = F.ceil(F.greatest(F.count("*") / PART, F.sum("n") / VOLUME)).cast("int")
    # of sizes whose ratio allows a link, the classes are equal or neighbours
    step = float(np.log(100 / percent) * (1 + 1e-9)) or 1.0
    k = F.floor(F.log(F.col("n").cast("double")) / step).cast("long")
    rows = family.join(family.groupBy("centre").agg(parts.alias("all")), "centre")
    rows = rows.withColumn("k", F.when(F.col("all") > 1, k).otherwise(0)).withColumn("large", F.col("all") > 1)
    large = rows.where("large")
    counts = large.groupBy("centre", "k").agg(parts.alias("parts"))
    return rows.where("not large").select("centre", "node", "n", "k", F.lit(0).alias("part"), "large").union(
        large.join(counts, ["centre", "k"]).select("centre", "node", "n", "k", _salt("node", "parts"), "large")
    )


def _salt(node: str, parts: str):
    return F.pmod(F.xxhash64(node), F.col(parts)).cast("int").alias("part")


def _by_task(work):
    """A map over rows sorted by task that gives whole tasks to work(table), some at once while few pairs can come of them."""

    def run(batches):
        held = None  # rows from the start of a task on
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or not len(held):
                continue
            task = held["task"].to_numpy()
            cuts = np.flatnonzero(task[1:] != task[:-1]) + 1
            cuts = np.append(cuts, len(task)) if batch is None else cuts
            at = load = 0
            for last, size in zip(cuts.tolist(), np.diff(np.append(0, cuts)).tolist(), strict=True):
                if load and load + size * size > PAIRS:
                    yield from work(held.slice(at, last - size - at))
                    at, load = last - size, 0
                load += size * size
            if len(cuts):
                yield from work(held.slice(at, int(cuts[-1]) - at))
                held = held.slice(int(cuts[-1]))

    return run


def bounded(tasks: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows (task, node, root, side, first) whose node has a partner in its task within the bound, with its key."""

    def work(table: pa.Table):
        task, node, root, side, first, n = (table[c].to_numpy() for c in ("task", "node", "root", "side", "first", "n"))
        _, group = np.unique(task, return_inverse=True)  # tasks come sorted
        good = hopeful(group, root, side, first, n, table["points"].to_pylist(), percent)
        if good.any():
            yield from table.select(["key", "task", "node", "root", "side", "first"]).filter(pa.array(good)).to_batches()

    rows = tasks.join(nodes, "node").select("key", "task", "node", "root", "side", "first", "n", "points")
    dealt = rows.repartition("task").sortWithinPartitions("task")
    return dealt.mapInArrow(_by_task(work), "key long, task long, node long, root long, side int, first boolean")


def shipped(docs: DataFrame, tasks: DataFrame, nodes: DataFrame, words_each: int, percent: int) -> DataFrame:
    """(a, b): links that join components in tasks, of rows (task, node, root, side, first) of `tasks`.

    side: 0 and 1 are tested against each other, 2 is both; first: the centre, which is tested before all others.
    """

    def work(table: pa.Table):
        """Of whole tasks, in their order."""
        data, w = [], []
        for _, _, hashes, off in shingle_sets(table["text"], words_each):
            data.append(hashes)
            w.append(np.diff(off))
        hashes, n = np.concatenate(data), np.concatenate(w)
        off = np.append(0, np.cumsum(n))
        task, node, root, side, first = (table[c].to_numpy() for c in ("task", "node", "root", "side", "first"))
        # a text of another node (of an equal key), or of a node that is here already, isn't tested
        _, group = np.unique(task, return_inverse=True)
        good = np.flatnonzero(set_nodes(hashes, off).view(np.int64) == node)
        order = good[np.lexsort((side[good], node[good], group[good]))]
        one = np.append(True, (group[order[1:]] != group[order[:-1]]) | (node[order[1:]] != node[order[:-1]]))
        at = order[one[: len(order)]]
        if len(at) > 1:
            hashes, off = hashes[ragged(off[at], n[at])], np.append(0, np.cumsum(n[at]))
            links = Forest(group[at], root[at], side[at], first[at], hashes, off, percent).links()
            yield pa.RecordBatch.from_arrays([pa.array(node[at][links[:, i]]) for i in (0, 1)], ["a", "b"])

    keyed = materialise(bounded(tasks, nodes, percent), "tasks")
    volume = keyed.join(nodes.select("node", "n"), "node").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # texts whose key's bucket is none of the tasks' stay where they are; 2 ** BUCKETS numbers are broadcast at most
    bucket = F.expr(f"shiftrightunsigned(key, {64 - BUCKETS})").alias("bucket")
    wanted = _rows(docs).select("key", "text", bucket).join(F.broadcast(keyed.select(bucket).distinct()), "bucket", "left_semi")
    rows = wanted.select("key", "text").join(keyed.hint("merge"), "key")
    rows = rows.select("task", "node", "root", "side", "first", "text").repartition(partitions(docs.sparkSession, 8 * volume), "task").sortWithinPartitions("task")
    return rows.mapInArrow(_by_task(work), "a long, b long")


class Forest:
    """Links that join components of sets that meet in groups, verified pair by pair, in numpy.

    group: numbers, ascending; root: the components that are known; side: 0 and 1 meet each other, 2 meets all.
    """

    #: Set members that are compared at once.
    BLOCK = 2_000_000

    def __init__(self, group, root, side, first, hashes, offsets, percent):
        self.group, self.side, self.first, self.percent = group, side, first, percent
        self.n = np.diff(offsets)
        # components within a group: those of other groups aren't joined by what is found here
        _, self.label = np.unique(np.stack([group, root], axis=1), axis=0, return_inverse=True)
        self.label = self.label.reshape(-1)
        self.parent = list(range(len(group)))
        _, ids, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.ids, shared = ids, counts[ids] > 1  # what one set holds alone never counts as overlap
        sums = np.append(0, np.cumsum(shared))
        self.shared, self.starts = ids[shared], sums[offsets[:-1]]
        self.lengths = sums[offsets[1:]] - self.starts
        self.offsets, self.found = offsets, []

    def _find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the sets' intersections, pair by pair."""
        pair = np.arange(len(a))
        la, lb = self.lengths[a], self.lengths[b]
        key = np.concatenate([np.repeat(pair, la) << 32 | self.shared[ragged(self.starts[a], la)], np.repeat(pair, lb) << 32 | self.shared[ragged(self.starts[b], lb)]])
        key.sort()
        return np.bincount(key[1:][key[1:] == key[:-1]] >> 32, minlength=len(a))

    def test(self, a: np.ndarray, b: np.ndarray) -> None:
        """Verify pairs in their order, block by block, and join the components of those that link."""
        while len(a):
            open_ = self.label[a] != self.label[b]
            a, b = a[open_], b[open_]
            k = max(1, int(np.searchsorted(np.cumsum(self.lengths[a] + self.lengths[b]), self.BLOCK)))
            x, y, a, b = a[:k], b[:k], a[k:], b[k:]
            linked = (100 + self.percent) * self.overlap(x, y) >= self.percent * (self.n[x] + self.n[y])
            changed = False
            for i, j in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
                u, v = self._find(int(self.label[i])), self._find(int(self.label[j]))
                if u != v:
                    self.parent[max(u, v)] = min(u, v)
                    self.found.append((i, j))
                    changed = True
            if changed:
                roots = np.fromiter((self._find(u) for u in range(len(self.parent))), np.int64, len(self.parent))
                self.label = roots[self.label]

    def links(self) -> np.ndarray:
        a, b = _with_centre(self.group, self.first)
        fits = 100 * np.minimum(self.n[a], self.n[b]) >= self.percent * np.maximum(self.n[a], self.n[b])
        self.test(a[fits], b[fits])
        # groups of more than one component, by sets of like sizes so that the lanes suit them
        least, most = np.full(self.group[-1] + 1, len(self.parent)), np.zeros(self.group[-1] + 1, np.int64)
        np.minimum.at(least, self.group, self.label)
        np.maximum.at(most, self.group, self.label)
        volume, count = np.bincount(self.group, self.n), np.maximum(np.bincount(self.group), 1)
        bits = np.clip(np.ceil(np.log2(np.maximum(2 * volume / count, 1))), 6, 12).astype(np.int64)
        bits[least >= most] = 0
        for width in np.unique(bits[bits > 0]).tolist():
            rows = np.flatnonzero(bits[self.group] == width)
            points = lanes(self.ids[ragged(self.offsets[rows], self.n[rows])], np.append(0, np.cumsum(self.n[rows])), width)
            left, right = np.flatnonzero(self.side[rows] != 1), np.flatnonzero(self.side[rows] != 0)
            if not len(left) or not len(right):
                continue
            label = self.label[rows]
            tree = CountTrees(self.group[rows][left], label[left], points[left])
            q, p, bound = tree.near(self.group[rows][right], label[right], points[right], self.percent)
            a, b = rows[left[p]], rows[right[q]]
            twice = (self.side[a] == 2) & (self.side[b] == 2) & (a > b)
            a, b, bound = a[~twice], b[~twice], bound[~twice]
            best = np.argsort(-(bound / (self.n[a] + self.n[b])), kind="stable")
            self.test(a[best], b[best])
        return np.array(self.found, np.int64).reshape(-1, 2)


class CountTrees:
    """R-trees over the count vectors of many groups at once, one tree a group.

    Points are packed in the order of component and size, FANOUT to a box. A box keeps its upper corner, its least
    size and its component if all its points are of one. Trees grow until no group has more than FANOUT boxes.
    """

    def __init__(self, group: np.ndarray, root: np.ndarray, points: np.ndarray):
        """group: ascending numbers; the rows of a group lie together."""
        sizes = points.sum(axis=1, dtype=np.int64)
        self.order = np.lexsort((sizes, root, group))
        group, root = group[self.order], root[self.order]
        self.levels = [(points[self.order], sizes[self.order], root, np.ones(len(root), bool), None)]
        while True:
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            count = np.diff(np.append(start, len(group)))
            if count.max() <= FANOUT:
                break
            cut = ragged(np.zeros(len(count), np.int64), -(-count // FANOUT)) * FANOUT + np.repeat(start, -(-count // FANOUT))
            corner, least, roots, one, _ = self.levels[-1]
            same = np.append(False, (roots[1:] == roots[:-1]) & one[1:])
            same[cut] = one[cut]
            below = np.diff(np.append(cut, len(group)))
            self.levels.append((np.maximum.reduceat(corner, cut, axis=0), np.minimum.reduceat(least, cut), roots[cut], np.logical_and.reduceat(same, cut), (cut, below)))
            group = group[cut]
        self.tops = group[start], start, count

    def near(self, group: np.ndarray, root: np.ndarray, points: np.ndarray, percent: int, block: int = 1 << 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point) numbers of the pairs in one group, of different components, that the bound allows, and the bound, from the roots down."""
        block = max(1000, block // points.shape[1])
        sizes = points.sum(axis=1, dtype=np.int64)
        tree = np.searchsorted(self.tops[0], group)
        found = (tree < len(self.tops[0])) & (self.tops[0][np.minimum(tree, len(self.tops[0]) - 1)] == group)
        out = [(np.zeros(0, np.int64),) * 3]
        for part in np.array_split(np.flatnonzero(found), max(1, int(found.sum()) * FANOUT // block)):
            n = self.tops[2][tree[part]]
            q, box = np.repeat(part, n), ragged(self.tops[1][tree[part]], n)
            for depth in range(len(self.levels) - 1, -1, -1):
                corners, least, roots, one, below = self.levels[depth]
                other = ~one[box] | (roots[box] != root[q])
                q, box = q[other], box[other]
                bounds = [np.minimum(points[q[i : i + block]], corners[box[i : i + block]]).sum(axis=1, dtype=np.int64) for i in range(0, len(q), block)]
                bound = np.concatenate([np.zeros(0, np.int64), *bounds])
                on = (100 + percent) * bound >= percent * (sizes[q] + least[box])
                q, box, bound = q[on], box[on], bound[on]
                if below:
                    first, n = below[0][box], below[1][box]
                    q, box = np.repeat(q, n), ragged(first, n)
            out.append((q, self.order[box], bound))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def across(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(task, node, root, side, first): what nodes outside the largest component of a family of several parts still have to meet.

    Side r: nodes outside it, m: nodes in it. Parts of r meet those of r and m of the same size class and its neighbours.
    """
    rows = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = rows.groupBy("centre", "root").agg(F.count("*").alias("c"))
    main = by_root.groupBy("centre").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1")
    rows = rows.join(main.select("centre", F.col("m.root").alias("main")), "centre").withColumn("rest", F.col("root") != F.col("main"))
    parts = F.ceil(F.greatest(F.count("*") / PART, F.sum("n") / VOLUME)).cast("int")
    counts = rows.groupBy("centre", "k", "rest").agg(parts.alias("parts"))
    rows = rows.join(counts, ["centre", "k", "rest"]).select("centre", "k", "rest", "node", "root", _salt("node", "parts"))
    each = counts.select("centre", "k", "rest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = each.where("rest").select("centre", F.col("k").alias("lk"), F.col("part").alias("lp"), F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    pairs = left.join(each, ["centre", "k"]).where("not rest OR k > lk OR (k = lk AND part >= lp)")
    pairs = pairs.withColumn("task", F.xxhash64("centre", "lk", "lp", "k", "rest", "part"))
    same = F.col("rest") & (F.col("k") == F.col("lk")) & (F.col("part") == F.col("lp"))
    ends = pairs.select("task", "centre", F.inline(F.array(
        F.struct(F.col("lk").alias("k"), F.lit(True).alias("rest"), F.col("lp").alias("part"), F.when(same, 2).otherwise(0).alias("side")),
        F.struct(F.col("k").alias("k"), F.col("rest").alias("rest"), F.col("part").alias("part"), F.when(same, 2).otherwise(1).alias("side")),
    ))).distinct()
    return rows.join(ends, ["centre", "k", "rest", "part"]).select("task", "node", "root", "side", F.lit(False).alias("first"))


def _joined(docs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """(doc_id, key, n, root, component_id) of every document; root is its component's least node, or its key without one."""
    spark = docs.sparkSession
    rows = docs.count()
    bits = min(MOST, SKETCH + max(0, (rows - 1) // 1_000_000).bit_length())
    scanned = materialise(scan(docs, words_each, bits), "sets")
    documents = scanned.where(F.col("segment").isNull()).select("doc_id", "key", "n", "node")
    prefix_rows = documents.agg(F.sum(F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)).first()[0] or 0
    grouped = materialise(groups(prefixes(docs, frequency_classes(scanned, bits), words_each, percent), partitions(spark, 24 * int(prefix_rows))), "groups")
    members = materialise(dealt(families(grouped), percent), "families")
    discard(spark, grouped)
    of_members = scanned.where("node IS NOT NULL").join(members.select("node").distinct(), "node", "left_semi")
    nodes = materialise(of_members.groupBy("node").agg(F.min(F.struct("key", "n", "points")).alias("m")).select("node", "m.*"), "nodes")
    task = F.xxhash64("centre", "k", "part").alias("task")
    meeting = members.select(task, "node", F.col("node").alias("root"), F.lit(2).alias("side"), (F.col("node") == F.col("centre")).alias("first"))
    # the centre is in each part of a larger family
    guests = members.where("large AND node <> centre").select(task, F.col("centre").alias("node"), F.col("centre").alias("root"), F.lit(2).alias("side"), F.lit(True).alias("first"))
    first = materialise(shipped(docs, meeting.union(guests).distinct(), nodes, words_each, percent), "links")
    roots = components(first)
    if not members.where("large").isEmpty():
        tasks = materialise(across(members.where("large"), roots), "open")
        if not tasks.isEmpty():
            more = materialise(shipped(docs, tasks, nodes, words_each, percent), "links")
            named = lambda c: F.coalesce(F.col(f"root_{c}"), F.col(c)).alias(c)
            side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
            joined = more.join(side("a"), "a", "left").join(side("b"), "b", "left").select(named("a"), named("b"))
            roots = components(joined.union(roots.select("node", "root")))
    least = documents.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    joined = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.select("node", "root").join(heads, "root")
    out = documents.join(named, "node", "left")
    return out.select("doc_id", "key", "n", F.coalesce("root", "key").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_join(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return _joined(docs, words_each, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the least id.

    Of rows with equal id and text the one of the least hash of all columns stays. Rows of one id with different texts
    are documents of their own; rows without an id stay as they are and never stand for others.
    """
    joined = _joined(docs, words_each, percent).where(F.col("doc_id").isNotNull())
    # two branches below read them: one plan of all that leads to them would start all its exchanges at once, twice
    heads = materialise(joined.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("m")).select("m.key").distinct(), "heads")
    key, row = fresh(docs, "key"), fresh(docs, "row")
    known = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).withColumn(row, F.xxhash64(*(F.to_json(F.struct(c)) if _unhashable(docs.schema[c].dataType) else F.col(c) for c in docs.columns)))
    kept = known.where(F.col("doc_id").isNotNull()).join(heads.select(F.col("key").alias(key)), key, "left_semi")
    least = kept.groupBy(key).agg(F.min(row).alias(row))
    kept = kept.join(least, [key, row], "left_semi").dropDuplicates([key, row]).select(*docs.columns)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def _unhashable(kind) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()
