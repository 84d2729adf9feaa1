"""What the operators share: the shared working folder, materialised tables, ragged numpy helpers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_local: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder's URI below the one that the cluster names in spark.checkpoint.dir.

    Only with a local master (tests, a laptop) a local temporary folder takes its place where that is unset; executors
    elsewhere wouldn't find each other's files there, so on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="quire-")
        base = _local[app]
    path = f"{base.rstrip('/')}/quire-{purpose}-{uuid.uuid4().hex}"
    _written.setdefault(app, []).append(path)
    return path


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove what was written for these frames (of materialise), or all of this application if none is given.

    Frames that read from there can't be computed any more.
    """
    known = _written.get(spark.sparkContext.applicationId, [])
    files = [f for df in frames for f in df.inputFiles()]
    for path in list(known):
        if not frames or any("/" + path.rsplit("/", 1)[1] + "/" in f for f in files):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            known.remove(path)


#: Bytes of rows that Spark hands to Python at once at most; texts and sets would fill 64 MB else, in every task twice.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def size_of(setting: str) -> int:
    """Bytes that a size like 4194304, 64m or 1GB stands for."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def small_batches(spark: SparkSession) -> None:
    if size_of(spark.conf.get(BATCH[0])) > BATCH[1]:
        spark.conf.set(*map(str, BATCH))


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> None:
    """Hand memory that is free in the driver back to the system.

    Spark starts a thread for each exchange, and the C library's pools of all these threads keep what they once held,
    which is more than the heap. The heap is collected where over half of what it may take is in use or kept free.
    """
    java = spark._jvm.java.lang
    heap = java.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        heap.gc()
    with contextlib.suppress(Py4JError):  # another Java or system hasn't got the command
        call = spark.sparkContext._gateway.new_array(java.Object, 4)
        call[0], call[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # the server's own class isn't open to Py4J, its interface is
        invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), call)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession, size: int) -> int:
    """Shuffle partitions for so many bytes: those of the session, or more of them if they would pass 64 MB."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bits of a bitmap of hashes, a power of two, and bytes of the segments that it is sent in.
BITS, SEGMENT = 24, 1 << 16


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """Flags by the upper bits of all hashes in a column: 2 MB on the driver whatever the table's size.

    Tasks set their own bits; segments are or-ed in groups. None of the hashes is missed, so it only ever rules out.
    """

    def mark(batches):
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            bits[(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)] = True
        packed = np.packbits(bits).reshape(-1, SEGMENT)
        full = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([packed[i].tobytes() for i in full], pa.binary())], ["segment", "bits"])

    out = np.zeros(((1 << BITS) // 8 // SEGMENT, SEGMENT), np.uint8)
    marked = rows.select(column).mapInArrow(mark, "segment long, bits binary")
    for segment, bits in folded(marked, np.uint8, np.bitwise_or, lambda x: x):
        out[segment] = bits
    return np.unpackbits(out.reshape(-1)).astype(bool)


def folded(rows: DataFrame, kind: type, operation: np.ufunc, finish) -> list[tuple[int, np.ndarray]]:
    """(segment, array of bytes) of rows (segment, bytes): those of a segment are folded one after the other, in a stream.

    No group is held; what reaches the driver has the size of the segments.
    """
    segment, content = rows.columns

    def fold(batches):
        at = total = None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([finish(total).astype(np.uint8).tobytes()], pa.binary())], ["segment", "content"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.uint8)
                if k != at:
                    if total is not None:
                        yield row()
                    at, total = k, x.astype(kind)
                else:
                    operation(total, x, out=total, casting="unsafe")
        if total is not None:
            yield row()

    dealt = rows.select(F.col(segment).cast("long"), content).repartition(segment).sortWithinPartitions(segment)
    return [(r["segment"], np.frombuffer(r["content"], np.uint8)) for r in dealt.mapInArrow(fold, "segment long, content binary").collect()]


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or plain path; executors open shared files through it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(offsets: np.ndarray, most: int):
    """(first, last) rows, a consecutive cover in which each has at most `most` bytes or is one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0].., starts[1].. and so on, lengths[i] of each."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: The bytes of a block that a rest of 0 to 8 bytes fills.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed one by one.
LONG_SPAN = 256


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes, never 0, of data[starts[i]:ends[i]]: equal bytes get equal hashes anywhere.

    Eight bytes at a time go through splitmix64's finaliser, which no two of them leave alike; spans over LONG_SPAN
    bytes through XXH3. Hashes of different seeds are independent.
    """
    n = ends - starts
    blocks = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(n.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64)))
    factor = np.uint64(0xD6E8FEB86659FD93 + 2 * seed)
    h = mix(h ^ (blocks[starts] & _MASKS[np.minimum(n, 8)]) * factor)
    live = np.flatnonzero((n > 8) & (n <= LONG_SPAN))
    at, left = starts[live] + 8, n[live] - 8
    while len(live):
        h[live] = mix(h[live] + mix((blocks[at] & _MASKS[np.minimum(left, 8)]) * factor + np.uint64(1)))
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    if len(long := np.flatnonzero(n > LONG_SPAN)):
        import xxhash

        raw = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    h[h == 0] = 1
    return h


class HashTable:
    """Open addressing in numpy: 64-bit keys other than 0, and the int64 value of each."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int = -1) -> np.ndarray:
        at = self._slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], missing)
        left = np.flatnonzero((there != keys) & (there != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], at[on]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct, not yet in the table."""
        self.size += len(keys)
        left, at = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = keys[left[free]]
            won = free[self.keys[at[free]] == keys[left[free]]]
            self.values[at[won]] = values[left[won]]
            on = np.ones(len(left), bool)
            on[won] = False
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
