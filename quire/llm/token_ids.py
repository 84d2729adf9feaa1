"""Token ids of a corpus as binary shards: Simple-8b words, read back block by block.

Texts are dealt and sorted by document id, and each document's ids are cut into blocks of BLOCK and the last block's
rest, which are packed as soon as they are there: a task holds no more ids than those of a chunk of text.

Shard layout, all little-endian:
  8 bytes  b"QUIRES8C"
  4 x u64  documents, blocks, words, ids per block
  documents x i64   document ids, and documents x u8  1 where the id is null
  documents x u64   ids of each document, which gives its blocks and the ids of each
  (blocks + 1) x u64      where each block starts among the words
  words x u64
  u32      crc32 of all before it
A word holds a selector in its upper 4 bits and in the others as many ids as the selector says, the first lowest.
Selector 15 is the escape: the word after it is one value of up to 64 bits. Words never cross a block, so blocks
decode apart from each other, and all words of one selector decode in one numpy step.

Defined cases: a null or empty text is the end id alone; a very long text is packed like any other, in a shard that may
pass SHARD_WORDS by it; documents of equal or null id are kept (null ids come first), ordered by a hash of their text
and the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.pretokens import encoded, encoder
from quire.llm.shared import file_system, materialise, partitions, work_dir

MAGIC = b"QUIRES8C"
#: Fixed values of the format: ids in a word and bits of each, by selector; 60 bits at most are used.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60, 64])
ESCAPE = 15
BLOCK = 256
#: A shard is closed at the first chunk of text with which it holds so many words, some 4 MB; the most words that are decoded at once.
SHARD_WORDS, SLAB = 500_000, 100_000
#: Blocks that are packed at once.
BLOCKS = 2048


def blocks_of(lengths: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """How many ids each block has of rows of so many ids; no block crosses rows."""
    n = -(-lengths // block)
    out = np.full(int(n.sum()), block, np.int64)
    last = np.cumsum(n)[n > 0] - 1
    out[last] = (lengths - (n - 1) * block)[n > 0]
    return out


def pack(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each block) of blocks of so many values; some BLOCKS of them advance together, one word each a round."""
    values, ends = np.ascontiguousarray(values, np.uint64), np.cumsum(sizes)
    parts = []
    for i in range(0, len(sizes), BLOCKS):
        own = sizes[i : i + BLOCKS]
        first = int(ends[i] - own[0])
        parts.append(_packed(values[first : first + int(own.sum())], own))
    words, counts = zip(*parts, strict=True) if parts else ([np.zeros(0, np.uint64)], [np.zeros(0, np.int64)])
    return np.concatenate(words), np.concatenate(counts)


def _packed(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = int(sizes.max())
    stop = np.cumsum(sizes)
    # by block and place, with places after the end, which any selector may cover
    need = np.zeros((len(sizes), width), np.uint64)
    need[np.arange(width) < sizes[:, None]] = values
    choice = np.full((len(sizes), width), ESCAPE, np.int8)
    for s in range(13, -1, -1):
        fits = np.ones((len(sizes), width + int(COUNTS[s]) - 1), bool)
        fits[:, :width] = need < np.uint64(1 << int(BITS[s]))
        reach = 1
        while reach < COUNTS[s]:  # fits: of `reach` places from here on, all
            step = min(reach, int(COUNTS[s]) - reach)
            fits = fits[:, :-step] & fits[:, step:]
            reach += step
        choice[fits] = s
    choice = choice[np.arange(width) < sizes[:, None]]
    at, out, of, live = stop - sizes, [], [], np.arange(len(sizes))
    while len(live):
        here = at[live]
        s = choice[here].astype(np.int64)
        take = np.minimum(COUNTS[s], stop[live] - here)
        word = s.astype(np.uint64) << np.uint64(60)
        for k in range(int(take.max())):
            on = np.flatnonzero((take > k) & (s != ESCAPE))
            word[on] |= values[here[on] + k] << (BITS[s[on]] * k).astype(np.uint64)
        out.append(word)
        of.append(live)
        if (escaped := s == ESCAPE).any():
            out.append(values[here[escaped]])
            of.append(live[escaped])
        at[live] = here + take
        live = live[at[live] < stop[live]]
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(out)[order], np.bincount(of, minlength=len(sizes))


def unpack(words: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of blocks of so many words and values each."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    head = np.zeros(len(words) + 1, bool)
    head[np.cumsum(counts) - counts] = True
    raw = np.zeros(len(words), bool)
    # a word is raw if the one before it in its block is an escape that isn't raw itself
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw[i] and i + 1 < len(words) and not head[i + 1]:
            raw[i + 1] = True
    held = np.where(raw, 0, COUNTS[selector])
    of = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(held) - held
    ends = np.cumsum(sizes)
    begin = ends - sizes
    place = before - before[(np.cumsum(counts) - counts)[of]] + begin[of]
    stop = ends[of]
    out = np.zeros(int(sizes.sum()), np.uint64)
    for s in range(ESCAPE):
        w = np.flatnonzero((selector == s) & ~raw)
        for k in range(int(COUNTS[s])):
            w = w[place[w] + k < stop[w]]
            out[place[w] + k] = words[w] >> np.uint64(BITS[s] * k) & np.uint64((1 << int(BITS[s])) - 1)
    w = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[place[w]] = words[w + 1]
    return out


def to_bytes(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, counts: np.ndarray, words: bytes) -> bytes:
    """A shard of documents with so many ids, blocks of so many words, and the words."""
    head = np.array([len(doc_ids), len(counts), len(words) // 8, BLOCK], "<u8")
    starts = np.append(0, np.cumsum(counts)).astype("<u8")
    body = b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), lengths.astype("<u8").tobytes(), starts.tobytes(), words])
    return body + zlib.crc32(body).to_bytes(4, "little")


def from_bytes(raw: bytes):
    """(document ids, null flags, ids of each, a generator of (document, its ids)); raises ValueError on a damaged shard."""
    if raw[:8] != MAGIC or len(raw) < 44 or zlib.crc32(memoryview(raw)[:-4]) != int.from_bytes(raw[-4:], "little"):
        raise ValueError("not a whole shard")
    docs, blocks, n_words, block = np.frombuffer(raw, "<u8", 4, 8).astype(int).tolist()
    at, parts = 40, []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", blocks + 1), ("<u8", n_words)):
        parts.append(np.frombuffer(raw, kind, count, at))
        at += parts[-1].nbytes
    doc_ids, nulls, lengths, starts, words = parts
    lengths, starts = lengths.astype(np.int64), starts.astype(np.int64)
    return doc_ids, nulls.astype(bool), lengths, _decoded(lengths, starts, words, block)


def _decoded(lengths: np.ndarray, starts: np.ndarray, words: np.ndarray, block: int):
    """(first document, ids, offsets) by slabs of whole documents."""
    per = -(-lengths // block)
    upto = np.append(0, np.cumsum(per))  # blocks before each document
    first = 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(starts[upto], starts[upto[first]] + SLAB, "right")) - 1)
        a, b = upto[first], upto[last]
        own = lengths[first:last]
        yield first, unpack(words[starts[a] : starts[b]], np.diff(starts[a : b + 1]), blocks_of(own, block)), np.append(0, np.cumsum(own))
        first = last


def packed(batches, path: str, end_id: int):
    """Of batches (doc_id, text): (doc_ids, ids of each, words of each block, words) by chunks of text, with the end ids."""
    for batch in batches:
        for first, ids, off in encoded(batch.column(1), path):
            lengths = np.diff(off) + 1
            words, counts = pack(np.insert(ids, off[1:], end_id), blocks_of(lengths))
            yield batch.column(0).slice(first, len(lengths)), lengths, counts, words


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the corpus in ascending id order; a row (part, seq, path, n_docs, n_ids) for each shard.

    A file's name has its task attempt in it, and only attempts that end well hand in rows: a retried or
    doubled task never spoils the result.
    """

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = file_system(folder)
        held, size, seq = [], 0, 0

        def close():
            doc_ids, nulls, lengths, counts, words = (np.concatenate(x) for x in zip(*held, strict=True))
            file = f"{base}/shard-{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.s8b"
            with fs.open_output_stream(file) as f:
                f.write(to_bytes(doc_ids, nulls, lengths, counts, words.astype("<u8").tobytes()))
            held.clear()
            return pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [file], "n_docs": [len(lengths)], "n_ids": [int(lengths.sum())]})

        fs.create_dir(base, recursive=True)
        for doc, lengths, counts, words in packed(batches, path, end_id):
            held.append((doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), lengths, counts, words))
            size += len(words)
            if size >= SHARD_WORDS:
                yield close()
                seq, size = seq + 1, 0
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(partitions(docs.sparkSession, volume), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return materialise(ordered.drop("tie").mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long"), "shards")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a manifest.

    The driver sums ids by part only, a row for each task that wrote.
    """
    sums = sorted(manifest.groupBy("part").agg(F.sum("n_ids"), F.count("*")).collect())
    starts = np.concatenate([[0], np.cumsum([r[1] for r in sums])]).astype(int).tolist()
    bases = spark.createDataFrame([(r[0], b) for r, b in zip(sums, starts, strict=False)], "part int, base long")
    from pyspark.sql import Window

    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.join(F.broadcast(bases), "part").select("path", (F.col("base") + F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).alias("base"))
    n_files = max(1, int(sum(r[2] for r in sums)))

    def read(batches):
        encoder.cache_clear()  # what this worker met when it wrote isn't needed any more
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = file_system(path)
                with fs.open_input_stream(name) as f:
                    doc_ids, nulls, lengths, slabs = from_bytes(f.read())
                for first, ids, off in slabs:
                    own = slice(first, first + len(off) - 1)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[own], pa.int64(), mask=nulls[own]), pa.array(off[:-1] + base), pa.array(lengths[own]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    base += int(off[-1])

    return files.repartition(min(n_files, 10_000), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write the corpus as shards and return what reading them gives."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, work_dir(spark, "ids"), path, end_id))
