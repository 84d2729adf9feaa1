"""WARC archives in Zstandard frames: a writer, and a reader that checks what it reads.

An archive starts with a skippable frame (0x184D2A5D) that holds a dictionary; then comes one frame for each record.
The reader loads the dictionary from the leading frame, decodes frame after frame, and raises ValueError where a
header is missing or malformed, a length disagrees with the record or a digest with the payload.

Of pages with equal payloads of at least `least` bytes the one of the largest id is the response and the others are
revisits that name its record. Only digests travel to be counted. Pages whose digest's bucket is none of those that
repeat are written where they are, and so are the revisits of digests that repeat often, which are few enough to be
broadcast; the other pages move once, to meet their digests, of which none has more than `OFTEN` pages or a 100,000th
of all.

Defined cases: a null html is the empty payload; pages of null id are responses and no revisit refers to them; pages
of equal id and payload are all responses if theirs is the largest id, and revisits name the first of them; every
record's id is its own; a null url is left out of the record; a very long page is one record like any other, in an
archive that may pass SHARD_BYTES by it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import file_system, materialise, work_dir

#: Fixed values of the format.
SKIPPABLE, VERSION = 0x184D2A5D, b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is trained on so many pages at most, the lowest by a hash of their id, and so many bytes of each.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 300, 20_000, 32_768
SHARD_BYTES = 64 << 20
FEED = 1 << 16
#: Pages of one digest from which on its revisits stay in place.
OFTEN = 1000
#: Binary logarithm of the buckets of digests that are broadcast at most.
BUCKETS = 20


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def response_id(page_id: int, payload_digest: str) -> str:
    """The record id of the response that revisits of a payload refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'response {page_id} {payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str = "", referred: bool = False) -> bytes:
    """One record: a revisit, which keeps the HTTP header alone, if it refers to another page.

    place: what no other record shares; referred: whether this is the record that revisits refer to.
    """
    kind, digest = "response" if refers_to is None else "revisit", digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    own = response_id(page_id, digest) if referred else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record {place}')}>"
    head = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": "1970-01-01T00:00:00Z"}
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url)
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": response_id(refers_to, digest), "WARC-Refers-To-Page-ID": str(refers_to)}
    if page_id is not None:
        head["WARC-Page-ID"] = str(page_id)
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b"", block, b"", b""])


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, by the dictionary in its leading frame."""
    held = stream.read(8)
    dictionary = None
    if len(held) == 8 and struct.unpack("<I", held[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", held[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise ValueError("the dictionary's frame is cut off")
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, held = zstandard.ZstdCompressionDict(raw), b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            held = held or stream.read(FEED)
            if not held:
                if parts:
                    raise ValueError("a frame is cut off")
                return
            try:
                parts.append(frame.decompress(held))
            except zstandard.ZstdError as e:
                raise ValueError(f"damaged frame: {e}") from None
            held = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """A record's fields, checked: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    fields = dict(x.split(b": ", 1) for x in lines if b": " in x)
    if version != VERSION or not gap or len(fields) != len(lines):
        raise ValueError("malformed record header")
    for name in (b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"WARC-Payload-Digest", b"Content-Length"):
        if name not in fields:
            raise ValueError(f"no {name.decode()}")
    size = int(fields[b"Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length isn't its Content-Length")
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)", http)
    kind, digest = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode()
    if not gap or not length or kind not in ("response", "revisit") or not digest.startswith("sha1:"):
        raise ValueError("malformed block or type")
    n, digest = int(length[1]), digest.removeprefix("sha1:")
    page = int(fields[b"WARC-Page-ID"]) if b"WARC-Page-ID" in fields else None
    refers = None
    if kind == "response":
        if n != len(payload) or digest != digest_of(payload):
            raise ValueError("the payload isn't that of its length and digest")
    else:
        match = re.fullmatch(rb"-?\d+", fields.get(b"WARC-Refers-To-Page-ID", b""))
        refers = int(match[0]) if match else None
        if payload or refers is None or fields.get(b"WARC-Refers-To", b"").decode() != response_id(refers, digest):
            raise ValueError("a revisit has a payload or refers to nothing")
    return {"page_id": page, "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": refers, "payload": payload}


def dictionary_of(pages: DataFrame) -> bytes:
    """A dictionary trained on a bounded sample; empty if there is too little to train on."""
    rows = pages.where(F.col("html").isNotNull()).withColumn("__key", F.xxhash64("page_id"))
    # ids first: each task offers SAMPLE of them, and bytes come of the chosen alone
    chosen = F.broadcast(rows.select("__key").distinct().orderBy("__key").limit(SAMPLE))
    heads = rows.join(chosen, "__key").select("__key", F.expr(f"substring(encode(html, 'UTF-8'), 1, {SAMPLE_BYTES})").alias("head"))
    sample = [bytes(r["head"]) for r in heads.orderBy("__key", "head").limit(SAMPLE).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, [s for s in sample if s], level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write every page to archives in the folder; a row (path, records) for each archive."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    dictionary = dictionary_of(rows)
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = rows.withColumn("digest", F.when(F.octet_length(payload) >= least, F.sha1(payload)))
    repeated = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1 AND head IS NOT NULL")
    heads = materialise(repeated, "heads")
    often = max(OFTEN, (heads.agg(F.sum("n")).first()[0] or 0) // 100_000)
    bucket = F.conv(F.substring("digest", 1, -(-BUCKETS // 4)), 16, 10).cast("long").alias("bucket")
    hot = F.broadcast(heads.where(F.col("n") > often).select("digest", F.col("head").alias("hot")))
    rows = rows.join(hot, "digest", "left").join(F.broadcast(heads.where(F.col("n") <= often).select(bucket).distinct().withColumn("near", F.lit(True))), bucket == F.col("bucket"), "left").drop("bucket")
    # of a digest that repeats often only its responses move; a null page_id is no revisit
    stays = F.when(F.col("hot").isNotNull(), F.coalesce(F.col("page_id") != F.col("hot"), F.lit(True))).otherwise(F.col("near").isNull())
    still = rows.where(stays).select("page_id", "url", "html", F.when(F.col("page_id") < F.col("hot"), F.col("hot")).alias("refers_to"), F.lit(None).cast("string").alias("referred"))
    # dealt here, so that adaptive execution doesn't part pages of one digest
    moved = rows.where(~stays).drop("hot", "near").repartition("digest").join(heads.select("digest", "head").hint("merge"), "digest", "left")
    moved = moved.withColumn("referred", F.when(F.col("page_id") == F.col("head"), F.col("digest"))).sortWithinPartitions("referred")
    moved = moved.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("head"), F.col("head")).alias("refers_to"), "referred")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        encode = compressor(dictionary)
        seq = n = size = 0
        out = path = before = None

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

        for batch in batches:
            for page_id, url, html, refers, digest in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    path = f"{base}/pages-{task.partitionId():06d}-{seq:05d}-{task.taskAttemptId()}.warc.zst"
                    out = fs.open_output_stream(path, compression=None)  # the name would ask for another frame around all
                    out.write(archive_head(dictionary))
                # rows of one digest lie together: the first is the record that revisits refer to
                raw = record(page_id, url, (html or "").encode("utf-8"), refers, f"{path} {n}", digest is not None and digest != before)
                before = digest
                out.write(encode.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= SHARD_BYTES:
                    yield closed()
                    out, seq, n, size = None, seq + 1, 0, 0
        if out is not None:
            yield closed()

    return materialise(still.unionByName(moved).mapInArrow(write, "path string, records long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches):
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = file_system(path)
                held, n = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for raw in frames(stream):
                        fields = parse(raw)
                        held.append([fields[k] for k in names])
                        n += 1
                        if len(held) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                            held = []
                if n != records:
                    raise ValueError(f"{path} has {n} records, not {records}")
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    n_files = max(1, archives.count())
    return archives.select("path", "records").repartition(min(n_files, 10_000), "path").mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder and return what reading them gives."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, work_dir(spark, "warc"), least))
