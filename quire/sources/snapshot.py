"""A parsed vault kept as Parquet tables: save, load with checks, refresh of some notes, staleness, removal."""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.model import NOTES
from quire.operators import search as S
from quire.sources.vault import good

FORMAT = 1


def _inside(path: str, root: str) -> str:
    """The path, if it lies below the root."""
    full, top = os.path.realpath(path), os.path.realpath(root)
    if not full.startswith(top + os.sep):
        raise ValueError(f"{path} isn't inside {root}")
    return full


def _body():
    return F.array_join(F.transform(F.filter("lines", lambda x: x["kind"].isin("body", "code")), lambda x: x["raw"]), "\n")


def save(notes: DataFrame, root: str, name: str = ".quire-index", stemming: bool = True, language: str | None = None) -> str:
    """Write notes and their inverted index beside each other, then put them in place by one rename."""
    target = _inside(os.path.join(root, name), root)
    new = f"{target}.{uuid.uuid4().hex}"
    notes.write.parquet(f"file://{new}/notes")
    rows = notes.sparkSession.read.schema(StructType.fromDDL(NOTES)).parquet(f"file://{new}/notes")
    index = S.build_index(good(rows), S.document_text(F.col("title"), _body()), stemming=stemming, lang=S.language_of(F.col("properties"), language))
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"file://{new}/postings")
    index.doc_stats.write.parquet(f"file://{new}/doc_stats")
    with open(f"{new}/meta.json", "w", encoding="utf-8") as f:
        json.dump({"format": FORMAT, "created_at": time.time(), "stemming": stemming}, f)
    if os.path.exists(target):
        old = f"{target}.old-{uuid.uuid4().hex}"
        os.rename(target, old)
        os.rename(new, target)
        shutil.rmtree(old)
    else:
        os.rename(new, target)
    return target


def load(spark: SparkSession, root: str, name: str = ".quire-index") -> tuple[DataFrame, S.Index] | None:
    """(notes, index), or None where there is no snapshot of this format: then the vault is to be scanned."""
    target = os.path.join(root, name)
    try:
        with open(os.path.join(target, "meta.json"), encoding="utf-8") as f:
            meta = json.load(f)
    except (OSError, ValueError):
        return None
    if meta.get("format") != FORMAT:
        return None
    uri = "file://" + os.path.realpath(target)
    schema = StructType.fromDDL(NOTES)
    if {f.name for f in spark.read.parquet(f"{uri}/notes").schema} != {f.name for f in schema}:
        return None
    return spark.read.schema(schema).parquet(f"{uri}/notes"), S.Index(spark.read.parquet(f"{uri}/postings"), spark.read.parquet(f"{uri}/doc_stats"), meta["stemming"])


def open_vault(spark: SparkSession, root: str, name: str = ".quire-index") -> tuple[DataFrame, S.Index | None]:
    """The snapshot if there is a fresh one, else a scan."""
    from quire.sources.vault import read_vault

    if not stale(root, name) and (held := load(spark, root, name)):
        return held
    return read_vault(spark, root), None


def stale(root: str, name: str = ".quire-index") -> bool:
    """Whether the vault or a folder or note of its top level changed a second or more after the snapshot."""
    try:
        with open(os.path.join(root, name, "meta.json"), encoding="utf-8") as f:
            created = json.load(f)["created_at"]
    except (OSError, ValueError, KeyError):
        return True
    newest = max((e.stat().st_mtime for e in os.scandir(root) if e.name != name and not e.name.startswith(".")), default=0)
    return newest > created + 1


def refresh(notes: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The notes with changed ones in place of their old rows, and without the removed."""
    keys = changed.select("rel_path")
    gone = keys if removed is None else keys.union(removed.select("rel_path"))
    return notes.join(gone.distinct(), "rel_path", "left_anti").unionByName(changed)


def refresh_index(index: S.Index, changed: DataFrame, removed: DataFrame | None = None, language: str | None = None) -> S.Index:
    """The inverted index that goes with refresh(): changed notes indexed anew, old rows of theirs and of removed ones left out."""
    new = S.build_index(good(changed), S.document_text(F.col("title"), _body()), stemming=index.stemming, lang=S.language_of(F.col("properties"), language))
    gone = changed.select("rel_path") if removed is None else changed.select("rel_path").union(removed.select("rel_path"))
    return S.refreshed(index, new, gone)


def renamed(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """The notes with those of moves (rel_path, dest, state 'move') under their new paths."""
    going = moves.where("state = 'move'").select("rel_path", "dest")
    return notes.join(going, "rel_path", "left").withColumn("rel_path", F.coalesce("dest", "rel_path")).select(*notes.columns)


def drop(root: str, name: str = ".quire-index") -> bool:
    """Remove a snapshot; only what is one, inside the root."""
    target = _inside(os.path.join(root, name), root)
    if not os.path.exists(os.path.join(target, "meta.json")):
        return False
    shutil.rmtree(target)
    return True
