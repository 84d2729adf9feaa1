"""A folder of Markdown notes as DataFrames: discovery, one-pass parsing, and the tables below a note."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.markdown import parse_note, property_type
from quire.functions.text import glob_regex, percent_decoded
from quire.model import META, NOTES

MAX_FILE = 100 << 20


def ignore_rules(root: str) -> list[tuple[bool, str]]:
    """(whether it ignores, regular expression of whole relative paths) of the rows of all .gitignore files, in their order.

    A row of a nested file holds below its folder; the last rule that a path meets decides, so `!pattern` admits again.
    """
    out = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n != ".git")
        if ".gitignore" not in files:
            continue
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        above = "" if rel == "." else rel + "/"
        with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
            rows = [x.rstrip("\n").rstrip("\r").rstrip() for x in f]
        for row in rows:
            if not row or row.startswith("#"):
                continue
            ignores = not row.startswith("!")
            row = row if ignores else row[1:]
            tops = "/" in row.rstrip("/")
            base = glob_regex(above + ("" if tops else "**/") + row.strip("/"))[1:-1]
            # a folder's rule holds for all below it; one that ends in a slash for that alone
            out.append((ignores, f"^{base}/.*$" if row.endswith("/") else f"^{base}(/.*)?$"))
    return out


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the last rule that a path meets ignores it."""
    state = F.lit(False)
    for ignores, pattern in rules:
        state = F.when(path.rlike(pattern), F.lit(ignores)).otherwise(state)
    return state


def empty_notes(root: str, hidden: list[str]) -> list[tuple]:
    """(rel_path, modified, "") of notes without a byte, which Spark's file readers pass over."""
    out = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n[0] not in "._" or os.path.abspath(os.path.join(folder, n)) in hidden)
        for name in files:
            path = os.path.join(folder, name)
            if name.endswith(".md") and name[0] not in "._" and os.path.getsize(path) == 0:
                out.append((os.path.relpath(path, root).replace(os.sep, "/"), datetime.fromtimestamp(os.path.getmtime(path), UTC).replace(microsecond=0), ""))
    return out


def too_large(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, size) of notes that discovery leaves out for their size; callers warn of them."""
    base = (root if "://" in root else "file://" + os.path.abspath(root)).rstrip("/")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(base)
    rows = files.where(F.col("length") > MAX_FILE).select("path", F.col("length").alias("size"))
    full = percent_decoded(F.regexp_replace("path", "^file:/+", "file:///"))
    return rows.select(F.substring(full, F.lit(len(re.sub("^file:/+", "file:///", base)) + 2), F.lit(1 << 20)).alias("rel_path"), "size")


def discover(spark: SparkSession, root: str, include: list[str] | None = None) -> DataFrame:
    """(rel_path, modified, text) of the folder's notes; hidden folders only where `include` admits them, .git never."""
    root = root.rstrip("/")
    base = (root if "://" in root else "file://" + os.path.abspath(root)).rstrip("/")

    def load(path, **options):
        # as bytes, so that broken UTF-8 is mended and not refused
        reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.md")
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.load(path).where(F.col("length") <= MAX_FILE).select(F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"))

    files = load(base, recursiveFileLookup="true")
    hidden = []
    if include and "://" not in root:
        for folder, names, _ in os.walk(root):
            names[:] = sorted(n for n in names if n != ".git")
            rel = os.path.relpath(folder, root).replace(os.sep, "/")
            if re.search(r"(^|/)[._]", rel) and rel != "." and any(re.match(glob_regex(g), rel) or re.match(glob_regex(g), rel + "/x.md") for g in include):
                hidden.append(folder)
    for folder in hidden:
        files = files.unionByName(load("file://" + os.path.abspath(folder)))
    full = percent_decoded(F.regexp_replace("path", "^file:/+", "file:///"))
    rel = F.substring(full, F.lit(len(re.sub("^file:/+", "file:///", base)) + 2), F.lit(1 << 20))
    out = files.select(rel.alias("rel_path"), "modified", "text")
    if "://" not in root and (blank := empty_notes(root, [os.path.abspath(h) for h in hidden])):
        out = out.unionByName(spark.createDataFrame(blank, "rel_path string, modified timestamp, text string"))
    rules = ignore_rules(root) if "://" not in root else []
    return out.where(~ignored(F.col("rel_path"), rules)) if rules else out


def _items(value) -> list[dict]:
    kind = {"checkbox": "checkbox", "number": "number", "null": "null"}
    out = []
    for v in value if isinstance(value, list) else [value]:
        if isinstance(v, str):
            out.append({"kind": "text", "text": v})
        elif isinstance(v, (dict, list)):
            out.append({"kind": "object", "text": json.dumps(v, ensure_ascii=False)})
        else:
            out.append({"kind": kind[property_type(v)], "text": json.dumps(v)})
    return out


def property_rows(properties: dict) -> list[dict]:
    return [{"name": k, "ord": i, "type": property_type(v), "json": json.dumps(v, ensure_ascii=False), "items": _items(v)} for i, (k, v) in enumerate(properties.items())]


def note_row(path: str, modified: datetime, text: str, body: bool = True) -> dict:
    """A note as a row of NOTES, or of META alone."""
    n = parse_note(text or "", body)
    row = {"rel_path": path, "modified": modified, "parse_error": n.error, "properties": property_rows(n.properties), "tags": n.tags, "title": n.title, "front_lines": n.front_lines}
    if body:
        row |= {"sections": n.sections, "tasks": n.tasks, "links": n.links, "lines": [vars(x) for x in n.lines], "text": text}
    return row


def parse(files: DataFrame, body: bool = True) -> DataFrame:
    """Notes from (rel_path, modified, text): all nested tables in one pass over each text, or the frontmatter alone."""
    return by_note(files, lambda *note: note_row(*note, body), NOTES if body else META)


def by_note(files: DataFrame, row_of: Callable[[str, datetime, str], dict], ddl: str) -> DataFrame:
    """A row for each of (rel_path, modified, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def rows(batches):
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, len(batch), 64)):
                out = [row_of(*note) for note in zip(*(part.column(n).to_pylist() for n in ("rel_path", "modified", "text")), strict=True)]
                yield pa.RecordBatch.from_pylist(out, arrow)

    return files.select("rel_path", F.col("modified").cast("timestamp").alias("modified"), "text").mapInArrow(rows, schema)


def read_vault(spark: SparkSession, root: str, include: list[str] | None = None, body: bool = True) -> DataFrame:
    return parse(discover(spark, root, include), body)


def kept(df: DataFrame) -> DataFrame:
    """df as Parquet in a new folder below spark.checkpoint.dir, read again: what is made of it doesn't parse its texts again.

    With a local master a temporary folder takes that one's place where it is unset; elsewhere df stays as it is.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            return df
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
    path = f"{base.rstrip('/')}/quire-notes-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def good(notes: DataFrame) -> DataFrame:
    """Notes whose frontmatter can be read; queries see only these."""
    return notes.where("parse_error IS NULL")


def child(notes: DataFrame, column: str) -> DataFrame:
    """A nested table of notes as rows: properties, sections, tasks, links or lines."""
    return notes.select("rel_path", F.posexplode(column).alias("ord", "row")).select("rel_path", F.col("ord").alias("position"), "row.*")


def typed_properties(**columns: Column) -> Column:
    """The properties array from named columns of any table; null counts as a missing key, arrays as lists."""
    rows = []
    for i, (name, c) in enumerate(columns.items()):
        rows.append((i, name, c))
    return F.filter(F.array(*(_property(i, n, c) for i, n, c in rows)), lambda p: p["json"].isNotNull())


def _property(i: int, name: str, c: Column) -> Column:
    text = c.cast("string")
    kind = F.typeof(c)
    json_text = F.to_json(F.array(c))
    json_text = F.when(c.isNotNull(), F.substring(json_text, F.lit(2), F.length(json_text) - 2))
    numeric = kind.isin("tinyint", "smallint", "int", "bigint", "float", "double") | kind.startswith("decimal")
    type_ = (
        F.when(kind == "boolean", "checkbox").when(numeric, "number").when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "date")
        .when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"), "datetime").otherwise("text")
    )
    item = F.struct(F.when(kind == "boolean", "checkbox").when(numeric, "number").otherwise("text").alias("kind"), text.alias("text"))
    return F.struct(F.lit(name).alias("name"), F.lit(i).alias("ord"), type_.alias("type"), json_text.alias("json"), F.array(item).alias("items"))


def json_properties(c: Column) -> Column:
    """The properties array from a column of JSON objects; a value's type is read off its JSON text."""
    pairs = F.map_entries(F.from_json(c, "map<string, string>"))
    def one(e: Column, i: Column) -> Column:
        value = e["value"]
        kind = F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").when(value.isin("true", "false"), "checkbox").when(value.isNull(), "null").when(value.startswith("["), "list").otherwise("text")
        return F.struct(e["key"].alias("name"), i.alias("ord"), kind.alias("type"), F.coalesce(value, F.lit("null")).alias("json"), F.array(F.struct(kind.alias("kind"), value.alias("text"))).alias("items"))

    return F.transform(pairs, one)
