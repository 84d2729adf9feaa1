"""Summaries of notes: properties, tags, folders, tasks, statuses, recent files, link health, odd values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import ascii_lower, percent_of


def properties_summary(properties: DataFrame) -> DataFrame:
    """(name, type, count, mixed_types) over rows (rel_path, name, type); several types make `mixed` with its parts."""
    by_type = properties.groupBy("name", "type").agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("type")))), lambda x: F.struct(x["type"].alias("type"), (-x["m"]).alias("count")))
    rows = by_type.groupBy("name").agg(F.sum("n").alias("count"), parts.alias("parts"))
    many = F.size("parts") > 1
    return rows.select("name", F.when(many, "mixed").otherwise(F.get("parts", F.lit(0))["type"]).alias("type"), "count", F.when(many, F.col("parts")).alias("mixed_types")).orderBy("name")


def property_types(properties: DataFrame) -> DataFrame:
    """(name, type, count) but for tags: a row for each type."""
    return properties.where("name <> 'tags'").groupBy("name", "type").agg(F.count("*").alias("count")).orderBy("name", "type")


def tags_summary(tags: DataFrame, by_count: bool = False) -> DataFrame:
    """(name, count) over rows (rel_path, ord, tag): tags equal but for the case of A to Z are one, spelt as first seen."""
    rows = tags.groupBy(ascii_lower(F.col("tag")).alias("key")).agg(F.min_by("tag", F.struct("rel_path", "ord")).alias("name"), F.count("*").alias("count"))
    return (rows.orderBy(F.col("count").desc(), "name") if by_count else rows.orderBy("key")).select("name", "count")


def folder_counts(paths: DataFrame, depth: int = 1) -> DataFrame:
    """(dir, count): folders cut to a depth, `.` for the top; the fullest first."""
    parts = F.split(F.regexp_extract("rel_path", "^(?:(.*)/)?[^/]*$", 1), "/")
    cut = F.array_join(F.slice(parts, 1, depth), "/") if depth else F.lit("")
    return paths.groupBy(F.when(cut == "", ".").otherwise(cut).alias("dir")).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), "dir")


def status_groups(values: DataFrame) -> DataFrame:
    """(status, count) over rows (rel_path, statuses array): each status of a note counts once."""
    each = values.select("rel_path", F.explode(F.array_distinct("statuses")).alias("status"))
    return each.groupBy("status").agg(F.count("*").alias("count")).orderBy("status")


def task_counts(tasks: DataFrame, *keys: str) -> DataFrame:
    """(total, done), by keys if any are given, over rows (.., done)."""
    return tasks.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("done").alias("done"))


def recent(notes: DataFrame, n: int = 10) -> DataFrame:
    """(rel_path, modified) of the newest, ties by path."""
    return notes.select("rel_path", "modified").orderBy(F.col("modified").desc(), "rel_path").limit(n)


def rare_values(values: DataFrame, most: int = 50) -> DataFrame:
    """(name, value, suggestion): text values met once within two edits of one met three times or more.

    Properties with more than `most` different values aren't looked at; values that differ in a final number alone aren't
    odd. Only values of the same property meet.
    """
    counts = values.groupBy("name", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("name").agg(F.count("*").alias("k")).where(F.col("k") <= most).select("name")
    counts = counts.join(few, "name", "left_semi")
    base = lambda c: F.regexp_replace(c, "[0-9]+$", "")
    rare = counts.where("n <= 1").select("name", "value")
    usual = counts.where("n >= 3").select("name", F.col("value").alias("usual"), F.col("n").alias("m"))
    near = rare.join(usual, "name").withColumn("d", F.levenshtein("value", "usual"))
    near = near.where(F.col("d").between(1, 2) & (base(F.col("value")) != base(F.col("usual"))))
    best = F.min_by("usual", F.struct((-F.col("m")).alias("m"), F.col("d"), F.col("usual")))
    return near.groupBy("name", "value").agg(best.alias("suggestion")).orderBy("name", "value")


def common_titles(matches: DataFrame, documents: int, common_words: set[str] = frozenset(), least: int | None = None) -> DataFrame:
    """(key, surface, count, share): titles met so often that linking them all is doubtful, or that are plain words.

    Over rows (surface): the most frequent spelling stands for a title; the bound is `least`, else 25 or a fortieth of the
    documents, rounded up.
    """
    per = matches.groupBy(ascii_lower(F.col("surface")).alias("key"), "surface").agg(F.count("*").alias("n"))
    rows = per.groupBy("key").agg(F.min_by("surface", F.struct((-F.col("n")).alias("m"), F.col("surface"))).alias("surface"), F.sum("n").alias("count"))
    total = rows.agg(F.sum("count").alias("total"))
    often = F.col("count") >= (max(25, -(-documents // 40)) if least is None else least)
    kept = rows.where(often | F.col("key").isin(*sorted(common_words)) if common_words else often)
    return kept.join(F.broadcast(total), F.lit(True)).select("key", "surface", "count", percent_of(F.col("count"), F.col("total")).alias("share"))


def unambiguous(rows: DataFrame, key: str, source: str) -> DataFrame:
    """Rows whose key has one source."""
    one = rows.groupBy(key).agg(F.count_distinct(source).alias("_n")).where("_n = 1").select(key)
    return rows.join(one, key, "left_semi")


def tally(plan: DataFrame) -> DataFrame:
    """One row (scanned, modified, skipped, conflicts) of a plan with a state column."""
    n = lambda s: F.count_if(F.col("state") == s)
    return plan.agg(F.count("*").alias("scanned"), n("modified").alias("modified"), n("skipped").alias("skipped"), n("conflict").alias("conflicts"))


def repeated_numbers(paths: DataFrame) -> DataFrame:
    """(rel_path, dir, number) of numbered notes whose number their folder has twice."""
    rows = paths.select("rel_path", F.regexp_extract("rel_path", "^(?:(.*)/)?[^/]*$", 1).alias("dir"), F.regexp_extract("rel_path", r"(?:^|/)([0-9]{4})-[^/]*$", 1).alias("number")).where("number <> ''")
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("dir", "number"))).where("_n > 1").drop("_n")


def carried(lines: DataFrame, value: Column, *keys: str, order: str = "line") -> Column:
    """The last non-null value up to each row: the heading that a line stands under."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def order_breaks(rows: DataFrame, key: str, order: str, *by: str, descending: bool = True) -> DataFrame:
    """Rows whose key is out of order with the one before."""
    before = F.lag(key).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("before", before).where(F.col(key) > F.col("before") if descending else F.col(key) < F.col("before"))


def summary(notes: DataFrame, resolved: DataFrame | None = None, depth: int = 1, recent_files: int = 10) -> dict[str, DataFrame]:
    """The parts of a vault's summary, each a DataFrame; notes are best cached or read from a snapshot."""
    from quire.operators import links as L
    from quire.sources.vault import child, good

    ok = good(notes)
    props = child(ok, "properties")
    tags = ok.select("rel_path", F.posexplode("tags").alias("ord", "tag"))
    status = props.where("name = 'status'").select("rel_path", F.transform("items", lambda i: i["text"]).alias("statuses"))
    out = {
        "files": ok.agg(F.count("*").alias("total")),
        "folders": folder_counts(ok, depth),
        "properties": property_types(props),
        "tags": tags_summary(tags, by_count=True),
        "status": status_groups(status),
        "tasks": task_counts(child(ok, "tasks")),
        "recent": recent(ok, recent_files),
        "rare_values": rare_values(props.where("type = 'text'").select("name", F.explode(F.transform("items", lambda i: i["text"])).alias("value"))),
    }
    if resolved is not None:
        edges = L.graph(resolved)
        # here links of a note to itself count as inbound
        out["orphans"] = L.orphans(ok, edges, resolved, self_links=True).agg(F.count("*").alias("orphans"))
        out["dead_ends"] = L.dead_ends(ok, edges, resolved, self_links=True).agg(F.count("*").alias("dead_ends"))
        out["links"] = L.health(resolved)
    return out
