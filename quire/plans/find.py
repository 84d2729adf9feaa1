"""The query over a vault: scope, predicates, search, projection, order and limit in one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import filters as X
from quire.operators import links as L
from quire.operators import search as S
from quire.sources.vault import child, good

FIELDS = ("properties", "properties-typed", "tags", "sections", "tasks", "links", "backlinks", "title")
DEFAULT_FIELDS = ("properties", "tags", "sections", "links")
SORTS = ("file", "path", "modified", "backlinks_count", "links_count", "title", "date", "score")
DEFAULT_LIMIT = 50


@dataclass
class Find:
    """What to find; every part is optional. Also the form of a saved view."""

    pattern: str | None = None
    regexp: str | None = None
    properties: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    task: str | None = None
    sections: list[str] = field(default_factory=list)
    title: str | None = None
    globs: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    broken_links: bool = False
    orphan: bool = False
    dead_end: bool = False
    fields: list[str] = field(default_factory=list)
    sort: str | None = None
    reverse: bool = False
    limit: int | None = None
    language: str | None = None
    stemming: bool = True

    def narrowing(self) -> bool:
        return bool(self.pattern or self.regexp or self.properties or self.tags or self.task or self.sections or self.title or self.globs or self.files or self.broken_links or self.orphan or self.dead_end)


def parse_fields(names: list[str]) -> list[str]:
    names = [{"outline": "sections"}.get(n, n) for x in names for n in x.split(",") if n]
    if "all" in names:
        return list(FIELDS)
    if bad := [n for n in names if n not in FIELDS]:
        raise ValueError(f"unknown fields: {', '.join(bad)}")
    return names or list(DEFAULT_FIELDS)


def limit_of(asked: int | None, configured: int | None = None, whole: bool = False) -> int | None:
    """The caller's limit, none for counts and the like, the configured one, 50; 0 is no limit."""
    n = asked if asked is not None else None if whole else configured if configured is not None else DEFAULT_LIMIT
    return n or None


def property_key(properties: Column, name: str) -> list[Column]:
    """A total order over one property: missing and null last, then numbers, then dates by day, then text."""
    p = F.get(F.filter(properties, lambda x: x["name"] == name), F.lit(0))
    text = F.get(p["items"], F.lit(0))["text"]
    whole = F.when(p["type"] == "list", p["json"]).otherwise(text)
    number = F.when(p["type"] == "number", text.cast("double"))
    day = F.when(p["type"].isin("date", "datetime", "datetime-tz"), F.substring(whole, 1, 10)).otherwise(whole)
    return [p.isNull() | (p["type"] == "null"), number.isNull(), number, day]


def order_of(sort: str, reverse: bool, properties: str = "properties") -> list[Column]:
    """Sort keys with their default directions and path ties; reversing turns the whole list round."""
    path = F.col("rel_path")
    down = lambda c: (c, True)
    up = lambda c: (c, False)
    if sort in ("file", "path"):
        keys = [up(path)]
    elif sort in ("backlinks_count", "links_count", "score"):
        keys = [down(F.col(sort)), up(path)]
    elif sort == "modified":
        keys = [up(F.col("modified")), up(path)]
    elif sort == "title":
        keys = [up(F.col("title").isNull()), up(F.col("title")), up(path)]
    elif sort == "date" or sort.startswith("property:"):
        keys = [*map(up, property_key(F.col(properties), "date" if sort == "date" else sort.removeprefix("property:"))), up(path)]
    else:
        raise ValueError(f"unknown sort: {sort}")
    return [c.desc_nulls_last() if d != reverse else c.asc_nulls_first() for c, d in keys]


def find(notes: DataFrame, query: Find, resolved: DataFrame | None = None, index: S.Index | None = None) -> DataFrame:
    """Rows of the query; `resolved` (the vault's links) is asked for only where links matter."""
    everything = good(notes)
    rows = X.scope(everything, query.globs, query.files)
    sections = [X.SectionFilter.parse(s) for s in query.sections]
    tests = []
    for text in query.properties:
        f = X.parse_property_filter(text)
        source = X.with_title(F.col("properties"), F.col("title")) if f.name == "title" else F.col("properties")
        tests.append(X.property_predicate(f, source))
    tests += [X.tag_predicate(t, F.col("tags")) for t in query.tags]
    if query.title:
        tests.append(X.title_predicate(query.title, F.col("title")))
    if sections:
        rows = rows.withColumn("_ranges", X.section_ranges(F.col("sections"), sections))
        tests.append(F.size("_ranges") > 0)
    if query.task:
        # with a pattern the whole note's tasks count, else those of the sections
        tasks = F.filter("tasks", lambda t: X.in_ranges(t["line"], F.col("_ranges"))) if sections and not query.pattern else F.col("tasks")
        tests.append(X.task_predicate(query.task, tasks))
    scoped = rows
    rows = rows.where(X.all_of(*tests))
    if query.regexp:
        pattern = X.checked_regex(X.slashed(query.regexp, True))
        hit = lambda x: x["kind"].isin("body", "code") & x["raw"].rlike(pattern) & (X.in_ranges(x["line"], F.col("_ranges")) if sections else F.lit(True))
        rows = rows.withColumn("matches", F.transform(F.filter("lines", hit), lambda x: F.struct(x["line"], x["section"], x["raw"].alias("text")))).where(F.size("matches") > 0)
    if query.pattern:
        parsed = S.parse_query(query.pattern, query.stemming, query.language)
        lang = S.language_of(F.col("properties"), query.language)
        if sections:
            inside = lambda x: x["kind"].isin("body", "code") & X.in_ranges(x["line"], F.col("_ranges"))
            text = F.array_join(F.transform(F.filter("lines", inside), lambda x: x["raw"]), "\n")
            index = S.build_index(rows, text, stemming=query.stemming, lang=lang)
        elif index is None:
            body = F.array_join(F.transform(F.filter("lines", lambda x: x["kind"].isin("body", "code")), lambda x: x["raw"]), "\n")
            index = S.build_index(scoped, S.document_text(F.col("title"), body), stemming=query.stemming, lang=lang)
        rows = rows.join(S.bm25(index, parsed, rows), "rel_path")
    edges = L.graph(resolved) if resolved is not None else None
    fields, sort = parse_fields(query.fields), query.sort or ("score" if query.pattern else "file")
    if query.broken_links:
        bad = L.broken(resolved).select("rel_path").union(L.broken_anchors(resolved, child(everything, "sections")).select("rel_path")).distinct()
        rows = rows.join(bad, "rel_path", "left_semi")
    if query.orphan:
        rows = L.orphans(rows, edges, resolved)
    if query.dead_end:
        rows = L.dead_ends(rows, edges, resolved)
    if sort == "backlinks_count":
        rows = rows.join(L.backlink_counts(everything, edges), "rel_path", "left")
    if sort == "links_count":
        rows = rows.withColumn("links_count", F.size("links"))
    shown = [F.col("rel_path").alias("file"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified")]
    if "backlinks" in fields:
        back = L.backlinks(edges).groupBy(F.col("target").alias("rel_path")).agg(F.array_sort(F.collect_list(F.struct("source", "line", "label"))).alias("backlinks"))
        rows = rows.join(back, "rel_path", "left").withColumn("backlinks", F.coalesce("backlinks", F.array().cast("array<struct<source: string, line: int, label: string>>")))
        shown.append(F.col("backlinks"))
    others = F.filter("properties", lambda p: p["name"] != "tags")
    columns = {
        "title": F.col("title"),
        "properties": F.map_from_entries(F.transform(others, lambda p: F.struct(p["name"], p["json"]))).alias("properties"),
        "properties-typed": F.transform(others, lambda p: F.struct(p["name"], p["type"], p["json"].alias("value"))).alias("properties_typed"),
        "tags": F.col("tags"),
        "sections": F.col("sections"),
        "tasks": F.col("tasks"),
        "links": F.col("links"),
    }
    shown += [columns[f] for f in fields if f in columns]
    shown += [F.col(c) for c in ("matches", "score") if c in rows.columns]
    ordered = rows.orderBy(*order_of(sort, query.reverse))
    n = limit_of(query.limit)
    return (ordered.limit(n) if n else ordered).select(*shown)


def total(notes: DataFrame, query: Find, resolved: DataFrame | None = None, index: S.Index | None = None) -> int:
    """How many rows the query has before its limit."""
    from dataclasses import replace

    return find(notes, replace(query, limit=0, sort="file", fields=["title"]), resolved, index).count()
