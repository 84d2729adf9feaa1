"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document's measures are whole numbers. A quantile sketch of a measure is its count by bucket: a bucket for each
value below 64, then 32 for each doubling, so a quantile is off by 1/32 at most and sketches merge by adding counts.
Sketches are kept per language and source and merged up to the language, then to all, where a group has fewer than
`least_docs` documents. A measure's fences lie beyond its 0.1 and 0.9 quantiles, by `reach` times their distance from
the median and a floor, which keeps groups whose measure hardly varies from rejecting at once. A document passes while
each measure stays within them; only documents that the base rule spares take part in the sketches.

Defined cases: a null text has no words, and texts without words fail; a null language or source is a group of its
own; repeated rows count and are returned each; very long texts are measured whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import let, materialise

#: Of each measure: the least distance between the 0.9 quantile and the fence above, and of the fence below (or none).
FLOORS = {
    "symbol_share": (50, None),
    "dup_line_share": (250, None),
    "repeat_share": (100, None),
    "stutter_share": (30, None),
    "word_length": (100, 50),
}
LEVELS = ("source", "lang", "all")


def bucket_sql(v: str) -> str:
    return f"CASE WHEN {v} < 64 THEN {v} ELSE 64 + (length(bin({v})) - 7) * 32 + ({v} >> (length(bin({v})) - 6)::INT) - 32 END"


def _bucket(v: Column) -> Column:
    e = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(64 + (e - 1) * 32 + F.call_function("shiftright", v, e) - 32)


def _low(b: Column) -> Column:
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", (b - 64) % 32 + 32, (F.floor((b - 64) / 32) + 1).cast("int")))


def _repeated(words: Column, n: int) -> Column:
    """Words within n-word windows that are found twice or more."""
    windows = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(n))))).otherwise(F.array().cast("array<long>"))

    def count(sorted_: Column) -> Column:
        twin = lambda x, j: F.coalesce(F.get(sorted_, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_, j + 1)["h"] == x["h"], F.lit(False))
        places = F.sort_array(F.transform(F.filter(sorted_, twin), lambda x: x["i"]))
        step = lambda a, p: F.struct((a["n"] + p + n - F.greatest(a["end"], p)).alias("n"), (p + n).alias("end"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])

    def repeated(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ordered, count))

    return let(windows, repeated)


def measures(docs: DataFrame) -> DataFrame:
    """The base counts and the measures of each document, in one projection over the scan."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    stutter = lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w, 5).cast("long").alias("n_repeat_words"), stutter(w).cast("long").alias("n_stutter")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    bare = F.length(F.translate("text", "\x20\x09\x0a\x0b\x0c\x0d", ""))
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    out = rows.select("doc_id", "lang", "source", counted.alias("c"), lined.alias("l"), bare.cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"))
    out = out.select("doc_id", "lang", "source", "c.*", "l.*", "word_chars", "n_symbols")
    share = lambda a, b, unit: F.expr(f"{unit} * {a} div greatest({b}, 1)")
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "n_words", 1000).alias("symbol_share"),
        share("n_dup_lines", "n_lines", 1000).alias("dup_line_share"),
        share("n_repeat_words", "n_words", 1000).alias("repeat_share"),
        share("n_stutter", "n_words", 1000).alias("stutter_share"),
        share("word_chars", "n_words", 100).alias("word_length"),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one row for each filled bucket."""
    each = F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), _bucket(F.col(m)).alias("bucket")) for m in FLOORS)))
    return measured.where(~F.col("base_failed")).select("lang", "source", each).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def fences(cells: DataFrame, level: str, reach: int) -> DataFrame:
    """(group columns, docs, low_* and high_* of each measure) from the cells merged at a level."""
    keys = {"source": ["lang", "source"], "lang": ["lang"], "all": []}[level]
    merged = cells.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bucket")))
    decile = lambda q: _low(F.min(F.when(10 * F.col("upto") >= q * F.col("total"), F.col("bucket"))))
    rows = ranked.groupBy(*keys, "measure").agg(F.max("total").alias("docs"), *(decile(q).alias(f"q{q}") for q in (1, 5, 9)))
    high = F.col("q9") + reach * (F.col("q9") - F.col("q5"))
    low = F.col("q1") - reach * (F.col("q5") - F.col("q1"))
    columns = [F.max("docs").alias("docs")]
    for m, (above, below) in FLOORS.items():
        columns.append(F.max(F.when(F.col("measure") == m, high + above)).alias(f"high_{m}"))
        if below is not None:
            columns.append(F.max(F.when(F.col("measure") == m, low - below)).alias(f"low_{m}"))
    return rows.groupBy(*keys).agg(*columns)


def quality_rules(docs: DataFrame, reach: int = 3, least_docs: int = 100) -> DataFrame:
    """The base counts of every document, base_failed, kept, and the level whose fences judged it."""
    measured = materialise(measures(docs), "measures")
    cells = materialise(sketches(measured), "sketches")
    out = measured
    bounds = [f"high_{m}" for m in FLOORS] + [f"low_{m}" for m, (_, below) in FLOORS.items() if below is not None]
    for level, keys in zip(LEVELS, (("lang", "source"), ("lang",), ()), strict=True):
        table = fences(cells, level, reach)
        if keys:
            table = table.where(F.col("docs") >= least_docs)
        table = table.select(*(F.col(k).alias(f"{level}_{k}") for k in keys), *(F.col(b).alias(f"{level}_{b}") for b in bounds))
        if keys:
            on = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"{level}_{k}"))
            out = out.join(table, on, "left")
        else:
            out = out.join(F.broadcast(table), F.lit(True), "left")  # the one row of all documents
    first = F.when(F.col(f"source_{bounds[0]}").isNotNull(), "source").when(F.col(f"lang_{bounds[0]}").isNotNull(), "lang").otherwise("all")
    bound = {b: F.coalesce(*(F.col(f"{level}_{b}") for level in LEVELS)) for b in bounds}
    good = ~F.col("base_failed")
    for m, (_, below) in FLOORS.items():
        good = good & F.coalesce(F.col(m) <= bound[f"high_{m}"], F.lit(True))
        if below is not None:
            good = good & F.coalesce(F.col(m) >= bound[f"low_{m}"], F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", good.alias("kept"), first.alias("judged_by"))


def oracle_sql(reach: int = 3, least_docs: int = 100) -> str:
    """The same as DuckDB SQL."""
    low = "CASE WHEN {b} < 64 THEN {b} ELSE (({b} - 64) % 32 + 32) << (({b} - 64) // 32 + 1)::INT END"
    levels = []
    for level, keys in zip(LEVELS, ("lang, source,", "lang,", ""), strict=True):
        cols = ", ".join(
            f"max(CASE WHEN measure = '{m}' THEN q9 + {reach} * (q9 - q5) + {above} END) AS high_{m}"
            + (f", max(CASE WHEN measure = '{m}' THEN q1 - {reach} * (q5 - q1) - {below} END) AS low_{m}" if below is not None else "")
            for m, (above, below) in FLOORS.items()
        )
        group = f"GROUP BY {keys.rstrip(',')}" if keys else ""
        levels.append(f"""
{level}_cells AS (SELECT {keys} measure, bucket, count(*) AS n FROM cells GROUP BY {keys} measure, bucket),
{level}_ranked AS (SELECT *, sum(n) OVER (PARTITION BY {keys} measure) AS total, sum(n) OVER (PARTITION BY {keys} measure ORDER BY bucket) AS upto FROM {level}_cells),
{level}_deciles AS (SELECT {keys} measure, max(total) AS docs, {", ".join(f"min(CASE WHEN 10 * upto >= {q} * total THEN bucket END) AS b{q}" for q in (1, 5, 9))} FROM {level}_ranked GROUP BY {keys} measure),
{level}_values AS (SELECT {keys} measure, docs, {", ".join(f"{low.format(b=f'b{q}')} AS q{q}" for q in (1, 5, 9))} FROM {level}_deciles),
{level}_fences AS (SELECT {keys} max(docs) AS docs, {cols} FROM {level}_values {group} {f"HAVING max(docs) >= {least_docs}" if keys else ""})""")
    tests = " AND ".join(
        f"coalesce({m} <= coalesce(s.high_{m}, l.high_{m}, a.high_{m}), true)"
        + (f" AND coalesce({m} >= coalesce(s.low_{m}, l.low_{m}, a.low_{m}), true)" if below is not None else "")
        for m, (_, below) in FLOORS.items()
    )
    each = ", ".join(f"{{'measure': '{m}', 'v': {m}}}" for m in FLOORS)
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(list_slice(w, p, p + 4), ' ')) AS c FROM t, unnest(range(1, len(w) - 3)) u(p)),
rep AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM win, unnest(range(0, 5)) u(o) WHERE c > 1 GROUP BY doc_id),
stut AS (SELECT doc_id, count(*) AS n FROM t, unnest(range(2, len(w) + 1)) u(p) WHERE w[p] = w[p - 1] GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(stut.n, 0) AS n_stutter FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN stut USING (doc_id)),
k AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 1000 * n_symbols // greatest(n_words, 1) AS symbol_share,
  1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_share,
  1000 * n_stutter // greatest(n_words, 1) AS stutter_share, 100 * word_chars // greatest(n_words, 1) AS word_length FROM m),
values_ AS (SELECT lang, source, unnest([{each}], recursive := true) FROM k WHERE NOT base_failed),
cells AS (SELECT lang, source, measure, {bucket_sql("v")} AS bucket FROM values_),{",".join(levels)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {tests} AS kept,
  CASE WHEN s.docs IS NOT NULL THEN 'source' WHEN l.docs IS NOT NULL THEN 'lang' ELSE 'all' END AS judged_by
FROM k LEFT JOIN source_fences s ON k.lang IS NOT DISTINCT FROM s.lang AND k.source IS NOT DISTINCT FROM s.source
LEFT JOIN lang_fences l ON k.lang IS NOT DISTINCT FROM l.lang CROSS JOIN all_fences a
"""
