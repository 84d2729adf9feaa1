"""Repairs of broken links, and links made from mentions of titles."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.markdown import EXTERNAL, link_spans
from quire.functions.text import ascii_lower, glob_regex, jaro_winkler_similarity, percent_decoded, stem
from quire.operators.aggregate import unambiguous
from quire.operators.links import first_only

TIE = 0.01
#: Paths that fuzzy repair hands to every task at most, in characters; beyond it they meet by letters they share.
MOST_PATHS = 8 << 20


def certain_repairs(broken: DataFrame, paths: DataFrame) -> DataFrame:
    """(.., new_path, strategy, confidence): the path in another case, with its extension, or of the stem that one note has."""
    t = F.regexp_replace(percent_decoded(F.col("target")), r"^(?:\./|/)+", "")
    rows = broken.withColumns({"_id": F.monotonically_increasing_id(), "_key": ascii_lower(t), "_stem": ascii_lower(stem(t)), "_site": F.col("target").startswith("/")})
    whole = paths.groupBy(ascii_lower(F.col("rel_path")).alias("_key")).agg(F.min("rel_path").alias("p"), F.count("*").alias("n")).where("n = 1").drop("n")
    bare = whole.select(F.regexp_replace("_key", r"\.md$", "").alias("_key"), F.col("p").alias("q"))
    stems = paths.groupBy(ascii_lower(stem(F.col("rel_path"))).alias("_stem")).agg(F.min("rel_path").alias("s"), F.count("*").alias("n")).where("n = 1").drop("n")
    out = rows.join(whole, "_key", "left").join(bare, "_key", "left").join(stems, "_stem", "left")
    pick = F.when(F.col("p").isNotNull(), F.struct("p", F.lit("case").alias("w"), F.lit(1.0).alias("c"))).when(F.col("q").isNotNull(), F.struct(F.col("q").alias("p"), F.lit("extension").alias("w"), F.lit(1.0).alias("c")))
    pick = pick.when(F.col("s").isNotNull(), F.struct(F.col("s").alias("p"), F.when(F.col("_site"), "basename").otherwise("stem").alias("w"), F.when(F.col("_site"), 0.6).otherwise(0.95).alias("c")))
    out = out.withColumn("_pick", F.when(pick["p"] != F.col("rel_path"), pick))
    return out.select(*broken.columns, F.col("_pick.p").alias("new_path"), F.col("_pick.w").alias("strategy"), F.col("_pick.c").alias("confidence"))


def fuzzy_repairs(broken: DataFrame, paths: DataFrame, least: float = 0.8) -> DataFrame:
    """(.., new_path, strategy, confidence): the path nearest by Jaro-Winkler, unless the second is within TIE of it.

    Each different written name is compared once with every stem, in the tasks that hold the names; the stems are
    handed to them only where they are few enough, else names and stems meet by letters that the similarity asks for.
    """
    name = ascii_lower(stem(percent_decoded(F.col("target"))))
    stems = paths.select("rel_path", ascii_lower(stem(F.col("rel_path"))).alias("stem"))
    names = broken.select(name.alias("name"), F.col("rel_path").alias("source")).distinct()
    size = stems.agg(F.coalesce(F.sum(F.length("rel_path") + F.length("stem")), F.lit(0))).first()[0]
    if size <= MOST_PATHS:
        # a similarity of `least` needs lengths within a bound: m matches of both give 3 s <= m / a + m / b + 1
        near = F.least(F.length("name"), F.length("stem")) >= F.greatest(F.length("name"), F.length("stem")) * F.lit(max(0.0, 3 * (least - 0.4) / 0.6 - 2))
        pairs = names.join(F.broadcast(stems), near & (F.col("source") != F.col("rel_path")))
    else:
        pairs = _by_letters(names, stems, least)
    scored = pairs.withColumn("score", jaro_winkler_similarity("name", "stem")).where(F.col("score") >= least)
    w = Window.partitionBy("name", "source").orderBy(F.col("score").desc(), "rel_path")
    ranked = scored.withColumns({"rank": F.row_number().over(w), "second": F.lead("score").over(w)}).where("rank = 1")
    best = ranked.where(F.col("second").isNull() | (F.col("score") - F.col("second") > TIE)).select("name", F.col("source").alias("rel_path"), F.col("rel_path").alias("new_path"), F.col("score").alias("confidence"))
    return broken.withColumn("name", name).join(best, ["name", "rel_path"], "left").select(*broken.columns, "new_path", F.when(F.col("new_path").isNotNull(), "fuzzy").alias("strategy"), "confidence")


def _by_letters(names: DataFrame, stems: DataFrame, least: float) -> DataFrame:
    """Pairs (name, source, rel_path, stem) that may be similar enough, by prefix filters over numbered letters.

    The k-th `a` of a text is a member of its own, so matches are members in common. With p first letters in common (4 at
    most count) the similarity before their bonus has to be j >= (least - p / 10) / (1 - p / 10), and above 0.7 for a bonus;
    lengths a and b then need m >= (3 j - 1) a b / (a + b) members in common. Two texts with so many share one of the
    first a - m + 1 of each in any common order; rare members come first in the one used. Each p is a join of its own.
    """

    def members(rows: DataFrame, key: str) -> DataFrame:
        each = rows.select(key).distinct().select(key, F.posexplode(F.split(key, "")).alias("i", "x")).where("x <> ''")
        w = Window.partitionBy(key, "x").orderBy("i")
        return each.select(key, F.concat("x", F.row_number().over(w).cast("string")).alias("m"))

    of_names, of_stems = members(names, "name"), members(stems, "stem")
    counts = of_names.select("m").union(of_stems.select("m")).groupBy("m").agg(F.count("*").alias("c"))
    ranked = lambda rows, key: rows.join(counts, "m").withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("c", "m")))
    of_names, of_stems = ranked(of_names, "name"), ranked(of_stems, "stem")
    met = None
    for p in range(5):
        j = min(least, max((least - 0.1 * p) / (1 - 0.1 * p), 0.7))
        ratio = max(0.0, 3 * j - 2)  # of the shorter to the longer length, if all of the shorter matches

        def heads(rows: DataFrame, key: str, p: int = p, j: float = j, ratio: float = ratio) -> DataFrame:
            n = F.length(key)
            other = F.ceil(n * ratio - 1e-9)  # what is asked for grows with the other length; this is the least
            m = F.greatest(F.lit(1), F.ceil((3 * j - 1) * n * other / (n + other) - 1e-9))
            return rows.where((F.col("k") <= n - m + 1) & (n >= p)).select(key, "m", F.substring(key, 1, p).alias("head"))

        pairs = heads(of_names, "name").join(heads(of_stems, "stem"), ["m", "head"])
        near = F.least(F.length("name"), F.length("stem")) >= F.greatest(F.length("name"), F.length("stem")) * ratio - 1e-9
        pairs = pairs.where(near).select("name", "stem")
        met = pairs if met is None else met.union(pairs)
    return names.join(met.distinct(), "name").join(stems, "stem").where("source <> rel_path")


def fix_plan(broken: DataFrame, paths: DataFrame, least: float = 0.8, ignore: list[str] = ()) -> DataFrame:
    """(source, line, kind, old_target, new_target, strategy, confidence); rows without a new target can't be repaired."""
    from quire.operators.filters import without

    rows = without(broken, "target", list(ignore)) if ignore else broken
    sure = certain_repairs(rows.select("rel_path", "line", "kind", "target"), paths)
    rest = fuzzy_repairs(sure.where("new_path IS NULL").select("rel_path", "line", "kind", "target"), paths, least)
    both = sure.where("new_path IS NOT NULL").unionByName(rest)
    return both.select(F.col("rel_path").alias("source"), "line", "kind", F.col("target").alias("old_target"), F.col("new_path").alias("new_target"), "strategy", F.round("confidence", 6).alias("confidence"))


def title_inventory(notes: DataFrame) -> DataFrame:
    """(key, rel_path): titles and stems that name one note."""
    rows = notes.select("rel_path", F.explode(F.array(F.col("title"), stem(F.col("rel_path")))).alias("name")).where("length(trim(name)) > 0")
    return unambiguous(rows.select("rel_path", ascii_lower(F.trim("name")).alias("key")).distinct(), "key", "rel_path")


def without_excluded(inventory: DataFrame, titles: list[str] = (), globs: list[str] = (), least: int = 0) -> DataFrame:
    """The titles that may become links: not in the list (in either case), not of notes in the globs, of `least` bytes at least."""
    out = inventory.where(F.octet_length("key") >= least)
    if titles:
        out = out.where(~F.col("key").isin(*{ascii_fold(t) for t in titles}))
    for g in globs:
        out = out.where(~F.col("rel_path").rlike("(?i)" + glob_regex(g)))
    return out


def excluded_by_settings(inventory: DataFrame, asked: dict, settings: dict, least: int = 0) -> DataFrame:
    """The titles that the settings' exclusions (titles, globs) take away beyond those that were asked for."""
    both = {k: [*asked.get(k, []), *settings.get(k, [])] for k in ("titles", "globs")}
    left = without_excluded(inventory, both["titles"], both["globs"], least)
    return without_excluded(inventory, asked.get("titles", []), asked.get("globs", []), least).join(left.select("key").distinct(), "key", "left_anti")


def ascii_fold(text: str) -> str:
    return text.translate({i: i + 32 for i in range(65, 91)})


def inert_zones(line: str) -> list[tuple[int, int]]:
    """Places that must stay as they are: links, embeds, bare addresses, tags of HTML, headings."""
    zones = [(s.start, s.end) for s in link_spans(line, external=True)]
    zones += [m.span() for m in re.finditer(r"!?\[[^\]]*\]\([^)]*\)|https?://\S+|<[^>]*>|`[^`]*`", line)]
    if re.match(r"#{1,6}\s", line):
        zones.append((0, len(line)))
    return zones


def title_hits(titles: list[str]):
    """Of a lower-cased line all titles, the longest at each start, in order, as (start, end, title)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for t in titles:
        machine.add_word(t, t)
    if titles:
        machine.make_automaton()

    def hits(line: str) -> list[tuple[int, int, str]]:
        longest = {}
        for end, t in machine.iter(line) if titles else ():
            a = end - len(t) + 1
            if a not in longest or longest[a][1] <= end:
                longest[a] = (a, end + 1, t)
        return [longest[a] for a in sorted(longest)]

    return hits


def leftmost_longest(hits: list[tuple]) -> list[tuple]:
    """The hits that start where the one kept before has ended or later; hits: (start, end, ..) by start, longest first."""
    out, at = [], 0
    for h in hits:
        if h[0] >= at:
            at = h[1]
            out.append(h)
    return out


def at_word_boundaries(line: str, a: int, b: int) -> bool:
    return not (a and (line[a - 1].isalnum() or line[a - 1] == "_")) and not (b < len(line) and (line[b].isalnum() or line[b] == "_"))


def mention_finder(titles: list[str]):
    """Of a lower-cased line the leftmost longest titles, as (start, end, title), cut at word boundaries after that choice."""
    hits = title_hits(titles)
    return lambda line: [h for h in leftmost_longest(hits(line)) if at_word_boundaries(line, *h[:2])]


#: Titles that mention search hands to every task at most, in characters.
MOST_TITLES = 32 << 20


def mentions(notes: DataFrame, inventory: DataFrame, first: bool = False) -> DataFrame:
    """(rel_path, line, col, surface, target): unlinked mentions of other notes' titles in body text.

    The titles' size is checked before they are handed to the tasks; above the bound, slices of them are, pass by pass.
    Then passes give a line's hits all, those at no word boundary or in inert zones as well, for they take their place
    from others in one pass too, and the leftmost longest are chosen among the hits of all passes.
    """
    titles = inventory.select("key", "rel_path")
    size = titles.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    passes = max(1, -(-int(size) // MOST_TITLES))
    found = None
    translate = {i: i + 32 for i in range(65, 91)}
    for k in range(passes):
        part = [r["key"] for r in titles.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == k).select("key").distinct().collect()]
        shared = notes.sparkSession.sparkContext.broadcast(part)

        def scan(batches, shared=shared):
            find = (mention_finder if passes == 1 else title_hits)(shared.value)
            for batch in batches:
                out = []
                for path, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for x in lines or ():
                        if x["kind"] != "body":
                            continue
                        line = x["cleaned"].translate(translate)
                        hits, zones = find(line), None
                        for a, b, t in hits:
                            zones = inert_zones(x["raw"]) if zones is None else zones
                            live = at_word_boundaries(line, a, b) and not any(c < b and a < d for c, d in zones)
                            if live or passes > 1:
                                out.append({"rel_path": path, "line": x["line"], "col": a + 1, "end": b, "surface": x["raw"][a:b], "key": t, "live": live})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("rel_path", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("end", pa.int32()), ("surface", pa.string()), ("key", pa.string()), ("live", pa.bool_())]))

        hits = notes.select("rel_path", "lines").mapInArrow(scan, "rel_path string, line int, col int, end int, surface string, key string, live boolean")
        found = hits if found is None else found.union(hits)
    if passes > 1:

        def choose(batches):
            for batch in batches:
                out = []
                for path, line, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for a, _, surface, key, live in leftmost_longest([(h["col"] - 1, -h["before"], h["surface"], h["key"], h["live"]) for h in hits]):
                        if live:
                            out.append({"rel_path": path, "line": line, "col": a + 1, "surface": surface, "key": key})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("rel_path", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("surface", pa.string()), ("key", pa.string())]))

        each = F.struct("col", (-F.col("end")).alias("before"), "surface", "key", "live")
        found = found.groupBy("rel_path", "line").agg(F.sort_array(F.collect_list(each)).alias("hits")).mapInArrow(choose, "rel_path string, line int, col int, surface string, key string")
    out = found.join(titles.withColumnRenamed("rel_path", "target"), "key").where("rel_path <> target").select("rel_path", "line", "col", "surface", "target")
    return first_only(out) if first else out


def is_external(target: str) -> bool:
    return bool(EXTERNAL.match(target))
