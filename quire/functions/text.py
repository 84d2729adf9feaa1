"""Scalar functions: columns where Spark has the means, else plain Python used inside pandas UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ascii_lower(c: Column) -> Column:
    """A to Z lower-cased, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_upper(c: Column) -> Column:
    """a to z upper-cased, nothing else."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def damerau(a: str, b: str) -> int:
    """Edits with swaps of neighbours, in the unrestricted sense."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + i - k - 1 + 1 + j - m - 1))
        rows.append(row)
        last[x] = i
    return rows[-1][-1]


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for up to four shared first characters by a tenth each where it is above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.IntegerType())
def damerau_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else damerau(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def glob_regex(glob: str) -> str:
    """A whole-path regular expression: * and ? stay within a folder, ** crosses folders, [..] and {a,b} as usual."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def glob_match(path: Column, globs: list[str]) -> Column:
    """Any of the positive globs (or there is none), and none of those that start with `!`."""
    yes = [g for g in globs if not g.startswith("!")]
    match = F.lit(not yes)
    for g in yes:
        match = match | path.rlike(glob_regex(g))
    for g in globs:
        if g.startswith("!"):
            match = match & ~path.rlike(glob_regex(g[1:]))
    return match


def percent_decoded(c: Column) -> Column:
    """Percent escapes decoded, `+` left alone, malformed text left as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?i)\.md$", "")


def normalised(path: Column) -> Column:
    """`.` and inner `..` resolved; what climbs above the top keeps its leading `..`."""
    step = lambda acc, x: F.when((x == "") | (x == "."), acc).when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, x))
    # an empty array has no last element, so it starts with a mark that never is a part
    start = F.array(F.lit("\u0000"))
    safe = lambda acc, x: F.when((x == "..") & (F.size(acc) == 1), F.array_append(acc, x)).otherwise(step(acc, x))
    parts = F.aggregate(F.split(path, "/"), start, safe)
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def date_ok(c: Column) -> Column:
    """A calendar date as yyyy-MM-dd."""
    return F.coalesce(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def loose_date(c: Column) -> Column:
    """`Y-M-D` with short months or days as yyyy-MM-dd; null if that isn't a date."""
    part = lambda k: F.regexp_extract(c, r"^\s*([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})\s*$", k)
    whole = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(date_ok(whole), whole)


def iso_seconds(c: Column) -> Column:
    """A UTC time as text; times before 1970 as 1970's start."""
    return F.date_format(F.greatest(c.cast("timestamp"), F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sanitised(c: Column) -> Column:
    """Without control characters, but for tab and line ends."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def shell_quoted(c: Column) -> Column:
    return F.when(c.rlike(r"^[A-Za-z0-9_./:=@%+,-]+$"), c).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def annotation_escaped(c: Column, in_property: bool = False) -> Column:
    """As a CI annotation's message or property has it."""
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), *([(":", "%3A"), (",", "%2C")] if in_property else [])):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def link_text_escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\[\]\\])", r"\\$1")


def link_target_escaped(c: Column) -> Column:
    return F.when(c.rlike(r"[\s()<>]"), F.concat(F.lit("<"), F.regexp_replace(c, r"([<>])", r"\\$1"), F.lit(">"))).otherwise(c)


def site_prefix_stripped(c: Column, prefix: str) -> Column:
    """`/prefix/x` as `x`, the prefix in either case; other leading slashes go."""
    stripped = F.regexp_replace(c, f"(?i)^/{re.escape(prefix)}/", "/") if prefix else c
    return F.regexp_replace(stripped, "^/+", "")


def percent_of(part: Column, whole: Column) -> Column:
    """Whole per cent, rounded half up; 0 of nothing."""
    return F.when(whole > 0, F.floor((200 * part + whole) / (2 * whole)).cast("long")).otherwise(F.lit(0).cast("long"))


SEMVER = r"^[0-9]+\.[0-9]+\.[0-9]+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$"
TAG = r"^[\p{L}\p{N}\p{So}\u200d\ufe0f_/-]+$"


def tag_ok(c: Column) -> Column:
    """Letters, digits, `_`, `-`, `/` and emoji, and not a number alone."""
    return c.rlike(TAG) & ~c.rlike(r"^[\p{N}]+$")


def literal(text: str):
    """A typed value of what a user wrote: integer, finite number, boolean, [[link]] as text, [a, b] as texts, else text."""
    if re.fullmatch(r"[+-]?[0-9]+", text):
        return int(text)
    try:
        value = float(text)
        if value == value and abs(value) != float("inf"):
            return value
    except ValueError:
        pass
    if text in ("true", "false"):
        return text == "true"
    if text.startswith("[[") and text.endswith("]]"):
        return text
    if text.startswith("[") and text.endswith("]"):
        return [x.strip().strip("\"'") for x in text[1:-1].split(",") if x.strip()]
    return text


def filename_regex(template: str) -> str:
    """The whole-name expression of a template with {n}, {n:0W}, {slug} and {date}."""
    parts = re.split(r"(\{n(?::0\d+)?\}|\{slug\}|\{date\})", template)
    known = {"{n}": r"(?<n>[0-9]+)", "{slug}": r"[a-z0-9]+(?:-[a-z0-9]+)*", "{date}": r"[0-9]{4}-[0-9]{2}-[0-9]{2}"}
    return "^" + "".join(known.get(p) or (f"(?<n>[0-9]{{{int(p[4:-1])},}})" if p.startswith("{n:0") else re.escape(p)) for p in parts) + "$"
