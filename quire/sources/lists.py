"""Lists of files, slices of notes, configuration."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.find import Find


def normalise_list(text: str) -> list[str]:
    """Paths of a newline list: without a byte order mark, carriage returns, blank lines and `./`, with `/` throughout."""
    rows = (x.strip().replace("\\", "/") for x in text.removeprefix("﻿").splitlines())
    return [re.sub(r"^(\./)+", "", x) for x in rows if x]


def files_from(spark: SparkSession, listed: list[str] | DataFrame, notes: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(rows of the listed notes, counts of missing, not_markdown and outside entries); a list of any size is a DataFrame (rel_path)."""
    rows = listed.select("rel_path") if isinstance(listed, DataFrame) else spark.createDataFrame([(x,) for x in listed], "rel_path string")
    outside = F.col("rel_path").startswith("/") | F.col("rel_path").rlike(r"(^|/)\.\.(/|$)")
    kind = rows.withColumn("kind", F.when(outside, "outside").when(~F.lower("rel_path").endswith(".md"), "not_markdown").otherwise("note"))
    known = notes.select("rel_path").withColumn("known", F.lit(True)).distinct()
    state = kind.join(known, "rel_path", "left")
    n = state.agg(F.count_if((F.col("kind") == "note") & F.col("known").isNull()).alias("missing"), F.count_if(F.col("kind") == "not_markdown").alias("not_markdown"), F.count_if(F.col("kind") == "outside").alias("outside")).first()
    return notes.join(kind.where("kind = 'note'").select("rel_path").distinct(), "rel_path", "left_semi"), n.asDict()


def read_slice(notes: DataFrame, path: str, section: str | None = None, lines: tuple[int | None, int | None] | None = None, frontmatter: bool = False) -> DataFrame:
    """(rel_path, text): raw lines of a note, of a section (nested matches merge into the outer one), of a range of body lines."""
    from quire.operators.filters import SectionFilter, in_ranges, section_ranges

    rows = notes.where(F.col("rel_path") == path)
    keep = lambda x: x["kind"] != "front"
    if section:
        rows = rows.withColumn("_ranges", section_ranges(F.col("sections"), [SectionFilter.parse(section)]))
        keep = lambda x: (x["kind"] != "front") & in_ranges(x["line"], F.col("_ranges"))
    body = F.filter("lines", keep)
    if lines:
        first, last = lines[0] or 1, lines[1]
        body = F.slice(body, first, (last - first + 1) if last else (1 << 30))
    if frontmatter:
        body = F.concat(F.filter("lines", lambda x: x["kind"] == "front"), body)
    return rows.select("rel_path", F.array_join(F.transform(body, lambda x: x["raw"]), "\n").alias("text"))


DEFAULTS = {"dir": ".", "format": "json", "hints": True, "views": {}, "links": {}, "lint": {}, "schema": {}, "search": {}}

#: Overlays of settings that a profile adds; lists are united in order, tables merged, own settings win.
PROFILES = {
    "okf": {"lint": {"rules": ["OKF"]}, "schema": {"default": {"required": ["type"]}}},
    "madr": {"lint": {"rules": ["MADR"]}, "schema": {"types": {"adr": {"required": ["status", "date"], "filename-template": "{n:04}-{slug}.md"}}, "bind": {"**/decisions/*.md": "adr"}}},
    "skills": {"lint": {"rules": ["SKILL"]}, "schema": {"types": {"skill": {"required": ["name", "description"]}}, "bind": {"**/SKILL.md": "skill"}}},
    "changelog": {"lint": {"rules": ["CHANGELOG"]}},
}


def merged(under: dict, over: dict) -> dict:
    """Tables merge, lists unite in order, else `over` wins."""
    out = dict(under)
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = [*out[k], *(x for x in v if x not in out[k])]
        else:
            out[k] = v
    return out


def load_config(root: str, name: str = ".quire.toml") -> dict:
    """The settings of a vault, with its profiles' under its own."""
    try:
        with open(os.path.join(root, name), "rb") as f:
            own = tomllib.load(f)
    except FileNotFoundError:
        own = {}
    base = DEFAULTS
    for profile in own.get("profiles", []):
        if profile not in PROFILES:
            raise ValueError(f"unknown profile: {profile}")
        base = merged(base, PROFILES[profile])
    return merged(base, own)


def view(config: dict, name: str) -> Find:
    """A saved query."""
    if name not in config["views"]:
        raise KeyError(f"no view {name}")
    row = {k.replace("-", "_"): v for k, v in config["views"][name].items()}
    known = {f.name for f in fields(Find)}
    if bad := sorted(set(row) - known):
        raise ValueError(f"unknown keys in view {name}: {', '.join(bad)}")
    return Find(**row)


def wide_views(config: dict) -> list[str]:
    """Views that narrow nothing."""
    return [name for name in sorted(config["views"]) if not view(config, name).narrowing()]


def nearest_names(path: str, known: list[str], most: int = 3) -> str | None:
    """The name beside `path` that is nearest by edit distance, within `most`; the first by name of equals."""
    from quire.functions.text import damerau

    folder, _, name = path.rpartition("/")
    beside = sorted(k.rpartition("/")[2] for k in known if k.rpartition("/")[0] == folder and k != path)
    best = min(((damerau(name, b), b) for b in beside if abs(len(b) - len(name)) <= most), default=None)
    return best[1] if best and best[0] <= most else None


def resolve_file(notes: DataFrame, asked: str) -> tuple[str | None, str | None]:
    """(path, hint): the note that a name asks for, as it is, with .md, or alone in either case; else what was perhaps meant."""
    asked = re.sub(r"^(\./)+", "", asked.replace("\\", "/"))
    names = [asked, f"{asked}.md"]
    folder = asked.rpartition("/")[0]
    lower = F.lower("rel_path").isin(*(n.lower() for n in names))
    rows = [r[0] for r in notes.where(lower | (F.regexp_extract("rel_path", "^(?:(.*)/)?[^/]*$", 1) == folder)).select("rel_path").distinct().collect()]  # one folder's names
    for n in names:
        if n in rows:
            return n, None
    folded = sorted(r for r in rows if r.lower() in {n.lower() for n in names})
    if len(folded) == 1:
        return folded[0], None
    return None, nearest_names(names[-1] if not asked.lower().endswith(".md") else asked, rows)


# Settings that are edited: new settings come back, and write_config puts them in place -------------------------------


def with_type(config: dict, name: str, **changes) -> dict:
    """The settings with a declared type set or changed; lists and tables given replace the old ones."""
    from quire.operators.lint import Schema

    types = config.get("schema", {}).get("types", {})
    out = merged(config, {}) | {"schema": {**config.get("schema", {}), "types": {**types, name: {**types.get(name, {}), **{k.replace("_", "-"): v for k, v in changes.items()}}}}}
    Schema.of(out["schema"])
    return out


def without_type(config: dict, name: str) -> dict:
    """The settings without a type and the paths bound to it."""
    schema = config.get("schema", {})
    if name not in schema.get("types", {}):
        raise KeyError(f"no type {name}")
    bind = {g: t for g, t in schema.get("bind", {}).items() if t != name}
    return {**config, "schema": {**schema, "types": {k: v for k, v in schema["types"].items() if k != name}, "bind": bind}}


def with_view(config: dict, name: str, **query) -> dict:
    """The settings with a saved query; it has to be one."""
    out = {**config, "views": {**config.get("views", {}), name: query}}
    view(out, name)
    return out


def without_view(config: dict, name: str) -> dict:
    if name not in config.get("views", {}):
        raise KeyError(f"no view {name}")
    return {**config, "views": {k: v for k, v in config["views"].items() if k != name}}


def _toml(value) -> str:
    import json

    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(str(k))} = {_toml(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_toml, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def write_config(config: dict, root: str, name: str = ".quire.toml") -> None:
    """Write what differs from the defaults, in one rename: values of the top level, then a table for each other key."""
    own = {k: v for k, v in config.items() if v is not None and v != DEFAULTS.get(k)}
    rows = [f"{k} = {_toml(v)}" for k, v in own.items() if not isinstance(v, dict)]
    for k, table in own.items():
        if isinstance(table, dict):
            rows += ["", f"[{k}]", *(f"{_toml(str(n))} = {_toml(v)}" for n, v in table.items())]
    path = os.path.join(root, name)
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write("\n".join(rows).lstrip("\n") + "\n")
    os.replace(f"{path}.new", path)
