"""Validation: declared constraints on properties, rules on links and bodies, rules of document families, fixes.

Violations are rows (file, rule_id, severity, line, message). Rules over one note's lines run in batches of notes;
rules across notes are joins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.markdown import FENCE, TASK, heading, is_date, is_datetime, is_datetime_tz, link_spans
from quire.functions.text import SEMVER, damerau, glob_regex
from quire.model import LINKS, META, SECTIONS, TASKS
from quire.operators.aggregate import repeated_numbers
from quire.sources.vault import by_note, child, good, note_row

VIOLATION = "file string, rule_id string, severity string, line int, message string"
SCANNED = f"{META}, sections {SECTIONS}, tasks {TASKS}, links {LINKS}, findings array<struct<rule_id: string, severity: string, line: int, message: string>>"
KINDS = ("string", "date", "datetime", "datetime-tz", "number", "boolean", "list", "enum", "string-list")


@dataclass
class Schema:
    """Declared types; a type's own constraints win over the default's, requirements unite in order."""

    default: dict = field(default_factory=dict)
    types: dict[str, dict] = field(default_factory=dict)
    bind: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, config: dict) -> Schema:
        schema = cls(config.get("default", {}), config.get("types", {}), config.get("bind", {}))
        for name, t in [("default", schema.default), *schema.types.items()]:
            for prop, c in t.get("properties", {}).items():
                if c.get("type", "string") not in KINDS:
                    raise ValueError(f"{name}.{prop}: unknown kind {c['type']}")
                if c.get("type") == "enum" and not c.get("values"):
                    raise ValueError(f"{name}.{prop}: an enum needs values")
                for key in ("pattern", "item-pattern"):
                    if key in c:
                        re.compile(c[key])
        return schema

    def __bool__(self) -> bool:
        return bool(self.default or self.types)

    def effective(self, name: str | None) -> dict:
        own = self.types.get(name or "", {})
        required = list(dict.fromkeys([*self.default.get("required", []), *own.get("required", [])]))
        properties = {**self.default.get("properties", {}), **own.get("properties", {})}
        declared = bool(properties)
        for r in required:
            properties.setdefault(r, {"type": "string", "implied": True})
        return {"required": required, "properties": properties, "declared": declared, "sections": [*self.default.get("required-sections", []), *own.get("required-sections", [])], "defaults": own.get("defaults", {}), "template": own.get("template")}


def with_type(notes: DataFrame, schema: Schema) -> DataFrame:
    """Adds own_type (the property), bound (by path) and schema_type (which of them is declared, else null)."""
    prop = F.get(F.filter("properties", lambda p: p["name"] == "type"), F.lit(0))
    own = F.when(prop["type"].isin("text", "date", "datetime"), F.get(prop["items"], F.lit(0))["text"])
    bound = F.lit(None).cast("string")
    for glob, name in reversed(schema.bind.items()):
        if name in schema.types:
            bound = F.when(F.col("rel_path").rlike(glob_regex(glob)), name).otherwise(bound)
    known = F.lit(False) if not schema.types else F.coalesce(own.isin(*schema.types), F.lit(False))
    return notes.withColumns({"own_type": own, "bound": bound, "schema_type": F.when(own.isNotNull(), F.when(known, own)).otherwise(bound), "type_row": prop})


def _rows(df: DataFrame, rule: str, severity: Column | str, message: Column, line=1) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.col("rel_path").alias("file"), F.lit(rule).alias("rule_id"), sev.alias("severity"), (F.lit(line) if isinstance(line, int) else line).cast("int").alias("line"), message.alias("message"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def constraint_rows(schema: Schema) -> list[tuple]:
    out = []
    for name in [None, *schema.types]:
        e = schema.effective(name)
        for prop, c in e["properties"].items():
            out.append((name or "", prop, c.get("type", "string"), c.get("pattern"), c.get("min"), c.get("max"), c.get("values"), c.get("item-pattern"), prop in e["required"], bool(c.get("implied"))))
    return out


RULE = "struct<name: string, kind: string, pattern: string, low: int, high: int, values: array<string>, item_pattern: string, required: boolean, implied: boolean>"


def _problem(rule: Column, p: Column) -> Column:
    """What is wrong with a property (a row of the properties array, or null) under one rule; null if nothing is."""
    items, kind = p["items"], rule["kind"]
    text = F.get(items, F.lit(0))["text"]
    plain = p["type"].isin("text", "date", "datetime", "datetime-tz")
    # a quoted date or time is text of that shape
    clock = r"T([01]\d|2[0-3]):[0-5]\d:[0-5]\d"
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull()
    shape = lambda pattern: plain & F.coalesce(text.rlike(pattern) & day, F.lit(False))
    not_like = lambda value, pattern: pattern.isNotNull() & ~F.regexp_like(value, pattern)
    found = (
        F.when(kind == "string", F.when(~plain, "must be text").when(F.length(text) < rule["low"], "is too short").when(F.length(text) > rule["high"], "is too long").when(not_like(text, rule["pattern"]), "doesn't have the pattern"))
        .when(kind == "date", F.when(~shape(r"^\d{4}-\d{2}-\d{2}$"), "must be a date"))
        .when(kind == "datetime", F.when(~shape(rf"^\d{{4}}-\d{{2}}-\d{{2}}{clock}$"), "must be a date with a time"))
        .when(kind == "datetime-tz", F.when(~shape(rf"^\d{{4}}-\d{{2}}-\d{{2}}{clock}(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"), "must be a time with its zone"))
        .when(kind == "number", F.when(p["type"] != "number", "must be a number"))
        .when(kind == "boolean", F.when(p["type"] != "checkbox", "must be true or false"))
        .when(kind == "list", F.when(p["type"] != "list", "must be a list"))
        .when(kind == "enum", F.when(~(plain & F.coalesce(F.array_contains(rule["values"], text), F.lit(False))), "isn't one of the values"))
        .when(kind == "string-list", F.when(p["type"] != "list", "must be a list").when(F.exists(items, lambda i: i["kind"] != "text"), "must hold texts only").when(F.exists(items, lambda i: not_like(i["text"], rule["item_pattern"])), "holds an item without the pattern"))
    )
    empty = p["json"].isin("null", "[]")
    return (
        F.when(p.isNull(), F.when(rule["required"], F.concat(F.lit("missing property: "), rule["name"])))
        .when(empty, F.when(rule["required"], F.concat(F.lit("empty property: "), rule["name"])))
        .when(~rule["implied"] & found.isNotNull(), F.concat(rule["name"], F.lit(" "), found))
    )


def schema_violations(notes: DataFrame, schema: Schema, strict: bool = False) -> DataFrame:
    """Findings under the rule SCHEMA, at line 1: one at most for each property. One pass over the notes.

    The rules of each declared type are one row of a small table (as many rows as the settings declare types).
    """
    spark = notes.sparkSession
    soft = "error" if strict else "warning"
    typed = with_type(good(notes), schema)
    per: dict[str, list] = {}
    for row in constraint_rows(schema):
        per.setdefault(row[0], []).append(row[1:])
    table = []
    for name in [None, *schema.types]:
        e = schema.effective(name)
        table.append((name or "", per.get(name or "", []), bool(e["declared"]), e["sections"]))
    rules = spark.createDataFrame(table, f"schema_type string, rules array<{RULE}>, closed boolean, wanted array<string>")
    rows = typed.withColumn("schema_type", F.coalesce("schema_type", F.lit(""))).join(F.broadcast(rules), "schema_type", "left")
    finding = lambda severity, message: F.struct(F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
    untyped, declares = F.col("own_type").isNull(), F.col("type_row").isNotNull()
    whole = [
        F.when(untyped & (F.col("type_row.type") != "null"), finding("error", "type must be text")),
        F.when(untyped & ~declares & F.col("bound").isNull(), finding(soft, "no type")),
        F.when(F.col("own_type") != F.col("bound"), finding("warning", F.concat(F.lit("type is "), F.col("own_type"), F.lit(" where the path asks for "), F.col("bound")))),
        F.when(F.exists("tags", lambda t: t.contains(",")), finding("warning", "a tag holds a comma")),
    ]
    named = lambda r: F.get(F.filter("properties", lambda p: p["name"] == r["name"]), F.lit(0))
    problems = F.transform("rules", lambda r: finding("error", F.element_at(F.transform(F.array(named(r)), lambda p: _problem(r, p)), 1)))
    known = lambda p: p["name"].isin("type", "tags", "title") | F.exists("rules", lambda r: r["name"] == p["name"])
    open_ = F.filter("properties", lambda p: F.col("closed") & ~known(p))
    parts = [F.array(*whole), problems, F.transform(open_, lambda p: finding(soft, F.concat(F.lit("undeclared property: "), p["name"])))]
    if any(row[3] for row in table):
        # a cursor through the wanted headings, moved on by the note's headings
        held = F.transform("sections", lambda s: F.concat(F.repeat(F.lit("#"), s["level"]), F.lit(" "), F.coalesce(s["heading"], F.lit(""))))
        same = lambda w, h: (w == h) | (w == F.regexp_replace(h, "^#+ ", ""))
        reached = F.aggregate(held, F.lit(0), lambda i, h: F.when(same(F.get("wanted", i), h), i + 1).otherwise(i))
        at = F.get("wanted", reached)
        parts.append(F.array(F.when(at.isNotNull(), finding("error", F.concat(F.lit("missing section, or out of order: "), at)))))
    found = F.filter(F.concat(*(F.coalesce(x, F.array().cast("array<struct<severity: string, message: string>>")) for x in parts)), lambda f: f["message"].isNotNull())
    return rows.select("rel_path", F.inline(found)).select(F.col("rel_path").alias("file"), F.lit("SCHEMA").alias("rule_id"), "severity", F.lit(1).alias("line"), "message")


def parse_violations(notes: DataFrame) -> DataFrame:
    return _rows(notes.where("parse_error IS NOT NULL"), "NOTE005", "error", F.concat(F.lit("frontmatter: "), F.col("parse_error")))


def date_violations(notes: DataFrame, keys: tuple[str, ...] = ("date", "created", "modified", "updated"), times: tuple[str, ...] = ()) -> DataFrame:
    """NOTE003: properties that hold no date; NOTE004: ones declared as times that hold none."""
    props = child(good(notes), "properties").where("type NOT IN ('null', 'list')").withColumn("text", F.get("items", F.lit(0))["text"])
    day = F.try_to_date(F.substring("text", 1, 10), "yyyy-MM-dd").isNotNull()
    shape = F.col("type").isin("date", "datetime", "datetime-tz")
    out = _rows(props.where(F.col("name").isin(*keys) & ~(shape & day)), "NOTE003", "warning", F.concat(F.col("name"), F.lit(" holds no date")))
    if times:
        out = out.unionByName(_rows(props.where(F.col("name").isin(*times) & ~(F.col("type").isin("datetime", "datetime-tz") & day)), "NOTE004", "warning", F.concat(F.col("name"), F.lit(" holds no date with a time"))))
    return out


def done_with_open_tasks(notes: DataFrame, schema: Schema) -> DataFrame:
    """NOTE002: completed notes with open tasks, where the schema's status knows `completed`."""
    known = any("completed" in t.get("properties", {}).get("status", {}).get("values", []) for t in [schema.default, *schema.types.values()])
    done = F.exists("properties", lambda p: (p["name"] == "status") & F.exists(p["items"], lambda i: i["text"] == "completed"))
    return _rows(good(notes).where(done & F.exists("tasks", lambda t: ~t["done"])) if known else good(notes).limit(0), "NOTE002", "error", F.lit("completed, but tasks are open"))


def link_violations(resolved: DataFrame, front: DataFrame | None = None) -> DataFrame:
    """NOTE006: links in bodies that lead nowhere."""
    return _rows(resolved.where("verdict = 'broken' AND line > 1"), "NOTE006", "warning", F.concat(F.lit("broken link: "), F.col("target")), F.col("line"))


# Rules over the lines of one note. Each yields (rule, severity, line, message).

#: Public rule names and what they are on by default.
BODY_RULES = ("MD001", "MD009", "MD010", "MD011", "MD012", "MD018", "MD019", "MD022", "MD023", "MD031", "MD034", "MD040", "MD042", "MD047", "NOTE001")


def body_findings(lines: list[dict], text: str):
    body = [x for x in lines if x["kind"] != "front"]
    level, blank, inside = 0, 0, ""
    for k, x in enumerate(body):
        raw, n, code = x["raw"], x["line"], x["kind"] == "code"
        before = body[k - 1]["raw"] if k else ""
        after = body[k + 1]["raw"] if k + 1 < len(body) else ""
        opens = code and not inside and FENCE.match(raw)
        if code:
            blank = 0
            m = FENCE.match(raw)
            if opens:
                inside = m[1]
                if k and before.strip():
                    yield "MD031", "warning", n, "a code block needs a blank line before it"
                if not m[2].strip():
                    yield "MD040", "warning", n, "a code block needs a language"
            elif m and inside and m[1][0] == inside[0] and len(m[1]) >= len(inside) and not m[2].strip():
                inside = ""
                if after.strip():
                    yield "MD031", "warning", n, "a code block needs a blank line after it"
            continue
        blank = blank + 1 if not raw.strip() else 0
        if blank == 2:
            yield "MD012", "warning", n, "more than one blank line"
        trailing = len(raw) - len(raw.rstrip(" "))
        if trailing and trailing != 2 and raw.strip() or trailing and not raw.strip():
            yield "MD009", "warning", n, "trailing spaces"
        if "\t" in raw:
            yield "MD010", "warning", n, "a hard tab"
        if x["kind"] != "body":
            continue
        if re.search(r"\([^()]+\)\[[^\]^][^\]]*\]", x["cleaned"]):
            yield "MD011", "warning", n, "a link the wrong way round"
        if re.match(r"#{1,6}[^#\s]", raw) and not re.match(r"#[\w/-]+(\s|$)", raw):
            yield "MD018", "warning", n, "no space after the heading's mark"
        if re.match(r"#{1,6}[ \t]{2,}\S", raw):
            yield "MD019", "warning", n, "several spaces after the heading's mark"
        if re.match(r"[ \t]+#{1,6}[ \t]\S", raw) and not re.match(r"\s{4,}", raw):
            yield "MD023", "warning", n, "a heading must start its line"
        if h := heading(raw):
            if level and h[0] > level + 1:
                yield "MD001", "warning", n, f"heading level {h[0]} after level {level}"
            level = h[0]
            if k and before.strip() or after.strip():
                yield "MD022", "warning", n, "a heading needs blank lines around it"
        spans = link_spans(x["cleaned"], x["raw"], external=True)
        for m in re.finditer(r"https?://[^\s<>)\]]+", x["cleaned"]):
            if not any(s.start <= m.start() < s.end for s in spans) and x["cleaned"][m.start() - 1 : m.start()] != "<":
                yield "MD034", "warning", n, "a bare address"
        if re.search(r"(?<!!)\[[^\]]*\]\(\s*(?:#|<>)?\s*\)", x["cleaned"]):
            yield "MD042", "warning", n, "a link to nothing"
        if re.match(r"\s*\[[ xX]\] ", raw) and not TASK.match(raw):
            yield "NOTE001", "error", n, "a checkbox outside a list"
    if text and not text.endswith("\n"):
        yield "MD047", "warning", lines[-1]["line"] if lines else 1, "the file must end with a line end"


CATEGORIES = ("Added", "Changed", "Deprecated", "Removed", "Fixed", "Security")


def changelog_findings(lines: list[dict]):
    body = [x for x in lines if x["kind"] == "body"]
    heads = [(x["line"], *heading(x["raw"])) for x in body if heading(x["raw"])]
    if not heads or heads[0][1] != 1 or heads[0][2] != "Changelog":
        yield "CHANGELOG001", "warning", 1, "the title must be Changelog"
    labels = {m[1].lower() for x in body if (m := re.match(r"\[([^\]]+)\]:\s", x["raw"]))}
    before = None
    for i, (line, level, text) in enumerate(heads):
        end = heads[i + 1][0] if i + 1 < len(heads) else 1 << 30
        if level == 2:
            m = re.fullmatch(r"\[?([^\]\s]+)\]?(?:\s+-\s+(\S+))?(?:\s+\[YANKED\])?", text)
            if not m or m[1] != "Unreleased" and not (re.match(SEMVER, m[1]) and m[2] and is_date(m[2])):
                yield "CHANGELOG002", "warning", line, f"not a version heading: {text}"
                continue
            if m[1] == "Unreleased":
                if any(h[1] == 2 for h in heads[:i]):
                    yield "CHANGELOG006", "warning", line, "Unreleased must come first"
            else:
                version = [int(v) for v in re.findall(r"\d+", m[1])[:3]]
                if before and version >= before[0]:
                    yield "CHANGELOG004", "warning", line, "versions must fall"
                if before and m[2] > before[1]:
                    yield "CHANGELOG005", "warning", line, "dates must fall"
                before = (version, m[2])
            if text.startswith("[") and m[1].lower() not in labels:
                yield "CHANGELOG008", "warning", line, f"no link definition for {m[1]}"
        if level == 3:
            if text not in CATEGORIES:
                yield "CHANGELOG003", "warning", line, f"not a category: {text}"
            if not any(line < x["line"] < end and x["raw"].strip() for x in body):
                yield "CHANGELOG007", "warning", line, "an empty section"


def okf_findings(path: str, lines: list[dict]):
    name = path.rsplit("/", 1)[-1]
    body = [x for x in lines if x["kind"] == "body"]
    heads = [(x["line"], *heading(x["raw"])) for x in body if heading(x["raw"])]
    if name == "index.md":
        if not heads or heads[0][1] != 1:
            yield "OKF001", "warning", 1, "an index starts with its title"
        for x in body:
            if re.match(r"\s*[-*+] ", x["raw"]) and not link_spans(x["cleaned"], x["raw"], external=True):
                yield "OKF002", "warning", x["line"], "an index entry without a link"
        return
    if name == "log.md":
        days = [(n, t) for n, level, t in heads if level == 2]
        for n, t in days:
            if not is_date(t[:10]):
                yield "OKF003", "warning", n, "a log heading must be a date"
        for (_, a), (n, b) in zip(days, days[1:], strict=False):
            if b[:10] > a[:10]:
                yield "OKF004", "warning", n, "the newest entry comes first"
        return
    for i, (n, level, t) in enumerate(heads):
        end = heads[i + 1][0] if i + 1 < len(heads) else 1 << 30
        below = i + 1 < len(heads) and heads[i + 1][1] > level
        if not below and not any(n < x["line"] < end and x["raw"].strip() for x in lines):
            yield "OKF005", "warning", n, f"an empty section: {t}"


#: Names that the skill format keeps for its vendor.
RESERVED_NAMES = ("anthropic", "claude")


def skill_findings(path: str, properties: dict[str, str], lines: list[dict]):
    name = properties.get("name", "")
    if name.lower() in RESERVED_NAMES:
        yield "SKILL001", "error", 1, "the name is reserved"
    folder = path.rsplit("/", 2)[-2] if path.count("/") else ""
    if folder and name != folder:
        yield "SKILL002", "warning", 1, "the name must be its folder's"
    if sum(x["kind"] != "front" for x in lines) > 500:
        yield "SKILL003", "warning", 1, "more than 500 lines"


def note_findings(path: str, lines: list[dict], text: str, properties: list[dict], rules: tuple[str, ...], profiles: tuple[str, ...]) -> list[tuple]:
    """What the line rules and the profiles find in one note."""
    found = [f for f in body_findings(lines, text) if f[0] in rules]
    name = path.rsplit("/", 1)[-1]
    if "changelog" in profiles and name.lower() == "changelog.md":
        found += changelog_findings(lines)
    if "okf" in profiles:
        found += okf_findings(path, lines)
    if "skills" in profiles and name == "SKILL.md":
        found += skill_findings(path, {p["name"]: p["items"][0]["text"] for p in properties if p["items"]}, lines)
    return found


def scanned(files: DataFrame, rules: tuple[str, ...] = BODY_RULES, profiles: tuple[str, ...] = ()) -> DataFrame:
    """Notes from (rel_path, modified, text) with their line findings in place of lines and text, in one pass over each text.

    body_violations hands these findings on, so lint needs nothing else of such notes.
    """

    def row(path, modified, text):
        note = note_row(path, modified, text)
        lines, text = note.pop("lines"), note.pop("text")
        found = [] if note["parse_error"] is not None else note_findings(path, lines, text or "", note["properties"], rules, profiles)
        return note | {"findings": [dict(zip(("rule_id", "severity", "line", "message"), f, strict=True)) for f in found]}

    return by_note(files, row, SCANNED)


def body_violations(notes: DataFrame, rules: tuple[str, ...] = BODY_RULES, profiles: tuple[str, ...] = ()) -> DataFrame:
    """Findings of the line rules, and of the profiles changelog, okf and skills where they apply by file name.

    Scanned notes have theirs already, of the rules and profiles that they were scanned with.
    """
    if "findings" in notes.columns:
        return good(notes).select(F.col("rel_path").alias("file"), F.inline("findings"))

    def check(batches):
        schema = pa.schema([("file", pa.string()), ("rule_id", pa.string()), ("severity", pa.string()), ("line", pa.int32()), ("message", pa.string())])
        for batch in batches:
            out = []
            for path, lines, text, props in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = note_findings(path, lines or [], text or "", props or [], rules, profiles)
                out += [{"file": path, "rule_id": r, "severity": s, "line": n, "message": m} for r, s, n, m in found]
            yield pa.RecordBatch.from_pylist(out, schema)

    return good(notes).select("rel_path", "lines", "text", "properties").mapInArrow(check, VIOLATION)


def madr_violations(notes: DataFrame) -> DataFrame:
    """MADR001: a folder's number used twice; MADR002: superseded by a number that its folder lacks."""
    twice = repeated_numbers(notes.select("rel_path"))
    out = _rows(twice, "MADR001", "warning", F.concat(F.lit("number used twice: "), F.col("number")))
    folder = F.regexp_extract("rel_path", "^(?:(.*)/)?[^/]*$", 1)
    numbers = notes.select(folder.alias("dir"), F.regexp_extract("rel_path", r"(?:^|/)([0-9]{4})-[^/]*$", 1).alias("number"), F.col("rel_path").alias("other")).where("number <> ''")
    status = child(good(notes), "properties").where("name = 'status'").select("rel_path", folder.alias("dir"), F.regexp_extract(F.get("items", F.lit(0))["text"], r"(?i)superseded by.*?([0-9]{4})", 1).alias("number")).where("number <> ''")
    missing = status.join(numbers, (status["dir"] == numbers["dir"]) & (status["number"] == numbers["number"]) & (status["rel_path"] != numbers["other"]), "left_anti")
    return out.unionByName(_rows(missing, "MADR002", "warning", F.concat(F.lit("no such record: "), F.col("number"))))


def citation_violations(resolved: DataFrame) -> DataFrame:
    """OKF006: links to files that aren't there."""
    return _rows(resolved.where("verdict = 'broken'"), "OKF006", "warning", F.concat(F.lit("citation leads nowhere: "), F.col("target")), F.col("line"))


#: The rules with their severity as found and what they are about.
CATALOG = {
    "SCHEMA": ("error", "declared properties, types and sections"), "NOTE001": ("error", "checkboxes outside lists"), "NOTE002": ("error", "completed notes with open tasks"),
    "NOTE003": ("warning", "properties that hold no date"), "NOTE004": ("warning", "properties that hold no time"), "NOTE005": ("error", "frontmatter that can't be read"), "NOTE006": ("warning", "broken links"),
    **{r: ("warning", "Markdown's public rule of this number") for r in BODY_RULES if r.startswith("MD")},
    **{f"CHANGELOG00{i}": ("warning", "changelogs") for i in range(1, 9)}, **{f"OKF00{i}": ("warning", "knowledge folders") for i in range(1, 7)},
    "MADR001": ("warning", "numbers of decision records"), "MADR002": ("warning", "superseded decision records"),
    "SKILL001": ("error", "reserved names"), "SKILL002": ("warning", "names and folders"), "SKILL003": ("warning", "length of skills"),
}


def catalog(overrides: dict[str, dict] | None = None) -> list[dict]:
    """Every rule with its default and effective severity, and whether it is on."""
    rows = []
    for rule, (severity, about) in sorted(CATALOG.items()):
        own = (overrides or {}).get(rule, {})
        rows.append({"rule_id": rule, "default_severity": severity, "severity": own.get("severity", severity), "enabled": own.get("enabled", True), "overridden": bool(own), "about": about})
    return rows


def with_override(overrides: dict[str, dict], rule: str, enabled: bool | None = None, severity: str | None = None) -> dict[str, dict]:
    """The overrides with one set; what equals the default is left out, and so is a rule without any."""
    if rule not in CATALOG:
        raise ValueError(f"unknown rule: {rule}")
    if severity not in (None, "error", "warning"):
        raise ValueError(f"unknown severity: {severity}")
    own = dict(overrides.get(rule, {}))
    if enabled is not None:
        own["enabled"] = enabled
    if severity is not None:
        own["severity"] = severity
    own = {k: v for k, v in own.items() if v != {"enabled": True, "severity": CATALOG[rule][0]}[k]}
    rest = {k: v for k, v in overrides.items() if k != rule}
    return rest | {rule: own} if own else rest


def without_override(overrides: dict[str, dict], rule: str) -> dict[str, dict]:
    if rule not in CATALOG:
        raise ValueError(f"unknown rule: {rule}")
    return {k: v for k, v in overrides.items() if k != rule}


@dataclass
class LintOptions:
    strict: bool = False
    ignore: list[str] = field(default_factory=list)
    overrides: dict[str, dict] = field(default_factory=dict)
    profiles: tuple[str, ...] = ()


def overridden(violations: DataFrame, overrides: dict[str, dict]) -> DataFrame:
    """Without rules switched off, and with the severities that settings give."""
    off = [r for r, o in overrides.items() if o.get("enabled") is False]
    out = violations.where(~F.col("rule_id").isin(*off)) if off else violations
    severity = F.col("severity")
    for r, o in overrides.items():
        if "severity" in o:
            severity = F.when(F.col("rule_id") == r, o["severity"]).otherwise(severity)
    return out.withColumn("severity", severity)


def lint(notes: DataFrame, schema: Schema, resolved: DataFrame | None = None, options: LintOptions | None = None) -> DataFrame:
    """All findings, by file, line and rule."""
    return findings(notes, schema, resolved, options).orderBy("file", "line", "rule_id", "message")


def findings(notes: DataFrame, schema: Schema, resolved: DataFrame | None = None, options: LintOptions | None = None) -> DataFrame:
    """All findings in no order, for groups and counts."""
    o = options or LintOptions()
    parts = [parse_violations(notes), body_violations(notes, profiles=o.profiles), date_violations(notes)]
    if schema:
        parts += [schema_violations(notes, schema, o.strict), done_with_open_tasks(notes, schema)]
    if resolved is not None:
        parts.append(link_violations(resolved))
        if "okf" in o.profiles:
            parts.append(citation_violations(resolved))
    if "madr" in o.profiles:
        parts.append(madr_violations(notes))
    out = overridden(_union(parts), o.overrides)
    for glob in o.ignore:
        out = out.where(~F.col("file").rlike(glob_regex(glob)))
    return out


#: Salts over which a rule's first findings are sought.
SALTS = 64


def rule_groups(violations: DataFrame, most: int = 20) -> DataFrame:
    """(rule_id, severity, total, files, shown, limited): the first `most` findings of each rule with its totals.

    A rule with an error is one of errors. No rule's findings meet in one task: each salt hands on its first ones.
    """
    from pyspark.sql import Window

    order = ("file", "line", "message")
    salted = violations.select("rule_id", *order, F.pmod(F.xxhash64("file"), F.lit(SALTS)).alias("_salt"))
    first = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("rule_id", "_salt").orderBy(*order))).where(F.col("_rank") <= most)
    first = first.withColumn("_rank", F.row_number().over(Window.partitionBy("rule_id").orderBy(*order))).where(F.col("_rank") <= most)
    shown = first.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("shown"))
    severity = F.when(F.bool_or(F.col("severity") == "error"), "error").otherwise(F.max("severity"))
    totals = violations.groupBy("rule_id").agg(severity.alias("severity"), F.count("*").alias("total"), F.count_distinct("file").alias("files"))
    out = totals.join(shown, "rule_id")
    return out.select("rule_id", "severity", "total", "files", "shown", (F.col("total") > most).alias("limited")).orderBy("rule_id")


def counts(violations: DataFrame) -> DataFrame:
    """One row: errors, warnings, files_with_issues."""
    return violations.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_distinct("file").alias("files_with_issues"))


def fixed_properties(path: str, properties: dict, schema: Schema, today: str | None = None) -> dict:
    """Properties after the repairs, in their order: type by path, defaults, enum typos, dates, tags with commas."""
    props = dict(properties)
    if "type" not in props:
        for glob, name in schema.bind.items():
            if name in schema.types and re.match(glob_regex(glob), path):
                props["type"] = name
                break
    own = props.get("type")
    e = schema.effective(own if isinstance(own, str) else None)
    for name, value in e["defaults"].items():
        if name not in props:
            props[name] = (today or date.today().isoformat()) if value == "$today" else value
    for name, c in e["properties"].items():
        value = props.get(name)
        if c.get("type") == "enum" and isinstance(value, str) and value not in c["values"]:
            near = sorted((damerau(value.lower(), v.lower()), v) for v in c["values"])
            if near and near[0][0] <= 2 and (len(near) == 1 or near[1][0] > near[0][0]):
                props[name] = near[0][1]
        if c.get("type") == "date" and isinstance(value, str) and not is_date(value) and (m := re.fullmatch(r"\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\s*", value)):
            whole = f"{m[1]}-{int(m[2]):02}-{int(m[3]):02}"
            props[name] = whole if is_date(whole) else value
    tags = props.get("tags")
    if isinstance(tags, list) and any(isinstance(t, str) and "," in t for t in tags):
        props["tags"] = list(dict.fromkeys(x for t in tags for x in ([y.strip() for y in t.split(",") if y.strip()] if isinstance(t, str) else [t])))
    elif isinstance(tags, str) and "," in tags:
        props["tags"] = list(dict.fromkeys(y.strip() for y in tags.split(",") if y.strip()))
    return props


def fixed_body(text: str, passes: int = 5) -> str:
    """The text after safe repairs of lines: spaces, tabs, blank lines, headings' marks, bare addresses, the last line end."""
    from quire.functions.markdown import parse_note

    for _ in range(passes):
        note = parse_note(text)
        found: dict[int, set[str]] = {}
        for rule, _, line, _ in body_findings([vars(x) for x in note.lines], text):
            found.setdefault(line, set()).add(rule)
        rows, out = text.split("\n"), []
        for n, raw in enumerate(rows, 1):
            rules = found.get(n, set())
            if "MD012" in rules:
                continue
            if "MD009" in rules:
                raw = raw.rstrip(" ")
            if "MD010" in rules:
                raw = raw.replace("\t", "    ")
            if "MD018" in rules:
                raw = re.sub(r"^(#{1,6})", r"\1 ", raw)
            if "MD019" in rules:
                raw = re.sub(r"^(#{1,6})[ \t]+", r"\1 ", raw)
            if "MD023" in rules:
                raw = raw.lstrip()
            if "MD034" in rules:
                raw = re.sub(r"(?<![<(\[])(https?://[^\s<>)\]]+)", r"<\1>", raw)
            if "NOTE001" in rules:
                raw = re.sub(r"^(\s*)(\[)", r"\1- \2", raw)
            out.append(raw)
        new = "\n".join(out)
        if new and not new.endswith("\n"):
            new += "\n"
        if new == text:
            break
        text = new
    return text


def valid_times(text: str) -> str | None:
    """Which of the strict kinds a text is."""
    return "date" if is_date(text) else "datetime" if is_datetime(text) else "datetime-tz" if is_datetime_tz(text) else None
