"""One note's text to nested values. Sequential by nature, so plain Python; sources.vault runs it over batches.

A note is optional YAML between `---` lines, then lines that are code, comment or body. In body lines code spans,
`%%` and HTML comments are blanked, place by place, before links are sought.
"""

from __future__ import annotations

import copy
import functools
import json
import re
from dataclasses import dataclass, field
from datetime import date, datetime

import yaml

#: The limits on what is parsed.
MAX_LINE, MAX_FRONT_LINES, MAX_FRONT_BYTES, MAX_DEPTH, MAX_NODES, MAX_SCALAR = 1 << 20, 2000, 64 << 10, 20, 5000, 8192
LINK_PROPERTIES = ("related", "depends-on", "supersedes", "superseded-by")

FENCE = re.compile(r"\s*(`{3,}|~{3,})(.*)$", re.S)
HEADING = re.compile(r"(#{1,6})(?:[ \t](.*))?$", re.S)
TASK = re.compile(r"\s*[-*+] \[(.)\] ?(.*)$", re.S)
EXTERNAL = re.compile(r"https?://|mailto:", re.I)
TITLE_TAIL = re.compile(r"""\s*(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^)\\])*\))?\s*\)""", re.S)


class Loader(yaml.SafeLoader):
    """YAML with plain dates left as text, only true and false as booleans, no aliases and no repeated keys."""

    nodes = depth = 0

    def compose_node(self, parent, index):
        if self.check_event(yaml.AliasEvent) or getattr(self.peek_event(), "anchor", None):
            raise yaml.YAMLError("anchors and aliases aren't allowed")
        Loader.count(self)
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise yaml.YAMLError("nested too deep")
        node = super().compose_node(parent, index)
        self.depth -= 1
        return node

    def count(self):
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise yaml.YAMLError("too many nodes")

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        if len({str(k) for k in keys}) < len(keys):
            raise yaml.YAMLError("a key is repeated")
        return super().construct_mapping(node, deep)


Loader.yaml_implicit_resolvers = {
    first: [(tag, pattern) for tag, pattern in rules if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")]
    for first, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"true|True|TRUE|false|False|FALSE"), list("tTfF"))


def _plain(value):
    """Values as JSON has them; keys as text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return str(value)
    return value


def parse_yaml(text: str) -> tuple[dict, str | None]:
    """(properties, error). Edits read the same text twice in a row, so the last ones are kept."""
    properties, error = _parsed(text)
    return copy.deepcopy(properties), error


@functools.lru_cache(32)
def _parsed(text: str) -> tuple[dict, str | None]:
    try:
        value = yaml.load(text, Loader)
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        return {}, " ".join(str(e).split()) or "malformed"
    if value is None:
        return {}, None
    if not isinstance(value, dict):
        return {}, "the frontmatter isn't a mapping"
    value = _plain(value)
    stack = [value]
    while stack:
        x = stack.pop()
        stack += list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
        if isinstance(x, str) and len(x.encode()) > MAX_SCALAR:
            return {}, "a value is too long"
    return value, None


def property_type(value) -> str:
    """text, number, checkbox, list, null, date, datetime or datetime-tz."""
    if isinstance(value, bool):
        return "checkbox"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, list):
        return "list"
    if value is None:
        return "null"
    if isinstance(value, str):
        if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value):
            return "date"
        if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}", value):
            return "datetime"
        if is_datetime_tz(value):
            return "datetime-tz"
    return "text"


def is_date(text: str) -> bool:
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        return False
    try:
        date.fromisoformat(text)
    except ValueError:
        return False
    return True


def is_datetime(text: str) -> bool:
    m = re.fullmatch(r"([0-9-]{10})T([0-9]{2}):([0-9]{2}):([0-9]{2})", text)
    return bool(m) and is_date(m[1]) and int(m[2]) < 24 and int(m[3]) < 60 and int(m[4]) < 60


def is_datetime_tz(text: str) -> bool:
    m = re.fullmatch(r"(.{19})(?:Z|[+-]([0-9]{2}):([0-9]{2}))", text)
    return bool(m) and is_datetime(m[1]) and (m[2] is None or int(m[2]) < 24 and int(m[3]) < 60)


def split_front(text: str) -> tuple[str | None, int, str | None]:
    """(YAML text or None, lines up to the closing delimiter, error)."""
    lines = text.removeprefix("\ufeff").split("\n")
    if lines[0].rstrip("\r") != "---":
        return None, 0, None
    size = 0
    for i, line in enumerate(lines[1:], 2):
        if line.strip() == "---":
            return "\n".join(x.rstrip("\r") for x in lines[1 : i - 1]), i, None
        size += len(line.encode()) + 1
        if i > MAX_FRONT_LINES or size > MAX_FRONT_BYTES:
            return "", i, "the frontmatter is too long"
    return "", len(lines), "the frontmatter isn't closed"


def _blank(text: list[str], a: int, b: int) -> None:
    text[a:b] = " " * (b - a)


def _blank_code(line: str, open_run: int, rest: str) -> tuple[str, int]:
    """(line without code spans, the run still open after it); a span may close lines later, an unclosed run is text."""
    out, at = list(line), 0
    runs = [(m.start(), m.end()) for m in re.finditer("`+", line)]
    if open_run:
        close = next((b for a, b in runs if b - a == open_run), None)
        if close is None:
            return " " * len(line), open_run
        _blank(out, 0, close)
        at, open_run = close, 0
    for i, (a, b) in enumerate(runs):
        if a < at:
            continue
        close = next((d for c, d in runs[i + 1 :] if d - c == b - a), None)
        if close is not None:
            _blank(out, a, close)
            at = close
        elif re.search(rf"(?<!`)`{{{b - a}}}(?!`)", rest):
            _blank(out, a, len(line))
            return "".join(out), b - a
    return "".join(out), 0


def _blank_percent(line: str) -> str:
    out, at = list(line), 0
    while (a := line.find("%%", at)) >= 0:
        if not line[a + 2 :].strip():
            break
        b = line.find("%%", a + 2)
        if b < 0:
            break
        _blank(out, a, b + 2)
        at = b + 2
    return "".join(out)


def _blank_html(line: str, inside: bool) -> tuple[str, bool]:
    out, at = list(line), 0
    while True:
        a = 0 if inside else line.find("<!--", at)
        if a < 0:
            return "".join(out), False
        b = line.find("-->", at if inside else a + 4)
        if b < 0:
            _blank(out, a, len(line))
            return "".join(out), True
        _blank(out, a, b + 3)
        at, inside = b + 3, False


def strip_inline_code(line: str) -> str:
    return _blank_code(line, 0, "")[0]


def _escaped(text: str, at: int) -> bool:
    n = at
    while n and text[n - 1] == "\\":
        n -= 1
    return (at - n) % 2 == 1


def split_fragment(target: str) -> tuple[str, str | None]:
    base, mark, fragment = target.partition("#")
    return base, fragment or None


def parse_wikilink(inner: str) -> dict | None:
    target, bar, label = inner.partition("|")
    target, fragment = split_fragment(target)
    if not target:
        return None
    if len(target) > 3 and target[-3:].lower() == ".md":
        target = target[:-3]
    return {"kind": "wikilink", "target": target, "label": label if bar else None, "fragment": fragment}


def parse_markdown_link(label: str, target: str) -> dict | None:
    if not target or EXTERNAL.match(target):
        return None
    target, fragment = split_fragment(target)
    return {"kind": "markdown", "target": target, "label": label or None, "fragment": fragment} if target else None


@dataclass
class Span:
    """A link's place in its line: of all of it, and of the part that names the target (with fragment)."""

    start: int
    end: int
    target_start: int
    target_end: int
    link: dict | None
    embed: bool = False
    angle: bool = False


def link_spans(cleaned: str, original: str | None = None, external: bool = False) -> list[Span]:
    """Links of a cleaned line, labels as the original has them; external ones too (link None) if asked."""
    original, out, i = cleaned if original is None else original, [], 0
    while (i := cleaned.find("[", i)) >= 0:
        if _escaped(cleaned, i):
            i += 1
            continue
        if cleaned.startswith("[[", i):
            end = cleaned.find("]]", i + 2)
            bang = i > 0 and cleaned[i - 1] == "!"
            if end >= 0 and not (bang and _escaped(cleaned, i - 1)) and (link := parse_wikilink(cleaned[i + 2 : end])):
                bar = cleaned.find("|", i + 2, end)
                out.append(Span(i - bang, end + 2, i + 2, end if bar < 0 else bar, link, embed=bang))
                i = end + 2
                continue
        if i and cleaned[i - 1] == "!":
            i += 1
            continue
        close = i + 1
        while (close := cleaned.find("]", close)) >= 0 and _escaped(cleaned, close):
            close += 1
        if close < 0 or not cleaned.startswith("(", close + 1):
            i += 1
            continue
        a = close + 2
        if angle := cleaned.startswith("<", a):
            b = a + 1
            while (b := cleaned.find(">", b)) >= 0 and _escaped(cleaned, b):
                b += 1
            tail = TITLE_TAIL.match(cleaned, b + 1) if b >= 0 else None
            a, b, end = a + 1, b, tail.end() if tail else -1
        else:
            b = cleaned.find(")", a)
            end = b + 1
        if b < 0 or end < 0:
            i += 1
            continue
        link = parse_markdown_link(original[i + 1 : close], cleaned[a:b])
        if link or external:
            out.append(Span(i, end, a, b, link, angle=angle))
        if link is None and not external:
            i += 1
            continue
        i = end
    return out


def heading(line: str) -> tuple[int, str] | None:
    m = HEADING.match(line)
    return (len(m[1]), (m[2] or "").rstrip("#").strip()) if m else None


def task(line: str) -> tuple[str, str] | None:
    m = TASK.match(line)
    return (m[1], m[2].strip()) if m else None


@dataclass
class Line:
    line: int
    kind: str  # front, code, comment or body
    raw: str
    cleaned: str
    section: str | None = None
    info: str | None = None  # of a line that opens a code block


@dataclass
class Note:
    properties: dict = field(default_factory=dict)
    error: str | None = None
    front_lines: int = 0
    lines: list[Line] = field(default_factory=list)
    sections: list[dict] = field(default_factory=list)
    tasks: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    title: str | None = None
    tags: list[str] = field(default_factory=list)


def classify(text: str, front_lines: int) -> list[Line]:
    """Every line with its kind; longer ones than MAX_LINE are left out."""
    out, fence, comment, run, html = [], "", False, 0, False
    rows = text.removeprefix("\ufeff").split("\n")
    if rows and rows[-1] == "":
        rows.pop()
    at = 0
    whole = text.removeprefix("\ufeff")
    for i, raw in enumerate(rows, 1):
        at += len(raw) + 1
        raw = raw.removesuffix("\r")
        if len(raw) > MAX_LINE:
            continue
        if i <= front_lines:
            out.append(Line(i, "front", raw, ""))
            continue
        if comment:
            comment = raw.strip() != "%%"
            out.append(Line(i, "comment", raw, ""))
            continue
        m = FENCE.match(raw)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            out.append(Line(i, "code", raw, ""))
            continue
        if m:
            fence = m[1]
            out.append(Line(i, "code", raw, "", info=m[2].strip()))
            continue
        if raw.strip() == "%%":
            comment = True
            out.append(Line(i, "comment", raw, ""))
            continue
        cleaned, run = _blank_code(raw, run, whole[at:]) if run or "`" in raw else (raw, run)
        cleaned, html = _blank_html(_blank_percent(cleaned), html)
        out.append(Line(i, "body", raw, cleaned))
    return out


def tags_of(value) -> list[str]:
    """A list's texts and numbers, or the one of a scalar."""
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    if isinstance(value, list):
        return [text(v) for v in value if isinstance(v, (str, int, float)) and not isinstance(v, bool)]
    return [text(value)] if isinstance(value, (str, int, float)) and not isinstance(value, bool) else []


def _strings(value):
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)


def parse_note(text: str, body: bool = True, link_properties: tuple[str, ...] = LINK_PROPERTIES) -> Note:
    """Properties, and unless body is false all that the lines have."""
    note = Note()
    front, note.front_lines, note.error = split_front(text)
    if front is not None and note.error is None:
        note.properties, note.error = parse_yaml(front)
    note.tags = tags_of(note.properties.get("tags"))
    if isinstance(note.properties.get("title"), str):
        note.title = note.properties["title"]
    for name in link_properties:
        for value in _strings(note.properties.get(name)):
            note.links += [{"line": 1, **s.link} for s in link_spans(value) if s.link and s.link["kind"] == "wikilink"]
    if not body:
        return note
    note.lines = classify(text, note.front_lines)
    section = {"level": 0, "heading": None, "line": note.front_lines + 1, "links": [], "task_total": 0, "task_done": 0, "code_blocks": []}
    note.sections = [section]
    for x in note.lines:
        if x.info is not None:
            section["code_blocks"].append(x.info)
        if x.kind == "code":
            x.section = section["heading"]
        if x.kind == "body":
            if h := heading(x.raw):
                section = {"level": h[0], "heading": h[1], "line": x.line, "links": [], "task_total": 0, "task_done": 0, "code_blocks": []}
                note.sections.append(section)
                if note.title is None and h[0] == 1:
                    note.title = h[1]
            x.section = section["heading"]
            if t := task(x.raw):
                done = t[0] in "xX"
                note.tasks.append({"line": x.line, "section": section["heading"], "status": t[0], "text": t[1], "done": done})
                section["task_total"] += 1
                section["task_done"] += done
            for s in link_spans(x.cleaned, x.raw):
                note.links.append({"line": x.line, **s.link})
                section["links"].append(s.link["target"])
    first = note.sections[0]
    if not (first["links"] or first["task_total"] or first["code_blocks"]):
        note.sections.pop(0)
    last = note.lines[-1].line if note.lines else 0
    for i, s in enumerate(note.sections):
        # a section ends before the next heading of its level or above
        s["end_line"] = next((t["line"] - 1 for t in note.sections[i + 1 :] if t["level"] <= max(s["level"], 1)), last)
    return note
