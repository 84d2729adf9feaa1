"""Queries that read Markdown: each document becomes a note by a fixed template, with its whole text in a code block.

The notes are parsed, linted, searched and edited by the engine's own operators; the SQL states from the template what
has to come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import aggregate as A
from quire.operators import links as L
from quire.operators import lint, mutate, repair
from quire.plans.find import Find, find
from quire.plans.queries import query, table
from quire.sources.vault import child, good, kept, parse

#: The template: its lines before and after the document's text. {j} is (7 i + 3) % 1300, {h} i // 2, {next} i + 1.
HEAD = (
    "---", "title: Note {i}", "lang: {lang}", "n_chars: {n}", "done: {even}", 'related: "[[{h}]]"', "tags:", "  - {lang}", "  - src/{source}", "---",
    "# Note {i}", "", "Intro with [[{j}|other]] and [part](missing/{i}.md#Part%201), [own](/{source}/{i}.md) and `[[code]]`.", "", "## Tasks", "", "- [ ] first of {i}", "- [x] second of {i}", "* [?] third{blanks}", "",
    "#### Text", "", "~~~~~~~~ text",
)
TAIL = ("~~~~~~~~", "", "%%", "[[hidden]]", "%%", "", "## Part {q}", "", "<!-- [[no]] --> last [[Note {next}#Part 1]]", "{end}", "")
_FIELDS = {
    "i": "doc_id", "lang": "lang", "n": "n_chars", "source": "source", "j": "((doc_id * 7 + 3) % 1300)", "h": "(doc_id {div} 2)", "next": "(doc_id + 1)", "q": "(doc_id % 4)",
    "even": "CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END", "blanks": "CASE WHEN doc_id % 2 = 0 THEN '   ' ELSE '' END",
    "end": "CASE WHEN doc_id % 5 = 0 THEN concat('See https://example.org/', doc_id, ' now') ELSE 'Plain end.' END",
}


def _text_sql(div: str, **changes: dict) -> str:
    """The note's text as SQL for either engine; `lines` has parts of the template and what replaces them."""
    whole = "\n".join([*HEAD, "\0", *TAIL])
    for old, new in changes.get("lines", {}).items():
        whole = whole.replace(old, new)
    parts, rest = [], whole
    while rest:
        at = min((k for k in (rest.find("{"), rest.find("\0")) if k >= 0), default=len(rest))
        if at:
            parts.append("'" + rest[:at].replace("'", "''") + "'")
        if at < len(rest):
            stop = at + 1 if rest[at] == "\0" else rest.index("}", at) + 1
            parts.append("coalesce(text, '')" if rest[at] == "\0" else "CAST(" + _FIELDS[rest[at + 1 : stop - 1]].replace("{div}", div) + " AS VARCHAR)")
            at = stop
        rest = rest[at:]
    return "concat(" + ", ".join(parts) + ")"


def _duck(**changes) -> str:
    # a line end within a literal is one in DuckDB as well
    return _text_sql("//", **changes)


#: What the SQL below starts from: m lines of text, and so `last` lines of the note.
N = f"""(SELECT doc_id AS i, source || '/' || doc_id || '.md' AS rel_path, lang, source, n_chars, len(string_split(coalesce(text, ''), chr(10))) AS m,
 len(string_split(coalesce(text, ''), chr(10))) + 33 AS last, (doc_id * 7 + 3) % 1300 AS j, doc_id // 2 AS h, {_duck()} AS note FROM documents)"""


def files(spark, sf_dir: str) -> DataFrame:
    text = F.expr(_text_sql("div").replace("AS VARCHAR", "AS STRING").replace("\n", "\\n"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), F.lit("2026-01-01").cast("timestamp").alias("modified"), text.alias("text"))


def notes(spark, sf_dir: str, body: bool = True) -> DataFrame:
    return parse(files(spark, sf_dir), body)


@query(f"""SELECT rel_path, unnest(['title', 'lang', 'n_chars', 'done', 'related', 'tags']) AS name, unnest([0, 1, 2, 3, 4, 5])::INT AS position, unnest(['text', 'text', 'number', 'checkbox', 'text', 'list']) AS type,
 unnest(['"Note ' || i || '"', '"' || lang || '"', n_chars::VARCHAR, CASE WHEN i % 2 = 0 THEN 'true' ELSE 'false' END, '"[[' || h || ']]"', '["' || lang || '", "src/' || source || '"]']) AS json FROM {N}""")
def parse_frontmatter(spark, sf_dir):
    """Every property of every note with its type, from the frontmatter alone."""
    return child(notes(spark, sf_dir, body=False), "properties").select("rel_path", "name", "position", "type", "json")


@query(f"""SELECT rel_path, 'Note ' || i AS title, lang || ',src/' || source AS tags, 10 AS front_lines FROM {N}""")
def parse_title_tags(spark, sf_dir):
    """Titles, tags and the frontmatter's length."""
    return notes(spark, sf_dir).select("rel_path", "title", F.array_join("tags", ",").alias("tags"), "front_lines")


@query(f"""SELECT rel_path, unnest([1, 2, 4, 2]) AS level, unnest(['Note ' || i, 'Tasks', 'Text', 'Part ' || i % 4]) AS heading, unnest([11, 15, 21, 30 + m])::INT AS line, unnest([last, 29 + m, 29 + m, last])::INT AS end_line,
 unnest([0, 3, 0, 0]) AS task_total, unnest([0, 1, 0, 0]) AS task_done, unnest([j || ',missing/' || i || '.md,/' || rel_path, '', '', 'Note ' || i + 1]) AS links, unnest(['', '', 'text', '']) AS code_blocks FROM {N}""")
def parse_sections(spark, sf_dir):
    """The outline: headings with their ranges, tasks, links and code blocks."""
    rows = child(notes(spark, sf_dir), "sections")
    return rows.select("rel_path", "level", "heading", "line", "end_line", "task_total", "task_done", F.array_join("links", ",").alias("links"), F.array_join("code_blocks", ",").alias("code_blocks"))


@query(f"""SELECT rel_path, unnest([17, 18, 19])::INT AS line, 'Tasks' AS section, unnest([' ', 'x', '?']) AS status, unnest(['first of ' || i, 'second of ' || i, 'third']) AS text, unnest([false, true, false]) AS done FROM {N}""")
def parse_tasks(spark, sf_dir):
    """Checkbox tasks with their sections; what looks like one in code is none."""
    return child(notes(spark, sf_dir), "tasks").select("rel_path", "line", "section", "status", "text", "done")


_LINKS = f"""(SELECT i, rel_path, unnest([1, 13, 13, 13, 32 + m])::INT AS line, unnest(['wikilink', 'wikilink', 'markdown', 'markdown', 'wikilink']) AS kind, unnest([h::VARCHAR, j::VARCHAR, 'missing/' || i || '.md', '/' || rel_path, 'Note ' || i + 1]) AS target,
 unnest([NULL, 'other', 'part', 'own', NULL]) AS label, unnest([NULL, NULL, 'Part%201', NULL, 'Part 1']) AS fragment, unnest([h, j, NULL, i, NULL]) AS other FROM {N})"""


@query(f"SELECT rel_path, line, kind, target, label, fragment FROM {_LINKS}")
def parse_links(spark, sf_dir):
    """Links of bodies and properties; those in code, comments and code spans are none."""
    return child(notes(spark, sf_dir), "links").select("rel_path", "line", "kind", "target", "label", "fragment")


@query(f"""SELECT rel_path, unnest(['front', 'code', 'comment', 'body']) AS kind, unnest([10, m + 2, 3, 18])::BIGINT AS n FROM {N}""")
def parse_lines(spark, sf_dir):
    """Lines by what they are: frontmatter, code, comment, body."""
    return child(notes(spark, sf_dir), "lines").groupBy("rel_path", "kind").agg(F.count("*").alias("n"))


@query(f"SELECT l.rel_path, line, target, o.rel_path AS path, CASE WHEN o.rel_path IS NULL THEN 'broken' WHEN kind = 'markdown' THEN 'resolved' ELSE 'short-form' END AS verdict FROM {_LINKS} l LEFT JOIN (SELECT i AS other, rel_path FROM {N}) o USING (other)")
def vault_link_resolution(spark, sf_dir):
    """The parsed links resolved against the notes."""
    rows = notes(spark, sf_dir)
    return L.resolve(child(rows, "links"), rows.select("rel_path")).select("rel_path", "line", "target", "path", "verdict")


@query(f"""SELECT n.rel_path AS file, string_agg(l.rel_path || ':' || l.line, ',' ORDER BY l.rel_path, l.line) AS backlinks FROM {N} n JOIN {_LINKS} l ON l.other = n.i AND l.i <> n.i
 WHERE n.lang = 'en' AND n.i % 2 = 0 GROUP BY ALL""")
def find_with_backlinks(spark, sf_dir):
    """The composed query: properties and sections, with the backlinks of what it finds."""
    rows = notes(spark, sf_dir)
    resolved = L.resolve(child(rows, "links"), rows.select("rel_path"))
    found = find(rows, Find(properties=["lang=en", "done=true"], sections=["## Tasks"], fields=["backlinks"], limit=0), resolved)
    others = F.filter("backlinks", lambda b: b["source"] != F.col("file"))
    sources = F.array_join(F.transform(others, lambda b: F.concat(b["source"], F.lit(":"), b["line"].cast("string"))), ",")
    return found.select("file", sources.alias("backlinks")).where("backlinks <> ''")


@query(f"""SELECT rel_path AS file, 17 AS line, 'Tasks' AS section, '- [ ] first of ' || i AS text FROM {N} WHERE i % 4 = 1
 UNION ALL SELECT rel_path, 18, 'Tasks', '- [x] second of ' || i FROM {N} WHERE i % 4 = 1""")
def find_in_section(spark, sf_dir):
    """Lines of a section that match, of notes with a heading and an open task in scope."""
    rows = find(notes(spark, sf_dir), Find(regexp=r"(first|second) of \d+$", sections=["Tasks"], task="?", properties=["done=false"], limit=0))
    outline = find(notes(spark, sf_dir), Find(sections=["## Part 1"], fields=["title"], limit=0)).select("file")
    return rows.join(outline, "file", "left_semi").select("file", F.inline("matches"))


@query(f"""SELECT rel_path, rule_id, line FROM (SELECT rel_path, unnest(['MD001', 'MD009', 'MD034']) AS rule_id, unnest([21, CASE WHEN i % 2 = 0 THEN 19 END, CASE WHEN i % 5 = 0 THEN last END])::INT AS line FROM {N}) WHERE line IS NOT NULL""")
def lint_body_rules(spark, sf_dir):
    """Findings of the rules over lines."""
    return lint.body_violations(notes(spark, sf_dir)).select(F.col("file").alias("rel_path"), "rule_id", "line")


@query(f"""WITH f AS (SELECT rel_path, 'MD001' AS rule_id, 'warning' AS severity FROM {N} UNION ALL SELECT rel_path, 'MD009', 'warning' FROM {N} WHERE i % 2 = 0 UNION ALL SELECT rel_path, 'MD034', 'error' FROM {N} WHERE i % 5 = 0
 UNION ALL SELECT l.rel_path, 'NOTE006', 'warning' FROM {_LINKS} l LEFT JOIN (SELECT i AS other, 1 AS there FROM {N}) o USING (other) WHERE there IS NULL AND line > 1
 UNION ALL SELECT rel_path, 'SCHEMA', 'warning' FROM {N}, range(4) UNION ALL SELECT rel_path, 'SCHEMA', 'error' FROM {N} WHERE lang NOT IN ('en', 'fr'))
SELECT rule_id, CASE WHEN bool_or(severity = 'error') THEN 'error' ELSE 'warning' END AS severity, count(*) AS total, count(DISTINCT rel_path) AS files, least(count(*), 20)::INT AS n_shown, count(*) > 20 AS limited FROM f GROUP BY rule_id""")
def lint_vault_groups(spark, sf_dir):
    """All findings of notes, links and schema by rule, with overrides; a rule's severity is its worst."""
    rows = kept(lint.scanned(files(spark, sf_dir)))
    schema = lint.Schema(default={"properties": {"lang": {"type": "enum", "values": ["en", "fr"]}}})
    resolved = L.resolve(child(rows, "links"), rows.select("rel_path"))
    found = lint.findings(rows, schema, resolved, lint.LintOptions(overrides={"MD034": {"severity": "error"}}))
    return lint.rule_groups(found).select("rule_id", "severity", "total", "files", F.size("shown").alias("n_shown"), "limited")


def _plan(plan: DataFrame) -> DataFrame:
    return plan.select("rel_path", "state", F.md5(F.col("after")).alias("after"))


@query(f"""SELECT rel_path, 'modified' AS state, md5(replace(replace(replace(note, '- [ ] first of ' || i, '- [x] first of ' || i), '- [x] second of ' || i, '- [ ] second of ' || i), '* [?] third', '* [x] third')) AS after FROM {N}""")
def task_toggle(spark, sf_dir):
    """Tasks of a section toggled; all else of the note stays."""
    return _plan(mutate.task_plan(notes(spark, sf_dir), section="Tasks"))


@query(f"""SELECT rel_path, CASE WHEN lang = 'en' THEN 'modified' ELSE 'skipped' END AS state, md5(CASE WHEN lang = 'en' THEN replace(note, 'tags:' || chr(10) || '  - en' || chr(10), 'tags:' || chr(10) || '  - english' || chr(10)) ELSE note END) AS after FROM {N}""")
def tags_rename(spark, sf_dir):
    """A tag renamed wherever notes have it."""
    return _plan(mutate.property_plan(notes(spark, sf_dir), mutate.rename_tag("en", "english")))


@query(f"SELECT rel_path, 'modified' AS state, md5({_duck(lines={'done: {even}\n': '', '  - src/{source}\n': '  - src/{source}\n  - new\nstatus: open\n'})}) AS after FROM (SELECT *, source || '/' || doc_id || '.md' AS rel_path FROM documents)")
def properties_edit(spark, sf_dir):
    """A property set, one removed, a value appended, in one plan."""
    return _plan(mutate.property_plan(notes(spark, sf_dir), mutate.set_property("status", "open"), mutate.remove_property("done"), mutate.append_value("tags", "new")))


@query(f"SELECT rel_path, CASE WHEN i % 2 = 0 OR i % 5 = 0 THEN 'modified' ELSE 'skipped' END AS state, md5(replace(replace(note, 'third   ' || chr(10), 'third' || chr(10)), 'See https://example.org/' || i || ' now', 'See <https://example.org/' || i || '> now')) AS after FROM {N}")
def body_fixes(spark, sf_dir):
    """The safe repairs of lines."""
    return _plan(mutate.body_fix_plan(notes(spark, sf_dir)))


@query(f"SELECT rel_path, 'markdown' AS kind, '/' || rel_path AS old_target, '/moved/' || i || '.md' AS new_target FROM {N} WHERE lang = 'de'")
def move_changes(spark, sf_dir):
    """What notes moved to a folder ask of links: paths from the top change, stems and links that lead nowhere don't."""
    rows = notes(spark, sf_dir)
    moves = mutate.move_plan(rows, rows.where(F.array_contains("tags", "de")), "moved")
    return mutate.move_link_changes(rows, moves)


@query(f"SELECT rel_path, 'modified' AS state, md5(replace(note, '(/' || rel_path || ')', '(/moved/' || i || '.md)')) AS after FROM {N} WHERE lang = 'de'")
def move_rewrites(spark, sf_dir):
    """The texts that a move writes."""
    rows = notes(spark, sf_dir)
    moves = mutate.move_plan(rows, rows.where(F.array_contains("tags", "de")), "moved")
    return _plan(mutate.rewrite_plan(rows, mutate.move_link_changes(rows, moves)))


@query(f"SELECT lower('Note ' || i) AS key, rel_path FROM {N} UNION ALL SELECT i::VARCHAR, rel_path FROM {N}")
def title_inventory(spark, sf_dir):
    """Titles and stems that name one note."""
    return repair.title_inventory(notes(spark, sf_dir)).select("key", "rel_path")


@query(f"""SELECT source AS dir, count(*)::BIGINT AS n, md5(string_agg('- [Note ' || i || '](' || i || '.md)', chr(10) ORDER BY 'note ' || i, i || '.md')) AS items FROM {N} GROUP BY source""")
def index_pages(spark, sf_dir):
    """A page for each folder with its notes."""
    pages = mutate.index_pages(notes(spark, sf_dir)).where("dir <> ''")
    body = F.regexp_replace("text", "^## Other\n\n", "")
    return pages.select("dir", F.size(F.split(body, "\n")).cast("long").alias("n"), F.md5(body).alias("items"))


@query(f"""SELECT rel_path, 3::BIGINT AS tasks, 5::BIGINT AS links, 4::BIGINT AS sections, md5(note) AS note, (i % 3 = 0) AS again FROM {N}""")
def snapshot_refresh(spark, sf_dir):
    """Stored notes with every third one parsed anew: all are there once, as they were."""
    from quire.sources.snapshot import refresh

    rows = notes(spark, sf_dir)
    third = F.regexp_extract("rel_path", r"(\d+)\.md$", 1).cast("long") % 3 == 0
    out = refresh(rows.withColumn("again", F.lit(False)), rows.where(third).withColumn("again", F.lit(True)))
    return out.select("rel_path", F.size("tasks").cast("long").alias("tasks"), F.size("links").cast("long").alias("links"), F.size("sections").cast("long").alias("sections"), F.md5(F.col("text")).alias("note"), "again")


@query(f"SELECT count(*)::BIGINT AS total, count(*)::BIGINT AS done, count(*)::BIGINT AS notes FROM {N}")
def vault_totals(spark, sf_dir):
    """Totals over nested tables: links of properties, done tasks, notes with open ones."""
    rows = notes(spark, sf_dir)
    front = child(rows, "links").where("line = 1").agg(F.count("*").alias("total"))
    tasks = child(rows, "tasks").agg(F.count_if("done").alias("done"), F.count_distinct(F.when(~F.col("done"), F.col("rel_path"))).alias("notes"))
    return front.crossJoin(F.broadcast(tasks))  # one row each


@query(f"""SELECT rel_path, 15 AS opens, 'Tasks' AS heading FROM {N}""")
def section_at_line(spark, sf_dir):
    """The innermost section that a line lies in, from the outline: the heading above each note's first task."""
    rows = notes(spark, sf_dir)
    first = child(rows, "tasks").groupBy("rel_path").agg(F.min("line").alias("at"))
    inside = child(rows, "sections").join(first, "rel_path").where("at BETWEEN line AND end_line")
    w = Window.partitionBy("rel_path").orderBy(F.col("line").desc())
    return inside.withColumn("k", F.row_number().over(w)).where("k = 1").select("rel_path", F.col("line").alias("opens"), "heading")


@query(f"SELECT lang AS name, count(*) AS count FROM {N} GROUP BY lang UNION ALL SELECT 'src/' || source, count(*) FROM {N} GROUP BY source")
def vault_tags(spark, sf_dir):
    """Tags of parsed notes with their counts."""
    tags = good(notes(spark, sf_dir)).select("rel_path", F.posexplode("tags").alias("ord", "tag"))
    return A.tags_summary(tags).select("name", "count")


@query(f"SELECT rel_path, 'text' AS info FROM {N}")
def code_blocks(spark, sf_dir):
    """Code blocks by their info string."""
    return child(notes(spark, sf_dir), "sections").select("rel_path", F.explode("code_blocks").alias("info"))

