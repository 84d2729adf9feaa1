import json
import os
import random

import pytest
from pyspark.sql import functions as F
from quire.functions import markdown as M
from quire.operators import aggregate as A
from quire.operators import filters as X
from quire.operators import links as L
from quire.operators import lint, mutate, repair
from quire.operators import search as S
from quire.plans.find import Find, find, total
from quire.sources import lists, sinks, snapshot
from quire.sources.vault import child, discover, good, kept, read_vault

FILES = {
    "alpha.md": '---\ntitle: Alpha\nstatus: planned\npriority: 10\ntags: [rust, Project/x]\ndue: 2024-01-02\nnone:\nq: "9"\n---\n# Alpha\nIntro [[beta]] and [g](gamma.md#Top)\n## Tasks\n- [ ] one\n- [x] two\n### Subtasks\n- [ ] three\n## Notes\nrunning fast machines\n',
    "beta.md": "---\nstatus: completed\ntags: rust\npriority: 2\nrelated: ['[[gamma]]']\n---\n# Beta\nback to [[Alpha]] and [[missing]] run run\n- [ ] open\n",
    "gamma.md": "# Top\nno front matter; the machine runs [x](sub/nested.md) [y](../out.md) [z](alpa.md)\n",
    "sub/nested.md": "---\ntags:\n  - project/backend\n---\nplain [up](../alpha.md) [[gamma#Nope]] about alpha, Alphabet and `alpha`\n",
    "foo/index.md": "index [[lonely]]\n",
    "lonely.md": "nothing here\n",
    "bad.md": "---\na: [\n---\n",
    ".hid/h.md": "hidden\n",
    "skip/s.md": "ignored\n",
    ".gitignore": "skip/\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("vault")
    for name, text in FILES.items():
        os.makedirs((top / name).parent, exist_ok=True)
        (top / name).write_text(text)
    return str(top)


@pytest.fixture(scope="module")
def notes(spark, root):
    return read_vault(spark, root).cache()


@pytest.fixture(scope="module")
def resolved(notes):
    return L.resolve(child(good(notes), "links"), good(notes).select("rel_path")).cache()


def names(notes, resolved, **query):
    return [r.file for r in find(notes, Find(**query), resolved).collect()]


def test_discovery(spark, root, notes):
    assert {r.rel_path for r in notes.collect()} == {n for n in FILES if n.endswith(".md") and n[0] != "." and not n.startswith("skip")}
    assert ".hid/h.md" in {r.rel_path for r in discover(spark, root, [".hid"]).collect()}
    assert notes.where("parse_error IS NOT NULL").first().rel_path == "bad.md"


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ({"properties": ["status=PLANNED"]}, ["alpha.md"]),
        ({"properties": ["status!=planned"]}, ["beta.md"]),
        ({"properties": ["none"]}, ["alpha.md"]),
        ({"properties": ["!status"], "globs": ["*.md"]}, ["gamma.md", "lonely.md"]),
        ({"properties": ["priority>=3"]}, ["alpha.md"]),
        ({"properties": ["q>10"]}, ["alpha.md"]),
        ({"properties": ["q=9.0"]}, []),
        ({"properties": ["tags=RUST"]}, ["alpha.md", "beta.md"]),
        ({"properties": ["title~=/^TO/i"]}, ["gamma.md"]),
        ({"tags": ["project"]}, ["alpha.md", "sub/nested.md"]),
        ({"task": "todo"}, ["alpha.md", "beta.md"]),
        ({"sections": ["## Tasks"], "task": "done"}, ["alpha.md"]),
        ({"sections": ["notes"], "task": "todo"}, []),
        ({"title": "top"}, ["gamma.md"]),
        ({"regexp": "MACHINE"}, ["alpha.md", "gamma.md"]),
        ({"regexp": "(?-i)MACHINE"}, []),
        ({"globs": ["**/*.md", "!a*", "!b*"], "files": ["alpha.md"], "limit": 2}, ["alpha.md", "foo/index.md"]),
        ({"pattern": "run machine"}, ["gamma.md", "alpha.md"]),
        ({"pattern": '"running fast"'}, ["alpha.md"]),
        ({"pattern": "run -back"}, ["gamma.md", "alpha.md"]),
        ({"pattern": "machine", "sections": ["Notes"]}, ["alpha.md"]),
        ({"broken_links": True}, ["beta.md", "gamma.md", "sub/nested.md"]),
        ({"dead_end": True}, ["lonely.md"]),
        ({"orphan": True}, []),
        ({"sort": "property:priority", "limit": 2}, ["beta.md", "alpha.md"]),
        ({"sort": "links_count", "limit": 2}, ["beta.md", "gamma.md"]),
        ({"sort": "backlinks_count", "limit": 1}, ["gamma.md"]),
    ],
)
def test_find(notes, resolved, query, want):
    assert names(notes, resolved, **query) == want


def test_reverse_turns_the_whole_list(notes, resolved):
    assert names(notes, resolved, sort="property:priority", reverse=True) == names(notes, resolved, sort="property:priority")[::-1]
    assert total(notes, Find(task="todo", limit=1)) == 2


def test_fields(notes, resolved):
    row = find(notes, Find(files=["gamma.md"], fields=["all"]), resolved).first()
    assert {b.source for b in row.backlinks} == {"alpha.md", "beta.md", "sub/nested.md"} and row.title == "Top"
    assert find(notes, Find(files=["alpha.md"], fields=["properties-typed"])).first().properties_typed[1].type == "text"


def test_verdicts(resolved):
    got = {(r.rel_path, r.target): r.verdict for r in resolved.collect()}
    assert got[("alpha.md", "beta")] == "resolved" and got[("beta.md", "missing")] == "broken" and got[("gamma.md", "../out.md")] == "out-of-vault"
    assert got[("sub/nested.md", "../alpha.md")] == "resolved" and got[("beta.md", "Alpha")] == "case-mismatch"


def test_anchors(notes, resolved):
    assert [(r.rel_path, r.fragment) for r in L.broken_anchors(resolved, child(good(notes), "sections")).collect()] == [("sub/nested.md", "Nope")]


def test_summary(notes, resolved):
    out = {k: [tuple(r) for r in v.collect()] for k, v in A.summary(notes, resolved).items()}
    assert out["tasks"] == [(4, 1)] and out["tags"][0] == ("rust", 2) and out["folders"][0] == (".", 4)
    assert out["links"] == [(11, 2, 1)] and ("completed", 1) in out["status"]


def test_properties_summary_mixes_types(notes):
    rows = {r.name: r for r in A.properties_summary(child(good(notes), "properties")).collect()}
    assert rows["tags"].type == "mixed" and rows["priority"]["count"] == 2 and rows["priority"].mixed_types is None


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("see [[a|b]] ![[c#d]] \\[[e]]", ["a", "c"]),
        ("[t](x.md 'title') ![i](p.png) [u](<a b.md> \"t)\")", ["x.md 'title'", "a b.md"]),
        ("[h](https://x.y) [m](MAILTO:a@b) [f](#top) [g](tel:1)", ["tel:1"]),
        ("[a [b\\] c](d.md)", ["d.md"]),
        ("[[x.MD]] [[#only]]", ["x"]),
    ],
)
def test_links_of_a_line(line, want):
    assert [s.link["target"] for s in M.link_spans(line) if s.link] == want


def test_lines_that_code_and_comments_hide():
    text = "a `[[x]]` ``[[y]] ` [[z]]``\n`open [[p]]\nclosed` [[q]]\n<!-- [[r]]\n[[s]] --> [[t]]\n%%[[u]]%% [[v]]\n%%\n[[w]]\n%%\n~~~\n[[k]]\n~~~\n`stray [[l]]\n"
    assert [x["target"] for x in M.parse_note(text).links] == ["q", "t", "v", "l"]


def test_headings_tasks_and_frontmatter():
    assert M.heading("# C#") == (1, "C") and M.heading("# T ## ") == (1, "T ##") and M.heading("#x") is None and M.heading("##") == (2, "")
    assert M.task("  * [-] odd") == ("-", "odd") and M.task("[ ] bare") is None
    assert M.parse_note("---\na: 1\na: 2\n---\n").error and M.parse_note("---\na: &x 1\nb: *x\n---\n").error and M.parse_note("---\nno end\n").error
    note = M.parse_note("﻿---\nd: 2024-13-45\nyes: yes\nt: 2024-01-01T10:00:00Z\n  ---  \nbody")
    assert note.properties == {"d": "2024-13-45", "yes": "yes", "t": "2024-01-01T10:00:00Z"}
    assert [M.property_type(v) for v in (True, 1.5, [], None, "2024-13-45", "2024-01-01T10:00:00", "2024-01-01T10:00:00+02:00", {"a": 1}, "x")] == ["checkbox", "number", "list", "null", "date", "datetime", "datetime-tz", "text", "text"]


def test_queries_parse():
    q = S.parse_query('one OR "two three" -four -"five six" AND')
    assert q.optional and q.positive == [["one"], ["two", "three"]] and q.negative == ["four", "five", "six"]
    assert S.operators_only("and OR") and not S.operators_only("and x") and S.language("xx", "fr") == "french"
    assert X.parse_property_filter("a.b >= 3") == X.PropertyFilter("a.b", ">=", "3")
    with pytest.raises(ValueError):
        X.parse_property_filter("a~=(?=x)")


def test_optional_phrases_reject_words_apart(spark):
    docs = spark.createDataFrame([("a", "red green"), ("b", "green red blue"), ("c", "red"), ("d", "blue")], "rel_path string, t string")
    index = S.build_index(docs, docs["t"])
    assert {r.rel_path for r in S.bm25(index, S.parse_query('"red green" OR blue')).collect()} == {"a", "c", "d"}


def test_snapshot(spark, root, notes, resolved):
    snapshot.save(notes, root)
    held, index = snapshot.load(spark, root)
    assert held.count() == notes.count() and not snapshot.stale(root)
    live = [(r.file, round(r.score, 9)) for r in find(notes, Find(pattern="run machine"), resolved).collect()]
    assert [(r.file, round(r.score, 9)) for r in find(held, Find(pattern="run machine"), resolved, index).collect()] == live
    changed = held.where("rel_path = 'lonely.md'")
    assert snapshot.refresh(held, changed, held.where("rel_path = 'bad.md'")).count() == held.count() - 1
    assert snapshot.drop(root) and not snapshot.drop(root) and snapshot.load(spark, root) is None
    with pytest.raises(ValueError):
        snapshot.save(notes, root, "../out")


def test_slices_and_lists(spark, notes):
    assert lists.read_slice(notes, "alpha.md", section="Tasks").first().text == "## Tasks\n- [ ] one\n- [x] two\n### Subtasks\n- [ ] three"
    assert lists.read_slice(notes, "alpha.md", lines=(1, 1)).first().text == "# Alpha"
    assert lists.normalise_list("﻿./a.md\r\n\nb\\c.md\n") == ["a.md", "b/c.md"]
    found, n = lists.files_from(spark, ["alpha.md", "x.md", "y.txt", "../z.md"], notes)
    assert found.count() == 1 and n == {"missing": 1, "not_markdown": 1, "outside": 1}


def test_config(tmp_path):
    (tmp_path / ".quire.toml").write_text('profiles = ["madr"]\n[views.open]\ntask = "todo"\n[views.all]\nlimit = 5\n[schema.default]\nrequired = ["title"]\n')
    config = lists.load_config(str(tmp_path))
    assert lists.view(config, "open").task == "todo" and lists.wide_views(config) == ["all"]
    assert config["schema"]["types"]["adr"]["required"] == ["status", "date"] and config["lint"]["rules"] == ["MADR"]


def test_repairs(notes, resolved):
    paths = good(notes).select("rel_path")
    rows = {r.old_target: (r.new_target, r.strategy) for r in repair.fix_plan(L.broken(resolved), paths).collect()}
    assert rows["alpa.md"] == ("alpha.md", "fuzzy") and rows["missing"] == (None, None)


def test_mentions(notes):
    hits = repair.mentions(good(notes), repair.title_inventory(good(notes)))
    assert [(r.line, r.col, r.surface, r.target) for r in hits.where("rel_path = 'sub/nested.md'").collect()] == [(5, FILES["sub/nested.md"].split("\n")[4].index(" alpha,") + 2, "alpha", "alpha.md")]


def test_mentions_in_several_passes(spark, monkeypatch):
    r = random.Random(4)
    words = ["ab", "cd", "ef", "gh", "x", "abc"]
    texts = ["ab cd ef gh", "ab [cd ef](u) gh", *(r.choice([" ", "", "-"]).join(r.choices(words, k=r.randint(4, 14))) for _ in range(60))]
    titles = {"ab cd", "cd ef", "ef gh", *(" ".join(r.choices(words, k=r.randint(1, 3))) for _ in range(40))}
    lines = "array<struct<kind string, line int, raw string, cleaned string>>"
    rows = spark.createDataFrame([(f"n{i}.md", [("body", 1, t, t), ("body", 2, t + " ab cd", t + " ab cd")]) for i, t in enumerate(texts)], f"rel_path string, lines {lines}")

    def found(keys, most):
        monkeypatch.setattr(repair, "MOST_TITLES", most)
        known = spark.createDataFrame([(k, f"t/{k}.md") for k in keys], "key string, rel_path string")
        return sorted(map(tuple, repair.mentions(rows, known).collect()))

    three = ["ab cd", "cd ef", "ef gh"]
    assert found(three, 5) == found(three, 1 << 20) and ("n0.md", 1, 7, "ef gh", "t/ef gh.md") in found(three, 5)
    assert found(titles, sum(map(len, titles)) // 5) == found(titles, 1 << 20)


SCHEMA = lint.Schema.of(
    {
        "default": {"required": ["title"]},
        "types": {"note": {"required": ["date"], "properties": {"date": {"type": "date"}, "status": {"type": "enum", "values": ["open", "completed"]}, "name": {"type": "string", "pattern": "^[a-z]+$", "max": 5}}, "required-sections": ["## One", "## Two"], "defaults": {"made": "$today"}}},
        "bind": {"bound/**": "note"},
    }
)


@pytest.fixture(scope="module")
def linted(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("lint")
    files = {
        "clean.md": "---\ntype: note\ntitle: T\ndate: 2024-02-29\nstatus: open\n---\n\n## One\n\n## Two\n",
        "bad.md": "---\ntype: note\ntitle: T\ndate: 2023-02-29\nstatus: opne\nname: Toolong\nextra: 1\ntags: ['a,b']\n---\n\n## Two\n\n## One\n",
        "bound/b.md": "---\ntitle: T\n---\n",
        "none.md": "text  \n\n\n\nmore https://x.y/z\n```\ncode\n```\n[ ] bare\n##no\n### three",
        "dec/0001-a.md": "---\nstatus: superseded by 0009\n---\n# A\n",
        "dec/0001-b.md": "# B\n",
        "CHANGELOG.md": "# Changelog\n\n## [Unreleased]\n\n## [1.0.0] - 2024-01-01\n\n### Added\n\n- x\n\n## [1.1.0] - 2024-02-01\n\n### Odd\n",
    }
    for name, text in files.items():
        os.makedirs((top / name).parent, exist_ok=True)
        (top / name).write_text(text)
    notes = read_vault(spark, str(top)).cache()
    resolved = L.resolve(child(good(notes), "links"), notes.select("rel_path"))
    rows = lint.lint(notes, SCHEMA, resolved, lint.LintOptions(profiles=("madr", "changelog"))).collect()
    return notes, rows


def test_lint(linted):
    _, rows = linted
    of = lambda f: {(r.rule_id, r.message) for r in rows if r.file == f}
    assert of("clean.md") == set()
    assert {m for r, m in of("bad.md") if r == "SCHEMA"} == {"date must be a date", "status isn't one of the values", "name is too long", "undeclared property: extra", "undeclared property: status"} - {"undeclared property: status"} | {"a tag holds a comma", "missing section, or out of order: ## Two"}
    assert ("SCHEMA", "missing property: date") in of("bound/b.md")
    assert {r for r, _ in of("none.md")} >= {"MD012", "MD034", "MD040", "MD031", "NOTE001", "MD018", "MD047", "SCHEMA"}
    assert {r for r, _ in of("dec/0001-a.md")} >= {"MADR001", "MADR002"}
    assert {r for r, _ in of("CHANGELOG.md")} >= {"CHANGELOG003", "CHANGELOG004", "CHANGELOG005", "CHANGELOG007", "CHANGELOG008"}


def test_lint_fixes(linted):
    notes, _ = linted
    plan = {r.rel_path: r for r in mutate.property_plan(notes, mutate.fix_lint(SCHEMA, "2024-05-05")).collect()}
    assert "status: open" in plan["bad.md"].after and "- a\n- b" in plan["bad.md"].after and "made: '2024-05-05'" in plan["bad.md"].after
    fixed = lint.fixed_body("##no\ntext   \n\n\n\n[ ] a\nhttps://x.y")
    assert fixed == "## no\ntext\n\n- [ ] a\n<https://x.y>\n"


def test_property_edits_keep_what_they_do_not_touch():
    text = "﻿---\r\n# note\r\na: 1   # keep\r\nlist:\r\n  - x\r\n---\r\nbody\r\n"
    out = mutate.with_properties(text, {"a": 1, "list": ["x", "y"]})
    assert out == "﻿---\r\n# note\r\na: 1   # keep\r\nlist:\r\n  - x\r\n  - y\r\n---\r\nbody\r\n"
    assert mutate.with_properties("body", {"a": 1}) == "---\na: 1\n---\nbody" and mutate.with_properties("---\na: 1\n---\nbody", {}) == "body"
    run = lambda edit, p: edit("x.md", p)
    assert run(mutate.add_tag("B"), {"tags": "a"}) == {"tags": ["a", "B"]} and run(mutate.add_tag("A"), {"tags": ["a"]}) == {"tags": ["a"]}
    assert run(mutate.append_value("k", 2), {"k": 1}) == {"k": [1, 2]} and run(mutate.append_value("k", 1), {}) == {"k": [1]}
    assert run(mutate.remove_property("k", "A"), {"k": ["a"], "z": 1}) == {"z": 1}
    assert list(run(mutate.rename_property("a", "c"), {"a": 1, "b": 2})) == ["b", "c"]
    assert run(mutate.rename_tag("a", "b"), {"tags": ["A", "b", "c"]}) == {"tags": ["b", "c"]}
    for edit, p in ((mutate.append_value("k", 1), {"k": {}}), (mutate.rename_property("a", "b"), {"a": 1, "b": 2})):
        with pytest.raises(mutate.Conflict):
            run(edit, p)


def test_plans_and_their_application(spark, notes, tmp_path):
    for name, text in FILES.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    plan = mutate.task_plan(notes.where("rel_path = 'alpha.md'"), lines=[13, 14])
    assert sinks.apply(plan, str(tmp_path)) == 1
    assert "- [x] one\n- [ ] two" in (tmp_path / "alpha.md").read_text()
    assert A.tally(mutate.property_plan(notes, mutate.set_property("status", "planned"))).first().asDict() == {"scanned": 6, "modified": 5, "skipped": 1, "conflicts": 0}


def test_moves(notes):
    moves = mutate.move_plan(good(notes), notes.where("rel_path IN ('alpha.md', 'gamma.md')"), "deep/er")
    plan = {r.rel_path: r.after for r in mutate.rewrite_plan(notes, mutate.move_link_changes(notes, moves)).collect()}
    assert "[up](../deep/er/alpha.md)" in plan["sub/nested.md"] and "[[gamma#Nope]]" in plan["sub/nested.md"]
    assert "[x](../../sub/nested.md)" in plan["gamma.md"] and "alpha.md" not in plan
    clash = mutate.move_plan(good(notes), notes.where("rel_path IN ('alpha.md', 'sub/nested.md')"), "sub")
    assert {r.rel_path: r.state for r in clash.collect()} == {"alpha.md": "move", "sub/nested.md": "skipped"}


def test_generated_texts(notes):
    assert mutate.scaffold(SCHEMA, "note", "N", "2024-01-01").startswith("---\ntype: note\ntitle: N\ndate: '2024-01-01'\n")
    assert mutate.spliced("a\n<!-- r:begin -->\nold\n<!-- r:end -->\nb\n", "r", "new") == "a\n<!-- r:begin -->\nnew\n<!-- r:end -->\nb\n"
    log = mutate.log_entry(mutate.log_entry("# Log\n", "one", "2024-01-01"), "two", "2024-01-02")
    assert log.index("two") < log.index("one") and mutate.log_entry(log, "three", "2024-01-02").index("three") < log.index("one")
    text = "# Changelog\n\n## [Unreleased]\n\n### Added\n\n- a\n\n## [1.0.0] - 2024-01-01\n\n[1.0.0]: x\n"
    added = mutate.changelog_add(mutate.changelog_add(text, "Added", "b"), "Fixed", "c")
    assert "- a\n- b\n\n### Fixed\n\n- c\n\n## [1.0.0]" in added
    assert "## [Unreleased]\n\n## [1.1.0] - 2024-02-02\n" in mutate.changelog_release(added, "1.1.0", "2024-02-02") and "[1.1.0]: TBD" in mutate.changelog_release(added, "1.1.0", "2024-02-02")
    pages = {r.dir: r.text for r in mutate.index_pages(notes).collect()}
    assert "[sub](sub/index.md)" in pages[""] and "## Other" in pages["sub"]
    assert mutate.record_table(notes).first().text.count("- [") == 6


def test_sinks(spark, linted):
    _, rows = linted
    df = spark.createDataFrame(rows).limit(1)
    out = json.loads(sinks.envelope(df, total=9, hints=["h"]))
    assert out["total"] == 9 and len(out["results"]) == 1
    assert sinks.annotations(df).first().value.startswith("::")


def test_stream(spark, root, tmp_path):
    from quire.streaming.ingest import LatestNotes, stream_files

    table = LatestNotes(spark, str(tmp_path / "table"))
    table.follow(stream_files(spark, root), once=True).awaitTermination(120)
    assert {r.rel_path for r in table.read().collect()} >= {"alpha.md", "sub/nested.md"}


def test_ignore_files(spark, tmp_path):
    for name, text in {"a.md": "", "x/keep.md": "", "x/b.md": "", "x/y/c.md": "", "x/y/d.md": "", "z/e.md": "", ".gitignore": "x/*\n!x/keep.md\n!x/y\n# no\nz/\n", "x/y/.gitignore": "d.md\n"}.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {r.rel_path for r in discover(spark, str(tmp_path)).collect()} == {"a.md", "x/keep.md", "x/y/c.md"}


def test_rename_and_what_it_skips(spark):
    from quire.sources.vault import parse

    texts = {"a/n.md": "[[n]] [[b/n]]\n", "b/n.md": "x\n", "c.md": "[[n]] [up](a/n.md) [[a/n|l]]\n"}
    notes = parse(spark.createDataFrame([(k, None, v) for k, v in texts.items()], "rel_path string, modified timestamp, text string"))
    state = lambda old, new: mutate.rename_plan(notes, old, new).first().state
    assert [state("a/n.md", "a/m.md"), state("a/n.md", "b/n.md"), state("no.md", "x.md"), state("c.md", "c.md")] == ["move", "conflict", "missing", "skipped"]
    for bad in ("x.txt", "../x.md", "/x.md"):
        with pytest.raises(ValueError):
            mutate.rename_plan(notes, "c.md", bad)
    moves = mutate.rename_plan(notes, "a/n.md", "a/m.md")
    after = {r.rel_path: r.after for r in mutate.rewrite_plan(notes, mutate.move_link_changes(notes, moves)).collect()}
    assert after == {"c.md": "[[n]] [up](a/m.md) [[a/m|l]]\n"}
    skipped = {(r.rel_path, r.target, tuple(r.candidates)) for r in mutate.skipped_ambiguous(notes, moves).collect()}
    assert skipped == {(p, "n", ("a/n.md", "b/n.md")) for p in ("a/n.md", "c.md")}
    assert sorted(r.rel_path for r in snapshot.renamed(notes, moves).collect()) == ["a/m.md", "b/n.md", "c.md"]


def test_link_fixes_are_guarded_and_tallied(spark, notes, resolved):
    everything = good(notes)
    fixes = repair.fix_plan(L.broken(resolved), everything.select("rel_path"))
    plan = {r.rel_path: r.after for r in mutate.link_fix_plan(notes, fixes, fuzzy=True).collect()}
    assert "[z](alpha.md)" in plan["gamma.md"] and not mutate.link_fix_plan(notes, fixes).collect()
    changes = mutate.guarded(mutate.link_fix_changes(fixes, fuzzy=True), notes)
    n = fixes.count()
    assert mutate.fix_tally(fixes, changes).first().asDict() == {"planned": 1, "unfixable": n - 1, "rejected": 0, "failed": 0, "applied": 1}
    assert mutate.fix_tally(fixes, changes, spark.createDataFrame([("gamma.md",)], "rel_path string")).first().applied == 0
    wrong = spark.createDataFrame([("gamma.md", "wikilink", "zz", "nowhere", "alpha.md"), ("gamma.md", "wikilink", "zz", "beta", "alpha.md"), ("gamma.md", "wikilink", "zz", "alpha", "alpha.md")], "rel_path string, kind string, old_target string, new_target string, path string")
    assert sorted((r.new_target, r.safe) for r in mutate.guarded(wrong, notes).collect()) == [("alpha", True), ("beta", False), ("nowhere", False)]


def test_mentions_become_links(spark, notes):
    everything = good(notes)
    titles = repair.title_inventory(everything)
    plan = {r.rel_path: r.after for r in mutate.auto_link_plan(notes, repair.mentions(everything, titles)).collect()}
    assert plan["sub/nested.md"].endswith("about [[alpha]], Alphabet and `alpha`\n")
    stale = spark.createDataFrame([("lonely.md", 1, 1, "nothing", "alpha.md"), ("lonely.md", 1, 3, "thing", "beta.md"), ("lonely.md", 1, 9, "gone", "beta.md"), ("lonely.md", 9, 1, "x", "beta.md")], "rel_path string, line int, col int, surface string, target string")
    row = mutate.auto_link_plan(notes, stale).first()
    assert (row.after, row.detail) == ("[[alpha]] here\n", "2 not found")
    left = {r.key for r in repair.without_excluded(titles, ["ALPHA"], ["SUB/*"], 5).collect()}
    assert "alpha" not in left and "nested" not in left and "beta" not in left and "gamma" in left
    assert {r.key for r in repair.excluded_by_settings(titles, {"titles": ["alpha"]}, {"titles": ["alpha", "gamma"]}).collect()} == {"gamma"}


def test_fuzzy_repairs_by_letters(spark, monkeypatch):
    r = random.Random(7)
    words = ["".join(r.choices("abcdeo", k=r.randint(1, 9))) for _ in range(120)]
    typos = ["".join(c for c in w if r.random() < 0.85) + r.choice(["", "x", "a"]) for w in words]
    paths = spark.createDataFrame([(f"d{i}/{w}.md",) for i, w in enumerate(words)], "rel_path string")
    broken = spark.createDataFrame([("s.md", i, "wikilink", w) for i, w in enumerate(typos)], "rel_path string, line int, kind string, target string")
    want = sorted(map(str, repair.fuzzy_repairs(broken, paths).collect()))
    monkeypatch.setattr(repair, "MOST_PATHS", 0)
    assert sorted(map(str, repair.fuzzy_repairs(broken, paths).collect())) == want and sum("fuzzy" in x for x in want) > 10


def test_index_follows_its_notes(spark, notes):
    body = lambda n: S.build_index(good(n), S.document_text(n["title"], snapshot._body()), stemming=True)
    gone = notes.where("rel_path = 'gamma.md'")
    changed = notes.where("rel_path = 'beta.md'")
    index = snapshot.refresh_index(body(notes), changed, gone)
    want = body(notes.where("rel_path <> 'gamma.md'"))
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(index.postings) == rows(want.postings) and rows(index.doc_stats) == rows(want.doc_stats)


def test_rule_catalog():
    overrides = lint.with_override({}, "MD009", enabled=False)
    assert overrides == {"MD009": {"enabled": False}} and lint.with_override(overrides, "MD009", enabled=True) == {}
    assert lint.with_override(overrides, "MD009", severity="error")["MD009"] == {"enabled": False, "severity": "error"}
    shown = {r["rule_id"]: r for r in lint.catalog(overrides)}
    assert not shown["MD009"]["enabled"] and shown["NOTE006"]["severity"] == "warning" and set(lint.BODY_RULES) <= set(shown)
    assert lint.without_override(overrides, "MD009") == {}
    for bad in (lambda: lint.with_override({}, "MD999"), lambda: lint.without_override({}, "X"), lambda: lint.with_override({}, "MD009", severity="fatal")):
        with pytest.raises(ValueError):
            bad()


def test_settings_are_edited(tmp_path):
    config = lists.load_config(str(tmp_path))
    config = lists.with_type(config, "note", required=["title"], properties={"status": {"type": "enum", "values": ["a", "b"]}})
    config = lists.with_view(config, "open", task="todo", tags=["x"])
    lists.write_config(config, str(tmp_path))
    again = lists.load_config(str(tmp_path))
    assert again["schema"]["types"]["note"]["required"] == ["title"] and lists.view(again, "open").tags == ["x"]
    again = lists.without_view(lists.without_type(again, "note"), "open")
    assert again["views"] == {} and again["schema"]["types"] == {}
    for bad in (lambda: lists.without_type(again, "note"), lambda: lists.without_view(again, "open")):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(ValueError):
        lists.with_type(again, "bad", properties={"p": {"type": "what"}})


def test_files_are_named_loosely(notes):
    ask = lambda x: lists.resolve_file(notes, x)
    assert ask("./alpha") == ("alpha.md", None) and ask("ALPHA.md") == ("alpha.md", None) and ask("sub/nestd.md") == (None, "nested.md")
    assert ask("sub/whatever.md") == (None, None)


def test_reserved_names_and_blank_lines():
    assert [f[0] for f in lint.skill_findings("s/SKILL.md", {"name": "Claude"}, [])] == ["SKILL001", "SKILL002"]
    note = M.parse_note("# T\n\n```py\nx\n```\n\ntext\n")
    assert not [f for f in lint.body_findings([vars(x) for x in note.lines], "\n") if f[0] == "MD012"]


@pytest.mark.parametrize(
    ("language", "words"),
    [
        ("german", "aufeinander aufeinand kategorischen kategor häuser haus freundlichkeiten freundlich bedürfnisse bedurfnis katzen katz größe gross autobahnen autobahn aufgeräumten aufgeraumt süßigkeiten sussig"),
        ("spanish", "chicas chic torneos torne trabajadores trabaj corriendo corr felicidad felic químicamente quimic hablábamos habl tecnología tecnolog existencia existent cheques chequ"),
        ("french", "continuation continu continuellement continuel maintenaient mainten majestueusement majestu majorité major maladies malad chevaux cheval quantité quantit constamment const évidemment évident finissaient fin"),
        ("english", "running run machines machin"),
        ("finnish", "taloissa taloissa"),
    ],
)
def test_stemmers(language, words):
    from quire.functions.snowball import stemmer

    words = words.split()
    assert [stemmer(language)(w) for w in words[::2]] == words[1::2]
    for odd in ("", "a", "ß", "y", "qu", "éè", "uyy", "iv", "niss", "123"):
        assert isinstance(stemmer(language)(odd), str)


def test_languages_of_notes_and_queries(spark):
    from quire.sources.vault import parse

    texts = {"f.md": "---\nlanguage: fr\n---\nles maladies\n", "e.md": "maladies here\n", "x.md": "---\nlanguage: klingon\n---\nmalade\n", "g.md": "---\nlanguage: 3\n---\nHäuser\n"}
    notes = parse(spark.createDataFrame([(k, None, v) for k, v in texts.items()], "rel_path string, modified timestamp, text string"))
    found = lambda pattern, language=None: sorted(r.file for r in find(notes, Find(pattern=pattern, language=language)).collect())
    assert found("malade", "french") == ["e.md", "f.md", "x.md"]  # what has no language of its own follows the query
    assert found("maladies") == ["e.md"]
    assert found("haus", "de") == ["g.md"] and found("haus") == []


def test_search_of_postings_and_of_words_agree(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(f"d{i}", " ".join(r.choices("ab cd ef gh ij kl".split(), k=r.randint(0, 12)))) for i in range(80)], "rel_path string, t string")
    index = S.build_index(docs, docs["t"])
    stored = S.Index(index.postings, index.doc_stats)
    rows = lambda i, q, c=None: sorted((x.rel_path, round(x.score, 9)) for x in S.bm25(i, S.parse_query(q), c).collect())
    for q in ("ab cd", "ab OR zz", '"ab cd" ef', '"ab cd" OR "ef gh" kl', "ab -cd", 'ab ab -"ef gh"', "zz", '"ab zz"', "-ab", '"ab zz" OR cd'):
        assert rows(index, q) == rows(stored, q)
        assert rows(index, q, docs.where("rel_path < 'd4'")) == rows(stored, q, docs.where("rel_path < 'd4'"))


def test_plain_values_are_written_as_yaml_writes_them():
    import yaml

    for value in ("open", "a b", "yes", "No", "x-1", "a/b_", "b ", " a", "1a", "null", "~", "a: b", "a #b", "-", True, False, 0, -7, 10**20, "é", ""):
        for key in ("status", "on", "my key", "k:x"):
            assert mutate._dump(key, value) == yaml.safe_dump({key: value}, allow_unicode=True, default_flow_style=False, sort_keys=False, width=1 << 30).rstrip("\n").split("\n")
    first, _ = M.parse_yaml("a: [1]")
    first["a"].append(2)
    assert M.parse_yaml("a: [1]") == ({"a": [1]}, None)


def test_moves_are_undone_if_one_fails(spark, tmp_path):
    top = tmp_path / "v"
    for name in ("a.md", "b.md", "c.md", "in/c.md"):
        os.makedirs((top / name).parent, exist_ok=True)
        (top / name).write_text(name)
    rows = lambda *names: spark.createDataFrame([(n, f"in/{n}", "move") for n in names], "rel_path string, dest string, state string")
    held = lambda: sorted(os.path.relpath(os.path.join(d, f), top) for d, _, fs in os.walk(top) for f in fs)
    before = held()
    assert not sinks.apply_moves(rows("a.md", "b.md", "c.md"), str(top), f"file://{tmp_path}/r1")
    assert held() == before and (top / "in/c.md").read_text() == "in/c.md"
    assert not sinks.apply_moves(rows("no.md"), str(top), f"file://{tmp_path}/r2")
    assert sinks.apply_moves(rows("a.md", "b.md"), str(top), f"file://{tmp_path}/r3")
    assert held() == ["c.md", "in/a.md", "in/b.md", "in/c.md"]
    assert sinks.apply_moves(rows("a.md"), str(top), f"file://{tmp_path}/r4")  # done already


def test_states_of_written_files(spark, tmp_path):
    top = tmp_path / "v"
    os.makedirs(top)
    for name, text in (("a.md", "1"), ("b.md", "2"), ("c.md", "x")):
        (top / name).write_text(text)
    plan = spark.createDataFrame([("a.md", "1", "2"), ("b.md", "1", "2"), ("c.md", "1", "2"), ("d.md", "1", "2"), ("e.md", "1", "1")], "rel_path string, before string, after string")
    assert sinks.apply(plan, str(top), f"file://{tmp_path}/report") == 2
    assert {r.rel_path: r.state for r in spark.read.parquet(f"{tmp_path}/report").collect()} == {"a.md": "written", "b.md": "there", "c.md": "changed", "d.md": "failed"}


def _reordered(df):
    """The same rows in another order each time that they are computed, as a shuffle on a cluster may give them."""

    def rows(frames):
        for frame in frames:
            order = list(range(len(frame)))
            random.SystemRandom().shuffle(order)
            yield frame.iloc[order]

    return df.repartition(1).mapInPandas(rows, df.schema)


@pytest.fixture(scope="module")
def reordered_links(spark):
    """(links, paths): of each note n one to the note n + 1, the last of them to none."""
    links = spark.range(300).selectExpr("concat('a/', id, '.md') AS rel_path", "2 AS line", "CASE WHEN id % 2 = 0 THEN 'wikilink' ELSE 'markdown' END AS kind", "CASE WHEN id = 299 THEN '../../out.md' WHEN id % 2 = 0 THEN concat('', id + 1) ELSE concat((id + 1), '.md') END AS target", "CAST(NULL AS STRING) AS label", "concat('h', id) AS fragment")
    return _reordered(links), spark.range(300).selectExpr("concat('a/', id, '.md') AS rel_path")


def test_broken_anchors_in_any_order_of_links(reordered_links):
    links, paths = reordered_links
    heads = paths.selectExpr("rel_path", "concat('H', CAST(regexp_extract(rel_path, '([0-9]+)', 1) AS INT) - 1) AS heading").where("rel_path <> 'a/7.md'")
    assert [(r.rel_path, r.path) for r in L.broken_anchors(L.resolve(links, paths), heads).collect()] == [("a/6.md", "a/7.md")]


def test_health_in_any_order_of_links(reordered_links):
    assert L.health(L.resolve(*reordered_links)).first().asDict() == {"total": 300, "broken": 0, "out_of_vault": 1}


def test_verdicts_in_any_order_of_links(reordered_links):
    found = {r.rel_path: (r.path, r.verdict) for r in L.resolve(*reordered_links).collect()}
    want = {f"a/{i}.md": (f"a/{i + 1}.md", "resolved" if i % 2 else "short-form") for i in range(299)}
    assert found == want | {"a/299.md": (None, "out-of-vault")}


def test_lint_of_scanned_notes(spark, root, notes, resolved):
    schema = lint.Schema(default={"properties": {"status": {"type": "enum", "values": ["planned", "completed"]}}})
    rows = kept(lint.scanned(discover(spark, root)))
    cells = lambda df: sorted(tuple(r) for r in df.select("file", "rule_id", "severity", "line", "message").collect())
    found = cells(lint.findings(rows, schema, resolved))
    assert found == cells(lint.lint(notes, schema, resolved)) and {"MD022", "NOTE005", "NOTE006", "SCHEMA"} <= {f[1] for f in found}


def test_lint_groups_parse_texts_once(spark):
    from quire.plans.queries import QUERIES

    # the texts are parsed before the plan starts, and their findings are read from then on
    plan = QUERIES["lint_vault_groups"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_word_edges_in_expressions(spark):
    titles = spark.createDataFrame([("Le mot",), ("Le",), ("Leè",), ("Lent",), ("le_x",), ("éle",), (None,)], "title string")
    held = lambda q: [r.title for r in titles.where(X.title_predicate(q, F.col("title"))).collect()]
    assert held(r"/^le\b/") == ["Le mot", "Le", "Leè"] and held(r"/^le\B/") == ["Lent", "le_x"] and held(r"/\ble$/") == ["Le", "éle"]
    assert X.checked_regex(r"[\b]\\b\Q\b\E") == r"[\b]\\b\Q\b\E"


def test_common_titles_at_the_bound_of_the_sql(spark, compare, tmp_path):
    from quire.plans.queries import ORACLES, QUERIES

    # a fortieth of 1,041 is 26.025: the SQL takes words met 26 times
    docs = spark.range(1041).selectExpr("id AS doc_id", "concat('w', id, CASE WHEN id < 26 THEN ' Edge' WHEN id < 51 THEN ' below' ELSE '' END) AS text", "'s' AS source")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["common_titles"](spark, str(tmp_path))
    assert [r.key for r in found.collect()] == ["edge"]
    compare(found, ORACLES["common_titles"], {"documents": f"{tmp_path}/documents.parquet/*.parquet"})


@pytest.fixture(scope="module")
def odd_documents(spark, tmp_path_factory):
    """Documents without an id or a source, of ids below 0, of sources that are nested, hold what URLs escape or (in `top`) are empty."""
    folder = tmp_path_factory.mktemp("odd")
    for name, empty in (("odd", "s"), ("top", "")):
        sources = f"array(CAST(NULL AS STRING), 's', '{empty}', 'a/b', 'Übé', '50%25', 'S t+', 's')"
        rows = spark.range(-60, 1300).selectExpr("id AS doc_id", f"element_at({sources}, CAST(pmod(id, 8) + 1 AS INT)) AS source")
        rows.union(spark.sql("SELECT CAST(NULL AS BIGINT), 's'")).write.parquet(f"{folder}/{name}/documents.parquet")
    return str(folder)


# a bare name of a note at the top is its exact path here, so its verdict is resolved where the SQL has short-form
@pytest.mark.parametrize("name", ["odd link_resolve_fallback", "top link_health", "top broken_anchors"])
def test_links_of_odd_documents(spark, compare, odd_documents, name):
    from quire.plans.queries import ORACLES, QUERIES

    folder, name = f"{odd_documents}/{name.split()[0]}", name.split()[1]
    compare(QUERIES[name](spark, folder), ORACLES[name], {"documents": f"{folder}/documents.parquet/*.parquet"})
