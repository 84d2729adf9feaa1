"""The queries of this subpackage, each an operator applied to its whole table, and their SQL."""

from __future__ import annotations

from quire.llm.shared import read_table


def op1_secret_scan(spark, sf_dir):
    """Every document's findings of secrets."""
    from quire.llm.secret_scan import secret_findings

    return secret_findings(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    """Every document's counts and its verdict under adaptive thresholds."""
    from quire.llm.quality_rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"))


def op3_token_ids(spark, sf_dir):
    """Every document's ids, written as Simple-8b shards in doc_id order and read back."""
    from quire.llm.pretokens import tokenizer_path
    from quire.llm.token_ids import token_ids

    return token_ids(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_token_counts(spark, sf_dir):
    """Token and byte counts of every document."""
    from quire.llm.pretokens import tokenizer_path
    from quire.llm.token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_decontamination(spark, sf_dir):
    """Every document's words that lie in benchmark windows, and the items they are of."""
    from quire.llm.decontamination import contamination

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("items")


def op6_packing(spark, sf_dir):
    """Every document's pieces and their places in sequences of 1024 tokens."""
    from quire.llm.packing import pack
    from quire.llm.pretokens import tokenizer_path

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_warc(spark, sf_dir):
    """Every page written to Zstandard WARC archives and read back."""
    from quire.llm.warc import warc_round_trip

    return warc_round_trip(read_table(spark, sf_dir, "pages"))


def op8_html_text(spark, sf_dir):
    """Every page's main text."""
    from quire.llm.html_text import extract_pages

    return extract_pages(read_table(spark, sf_dir, "pages"))


def op9_quality_classifier(spark, sf_dir):
    """Every document's quality score."""
    from quire.llm.quality_classifier import quality_scores

    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark, sf_dir):
    """Every document's component under 5-word shingle similarity of 0.8 or more."""
    from quire.llm.jaccard_join import jaccard_join

    return jaccard_join(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_token_ids, op4_token_counts, op5_decontamination, op6_packing, op7_warc, op8_html_text, op9_quality_classifier, op10_jaccard_join)}


#: Lower-casing of A to Z alone, as SQL.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
       FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(p)),
hit AS (SELECT doc_id, item_id, dw.n, p FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT p + o) AS n_hit FROM hit, unnest(range(0, n)) t(o) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
          sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS items_sha256 FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS head FROM p),
bits AS (SELECT page_id, h, head, sha1(h) AS x FROM m)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (list_sum(list_transform(range(0, 5), lambda j: ((('0x' || substr(x, (5 * i + j) // 4 + 1, 1))::INT >> (3 - (5 * i + j) % 4)::INT) & 1) << (4 - j)::INT)) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < head THEN head END AS refers_to
FROM bits
"""


OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + least(5, len(w)) - 1), ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.doc_id)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(r), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    from quire.llm import quality_rules

    return {"op7_warc": OP7_SQL, "op2_quality_rules": quality_rules.oracle_sql(), "op5_decontamination": OP5_SQL, "op10_jaccard_join": OP10_SQL}
