import re

import corpus_pipeline as C
from quire.llm import jaccard_join, quality_classifier
from quire.llm.shared import read_table

from tests.llm.test_text_operators import SMALL, brute_components, brute_hits


def test_stages(spark, tmp_path):
    docs = read_table(spark, SMALL, "documents")
    first, columns = docs.collect(), docs.columns
    kept = {}
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[i] = {r.doc_id: r for r in docs.collect()}
        if i < 4:
            assert docs.columns == columns
    texts = {r.doc_id: r.text for r in first}
    labels = {r.doc_id: r.quality for r in read_table(spark, SMALL, "labels").collect()}
    rejected = set(texts) - set(kept[0])
    assert sum(labels.get(d) == 1 for d in rejected) <= 0.05 * sum(v == 1 for v in labels.values())
    heads = {d for d, _, c in brute_components([(d, texts[d]) for d in sorted(kept[0])]) if d == c}
    assert set(kept[1]) == heads
    items = [(r.item_id, r.text) for r in read_table(spark, SMALL, "benchmark").collect()]
    assert set(kept[2]) == {d for d in kept[1] if not brute_hits(texts[d], items)[4]}
    assert set(kept[3]) == set(kept[2])
    for d, r in kept[3].items():
        assert not re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i:password)=[0-9a-f]{8}", r.text)
        assert r.text == texts[d] or "[secret]" in r.text
    assert set(kept[4]) == set(kept[3])


def test_stages_take_odd_rows(spark, odd):
    docs = odd
    for _, stage in C.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), odd.schema)
        assert docs.columns == odd.columns
    assert C.STAGES[4][1](spark, docs, SMALL).count() >= docs.count()
    assert C.STAGES[1][1](spark, odd.limit(0), SMALL).count() == 0


def test_run_gives_what_the_stages_give(spark):
    assert C.run(spark, SMALL).count() > 0
    assert jaccard_join and quality_classifier


def test_one_of_each_reads_its_heads(spark):
    # the last plan starts from the heads, so it doesn't start the exchanges that lead to them, for each branch anew
    plan = jaccard_join.one_of_each(read_table(spark, SMALL, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "quire-heads-" in plan and "quire-links-" not in plan and "quire-sets-" not in plan


def test_free_memory_of_the_driver_goes_back(spark):
    from quire.llm.shared import materialise

    free = spark._jvm.java.util.ArrayList()
    for _ in range(2000):
        free.add(spark._jvm.java.util.zip.Deflater())  # about 256 KB each, outside the heap, between blocks that stay
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    size = lambda: int(re.search(r"Rss:\s+(\d+)", open(f"/proc/{pid}/smaps_rollup").read())[1])
    last = free.get(1999)
    for i in range(1999):
        free.get(i).end()
    before = size()
    materialise(spark.range(3), "small")
    last.end()
    assert size() < before - 100_000
