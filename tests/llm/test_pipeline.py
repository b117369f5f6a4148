"""Each stage works on what its predecessor kept; the whole is held against the operators one by one."""

from pyspark.sql import functions as F

import corpus_pipeline as C
from localmarkets.llm import decontaminate, exact_dedup, quality, simhash
from localmarkets.shared import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, docs
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        kept = stage(spark, kept, sf)
        rows = kept.select("doc_id").collect()
        assert kept.columns == columns, name
        assert {r.doc_id for r in rows} <= before and len(rows) == len({r.doc_id for r in rows}), name
    packed = {r.doc_id for r in C.run(spark, sf).select("doc_id").collect()}
    assert packed == {r.doc_id for r in kept.select("doc_id").collect()}
    # None of the last stage's documents is one that an operator would take out.
    rest = docs.where(F.col("doc_id").isin(list(packed)))
    assert exact_dedup.dedup_index(rest).where("not kept").count() == 0
    assert simhash.near_duplicates(rest, 5).where("id <> component_id").count() == 0
    assert decontaminate.contaminated(rest, table(spark, sf, "benchmark")).count() == 0
    model = quality.fit(docs, table(spark, sf, "labels"))
    assert quality.keep_good(rest, model).count() == len(packed)


def test_empty(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in C.STAGES:
        docs_out = stage(spark, docs, sf)
        assert docs_out.count() == 0
