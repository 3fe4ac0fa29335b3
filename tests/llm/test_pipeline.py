"""The pipeline's stages on the small documents, each against what brute force expects of it."""

import re

import corpus_pipeline
from packetloom.llm import queries
from packetloom.llm.common import table

DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    before = docs.count()
    names = docs.columns
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR).cache()
        counts.append(out.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == names, name
        if name == "exact_dedup":
            bare = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.collect()]
            assert counts[-1] == len(set(bare))
        if name == "quality_classifier":
            clean = table(spark, DIR, "labels").filter("quality = 1").join(docs, "doc_id", "left_semi").select("doc_id")
            assert clean.join(out, "doc_id", "left_anti").count() <= 0.02 * clean.count()
        docs = out
    assert before > counts[0] > counts[1] >= counts[2] and counts[3] == counts[4]
    assert docs.filter("not round_trip").count() == 0
    spark.catalog.clearCache()


def test_registered():
    import __spark_entry__ as entry

    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES)
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries() and queries.SQL.keys() <= entry.queries().keys()
