import __spark_entry__
import corpus_pipeline
from spindrift.llm.queries import QUERIES


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert QUERIES.keys() | {"pipeline"} <= __spark_entry__.queries().keys()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "packing"]


def test_pipeline_by_its_stages(spark, sf, messy):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, sf)
        assert left.columns == docs.columns, name
        assert 0 < left.count() <= docs.count()
        kept = stage(spark, messy, sf)
        assert kept.columns == messy.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = left
    total = sum(r.length for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect())
    assert total == sum(r.length for r in corpus_pipeline.run(spark, sf).collect()) > 0
