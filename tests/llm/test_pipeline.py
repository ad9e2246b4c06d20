import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from lumenweave.llm.common import save, table

    docs, out = table(spark, SF, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        after = save(f(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(spark, stages):
    from lumenweave.llm import classifier, mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [s[0] for s in stages] == ["quality", "near_duplicates", "personal_data", "mixture", "tokens"]
    assert all(after.columns == docs.columns for _, _, after in stages[:-1])
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    scored = classifier.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(stages[0][2]) == ids(scored.filter("score >= 0.5"))
    assert set(ids(stages[1][2])) <= set(ids(stages[1][1])) and ids(stages[2][1]) == ids(stages[2][2])
    assert stages[2][2].filter("text rlike '[a-z0-9]@[a-z0-9-]+\\\\.[a-z]'").count() == 0
    report = mixing.mix_report(stages[3][1]).filter("size > 0").select("doc_id", (F.col("taken") / F.col("size")).cast("int").alias("n")).filter("n > 0")
    assert sorted(map(tuple, report.collect())) == sorted(map(tuple, stages[3][2].groupBy("doc_id").agg(F.count(F.lit(1)).cast("int")).collect()))
    texts = lambda df: sorted(r.text for r in df.select("text").collect())
    assert texts(stages[4][1]) == texts(stages[4][2])


def test_stages_equal_brute_force(stages):
    """Near-duplicates against all pairs, redaction against a plain loop over the spans."""
    from test_dedup import classes
    from test_filters import plain_redaction

    from lumenweave.llm import pii

    rows = [(r.doc_id, r.text) for r in stages[1][1].select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in stages[1][2].select("doc_id").collect()) == sorted({c for _, c in classes(rows)})
    spans = {r.doc_id: r.spans for r in pii.pii_report(stages[2][1]).collect()}
    want = {r.doc_id: plain_redaction(r.text, spans[r.doc_id]) for r in stages[2][1].select("doc_id", "text").collect()}
    assert {r.doc_id: r.text for r in stages[2][2].select("doc_id", "text").collect()} == want


def test_run_equals_its_stages(spark, stages):
    a, b = corpus_pipeline.run(spark, SF), stages[-1][2]
    assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2:3].isdigit()} == set(range(1, 11))
