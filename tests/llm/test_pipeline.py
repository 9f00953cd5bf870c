"""Each stage on its own input, and the whole run."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from lanternq.llm import byte_cnn, decontaminate, mixing

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of each stage, written and read again as on a cluster."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{i}"
        stage(spark, docs, FOLDER).write.parquet(path)
        done = spark.read.parquet(path)
        out.append((docs, done))
        docs = done
    return out


def test_columns(stages):
    for docs, done in stages[:-1]:
        assert done.columns == docs.columns


def test_quality_stage(spark, stages):
    docs, done = stages[0]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    want = {r["doc_id"] for r in byte_cnn.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in done.select("doc_id").collect()} == want


def test_near_duplicate_stage(stages):
    from .test_dedup import brute_groups

    docs, done = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in done.collect()) == sorted({c for _, _, c in brute_groups(rows)})


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark, docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "q"), (None, "q"), (3, None), (4, ""), (5, "one text of its own"), (5, "and another one that shares the id"), (None, "one text of its own")]
    got = P.near_duplicates(spark, docs(rows), FOLDER).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(1, "a b c d e f"), (None, "q"), (3, None), (5, "one text of its own"), (5, "and another one that shares the id")], key=repr)


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, score double, leaks string, bytes string, fp long, r long, copies long, `a.b` string"


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, k):
    """Null cells, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    _, stage = P.STAGES[k]
    rows = [(1, "good words " * 20), (1, "good words " * 20), (None, "a b c d e"), (2, None), (3, ""), (4, " \t\n"), (5, "long " * 40_000), (6, "é 😀 \x0b z")]
    df = spark.createDataFrame([(i, t, "en" if i else None, "src1" if t else None, 1, 0.5, None, "x", 7, 8, 9, "y") for i, t in rows], CLASHES)
    got = stage(spark, df, FOLDER)
    if k < 4:
        assert got.columns == df.columns and set(map(tuple, got.collect())) <= set(map(tuple, df.collect()))
    else:
        assert got.count() == len(rows)
    assert stage(spark, df.limit(0), FOLDER).count() == 0


def test_decontamination_stage(spark, stages):
    from .test_models import plain_leaks

    docs, done = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {r["doc_id"] for r in done.collect()}
    for r in docs.collect():
        if len(decontaminate.words(r["text"])) < 500:
            assert (r["doc_id"] in kept) == (not plain_leaks(r["text"], items))


def test_mixing_stage(stages):
    docs, done = stages[3]
    want = {r["doc_id"]: r["copies"] for r in mixing.mixture(docs).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in done.groupBy("doc_id").count().collect()} == want
    assert 0 < done.count() != docs.count()


def test_token_stage(stages):
    docs, done = stages[4]
    assert done.count() == docs.count()
    assert done.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == done.agg(F.sum("n_tokens")).first()[0]


def test_run(spark, stages):
    assert sorted(map(tuple, P.run(spark, FOLDER).collect())) == sorted(map(tuple, stages[4][1].collect()))


