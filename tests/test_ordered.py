"""Passes over groups: a group that goes over batches, null keys, and one stream a task."""

import pytest

from inkfathom.operators import building, chunking, diffusion
from inkfathom.operators.ordered import by_group


def test_groups_go_over_batches(spark):
    rows = [(k, n) for k in (*range(20), None) for n in range(k or 7)]
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(conf)
    spark.conf.set(conf, "3")
    try:
        df = spark.createDataFrame(rows, "k bigint, n bigint").repartition(5)
        got = by_group(df, "k", ["n"], lambda own: [{"k": own[0]["k"], "all": ",".join(str(r["n"]) for r in own)}], "k bigint, all string").collect()
    finally:
        spark.conf.set(conf, had)
    assert sorted(map(repr, got)) == sorted(f"Row(k={k}, all='{','.join(map(str, range(k or 7)))}')" for k in (*range(20), None))


@pytest.mark.parametrize("operator", ["greedy", "semantic", "batches", "diffuse"])
def test_no_call_of_its_own_for_each_group(spark, operator):
    s = spark.createDataFrame([(1, "a", 0, 1, "x", "one two.")], "document_id bigint, section_id string, ord bigint, level bigint, heading string, text string")
    c, e = spark.createDataFrame([("q", 1, 1.0)], "query_id string, id bigint, score double"), spark.createDataFrame([("q", 1, 2, 1.0)], "query_id string, a bigint, b bigint, weight double")
    df = {
        "greedy": lambda: chunking.greedy_chunks(s), "semantic": lambda: chunking.semantic_chunks(s), "diffuse": lambda: diffusion.diffuse(c, e),
        "batches": lambda: building.text_batches(s, "document_id", "ord", "level", 8, 1500),
    }[operator]()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan and len(df.collect()) == 1
