"""Pairs are counted where their first end is: no shuffle is keyed by both ends."""

import re

from inkfathom.operators import impacts
from inkfathom.plans import extras, graph, ingest, sparse

SF = "/root/testdata/sf0.001"


def keys(df):
    """The columns of each shuffle of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]


def test_prefetch_scores_texts_in_place(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("postings are shuffled by term")

    monkeypatch.setattr(impacts, "best_bm25", never)
    assert sparse.prefetch_fusion(spark, SF).count() > 0


def test_dependency_v2(spark):
    assert not [k for k in keys(graph.template_dependency_v2(spark, SF)) if len(k) > 1]


def test_related_documents(spark, monkeypatch):
    whole = graph.related_documents(spark, SF)
    assert not [k for k in keys(whole) if len(k) > 1]
    monkeypatch.setattr(graph, "_DOCUMENTS", 2)  # lists in parts
    assert sorted(whole.collect()) == sorted(graph.related_documents(spark, SF).collect()) != []


def test_dependency_v1(spark):
    assert not [k for k in keys(graph.template_dependency_v1(spark, SF)) if len(k) > 1]


def test_coverage_deals_lines_once(spark):
    assert keys(graph.coverage_counts(spark, SF)) == [["chunk"]]


def test_entity_channel_counts_by_chunk(spark):
    assert not [k for k in keys(extras.entity_anchored_channel(spark, SF)) if "chunk" in k[1:] or "chunk_id" in k[1:]]


def test_html_sections_hold_few_pages(spark):
    found = ingest.html_sections(spark, SF)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    many = spark.range(130).selectExpr("id AS page_id", "if(id % 9 = 0, null, concat('<h1>t', id, '</h1><p>some words of text</p>')) AS html").coalesce(1)
    rows = ingest.ingest.html_sections(many).collect()
    assert sorted(tuple(r) for r in rows) == [(i, 0, 1, f"t{i}", "some words of text") for i in range(130) if i % 9]
