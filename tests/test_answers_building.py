import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfathom.functions import scalars as S
from inkfathom.operators import answers, building, chunking, context, fusion, guards, learning, search
from inkfathom.sources import sinks
from inkfathom.streaming import jobs


def test_confidence_by_hand(spark):
    d = spark.createDataFrame([([0.9, 0.8, 0.7, 0.2, 0.1], [0.9, 0.6, 0.3], [True, False, False, False, False]), ([], [], [])], "s array<double>, e array<double>, p array<boolean>")
    got = [r[0] for r in d.select(answers.confidence(F.col("s"), F.col("e"), F.col("p"))).collect()]
    # threshold: the fourth of five sorted scores, 0.8; two reach it; one of five has a path
    assert got[0] == pytest.approx(0.3 * 0.9 + 0.2 * 0.6 + 0.2 * 2 / 3 + 0.3 * 0.2) and got[1] == 0
    one = spark.range(1).select(S.confidence(F.lit(1.0), F.lit(0.5), F.lit(0.5), F.lit(1.0)).alias("c")).first()["c"]
    assert one == pytest.approx(0.3 + 0.1 + 0.1 + 0.3)


def test_dedup_falls_back_to_the_vector_score(spark):
    rows = [(1, 1, "a", 0.9, None, 1.0, None, None), (1, 1, "b", 0.1, 0.8, 2.0, 0.5, None), (1, 2, "c", 0.3, None, None, None, None)]
    d = spark.createDataFrame(rows, "query_id int, id int, source string, vector double, graph double, bm25 double, fused double, rerank double")
    got = {r["id"]: r for r in fusion.dedup_merged(d).collect()}
    assert (got[1]["source"], got[1]["vector"], got[1]["graph"], got[1]["bm25"]) == ("a", 0.9, 0.8, 2.0)
    assert got[1]["fused"] == pytest.approx(0.7 * 0.9 + 0.3 * 0.8)
    assert got[2]["fused"] is None and got[2]["graph"] is None


def test_batches_and_rerank(spark):
    assert answers.batches(["a b", "c " * 1023, "d"], 32, 1024) == [[0], [1, 2]]
    assert [len(b) for b in answers.batches(["x"] * 70)] == [32, 32, 6]
    assert answers.batches(["y " * 5000, "z"]) == [[0], [1]]
    c = spark.createDataFrame([(1, "red fox", 1, "a fox", 0.2), (1, "red fox", 2, "red fox", 0.1), (1, "red fox", 3, "", 0.9)], "query_id int, query string, id int, text string, score double")
    assert [(r["id"], r["rerank"], r["rank"]) for r in answers.rerank(c).orderBy("rank").collect()] == [(2, 1.0, 1), (1, 0.5, 2)]

    def broken(query, texts):
        raise RuntimeError("down")

    assert [(r["id"], r["rerank"]) for r in answers.rerank(c, broken).orderBy("rank").collect()] == [(1, None), (2, None)]


def test_citations(spark):
    labels = [(0, "Guide", 1), (2, "Other", 2), (2, "Step 1", 2), (2, "other", 3), (1, " First ", 0), (3, "", 0)]
    d = spark.createDataFrame([(labels, "Guide"), ([(0, "Guide", 1)], "Guide"), ([(0, "Guide", 1), (0, "Part", 1)], "guide"), ([], "x")], f"labels {answers.LABELS}, heading string")
    got = [r[0] for r in d.select(answers.citation_order(F.col("labels"), F.col("heading"))).collect()]
    assert got == [["First", "Step 1", "Other"], ["Guide"], ["Part"], []]
    texts = ['[{"order": 2, "heading": "A", "level": 1}, {"title": "B"}, {"order": "x", "heading": ""}]', '{"sections": [{"order": "3", "title": "C"}]}', "{}", "no json", None]
    j = spark.createDataFrame([(t,) for t in texts], "j string")
    assert [[tuple(x) for x in r[0]] for r in j.select(answers.parsed_boundaries(F.col("j"))).collect()] == [[(2, "A", 1), (0, "B", 0)], [(3, "C", 0)], [], [], []]
    c = spark.createDataFrame([(1, 1, ["a", "b"], "h", False), (1, 2, [], "h", True), (1, 3, [], None, False)], "d int, o int, titles array<string>, heading string, extra boolean")
    assert answers.numbered_citations(c, "d", ["o"]).first()["citations"] == "[1] a\n[2] b\n[3] Related: h\n[4] Section"


def test_cursor_and_trigger(spark):
    assert answers.offset_of("MjA=") == 20 and answers.offset_of(None) == 0 and answers.offset_of("?") == 0
    d = spark.createDataFrame([("g", i) for i in range(5)], "g string, i int")
    page = answers.page(d, "g", ["i"], "Mg==", 2).collect()
    assert [(r["i"], r["next_cursor"]) for r in page] == [(2, "NA=="), (3, "NA==")]
    assert [r["next_cursor"] for r in answers.page(d, "g", ["i"], "NA==", 2).collect()] == [None]


def test_containing_against_brute_force(spark):
    wide = ["abcabc", "xyz", "a", "ab", "hello there", "there", "éa", "cab"]
    narrow = ["ab", "abc", "z", "there", "nothing", "hello there you", "éa", "c"]
    got = building.containing(spark.createDataFrame([(t,) for t in wide], "text string"), spark.createDataFrame([(t,) for t in narrow], "part string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((w, n) for w in wide for n in narrow if n in w)


def test_knn_on_odd_vectors(spark):
    schema = "id bigint, vector array<double>, grp bigint"
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, None, 0), (3, [float("nan"), 1.0], 0), (4, [1.0, 1.0, 1.0], 0), (5, [0.0, 0.0], 0), (6, [0.0, 1.0], 0), (7, [1.0, None], 0)], schema)
    queries = spark.createDataFrame([(10, [1.0, 1.0], 0), (11, None, 0), (12, [2.0, 2.0, 2.0], 0)], schema.replace("id", "query_id", 1))
    want = [(10, 1, 0.707106781), (10, 5, 0.0), (10, 6, 0.707106781), (12, 4, 1.0)]
    for block in (1, 2, 100):
        got = search.knn(rows, queries, 5, block=block)
        assert sorted((r["query_id"], r["id"], r["score"]) for r in got.collect()) == want
    assert search.knn(rows, queries, None).count() == 4
    both = search.knn_fields(rows.where("id in (1, 6)"), queries.where("query_id = 10"), 1, {"a": slice(0, 1), "b": slice(1, 2)}).collect()
    assert sorted((r["field"], r["id"]) for r in both) == [("a", 1), ("b", 6)]


def section(n, level, heading, words, word="w"):
    return {"section_id": f"s{n}", "ord": n, "level": level, "heading": heading, "text": " ".join([word] * words)}


def greedy(sections, least=5, target=20, hard=40, most=4, overlap=2):
    made = chunking.greedy(sections, "d", least, target, hard, most, chunking.BREAKS, overlap)
    return [c["section_ids"] for c in chunking.balance(made, least, hard)]


def test_greedy_chunks_by_hand():
    # sections of one block join until the target; a level 2 heading begins a block
    assert greedy([section(0, 2, "", 8), section(1, 3, "", 8), section(2, 3, "", 8), section(3, 3, "", 8), section(4, 2, "", 8)]) == [["s0", "s1", "s2"], ["s3"], ["s4"]]
    # alike at level 3: apart, however small
    assert greedy([section(0, 3, "", 2), section(1, 3, "", 2), section(2, 4, "", 2)]) == [["s0"], ["s1", "s2"]]
    # a break word begins a block and is not joined; a small tail joins what stands before it
    assert greedy([section(0, 2, "", 10), section(1, 3, "FAQ", 10)]) == [["s0"], ["s1"]]
    assert greedy([section(0, 2, "", 10), section(1, 2, "Glossary", 3)]) == [["s0", "s1"]]
    # never beyond the hard limit
    assert greedy([section(0, 2, "", 15), section(1, 3, "", 30)]) == [["s0"], ["s1"]]
    long = chunking.greedy([section(0, 2, "", 100)], "d", 5, 20, 40, 4, chunking.BREAKS, 2)
    assert [c["ord"] for c in long] == [0, 1, 2] and all(c["is_split"] and c["token_count"] <= 40 for c in long) and len({c["chunk_id"] for c in long}) == 3


def test_semantic_chunks():
    assert chunking.merge_tiny([("a", 1), ("b", 9), ("c", 9), ("d", 1)], 3) == [("a\n\nb", 10), ("c\n\nd", 10)]
    assert chunking.merge_tiny([], 3) == [] and chunking.merge_tiny([(" ", 0)], 3) == []
    text = "cat dog cat dog. cat dog dog. sun moon star. moon star sun."
    pieces = chunking.semantic(text, chunking.hashed_embedding, 100, 1, 1000, 0.1)
    assert " ".join(p for p, _ in pieces) == text and sum(n for _, n in pieces) == chunking.count(text)
    code = "```\n" + "x = 1\n" * 60 + "```"
    assert len(chunking.semantic(code, chunking.hashed_embedding, 50, 5, 1000, 0.1)) == 4
    assert all(n <= 30 for _, n in chunking.semantic("word " * 100, chunking.hashed_embedding, 500, 5, 30, 0.1))
    v = chunking.hashed_embedding(["a b", ""])
    assert np.linalg.norm(v[0]) == pytest.approx(1) and not v[1].any()


def test_chunk_assemblers(spark):
    rows = [(1, f"s{i}", i, 2 + i % 2, f"h{i}" if i else None, "one two three. four five." if i != 2 else None) for i in range(4)]
    d = spark.createDataFrame(rows, "document_id int, section_id string, ord bigint, level bigint, heading string, text string")
    for kind in ("greedy", "semantic", "unknown"):
        got = chunking.assembler(kind)(d).collect()
        assert {s for r in got for s in r["section_ids"]} >= {"s0", "s1", "s3"}
    assert chunking.assembler("greedy")(d.where("false")).count() == 0


class FailingFiles:
    """Renames fail from the given one on."""

    def __init__(self, files, fail):
        self.files, self.fail, self.n, self.deleted = files, fail, 0, []

    def exists(self, path):
        return path in self.files

    def rename(self, a, b):
        self.n += 1
        if self.n == self.fail:
            return False
        self.files[b] = self.files.pop(a)
        return True

    def delete(self, path, _):
        self.deleted.append(path)
        del self.files[path]


@pytest.mark.parametrize("fail", [1, 2])
def test_a_failed_rename_keeps_the_old_table(fail):
    fs = FailingFiles({"t": "old", "new": "new"}, fail)
    with pytest.raises(OSError):
        sinks.swap(fs, "t", "new", "t.old")
    assert fs.files == {"t": "old", "new": "new"} and not fs.deleted


def test_swap_and_latest(spark):
    fs = FailingFiles({"t": "old", "new": "new"}, 0)
    sinks.swap(fs, "t", "new", "t.old")
    assert fs.files == {"t": "new"}
    d = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c"), (None, 3, "d"), (None, 1, "e")], "k int, at int, x string")
    assert sorted(r["x"] for r in jobs.latest(d, "k", "at").collect()) == ["b", "c", "d"]
    assert jobs.latest(d, "k").count() == 3


def test_written_tables_and_reports(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id int, vector array<double>")
    sinks.write_vectors(v, str(tmp_path / "v"), 2)
    sinks.write_vectors(v, str(tmp_path / "v"), 2, "v2")
    assert spark.read.parquet(str(tmp_path / "v")).first()["embedding_version"] == "v2"
    with pytest.raises(Exception):
        sinks.write_vectors(v, str(tmp_path / "w"), 3)
    sinks.write_report(v, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["id"] == 1


def test_a_resumed_pipeline_runs_only_what_is_missing(spark, tmp_path):
    ran = []

    def stage(name):
        def run(rows):
            ran.append(name)
            return rows.withColumn(name, F.lit(len(ran)))

        return name, run

    start = spark.range(3).toDF("id")
    first = jobs.resumed(spark, str(tmp_path), [stage("parse"), stage("extract")], start).columns
    again = jobs.resumed(spark, str(tmp_path), [stage("parse"), stage("extract"), stage("graph")], start)
    assert first == ["id", "parse", "extract"] and again.columns == ["id", "parse", "extract", "graph"] and ran == ["parse", "extract", "graph"]


def test_scalar_pieces(spark):
    row = spark.createDataFrame([("Crème Brûlée!", 7)], "t string, u int")
    got = row.select(S.slug(F.col("t")).alias("slug"), S.in_rollout("f", F.col("u"), 100).alias("on"), S.in_rollout("f", F.col("u"), 0).alias("off")).first()
    assert (got["slug"], got["on"], got["off"]) == ("creme-brulee", True, False)
    key = lambda v: row.select(S.cache_key(F.struct("u"), v)).first()[0]
    assert key("v1") == key(F.lit("v1")) != key("v2") and len(key("v1")) == 16
    assert row.select(S.code_ratio(F.lit("ab```x```"))).first()[0] == pytest.approx(7 / 9)


def test_registry_library_guards(spark):
    reg = learning.Registry(spark)
    reg.register("a", 4, "m", active=True)
    with pytest.raises(ValueError):
        reg.register("a", 4, "m")
    with pytest.raises(KeyError):
        reg.activate("b")
    assert reg.table().first()["active"] and learning.default_version("search") == "v4" and learning.default_version("none") == "v1"
    assert learning.render("explain").__name__ == "template_explain_v2"
    with pytest.raises(ValueError):
        learning.render("explain", "v9")
    from inkfathom.queries import QUERIES

    assert all(q in QUERIES for v in learning.LIBRARY.values() for q in v.values())
    r = spark.createDataFrame([("comparison", 9, 1, "MENTIONS"), ("comparison", 1, 1, "AFFECTS"), ("odd", 1, 1, "MENTIONS")], "template string, depth bigint, results bigint, rel string")
    assert [x["verdict"] for x in guards.guarded(r).collect()] == ["clamped", "refused", "refused"]
    c = spark.createDataFrame([(1, 0, 0, 10, 100), (1, 1, 1, 10, 100), (1, 2, 0, 60, 100)], "d int, o int, p int, t int, b int")
    assert context.phase_budget(c, "d", "o", "p", "t", "b", 100, 1000, {0: 0.5, 1: 0.5}).count() == 2
