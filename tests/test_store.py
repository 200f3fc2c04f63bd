"""Merge-on-read tables and sagas: what is written, what readers see, crashes at each step."""

import pytest
from pyspark.sql import functions as F

from inkfathom.sources import store
from inkfathom.sources.store import KeyedTable

SCHEMA = "k bigint, v string, w array<double>"


def made(spark, path, buckets=8):
    return KeyedTable.create(spark, str(path), SCHEMA, "k", buckets)


def rows(spark, *pairs):
    return spark.createDataFrame([(k, v, [1.0] if v else None) for k, v in pairs], SCHEMA)


def content(table, version=None):
    return sorted(((r["k"], r["v"]) for r in table.read(version).collect()), key=str)


def test_a_batch_writes_only_its_buckets(spark, tmp_path):
    t = made(spark, tmp_path / "t")
    assert content(t) == []
    t.merge(rows(spark, *((i, f"a{i}") for i in range(40))))
    before = {b: list(fs) for b, fs in t.manifest()["buckets"].items()}
    t.merge(rows(spark, (3, "new"), (3, "newer"), (100, "more")), order="v")
    after = t.manifest()["buckets"]
    own = {r[0] for r in spark.createDataFrame([(3,), (100,)], "k bigint").select(F.concat(F.lit("bucket="), F.pmod(F.xxhash64("k"), 8))).collect()}
    assert {b for b in after if after[b] != before.get(b)} == own and len(before) == 8
    (folder,) = {fs[-1] for b, fs in after.items() if b in own}
    assert {n for n in t.files.names(folder) if n.startswith("bucket=")} == own
    want = {i: f"a{i}" for i in range(40)} | {3: "newer", 100: "more"}
    assert content(t) == sorted(want.items(), key=str)
    assert content(t, 1) == sorted(((i, f"a{i}") for i in range(40)), key=str)
    with pytest.raises(ValueError):
        KeyedTable.create(spark, str(tmp_path / "u"), "k bigint, bucket int", "k")


def test_deletes_nulls_compaction_and_vacuum(spark, tmp_path):
    t = made(spark, tmp_path / "t", 2)
    t.merge(rows(spark, (1, "a"), (2, "b"), (None, "none"), (4, None)))
    t.delete(spark.createDataFrame([(2,), (77,)], "k bigint"))
    t.merge(rows(spark, (None, "other"), (5, "e")))
    t.merge(rows(spark, (2, "again")))
    want = [(1, "a"), (2, "again"), (4, None), (5, "e"), (None, "other")]
    assert content(t) == sorted(want, key=str)
    before = t.version()
    t.compact(2)
    assert content(t) == sorted(want, key=str) == content(t, before)
    assert all(len(fs) == 1 for fs in t.manifest()["buckets"].values()) and t.compact(2) == t.version()
    gone = t.vacuum(1)
    assert gone and content(t) == sorted(want, key=str) and t.vacuum(1) == []
    assert KeyedTable(spark, str(tmp_path / "t")).read().schema.simpleString() == "struct<k:bigint,v:string,w:array<double>>"


def test_a_reader_keeps_its_version(spark, tmp_path):
    t = made(spark, tmp_path / "t")
    t.merge(rows(spark, (1, "a")))
    seen = t.read()
    t.merge(rows(spark, (1, "b")))
    t.compact(2)
    assert [r["v"] for r in seen.collect()] == ["a"] and content(t) == [(1, "b")]
    with pytest.raises(FileExistsError):
        t.files.put(f"manifests/{t.version():020d}.json", {})
    assert not [n for n in t.files.names("") if n.startswith(".staged")]


def test_micro_batches_are_merged_once(spark, tmp_path):
    t, where = made(spark, tmp_path / "t"), str(tmp_path / "in")
    for n, batch in enumerate([[(1, "a"), (2, "b")], [(2, "c")], [(3, "d"), (1, "z")]]):
        rows(spark, *batch).withColumn("n", F.lit(n)).coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(f"{SCHEMA}, n int").parquet(where)
        q = store.merge_stream(stream, t, str(tmp_path / "mark"), order="n", compact_at=2)
        assert q.awaitTermination(120), q.stop()
    assert content(t) == [(1, "z"), (2, "c"), (3, "d")]
    version = t.version()
    again = t.manifest()["batches"][str(tmp_path / "mark")]
    assert t.merge(rows(spark, (9, "twice")), source=str(tmp_path / "mark"), number=again) == version and content(t)[-1] == (3, "d")


def test_update_from_diff_and_orphans(spark, tmp_path):
    t = made(spark, tmp_path / "t")
    t.merge(rows(spark, *((i, f"a{i}") for i in range(10))))
    now = rows(spark, *((i, f"a{i}" if i != 4 else "changed") for i in range(2, 12)))
    assert store.update_from_diff(t, now, ["v", "w"]) == {"added": 2, "changed": 1, "removed": 2}
    assert content(t) == sorted(((r["k"], r["v"]) for r in now.collect()), key=str)
    version = t.version()
    assert store.update_from_diff(t, now, ["v", "w"]) == {"added": 0, "changed": 0, "removed": 0} and t.version() == version
    names = spark.createDataFrame([("changed",), ("a5",)], "name string")
    assert sorted(r["k"] for r in store.repair_orphans(t, "v", names, "name").collect()) == [2, 3, 6, 7, 8, 9, 10, 11]
    assert content(t) == [(4, "changed"), (5, "a5")]


class Crash(BaseException):
    """Ends the process, as far as the code under test can tell."""


def three(spark, tmp_path, fail_at=None, error=RuntimeError, late=False):
    tables = {}
    for name in ("documents", "chunks", "vectors"):
        path = tmp_path / name
        tables[name] = KeyedTable(spark, str(path)) if path.exists() else made(spark, path)
        if tables[name].version() == 0:
            tables[name].merge(rows(spark, (1, "old")))

    def change(name):
        def do(table):
            if name == fail_at and not late:
                raise error(name)
            table.merge(rows(spark, (1, "new"), (2, name)))
            if name == fail_at:
                raise error(name)

        return do

    return tables, store.table_saga(spark, str(tmp_path / "journal"), "ingest-1", [(n, t, change(n)) for n, t in tables.items()])


def test_a_saga_completes(spark, tmp_path):
    tables, saga = three(spark, tmp_path)
    assert saga.run() == "completed" == saga.recover() == saga.run()
    assert {n: content(t) for n, t in tables.items()} == {n: [(1, "new"), (2, n)] for n in tables}


@pytest.mark.parametrize("step", ["documents", "chunks", "vectors"])
@pytest.mark.parametrize("late", [False, True])
def test_a_failed_step_undoes_those_before(spark, tmp_path, step, late):
    tables, saga = three(spark, tmp_path, step, late=late)
    assert saga.run() == "compensated" == saga.state()
    assert all(content(t) == [(1, "old")] for t in tables.values())
    undone = [m for m, _ in saga._marks() if m.startswith("undone-")]
    order = ["documents", "chunks", "vectors"]
    assert undone == [f"undone-{n}" for n in reversed(order[: order.index(step) + 1])]


@pytest.mark.parametrize("step", ["documents", "chunks", "vectors"])
@pytest.mark.parametrize("late", [False, True])
def test_a_crash_is_recovered_from_the_journal(spark, tmp_path, step, late):
    _, saga = three(spark, tmp_path, step, Crash, late)
    with pytest.raises(Crash):
        saga.run()
    tables, again = three(spark, tmp_path)  # a new process
    assert again.state() == "begun" and again.recover() == "compensated" == again.recover()
    assert all(content(t) == [(1, "old")] for t in tables.values())
