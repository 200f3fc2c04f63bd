from inkfathom.operators import ingest


def test_runs_are_made_of_first_words_only(spark, monkeypatch):
    """With the first words looked up, or with too many of them for that, the same names are found."""
    names = spark.createDataFrame([("Red",), ("red apple",), ("the  north of it",), ("pie",), (" ",), (None,)], "name string")
    docs = spark.createDataFrame([(1, "a RED apple\n pie of the north of it"), (2, "red red apples"), (3, None), (4, ""), (5, "the north")], "id bigint, text string")
    found = lambda: sorted(tuple(r) for r in ingest.longest_entities(docs, names, "id", "text", "name").collect())
    want = [(1, 2, "red apple"), (1, 4, "pie"), (1, 6, "the north of it"), (2, 1, "red"), (2, 2, "red")]
    assert found() == want
    monkeypatch.setattr(ingest, "_HEADS", 1)
    assert found() == want
    monkeypatch.setattr(ingest, "_HEADS", 2000)
    none = ingest.longest_entities(docs, names.where("false"), "id", "text", "name")
    assert none.collect() == []
