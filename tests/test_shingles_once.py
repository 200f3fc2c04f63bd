import hashlib

from pyspark.sql import functions as F

from inkfathom.functions import scalars as S


def test_a_text_is_cut_into_words_once(spark):
    texts = [None, "", "  ", "One two", "a b c d e f g h", " ".join(f"W{i}" for i in range(100))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", S.shingle_hash(F.col("text")).alias("h"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    for r in df.collect():
        text = texts[r["i"]]
        w = (text or "").lower().split()
        parts = [" ".join(w[i : i + 8]) for i in range(min(64, max(1, len(w) - 7)))]
        assert r["h"] == hashlib.sha256("||".join(parts).encode()).hexdigest()
