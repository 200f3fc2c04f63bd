"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.llm import binpacking, bpe, centroids, langid, licenses, lm, media, packing, rangejoin, resampling, simhash, toxicity, urlfilter
from inkfathom.llm.common import fold, table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold("doc_id", 5) == 1
    return lm.score_texts(table(spark, sf_dir, "documents"), ~out, keep=[out.alias("held_out")])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.held_out()
    found = langid.identify(table(spark, sf_dir, "documents"), ~out)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def op3_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangejoin.join(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages")).drop("by_pattern")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fold("doc_id", 3) == 1
    found = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out)
    return found.select("doc_id", out.alias("held_out"), "score", "predicted")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpacking.pack_best_fit(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _centroid_sql() -> str:
    """Every round written out, in DuckDB's exact integers."""
    k, dim, rounds = centroids.K, centroids.DIM, centroids.ROUNDS
    gap = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (v[i] - mid[i]) * (v[i] - mid[i])))"
    steps = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS mid
  FROM (SELECT sha256(concat('{centroids.SALT}:', CAST(vec_id AS VARCHAR))) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS (SELECT r, vec_id, v, min({{'gap': gap, 'c': c}}) AS best FROM"
            f" (SELECT r, vec_id, v, c, CAST({gap} AS BIGINT) AS gap FROM kept, c{n}) GROUP BY r, vec_id, v)"
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS mid
  FROM (SELECT best.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, {dim + 1}) t(i) GROUP BY best.c, i) GROUP BY c),
c{n + 1} AS (SELECT c, coalesce(m.mid, o.mid) AS mid FROM c{n} o LEFT JOIN m{n} m USING (c))"""
            )
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(best.c AS INTEGER) AS "cluster", best.gap AS distance,
  CAST(sum(best.gap) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.gap) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(mid, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = best.c"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _resampling_sql() -> str:
    """CRC-32 is written out over the UTF-8 bytes of each distinct word."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cut = f"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    n = resampling.BUCKETS
    return f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs
  FROM range(256) r(i)),
doc_words AS (SELECT row_number() OVER () AS r, doc_id, coalesce({cut}, []) AS ws FROM documents),
in_docs AS (SELECT w, count(*) AS s FROM (SELECT unnest(ws) AS w FROM doc_words) GROUP BY w),
in_target AS (SELECT w, count(*) AS t FROM (SELECT unnest({cut}) AS w FROM benchmark) GROUP BY w),
each AS (SELECT w, coalesce(s, 0) AS s, coalesce(t, 0) AS t, hex(encode(w)) AS code FROM in_docs FULL JOIN in_target USING (w)),
hashed AS (
  SELECT w, s, t, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(0, length(code) // 2), lambda i: CAST(concat('0x', substr(code, 2 * i + 1, 2)) AS BIGINT))),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % {n} AS bucket
  FROM each, crc_table),
total AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM hashed),
buckets AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM hashed GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * (s_all + {n})) / ((s + 1) * (t_all + {n})))) AS BIGINT) AS gain FROM buckets, total),
sums AS (
  SELECT r, CAST(sum(gain) AS BIGINT) AS weight
  FROM (SELECT r, unnest(ws) AS w FROM doc_words) JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST(concat('0x', substr(sha256(concat('{resampling.SALT}:', CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM doc_words LEFT JOIN sums USING (r)),
fit AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, r) AS place FROM scored WHERE n_features >= {resampling.LEAST_WORDS}),
drawn AS (SELECT {resampling.PERCENT} * count(*) // 100 AS n FROM fit)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n THEN place END AS rank FROM scored LEFT JOIN fit USING (r), drawn"""


#: The table has no paths, so the query gives each document one: every 50th is a
#: licence file, at one of three levels.
_PATH = """
CASE WHEN doc_id % 50 <> 0 THEN concat(source, '/', lang, '/', cast(doc_id % 97 AS varchar(9)), '/doc-', cast(doc_id AS varchar(20)), '.txt')
     WHEN doc_id % 3 = 0 THEN concat(source, '/LICENSE-', cast(doc_id AS varchar(20)), '.txt')
     WHEN doc_id % 3 = 1 THEN concat(source, '/', lang, '/LICENSE-', cast(doc_id AS varchar(20)), '.txt')
     ELSE concat(source, '/', lang, '/', cast(doc_id % 97 AS varchar(9)), '/LICENSE-', cast(doc_id AS varchar(20)), '.txt') END"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", F.expr(_PATH))


def _license_sql() -> str:
    templates = ", ".join(
        f"({i}, '{name}', [{', '.join(repr(w) for w in ws)}])" for i, (name, ws) in enumerate(licenses.template_words())
    )
    word, cue = licenses.WORD, licenses.CUE
    return f"""
WITH templates(t, license, words) AS (VALUES {templates}),
vocab AS (SELECT DISTINCT unnest(words) AS w FROM templates),
files AS (SELECT doc_id, {_PATH} AS path, text FROM documents),
placed AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, text FROM files),
lines AS (
  SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line FROM placed WHERE regexp_matches(lower(text), '{cue}')),
segs AS (
  SELECT row_number() OVER () AS seg, doc_id, path, list_distinct(regexp_extract_all(lower(line), '{word}', 1)) AS words
  FROM lines WHERE regexp_matches(lower(line), '{cue}')),
total AS (SELECT count(*) AS n FROM segs),
seg_words AS (SELECT seg, unnest(words) AS w FROM segs),
df AS (SELECT w, count(*) AS n FROM seg_words WHERE w IN (SELECT w FROM vocab) GROUP BY w),
idf AS (
  SELECT w, power(ln((1 + total.n) / (1 + coalesce(df.n, 0))) + 1, 2) AS q FROM vocab CROSS JOIN total LEFT JOIN df USING (w)),
seg_norm AS (
  SELECT seg, sqrt(sum(coalesce(q, power(ln(1 + total.n) + 1, 2)))) AS norm
  FROM seg_words CROSS JOIN total LEFT JOIN idf USING (w) GROUP BY seg),
tw AS (SELECT t, license, unnest(words) AS w FROM templates),
t_norm AS (SELECT t, sqrt(sum(q)) AS norm FROM tw JOIN idf USING (w) GROUP BY t),
dots AS (
  SELECT seg, t, license, sum(q) AS dot FROM seg_words JOIN tw USING (w) JOIN idf USING (w) GROUP BY seg, t, license),
scored AS (
  SELECT doc_id, license, round(dot / (s.norm * n.norm), 9) AS score
  FROM dots JOIN seg_norm s USING (seg) JOIN t_norm n USING (t) JOIN segs USING (seg)),
own AS (
  SELECT doc_id, max(score) AS score, arg_max(license, (score, license)) AS license
  FROM scored WHERE score >= {licenses.THRESHOLD} GROUP BY doc_id),
given AS (
  SELECT dir, arg_max({{'score': score, 'license': license, 'path': path}}, (score, license, path)) AS g
  FROM placed JOIN own USING (doc_id)
  WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '{licenses.LICENCE_FILE}') GROUP BY dir),
nearest AS (
  SELECT dir, arg_max(g, length(at_dir)) AS g
  FROM (SELECT DISTINCT dir FROM placed) d
  JOIN (SELECT dir AS at_dir, g FROM given) ON at_dir = '' OR dir = at_dir OR starts_with(dir, at_dir || '/')
  GROUP BY dir)
SELECT p.doc_id, p.path, coalesce(o.license, g.license) AS license, coalesce(o.score, g.score) AS score,
  CASE WHEN o.doc_id IS NOT NULL THEN 'own' WHEN g IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.doc_id IS NOT NULL THEN p.path ELSE g.path END AS licensed_by
FROM placed p LEFT JOIN own o USING (doc_id) LEFT JOIN nearest USING (dir)"""


def _url_sql() -> str:
    q = "'"
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.rule}'"
        for r in sorted(urlfilter.HOST_RULES, key=lambda r: (-len(r.rule), r.rule))
    )
    said = " ".join(f"WHEN rule = '{r.rule}' THEN '{r.verdict}'" for r in urlfilter.HOST_RULES)
    alone, offers, goods = ("|".join(ws) for ws in (urlfilter.ALONE, urlfilter.OFFERS, urlfilter.GOODS))
    many = {t for t in urlfilter.ALONE} | {(a, b) for a in urlfilter.OFFERS for b in urlfilter.GOODS}
    patterns = [
        rf"(?:^|[^a-z0-9])(?:{alone})(?:[^a-z0-9]|$)",
        rf"(?:^|[^a-z0-9])(?:{offers})[^a-z0-9]+(?:{goods})(?:[^a-z0-9]|$)",
        *(r.pattern for r in urlfilter.PATTERN_RULES if not ({r.tokens, *r.tokens[:1]} if len(r.tokens) == 1 else {r.tokens}) & many),
    ]
    hit = " OR ".join(f"regexp_matches(low, '{p.replace(q, q * 2)}')" for p in patterns)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/]*'), '{upper}', '{lower}') AS host,
    CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut),
ruled AS (SELECT *, CASE {fits} END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE {said} WHEN {hit} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_language_id": op2_language_id,
    "op3_embedding_join": op3_embedding_join,
    "op4_simhash": op4_simhash,
    "op5_url_filter": op5_url_filter,
    "op6_media_columns": op6_media_columns,
    "op7_bpe": op7_bpe,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op5_url_filter": _url_sql(),
    "op10_license_scan": _license_sql(),
    "op12_centroid_clustering": _centroid_sql(),
    "op13_importance_resampling": _resampling_sql(),
}
