"""Allow-lists, filters and checks of a plan before it runs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that may be projected, and edge types that may be walked.
PROJECTED = ("doc_id", "chunk_id", "document_id", "lang", "source", "text", "title")
EDGE_TYPES = (
    "MENTIONS", "REFERENCES", "NEXT_CHUNK", "NEXT", "PARENT_HEADING", "CHILD_OF", "PARENT_OF", "HAS_CHUNK", "CONTAINS_STEP",
    "HAS_PARAMETER", "DEFINES", "IN_SECTION", "IN_CHUNK", "HAS_CITATION", "RESOLVES", "EXECUTES", "CONFIGURES", "RELATED_TO",
)
_WRITES = re.compile(r"(?i)\b(insert|update|delete|drop|truncate|alter|create|merge|grant|revoke)\b")


class Refused(ValueError):
    """A query that the guards do not let through."""


def project(df: DataFrame, columns: Iterable[str], allowed: Iterable[str] = PROJECTED) -> DataFrame:
    unknown = [c for c in columns if c not in set(allowed)]
    if unknown:
        raise Refused(f"not to be projected: {unknown}")
    return df.select(*columns)


def filters(raw: Mapping[str, object], allowed: Iterable[str]) -> Column:
    """One predicate of allowed keys; null values drop out, lists mean any of."""
    parts = []
    for key, value in sorted(raw.items()):
        if value is None:
            continue
        if key not in set(allowed):
            raise Refused(f"not to be filtered by: {key}")
        many = list(value) if isinstance(value, (list, tuple, set)) else [value]
        parts.append(F.col(key) == many[0] if len(many) == 1 else F.col(key).isin(*many))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def edge_types(types: Iterable[str], allowed: Iterable[str] = EDGE_TYPES) -> list[str]:
    bad = sorted(set(types) - set(allowed))
    if bad:
        raise Refused(f"not to be walked: {bad}")
    return sorted(set(types))


def checked_sql(sql: str, limit: int = 1000) -> str:
    """A single reading statement, with a limit if it has none."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", sql).strip().rstrip(";")
    if ";" in bare or _WRITES.search(bare) or not re.match(r"(?i)(select|with)\b", bare):
        raise Refused("only one SELECT is let through")
    return sql.strip().rstrip(";") + ("" if re.search(r"(?i)\blimit\s+\d+\s*$", bare) else f" LIMIT {limit}")


def checked_plan(df: DataFrame, most_rows: float = 1e10) -> DataFrame:
    """Refuses cross products and estimates beyond ``most_rows``."""
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan().toString()
    if "CartesianProduct" in plan:
        raise Refused("a cross product")
    rows = execution.optimizedPlan().stats().rowCount()
    if rows.isDefined() and float(str(rows.get())) > most_rows:
        raise Refused("too many rows")
    return df


def normal_sql(sql: str) -> str:
    """A statement with its literals as parameters: its fingerprint's text."""
    return re.sub(r"\s+", " ", re.sub(r"\b\d+(\.\d+)?\b", "?", re.sub(r"'(?:[^']|'')*'", "?", sql))).strip().lower()


#: Most steps, most results and the edges of a template.
GUARDRAILS = {
    "dependency_chain": (5, 100, ("MENTIONS", "CONTAINS_STEP", "HAS_PARAMETER")),
    "impact_assessment": (3, 100, ("MENTIONS", "CONTAINS_STEP")),
    "comparison": (2, 100, ("MENTIONS", "CONTAINS_STEP")),
}


def guarded(requests: DataFrame) -> DataFrame:
    """Requests (template, depth, results, rel, ...) with depth and results cut to
    the template's limits, and verdict ok, clamped or refused (an edge or template that is not allowed)."""
    table = F.create_map(*(
        x for name, (d, n, rels) in GUARDRAILS.items()
        for x in (F.lit(name), F.struct(F.lit(d).cast("bigint").alias("depth"), F.lit(n).cast("bigint").alias("results"), F.array(*map(F.lit, rels)).alias("rels")))
    ))
    r = requests.withColumn("__g", table[F.col("template")])
    over = (F.col("depth") > F.col("__g.depth")) | (F.col("results") > F.col("__g.results"))
    allowed = F.coalesce(F.array_contains("__g.rels", F.col("rel")), F.lit(False))
    verdict = F.when(~allowed, "refused").when(over, "clamped").otherwise("ok")
    return (
        r.withColumn("verdict", verdict).withColumn("depth", F.least("depth", "__g.depth"))
        .withColumn("results", F.least("results", "__g.results")).drop("__g")
    )


def expected(asked: DataFrame, found: DataFrame, batch: str, id_col: str) -> DataFrame:
    """batch, expected, found, status (complete, partial, empty) and the missing ids of each batch."""
    there = found.select(id_col, F.lit(True).alias("__there")).distinct()
    j = asked.select(batch, id_col).join(there, id_col, "left")
    g = j.groupBy(batch).agg(
        F.count("*").alias("expected"), F.count("__there").alias("found"), F.sort_array(F.collect_list(F.when(F.col("__there").isNull(), F.col(id_col)))).alias("__lost")
    )
    status = F.when(F.col("found") == 0, "empty").when(F.col("found") < F.col("expected"), "partial").otherwise("complete")
    lost = F.array_join(F.transform("__lost", lambda x: x.cast("string")), ",")
    return g.select(batch, "expected", "found", status.alias("status"), lost.alias("missing"))
