"""What is learnt from use: statement patterns, slow queries, templates, an index registry."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfathom.sources.scratch import written

#: Templates by intent and version: the registered query of each.
LIBRARY = {
    "search": {"v1": "template_search_v1", "v2": "template_search_v2", "v3": "khop_neighbors", "v4": "template_search_v4"},
    "traverse": {"v1": "khop_neighbors", "v2": "khop_both_ways", "v3": "typed_traversal"},
    "compare": {"v1": "template_compare_v1", "v2": "template_compare_v2", "v3": "template_comparison"},
    "explain": {"v1": "template_explain", "v2": "template_explain_v2"},
    "troubleshoot": {"v1": "template_troubleshoot_v1", "v2": "template_troubleshoot_full", "v3": "error_context"},
    "troubleshooting_path": {"v1": "resolution_steps", "v2": "resolution_configs", "v3": "resolution_context"},
    "dependency_chain": {"v1": "template_dependency_v1", "v2": "template_dependency_v2", "v3": "template_dependency_v3"},
    "impact_assessment": {"v1": "template_impact", "v2": "template_dependency_v1"},
    "comparison": {"v1": "template_comparison_v1", "v2": "template_comparison", "v3": "template_comparison_v3"},
    "temporal": {"v1": "template_temporal"},
}


def default_version(intent: str) -> str:
    """The highest of an intent's versions; v1 if it has none."""
    return max(LIBRARY.get(intent, {"v1": ""}), key=lambda v: int(v.removeprefix("v")))


def versions() -> list[tuple[str, str, bool]]:
    return [(i, v, v == default_version(i)) for i, named in sorted(LIBRARY.items()) for v in sorted(named)]


def render(intent: str, version: str | None = None):
    """The query of a template; raises for what the library lacks."""
    from inkfathom.queries import QUERIES

    chosen = version or default_version(intent)
    name = LIBRARY.get(intent, {}).get(chosen)
    if name is None:
        raise ValueError(f"no template of {intent!r} in version {chosen!r}")
    return QUERIES[name]


def warm(spark: SparkSession, sf_dir: str, intents: Iterable[str]) -> dict[str, int]:
    """Runs the default templates of the intents and keeps their results cached; rows of each."""
    return {i: render(i)(spark, sf_dir).cache().count() for i in intents}


def statement_pattern(statement: Column) -> Column:
    """A graph statement with strings, numbers and variables put aside, labels kept."""
    for pattern, by in (
        (r"'[^']*'", r"\$STR"), (r'"[^"]*"', r"\$STR"), (r"\b\d+\b", r"\$NUM"), (r"\((\w+):", r"(\$VAR:"), (r"-\[(\w+):", r"-[\$VAR:"), (r"\s+", " "),
    ):
        statement = F.regexp_replace(statement, pattern, by)
    return F.trim(statement)


def property_accesses(statement: Column) -> Column:
    """Array of struct(label, prop): properties in node patterns, in WHERE and in RETURN."""
    every = lambda p, g: F.regexp_extract_all(statement, F.lit(p), F.lit(g))
    named = F.arrays_zip(every(r"\((\w+):(\w+)", 1).alias("var"), every(r"\((\w+):(\w+)", 2).alias("label"))
    label_of = lambda v: F.get(F.filter(named, lambda n: n["var"] == v), F.lit(0))["label"]
    pair = lambda label, prop: F.struct(label.alias("label"), prop.alias("prop"))
    node = r"\((\w+):(\w+)\s*\{([^}]+)\}"
    nodes = F.arrays_zip(every(node, 2).alias("label"), every(node, 3).alias("props"))
    inside = F.flatten(F.transform(nodes, lambda n: F.transform(F.regexp_extract_all(n["props"], F.lit(r"(\w+)\s*:"), F.lit(1)), lambda p: pair(n["label"], p))))
    read = [F.transform(F.arrays_zip(every(p, 1).alias("var"), every(p, 2).alias("prop")), lambda x: pair(label_of(x["var"]), x["prop"])) for p in (r"WHERE\s+(\w+)\.(\w+)", r"(?i)RETURN.*?(\w+)\.(\w+)")]
    return F.filter(F.concat(inside, *read), lambda x: x["label"].isNotNull())


def suggest_templates(patterns: DataFrame, least: int = 5, liked: float = 0.6, most: int = 10) -> DataFrame:
    """intent, pattern, frequency, rating, confidence of the patterns that come
    ``least`` times or more and are rated ``liked`` or better, or not at all."""
    g = patterns.groupBy("intent", "pattern").agg(F.count("*").alias("frequency"), F.avg("rating").alias("mean"))
    g = g.where((F.col("frequency") >= least) & (F.col("mean").isNull() | (F.col("mean") >= liked)))
    sure = F.least(F.lit(1.0), F.col("frequency") / (2.0 * least)) * F.coalesce("mean", F.lit(1.0))
    out = g.select("intent", "pattern", "frequency", F.round("mean", 6).alias("rating"), F.round(sure, 6).alias("confidence"))
    return out.orderBy(F.desc("confidence"), F.desc("frequency"), "intent", "pattern").limit(most)


def slow_queries(log: DataFrame, text: str, ms: str, tie: list[str], least: int = 100, top: int = 50) -> DataFrame:
    """The ``top`` slowest statements of ``least`` ms or more, with a fingerprint
    that comments and white space do not change; of each only the slowest."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"--[^\n]*", ""), r"\s+", " "))
    slow = log.where(F.col(ms) >= least).orderBy(F.desc(ms), *tie).limit(top)
    slow = slow.withColumn("fingerprint", F.substring(F.sha2(bare, 256), 1, 16))
    w = Window.partitionBy("fingerprint").orderBy(F.desc(ms), *tie)
    return slow.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


class Registry:
    """The indexes there are: name, dims, model, and which one is asked. A short list on the driver."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.indexes: dict[str, tuple[int, str]] = {}
        self.active: str | None = None

    def register(self, name: str, dims: int, model: str, active: bool = False) -> None:
        if name in self.indexes or dims <= 0:
            raise ValueError(f"{name!r} is registered already, or {dims} dims are none")
        self.indexes[name] = (dims, model)
        if active:
            self.active = name

    def activate(self, name: str) -> None:
        if name not in self.indexes:
            raise KeyError(name)
        self.active = name

    def table(self) -> DataFrame:
        rows = [(n, d, m, n == self.active) for n, (d, m) in self.indexes.items()]
        return self.spark.createDataFrame(rows, "name string, dims int, model string, active boolean")

    def compatibility(self, vectors: DataFrame) -> DataFrame:
        """name, model, vectors, status of vectors (name, model, dims) meant for an index."""
        r = self.table().select("name", F.col("dims").alias("__dims"), F.col("model").alias("__model"))
        j = vectors.join(F.broadcast(r), "name", "left")  # some indexes
        status = (
            F.when(F.col("__dims").isNull(), "unknown").when(F.col("__dims") != F.col("dims"), "dims")
            .when(F.col("__model") != F.col("model"), "model").otherwise("ok")
        )
        return j.groupBy("name", "model", status.alias("status")).agg(F.count("*").alias("vectors"))


# -- weights ---------------------------------------------------------------------
def on_simplex(w: np.ndarray) -> np.ndarray:
    """The nearest weights of sum one, none negative."""
    u = np.sort(w)[::-1]
    excess = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(w - excess[np.flatnonzero(u > excess)[-1]], 0)


def tune_weights(rows: DataFrame, group: str, features: Sequence[str], gain: str, sharpness: float = 8.0, steps: int = 60, tolerance: float = 1e-5) -> tuple[np.ndarray, list[float]]:
    """Weights of sum one, none negative, that rank each group's rows by gain; and the loss of each step.

    The loss is listwise and smooth: for each group the cross-entropy of softmax(gain) and
    softmax(sharpness * weighted features). It is convex. Each step sums it and its
    gradient over all rows of all groups on the executors and brings back a number a
    feature; the weights follow the gradient, by steps of Barzilai and Borwein, halved
    where the loss would rise, and are projected to the simplex. Features are scaled to 0
    to 1 over all rows, so no exponential overflows. Rows with nulls are left out; without
    rows the weights are equal.
    """
    d = len(features)
    fine = rows.select(F.col(group).alias("g"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), F.col(gain).cast("double").alias("y")).dropna()
    ends = fine.agg(*(f(f"x{i}").alias(f"{n}{i}") for i in range(d) for n, f in (("low", F.min), ("high", F.max))), F.max("y").alias("top")).first()
    w = np.full(d, 1 / d)
    if ends["top"] is None:
        return w, []
    scaled = [((F.col(f"x{i}") - ends[f"low{i}"]) / ((ends[f"high{i}"] - ends[f"low{i}"]) or 1.0)).alias(f"x{i}") for i in range(d)]
    data = written(fine.select("g", *scaled, F.exp(F.col("y") - ends["top"]).alias("p")), "gains")
    wanted = data.groupBy("g").agg(F.sum("p").alias("z"), *(F.sum(F.col("p") * F.col(f"x{i}")).alias(f"c{i}") for i in range(d)))
    due = wanted.agg(F.count("*").alias("n"), *(F.sum(F.col(f"c{i}") / F.col("z")).alias(f"c{i}") for i in range(d))).first()
    target, groups = np.array([due[f"c{i}"] for i in range(d)]), due["n"]

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        score = sum((F.col(f"x{i}") * float(w[i]) for i in range(d)), F.lit(0.0)) * sharpness
        e = data.select("g", F.exp(score).alias("e"), *(f"x{i}" for i in range(d)))
        one = e.groupBy("g").agg(F.sum("e").alias("z"), *(F.sum(F.col("e") * F.col(f"x{i}")).alias(f"v{i}") for i in range(d)))
        r = one.agg(F.sum(F.ln("z")).alias("loss"), *(F.sum(F.col(f"v{i}") / F.col("z")).alias(f"v{i}") for i in range(d))).first()
        v = np.array([r[f"v{i}"] for i in range(d)])
        return (r["loss"] - sharpness * float(target @ w)) / groups, sharpness * (v - target) / groups

    loss, slope = at(w)
    losses, size = [loss], 1.0 / sharpness
    for _ in range(steps):
        new = on_simplex(w - size * slope)
        if np.abs(new - w).max() < tolerance:
            break
        now, then = at(new)
        if now > loss + 1e-12:
            size /= 2
            continue
        move, turn = new - w, then - slope
        size = float(move @ move / (move @ turn)) if move @ turn > 1e-15 else size * 2
        w, loss, slope = new, now, then
        losses.append(loss)
    return w, losses
