"""Personalised PageRank over each query's candidates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.operators.ordered import by_group


def personalised_rank(seed: np.ndarray, weight: np.ndarray, damping: float = 0.85, steps: int = 20, stop: float = 1e-4) -> np.ndarray:
    """Restart at ``seed``; rows of the symmetrised weights sum to one, an isolated node restarts."""
    w = weight + weight.T
    total = w.sum(1, keepdims=True)
    walk = np.divide(w, total, out=np.zeros_like(w, dtype=float), where=total > 0)
    s = seed / seed.sum() if seed.sum() > 0 else np.full(len(seed), 1 / max(1, len(seed)))
    r = s.copy()
    for _ in range(steps):
        lost = r[total[:, 0] == 0].sum()
        new = damping * (walk.T @ r + lost * s) + (1 - damping) * s
        done = np.abs(new - r).sum() < stop
        r = new
        if done:
            break
    return r


def diffuse(candidates: DataFrame, edges: DataFrame, blend: float = 0.3) -> DataFrame:
    """query_id, id, score: (1 - blend) * score + blend * rank over the largest rank.

    ``candidates``: query_id, id, score, a bounded list for each query; ``edges``:
    query_id, a, b, weight among them.
    """

    def one(rows: list[dict]) -> list[dict]:
        c = [r for r in rows if r["kind"] == 0]
        if not c:
            return []
        at = {r["id"]: i for i, r in enumerate(c)}
        w = np.zeros((len(c), len(c)))
        for r in rows[len(c) :]:
            if r["id"] in at and r["other"] in at:
                w[at[r["id"]], at[r["other"]]] += np.nan if r["score"] is None else r["score"]
        score = np.array([r["score"] for r in c], float)
        r = personalised_rank(np.maximum(score, 0), w)
        scaled = r / r.max() if r.max() > 0 else r
        return [x | {"score": y} for x, y in zip(c, ((1 - blend) * score + blend * scaled).tolist())]

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    end = F.lit(None).cast(kinds["id"]).alias("other")
    nodes = candidates.select("query_id", F.lit(0).alias("kind"), "id", end, F.col("score").cast("double").alias("score"))
    links = edges.select("query_id", F.lit(1).alias("kind"), F.col("a").alias("id"), F.col("b").alias("other"), F.col("weight").cast("double").alias("score"))
    return by_group(nodes.unionByName(links), "query_id", ["kind", "id", "other"], one, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
