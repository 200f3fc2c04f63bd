"""Passes in order over each group's own rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def by_group(rows: DataFrame, key: str, order: list[str], run: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """What ``run`` gives for each group's rows, as dictionaries in ``order``.

    Rows are dealt and sorted by Spark and come as a stream in which groups follow one
    another: a task holds a batch and the group that goes on into the next, and
    a small group costs no call of its own between Spark and Python.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def made(groups: list[list[dict]]) -> pa.RecordBatch:
            found = [r for g in groups for r in run(g)]
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in found], f.type, from_pandas=True) for f in out], schema=out)

        for batch in batches:
            groups = [list(g) for _, g in groupby(batch.to_pylist(), key=lambda r: r[key])]
            if held and groups and groups[0][0][key] == held[0][key]:
                held += groups.pop(0)
            if groups:
                whole = [held] if held else []
                held = groups.pop()
                yield made(whole + groups)
        if held:
            yield made([held])

    dealt = rows.repartition(key).sortWithinPartitions(key, *(F.asc_nulls_last(c) for c in order))
    return dealt.mapInArrow(stream, schema)
