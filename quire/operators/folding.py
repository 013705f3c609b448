"""Folds over the ordered rows of a group, many groups to one Python call.

Rows are dealt by their group and sorted by Spark; a worker gets them batch by batch and carries one group's state on, so that no group is held in memory.
The rows of one group follow from each other, hence one task takes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def folded(df: DataFrame, keys: list[str], order: list[str], given: list[str], start: Callable, step: Callable, name: str, kind: DataType, arrow: pa.DataType) -> DataFrame:
    """df with the column `name`: step(state, *given values) row after row, with a state from start() for each group.

    Rows with equal order come in any order; null keys are a group; a column called `name` is replaced.
    """
    rows = df.drop(name)
    schema = StructType([*rows.schema.fields, StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in [*keys, *given]]
            out = []
            for row in zip(*columns, strict=True):
                if state is None or row[: len(keys)] != now:
                    now, state = row[: len(keys)], start()
                out.append(step(state, *row[len(keys) :]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, name])

    sort = [F.col(c) for c in [*keys, *order]]
    return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*sort).mapInArrow(run, schema)
