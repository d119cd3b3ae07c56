"""Folds in order of time for rules whose state depends on what they decided before.

Rows are dealt by key and sorted by Spark; a task goes over them once, batch by batch,
and holds no more than a key's state, however many rows a key has. Keys run side by
side, a key's rows one after the other: rules whose steps compose go through scans.py
instead, which cuts a key's rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

ARROW = {"double": pa.float64(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], take: list[str], start: Callable, out: str) -> DataFrame:
    """The columns of rows and those of the schema `out`. start() gives a step for each key: step(*values of take) returns
    the values of `out`, or None if the row goes."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rows.columns), out])
    names = [x.split()[0] for x in out.split(",")]

    def run(batches):
        key, step = object(), None
        for b in batches:
            n, own, made = b.num_rows, [], []
            key_rows = zip(*(b.column(c).to_pylist() for c in keys), strict=True)
            values = zip(*(b.column(c).to_pylist() for c in take), strict=True)
            for i, k, v in zip(range(n), key_rows, values, strict=True):
                if k != key:
                    key, step = k, start()
                got = step(*v)
                if got is not None:
                    own.append(i)
                    made.append(got)
            kept = b.take(pa.array(own, pa.int64()))
            more = zip(*made, strict=True) if made else [[] for _ in names]
            arrays = [pa.array(list(x), t) for x, t in zip(more, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *arrays], names=[*rows_names, *names])

    types, rows_names = [ARROW[x.split()[1]] for x in out.split(",")], rows.columns
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
