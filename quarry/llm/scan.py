"""Running values along sorted groups, however long these are: ranges of rows, each a task, and a carry from range to range."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def running(df: DataFrame, group: list[str], order: list, start, step: Callable, follow: Callable, give: Callable, schema: str) -> DataFrame:
    """Rows of `schema`, one for each row of df, from a value that runs along each group in the given order.

    A group's value is `start` before its first row, and step(value, row) after each; row is the tuple of df's columns. follow(a, b) is
    the value after the rows of a and then those of b. give(before, after, row) is the tuple that the row gives, or None for no row.
    Rows are sorted by ranges, so that a group may take many tasks; of each range the driver gets one row, the value of its last group, and
    sends back what the groups before it have come to. The order has to be total for results to be alike between runs.
    """
    keys = [F.col(g) for g in group]
    ranges = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order))
    at = [df.columns.index(g) for g in group]

    def last(batches):
        from pyspark import TaskContext

        now = first = None
        value, rows, one = start, 0, True
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                name = tuple(row[i] for i in at)
                if not rows:
                    now = first = name
                elif name != now:
                    now, value, one = name, start, False
                value, rows = step(value, row), rows + 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps((first, now, value, one))], pa.binary())], names=["range", "last"])

    carried, name, value = {}, None, start
    for r in sorted(ranges.mapInArrow(last, "range int, last binary").collect(), key=lambda r: r["range"]):
        first, now, own, one = pickle.loads(bytes(r["last"]))
        if first == name:
            carried[r["range"]] = (first, value)
        value = follow(value, own) if one and first == name else own
        name = now
    carry = df.sparkSession.sparkContext.broadcast(carried)  # one value a range at most
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        now, value = carry.value.get(TaskContext.get().partitionId(), (None, start))
        kinds = None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                name = tuple(row[i] for i in at)
                if name != now:
                    now, value = name, start
                before, value = value, step(value, row)
                given = give(before, value, row)
                if given is not None:
                    out.append(given)
            kinds = kinds or _arrow(schema)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return ranges.mapInArrow(run, schema)


def _arrow(schema: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return [kinds[f.split()[1]] for f in schema.split(", ")]
