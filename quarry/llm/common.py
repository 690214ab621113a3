"""Helpers that the operators share: shared folder, lineage cuts, sizes, Arrow text slices."""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of the numpy kernels takes at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (where unset and all runs in one process, as in tests) a new temporary one."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if not conf and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return conf or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(columns: list[str], new: tuple[str, ...]) -> list[str]:
    """Those of the columns whose names none of the new ones has, however it is written."""
    return [c for c in columns if c.lower() not in {n.lower() for n in new}]


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total bytes of a text column (one narrow aggregate)."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0)).alias("b")).first()["b"]


def held_out(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 5 = 0; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES):
    """Yield (first row, end row, bytes, offsets) over a string column in pieces of about limit bytes; null reads as empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for arr in chunks:
        arr = pc.fill_null(arr, "").cast(pa.large_string())
        n = len(arr)
        if not n:
            continue
        off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
        data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), n)
            yield base + i, base + j, data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
        base += n


def map_text(docs: DataFrame, function, schema: str, column: str = "text", keep: bool = False) -> DataFrame:
    """Apply function(string column) -> list of Arrow arrays to every batch; schema names and types them.

    The other columns of docs are carried along unchanged; one whose name function's columns have too gives way to it. The text itself
    is returned only with keep.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(schema)
    taken = {f.name.lower() for f in new}
    others = [c for c in docs.columns if c != column and c.lower() not in taken]
    carried = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("int")
    packed = docs.select(carried.alias("carried"), F.col(column).cast("string").alias("text"))
    names = ["carried", *(["text"] if keep else []), *(f.name for f in new)]

    def apply(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *([b.column(1)] if keep else []), *function(b.column(1))], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
    out = packed.mapInArrow(apply, f"carried {packed.schema['carried'].dataType.simpleString()}, {'text string, ' if keep else ''}{kinds}")
    back = [F.col("text").alias(c) if c == column else F.col(f"carried.`{c}`").alias(c) for c in docs.columns if c in others or (keep and c == column)]
    return out.select(*back, *(F.col(f.name) for f in new))
