"""What several corpus operators need: reading, Arrow maps, size-checked joins, models on every worker."""

import ctypes
import zlib
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType, _parse_datatype_string

#: A side of at most so many bytes, counted in its rows (some 100 MB when hashed at the very most), may be broadcast.
BROADCAST_BYTES = 48 << 20
ROW_BYTES, CELL_BYTES = 16, 16  # what a row and a value that is not text take at most


#: Bytes of a batch that become Python objects at once.
SLICE_BYTES = 2 << 20
#: Bytes of rows that the JVM sends to a worker at once. It fills and copies a batch outside its heap, and by default a
#: batch has up to 64 MB (10,000 texts): each task then takes several times that of an executor's memory.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What this worker process holds from task to task: one thing of one operator, with its caches.
_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """A model with its caches, made once in a worker process; what another operator's tasks have left is dropped."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def ascending(values: np.ndarray) -> np.ndarray:
    """Distinct values in ascending order: by one sort, which for integers is many times faster than a hash table."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def identity(name: str, *data: bytes) -> Hashable:
    """A key for `held`: what is made of these bytes under this name."""
    return (name, *((len(d), zlib.crc32(d)) for d in data))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of some SLICE_BYTES at a time, as Python objects need several times what a batch does."""
    rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def _give_back() -> None:
    """Hand freed memory to the system: a worker process lives on and gets tasks of other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def arrow_map(
    df: DataFrame, columns: list[str], schema: str, function: Callable[[Iterable[dict]], Iterator[dict]], holds: Hashable = None
) -> DataFrame:
    """`function` turns a stream of {column: list} batches into {column: list or array} batches of `schema`.

    Only `columns` leave the JVM, so other columns of any name do not matter. `holds` is the key that `function` asks
    `held` for; a worker drops what it holds under another one. The session's bound on the bytes of a batch becomes
    BATCH_BYTES, which changes no result.
    """
    df.sparkSession.conf.set(BATCH, BATCH_BYTES)
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if holds not in _held:
            _held.clear()
            _give_back()
        source = ({c: b.column(i).to_pylist() for i, c in enumerate(columns)} for batch in batches for b in _slices(batch))
        try:
            for out in function(source):
                arrays = [
                    out[f.name].cast(f.type) if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type)
                    for f in arrow
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            _give_back()

    return df.select(*columns).mapInArrow(run, kind)


def file_of(path: str) -> bytes:
    """A model file, read on the driver; the tokenizers of this library have a few MB."""
    with open(path, "rb") as f:
        return f.read()


def _bytes_of(cell: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in memory: texts and lists by their true lengths."""
    if isinstance(kind, (StringType, BinaryType)):
        return CELL_BYTES + F.coalesce(F.octet_length(cell), F.lit(0)).cast("long")
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return F.coalesce(
                F.aggregate(cell, F.lit(CELL_BYTES).cast("long"), lambda n, x: n + _bytes_of(x, kind.elementType)), F.lit(CELL_BYTES).cast("long")
            )
        return CELL_BYTES + F.coalesce(F.when(cell.isNotNull(), F.size(cell)), F.lit(0)).cast("long") * CELL_BYTES
    if isinstance(kind, StructType):
        return sum((_bytes_of(cell.getField(f.name), f.dataType) for f in kind), F.lit(CELL_BYTES).cast("long"))
    return F.lit(CELL_BYTES).cast("long")


def is_small(df: DataFrame) -> bool:
    """Whether all rows of a stored frame together take at most BROADCAST_BYTES, whatever their number and widths."""
    row = sum((_bytes_of(df[f"`{f.name}`"], f.dataType) for f in df.schema), F.lit(ROW_BYTES).cast("long"))
    return (df.agg(F.sum(row)).first()[0] or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """Broadcast a stored frame if it is measured to be small; a larger one is joined by a shuffle."""
    return F.broadcast(df) if is_small(df) else df


def keep_ids(df: DataFrame, ids: DataFrame, column: str, anti: bool = False) -> DataFrame:
    """Rows of `df` whose `column` is (not) in `ids`, a stored frame of one column.

    A measured, bounded list is broadcast so that wide rows stay where they are; a longer one is joined by a
    shuffle. Null matches null.
    """
    other = ids.select(F.col(column).alias("__id")).distinct()
    if is_small(ids):
        other = F.broadcast(other)
    return df.join(other, df[column].eqNullSafe(other["__id"]), "left_anti" if anti else "left_semi")
