"""What the corpus operators share: reading tables, row hashes, sizing shuffles, running Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyjoin.names import col, free
from tallyjoin.storage import materialize, new_path, remove, shared_dir

__all__ = ["materialize", "new_path", "remove", "shared_dir"]

#: Input bytes that one shuffle partition should hold.
PARTITION_BYTES = 64 << 20
#: Most rows in one Arrow batch that goes to Python; texts may be very long.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; those that can't be hashed count as JSON."""
    plain = lambda kind: not isinstance(kind, (T.MapType, T.VariantType)) and (not isinstance(kind, T.ArrayType) or plain(kind.elementType)) and (not isinstance(kind, T.StructType) or all(plain(f.dataType) for f in kind))
    return F.xxhash64(*(col(f.name) if plain(f.dataType) else F.to_json(F.struct(col(f.name))) for f in df.schema))


def partitions_for(df: DataFrame, bytes_each: int = PARTITION_BYTES) -> int:
    """Shuffle partitions for df: the session's number, or more where the planner's size estimate asks for more."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(estimate // bytes_each, 1 << 20))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """One Arrow batch in, one out; batches are kept small because single texts can be very long.

    Names with dots or backticks, which mapInArrow() can't take, are others while it runs; schema must then be a StructType.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    other = {c: free(f"_column{i}", df) for i, c in enumerate(df.columns) if "." in c or "`" in c}
    if not other:
        return df.mapInArrow(run, schema)
    named = T.StructType([T.StructField(other.get(f.name, f.name), f.dataType) for f in schema])
    return df.toDF(*(other.get(c, c) for c in df.columns)).mapInArrow(run, named).toDF(*schema.names)


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def batch_of(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
