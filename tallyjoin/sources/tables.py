"""Sources: Parquet tables by name, tables in partition files, whitespace-separated text, generated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partition_paths(path: str, parts: int) -> list[str]:
    """Paths of a table in parts files; a table in one file has the bare path."""
    return [path] if parts == 1 else [f"{path}_p{i}" for i in range(parts)]


def scan_table(spark: SparkSession, path: str, parts: int = 1, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).load(partition_paths(path, parts))


def scan_text(spark: SparkSession, path: str, schema: T.StructType, parts: int = 1, strict: bool = False) -> DataFrame:
    """Rows of whitespace-separated values under a header line in each file; blank lines don't count.

    The schema is given and the header skipped, as its names may differ. The line reader runs distributed and drops each
    file's header itself; strict raises on lines of another arity, which else get nulls or lose their surplus.
    """
    whole_line = T.StructType([T.StructField("line", T.StringType())])
    lines = spark.read.csv(partition_paths(path, parts), schema=whole_line, sep="\x01", quote="", header=True, enforceSchema=True)
    cells = lines.select(F.trim("line").alias("line")).filter("line != ''").select(F.split("line", r"\s+").alias("c"))
    if strict:
        cells = cells.select(F.when(F.size("c") == len(schema), F.col("c")).otherwise(F.raise_error(F.concat(F.lit("arity: "), F.array_join("c", " ")))).alias("c"))
    return cells.select(*(F.get("c", F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)))


def write_text(df: DataFrame, path: str) -> None:
    """df as whitespace-separated text, a header line in each file: what scan_text() reads. Values must hold no white space."""
    df.write.csv(path, sep=" ", header=True, quote="", nullValue="", emptyValue="")


def generate_data(spark: SparkSession, columns: int, rows: int) -> DataFrame:
    """Cell (i, j) is i + j; columns c0, c1, ..."""
    return spark.range(rows).select(*((F.col("id") + j).alias(f"c{j}") for j in range(columns)))


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.format(form).save(path)
