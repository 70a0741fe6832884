"""Typed record sources and sinks: source rows, JSON lines, word lists, fan-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_SCHEMA = "uuid bigint, module_name string, entry_point string, python_code string, triton_code string, licenses array<string>, synthetic boolean, repo_link string"
VALIDATION_SCHEMA = "task string, mode string, oracle double, nop double, keep boolean, reason string"
_END = "struct<end_s: double>"
EPISODE_SCHEMA = (
    "episode_id string, ok boolean, num_output_tokens bigint, traces array<struct<task: struct<data: struct<name: string>>, "
    "rewards: map<string, struct<score: double, weight: double>>, stop_condition: string, nodes: array<struct<sampled: boolean>>, "
    f"timing: struct<start_s: double, boot: {_END}, setup: {_END}, agent: {_END}, finalize: {_END}, scoring: {_END}>>>"
)


def to_rows(df: DataFrame) -> DataFrame:
    """Coerce and project raw records to ROW_SCHEMA: null licences become empty, a null link the empty text."""
    schema = T.StructType.fromDDL(ROW_SCHEMA)
    cols = {f.name: F.col(f.name).cast(f.dataType) for f in schema}
    cols["licenses"] = F.coalesce(cols["licenses"], F.array().cast("array<string>"))
    cols["synthetic"] = F.coalesce(cols["synthetic"], F.lit(False))
    cols["repo_link"] = F.coalesce(cols["repo_link"], F.lit(""))
    return df.select(*(c.alias(n) for n, c in cols.items()))


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    return to_rows(spark.read.parquet(path))


def held_out_keys(splits: list[DataFrame], key) -> DataFrame:
    """Distinct non-null keys of several splits of a held-out set; *key* maps a table to its key column."""
    return reduce(DataFrame.unionByName, [s.select(key(s).alias("key")) for s in splits]).where("key is not null").distinct()


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; a line that is not JSON is an error, not a null row."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str, order: str | None = None, single: bool = False) -> None:
    """JSON lines with nulls written out; ordered by range over all files, in one file only if asked for."""
    out = df.orderBy(order) if order else df
    (out.coalesce(1) if single else out).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_fan_out(decided: DataFrame, kept_path: str, dropped_path: str, order: str = "uuid") -> None:
    """One decided table to two outputs; it is computed once."""
    decided.persist()
    try:
        write_json_lines(decided.where("reason is null").drop("reason"), kept_path, order)
        write_json_lines(decided.where("reason is not null").select(order, "module_name", "reason"), dropped_path, order)
    finally:
        decided.unpersist()


def write_list(df: DataFrame, column: str, path: str) -> None:
    """One value a line, sorted."""
    df.select(F.col(column).cast("string")).orderBy(column).write.mode("overwrite").text(path)


def read_list(spark: SparkSession, path: str, column: str = "task") -> DataFrame:
    """Values parted by white space, over any number of lines."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias(column)).where(F.col(column) != "")


def numbers_only(df: DataFrame) -> DataFrame:
    """The numeric columns as doubles."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.select(*(F.col(c).cast("double").alias(c) for c in numeric))
