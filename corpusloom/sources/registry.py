"""Registries (a JSON array of datasets with their tasks) and TOML task descriptions."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY_SCHEMA = "name string, version string, description string, tasks array<struct<name: string, path: string>>"


def registry(df: DataFrame, name: str, description: str, version: str = "0.1") -> DataFrame:
    """One row: the registry entry of the tasks (columns name and path), in order of name.

    The entry is one value by definition; its size is that of the list it publishes.
    """
    tasks = F.array_sort(F.collect_list(F.struct("name", "path")))
    return df.agg(tasks.alias("tasks")).select(F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(description).alias("description"), "tasks")


def registry_json(df: DataFrame) -> DataFrame:
    """The registry as one JSON text."""
    return df.agg(F.to_json(F.collect_list(F.struct("name", "version", "description", "tasks"))).alias("json"))


def write_registry(df: DataFrame, path: str) -> None:
    registry_json(df).coalesce(1).write.mode("overwrite").text(path)


def read_registry(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(index, name, path) of the tasks of the one dataset of that name; none or several are an error."""
    found = spark.read.schema(REGISTRY_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path).where(F.col("name") == name)
    one = found.agg(F.collect_list("tasks").alias("d"))
    tasks = F.when(F.size("d") == 1, F.col("d")[0]).otherwise(F.raise_error(F.lit(f"expected exactly one dataset {name}")))
    return one.select(F.posexplode(tasks).alias("index", "t")).select("index", "t.name", "t.path")


def _value(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(_value(x) for x in v) + "]"
    text = str(v).replace("\\", "\\\\").replace('"', '\\"')
    return '"' + "".join(f"\\u{ord(c):04x}" if ord(c) < 32 or ord(c) == 127 else c for c in text) + '"'


def to_toml(tree: dict, at: tuple[str, ...] = ()) -> str:
    """A nested dict as TOML: plain keys first, then tables; nulls are left out, lists of dicts become table arrays."""
    plain = [f"{k} = {_value(v)}" for k, v in tree.items() if v is not None and not isinstance(v, dict) and not (isinstance(v, list) and v and isinstance(v[0], dict))]
    parts = ["\n".join(plain)] if plain else []
    for k, v in tree.items():
        here = (*at, k)
        if isinstance(v, dict):
            parts.append(f"[{'.'.join(here)}]\n{to_toml(v, here)}".rstrip("\n"))
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            parts += [f"[[{'.'.join(here)}]]\n{to_toml(x, here)}".rstrip("\n") for x in v]
    return "\n\n".join(parts) + "\n"


@F.pandas_udf(T.StringType())
def toml_of_json(documents: pd.Series) -> pd.Series:
    """TOML text of nested structs that came as JSON (to_json of a struct column)."""
    import json

    return documents.map(lambda d: None if d is None else to_toml(json.loads(d)))


@F.pandas_udf(T.StringType())
def json_of_toml(documents: pd.Series) -> pd.Series:
    """JSON text of TOML documents, to be read with from_json and an explicit schema."""
    import json

    return documents.map(lambda d: None if d is None else json.dumps(tomllib.loads(d), default=str))
