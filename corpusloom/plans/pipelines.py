"""Whole pipelines: filtering with reasons, the profile, and tasks with their files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, fixed, text
from ..functions.code import code_facts
from ..functions.fixed import LARGE_ELEMENTS
from ..operators import aggregates, dedup, isolated, rules
from ..session import spread, written
from ..sources import folders, records, registry


def with_facts(rows: DataFrame) -> DataFrame:
    """Rows with the struct f of what one parse tells; written, since every later stage reads it."""
    return written(spread(rows).withColumn("f", code_facts("python_code", F.trim("module_name"))), "facts")


def filter_pipeline(rows: DataFrame, held_out: DataFrame, check: str | None = None, licenses: Column | None = None) -> DataFrame:
    """(uuid, module_name, reason) of every row; a null reason keeps it.

    The stages run in this order, and a row is dropped by the first that objects: parse, licence, length, shapes;
    duplicate of a row that passed those; class in the held-out keys (column key); *check* in isolated processes.
    The owner of a duplicate group may itself be dropped later; its duplicates stay dropped and name it.
    """
    facts = with_facts(rows)
    static = rules.decide(facts, rules.parse_reason("f.parses"), licenses if licenses is not None else rules.license_reason(), rules.length_reason("python_code"), rules.shapes_reason("f.shapes"))
    passed = static.where("reason is null").drop("reason")
    owned = dedup.keep_lowest(passed, F.col("f.source_key"), "uuid").withColumn("reason", dedup.duplicate_reason("uuid"))
    first = owned.where("reason is null")
    matched = first.join(dedup.small(held_out.select("key").distinct().withColumn("hit", F.lit(True))), first["f.structure_key"] == F.col("key"), "left")
    matched = matched.withColumn("reason", F.when(F.col("hit"), "held out: class of the evaluation set"))
    left = matched.where("reason is null")
    if check is None:
        ran = left.select("uuid", "module_name", F.lit(None).cast("string").alias("reason"))
    else:
        replies = isolated.isolated_map(left, "uuid", ["python_code", "module_name"], check)
        ran = left.select("uuid", "module_name").join(replies.withColumnRenamed("id", "uuid"), "uuid", "left")
    parts = [d.where("reason is not null").select("uuid", "module_name", "reason") for d in (static, owned, matched)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(ran)


def profile(rows: DataFrame) -> dict[str, DataFrame]:
    """The sections of the profile, by name; each is a small aggregate."""
    facts = with_facts(rows)
    n = arrays.elements("f.shapes")
    ops = facts.select("uuid", F.col("f.ops").alias("ops"))
    lines = facts.select("uuid", F.explode(F.split("triton_code", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line")).withColumn("line", F.trim("line"))
    internal = lines.where(F.startswith("line", F.lit("from torch._")) | F.startswith("line", F.lit("import torch._")))
    sizes = facts.select(n.cast("double").alias("elements"), text.line_count("python_code").alias("python_lines"), text.line_count("triton_code").alias("triton_lines"), text.occurrences("triton_code", "@triton.jit").alias("kernels"))
    single = ops.where(F.size("ops") == 1).groupBy(F.col("ops")[0].alias("op")).agg(F.min("uuid").alias("uuid"))
    top = aggregates.top_k(ops.select(F.explode("ops").alias("op")), "op", "op", 30)
    return {
        "duplicates": dedup.duplicate_counts(facts, F.sha2("python_code", 256), "uuid"),
        "provenance": aggregates.count_shares(facts, synthetic=F.col("synthetic"), no_license=F.size("licenses") == 0),
        "licenses": aggregates.top_k(facts.select("uuid", F.explode("licenses").alias("license")), "license", "uuid", 15),
        "interface": aggregates.checks_all(
            facts, parses=F.col("f.parses"), get_inputs=F.col("f.has_get_inputs"), get_init_inputs=F.col("f.has_get_init_inputs"), class_exists=F.col("f.has_class"),
            triton_class=F.contains("triton_code", F.concat(F.lit("class "), F.trim("module_name"), F.lit("New"))), entry_point=F.col("entry_point") == F.col("module_name")),
        "inputs": aggregates.count_shares(facts.where("f.shapes is not null"), tiny=n <= 1024, large=n > LARGE_ELEMENTS),
        "tensors": aggregates.capped_histogram(facts.where("f.shapes is not null"), F.size("f.shapes")),
        "ops_per_row": aggregates.capped_histogram(ops, F.coalesce(F.size("ops"), F.lit(0))),
        "ops": top,
        "sizes": aggregates.nearest_rank(sizes, ["elements", "python_lines", "triton_lines", "kernels"], [10, 50, 90, 99, 100]),
        "internal_imports": aggregates.top_k(internal, "line", "uuid", 10),
        "examples": top.limit(3).join(single, "op").join(facts.select("uuid", text.head_lines("python_code").alias("excerpt")), "uuid"),
    }


def report(rows: DataFrame) -> str:
    """The profile as Markdown."""
    return "\n\n".join(f"## {name}\n\n{folders.markdown(df)}" for name, df in profile(rows).items()) + "\n"


def task_description(settings: dict | None = None) -> Column:
    """The TOML description of each row's task: its name, where it comes from, and *settings* of the caller's own."""
    name = F.trim("module_name")
    tree = F.to_json(F.struct(
        F.lit(fixed.DESCRIPTION_VERSION).alias("schema_version"), F.array(F.lit(fixed.SOLUTION_PATH)).alias("artifacts"),
        F.struct(text.record_name("uuid", name).alias("name")).alias("task"),
        F.struct("uuid", name.alias("module_name"), F.get("licenses", F.lit(0)).alias("license")).alias("metadata")))
    if settings:
        tree = F.concat(F.left(tree, F.length(tree) - 1), F.lit("," + json.dumps(settings)[1:]))
    return registry.toml_of_json(tree)


def task_files(rows: DataFrame, template: str = "Implement ${class_name}New.\n", test_script: str = "#!/bin/bash\n", shared: dict[str, str] | None = None, settings: dict | None = None) -> DataFrame:
    """(folder, path, text, executable): the folder of each kept row; *shared* files are copied into every folder."""
    name = F.trim("module_name")
    files = {fixed.DESCRIPTION_FILE: task_description(settings), fixed.INSTRUCTION_FILE: text.substitute(template, class_name=name), fixed.SOLUTION_FILE: F.lit("")}
    files |= dict.fromkeys(fixed.REFERENCE_FILES, F.col("python_code"))
    files |= {fixed.TEST_SCRIPT: F.lit(test_script), fixed.SOLVE_SCRIPT: text.wrap("triton_code")}
    files |= {path: F.lit(content) for path, content in (shared or {}).items()}
    return folders.files_of(rows, text.record_name("uuid", name), files)


def split_kept(kept: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((task, module_group, split), check) of the kept tasks, from the metadata of each task's record.

    *kept* is (task), *rows* (uuid, module_name).  A task without a record or a name cannot be placed and has a null
    split.  check is one row: groups in both splits, tasks, and tasks with a split.
    """
    named = rows.select(F.col("uuid").alias("number"), F.lower(F.trim("module_name")).alias("module_group")).distinct()
    placed = kept.select(text.tidy_record_name("task").alias("task")).distinct().withColumn("number", text.record_number("task")).join(named, "number", "left")
    split = F.when(text.hash_bucket("module_group", fixed.DEV_BUCKETS) == 0, "dev").when(F.col("module_group").isNotNull(), "train")
    lists = placed.select("task", "module_group", split.alias("split"))
    return lists, dedup.split_check(lists, "module_group", "split")


def write_split(kept: DataFrame, rows: DataFrame, root: str) -> None:
    """One list of tasks and one registry for each split below *root*; groups in both or tasks in none are an error."""
    lists, check = split_kept(kept, rows)
    found = check.first()
    if found.n_torn_groups or found.n_rows != found.n_split_rows:
        raise ValueError(f"split is not clean: {found}")
    for name in ("train", "dev"):
        own = lists.where(F.col("split") == name).select("task")
        records.write_list(own, "task", f"{root}/{name}")
        registry.write_registry(registry.registry(own.select(F.col("task").alias("name"), F.concat(F.lit("tasks/"), "task").alias("path")), name, f"{name} split"), f"{root}/registry-{name}")
