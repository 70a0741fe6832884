"""Pipelines on hand-made rows."""

import tomllib

import pytest

from corpusloom.functions import fixed
from corpusloom.functions.code import analyse
from corpusloom.operators import checks, isolated
from corpusloom.plans import pipelines
from corpusloom.sources import folders, records

from .test_operators import BASE


def table(spark, rows):
    return spark.createDataFrame([(u, m, m, p, t, lic, False, None) for u, m, p, t, lic in rows], records.ROW_SCHEMA)


def test_filter_pipeline_keeps_the_order_of_stages(spark):
    other = BASE.replace("0.25", "0.5")
    held = BASE.replace("0.25", "0.75")
    fails = BASE + "raise ValueError(1)\n"
    rows = records.to_rows(table(spark, [
        (1, "Blend", "x = (", "", ["MIT"]), (2, "Blend", BASE, "", ["GPL-3.0"]), (3, "Blend", BASE, "", None), (4, "Blend", BASE + "\n" * 300, "", ["MIT"]),
        (5, "Blend", BASE, "", ["MIT"]), (6, "Blend", "# copy\n" + BASE, "", ["MIT"]), (7, "Blend", other, "", ["MIT"]),
        (8, "Blend", held, "", ["MIT"]), (9, "Blend", "# copy\n" + held, "", ["MIT"]), (10, "Blend", fails, "", ["MIT"]), (11, "Missing", BASE + "y = 1\n", "", ["MIT"])]))
    keys = spark.createDataFrame([(analyse(held, "Blend")["structure_key"],), (None,)], "key string")
    got = {r.uuid: r.reason for r in pipelines.filter_pipeline(rows, keys, "tests.test_pipelines:refuse").collect()}
    assert got[1].startswith("parse") and got[2].startswith("license: restricted") and got[3] == "license: none listed" and got[4].startswith("length")
    assert got[5] is None and got[6] == "duplicate: same code as uuid 5" and got[7] is None
    assert got[8].startswith("held out") and got[9] == "duplicate: same code as uuid 8"  # the owner is dropped later, its copy stays dropped
    assert got[10].startswith("exec: RuntimeError") and got[11] is None and len(got) == 11


def refuse(row):
    if "raise" in row["python_code"]:
        raise RuntimeError("refused")


RUN = """
import numpy as np
class Model:
    calls = 0
    def __init__(self, k=1): self.k = k
    def parameters(self): return [np.array([{weight}])]
    def __call__(self, x):
        Model.calls += 1
        x += 1
        return {out}
def get_inputs(): return [np.ones(3)]
def get_init_inputs(): return [[], {{"k": 2}}]
"""


def test_run_check():
    run = lambda out, weight="1.0": checks.runs_deterministically({"python_code": RUN.format(out=out, weight=weight), "module_name": "Model"})
    assert run("x * self.k") is None
    assert run("x / 0 * 0").startswith("output: not finite")
    assert run("[x]") == "output: list, not one array"
    assert run("x * Model.calls") == "nondeterministic: two calls differ"
    assert run("x", "float('nan')").startswith("init")


def test_map_with_errors(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "task string, n int")
    got = {r.task: (r.result, r.error) for r in isolated.map_with_errors(df, "task", ["n"], lambda r: str(1 // r["n"])).collect()}
    assert got["a"] == ("1", None) and got["b"][0] is None and got["b"][1].startswith("ZeroDivisionError")


def test_profile_and_report(spark):
    rows = records.to_rows(table(spark, [(1, "Blend", BASE, "import torch._inductor\nclass BlendNew: pass", ["MIT", "MIT"]), (2, "X", "x = (", None, [])]))
    p = pipelines.profile(rows)
    assert {(r.license, r.n) for r in p["licenses"].collect()} == {("MIT", 2)}
    assert {r.measure: r.n for r in p["interface"].collect()} == {"parses": 1, "get_inputs": 1, "get_init_inputs": 1, "class_exists": 1, "triton_class": 1, "entry_point": 2, "all": 1}
    assert [(r.line, r.n) for r in p["internal_imports"].collect()] == [("import torch._inductor", 1)]
    assert {(r.measure, r.value) for r in p["sizes"].where("percent = 50").collect()} == {("elements", 60.0), ("python_lines", 20.0), ("triton_lines", 2.0), ("kernels", 0.0)}
    assert pipelines.report(rows).startswith("## duplicates\n\n| n_rows")


def test_task_files(spark, tmp_path):
    rows = records.to_rows(table(spark, [(42, " Blend ", BASE, "code", ["MIT"])]))
    files = pipelines.task_files(rows, shared={"tests/lib/__init__.py": "x"}, settings={"agent": {"seconds": 9}})
    folders.write_folders(files, str(tmp_path / "t"))
    at = tmp_path / "t/task-00042-blend"
    assert tomllib.loads((at / "task.toml").read_text()) == {"schema_version": "1.4", "artifacts": [fixed.SOLUTION_PATH], "task": {"name": "task-00042-blend"}, "metadata": {"uuid": 42, "module_name": "Blend", "license": "MIT"}, "agent": {"seconds": 9}}
    assert (at / "instruction.md").read_text() == "Implement BlendNew.\n" and (at / "tests/lib/__init__.py").read_text() == "x"


def test_split_of_kept_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f" M{i % 9} ") for i in range(60)], "uuid bigint, module_name string")
    kept = spark.createDataFrame([(f"Task-{i:05d}-m{i % 9}",) for i in range(0, 60, 2)] + [("task/00004-m4 2",)], "task string")
    pipelines.write_split(kept, rows, str(tmp_path / "s"))
    lists = {n: {r.task for r in records.read_list(spark, str(tmp_path / f"s/{n}")).collect()} for n in ("train", "dev")}
    assert not lists["train"] & lists["dev"] and len(lists["train"]) + len(lists["dev"]) == 30
    with pytest.raises(ValueError):
        pipelines.write_split(kept.union(spark.createDataFrame([("task-99999-x",)], "task string")), rows, str(tmp_path / "t"))
