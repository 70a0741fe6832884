"""Sources and sinks round-trip; isolation survives what rows do."""

import json
import tomllib

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.operators import isolated
from corpusloom.sources import folders, records, registry


def test_rows_are_coerced_and_projected(spark):
    df = spark.sql("select 7 uuid, 'a' module_name, 'b' entry_point, 'c' python_code, 'd' triton_code, cast(null as array<string>) licenses, true synthetic, cast(null as string) repo_link, 1 extra")
    r = records.to_rows(df).first()
    assert r.licenses == [] and r.repo_link == "" and "extra" not in r.asDict()


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", "x: y")], "uuid bigint, module_name string, reason string")
    path = str(tmp_path / "j")
    records.write_json_lines(df, path, "uuid", single=True)
    lines = [json.loads(x) for p in (tmp_path / "j").glob("*.json") for x in p.read_text().splitlines()]
    assert [x["uuid"] for x in lines] == [1, 2] and lines[1]["reason"] is None
    assert records.read_json_lines(spark, path, "uuid bigint, reason string").count() == 2
    (tmp_path / "bad.json").write_text('{"uuid": 1}\nnot json\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        records.read_json_lines(spark, str(tmp_path / "bad.json"), "uuid bigint").collect()
    records.write_fan_out(df, str(tmp_path / "kept"), str(tmp_path / "dropped"))
    assert spark.read.json(str(tmp_path / "kept")).count() == 1 and spark.read.json(str(tmp_path / "dropped")).first().reason == "x: y"


def test_lists(spark, tmp_path):
    records.write_list(spark.createDataFrame([("b",), ("a",)], "task string"), "task", str(tmp_path / "l"))
    assert sorted(r.task for r in records.read_list(spark, str(tmp_path / "l")).collect()) == ["a", "b"]
    (tmp_path / "w.txt").write_text("a  b\n\n c\n")
    assert [r.task for r in records.read_list(spark, str(tmp_path / "w.txt")).collect()] == ["a", "b", "c"]


def test_registry(spark, tmp_path):
    tasks = spark.createDataFrame([("t2", "p2"), ("t1", "p1")], "name string, path string")
    both = registry.registry(tasks, "train", "x").unionByName(registry.registry(tasks.limit(0), "dev", "y"))
    registry.write_registry(both, str(tmp_path / "r"))
    assert [tuple(r) for r in registry.read_registry(spark, str(tmp_path / "r"), "train").orderBy("index").collect()] == [(0, "t1", "p1"), (1, "t2", "p2")]
    with pytest.raises(PySparkException):
        registry.read_registry(spark, str(tmp_path / "r"), "none").collect()


def test_toml(spark):
    tree = {"version": "1.4", "files": ["a", "b"], "task": {"name": 'q"\\\n', "n": 3, "on": True, "none": None, "env": {"K": "v"}}, "servers": [{"name": "x", "args": ["1"]}]}
    back = tomllib.loads(registry.to_toml(tree))
    del tree["task"]["none"]
    assert back == tree
    df = spark.createDataFrame([(json.dumps(tree),), (None,)], "j string").withColumn("t", registry.toml_of_json("j"))
    got = df.select(F.from_json(registry.json_of_toml("t"), "version string, task struct<name: string, n: bigint>").alias("x")).collect()
    assert got[0].x.task.name == 'q"\\\n' and got[1].x is None


def test_folders(spark, tmp_path):
    root = str(tmp_path / "tasks")
    df = spark.createDataFrame([("a-1", "code\n", "s"), ("b-2", None, "t")], "name string, code string, script string")
    files = folders.files_of(df, F.col("name"), {"task.toml": F.lit("x = 1\n"), "env/reference.py": F.col("code"), "solution/solve.sh": F.col("script")})
    folders.write_folders(files, root)
    assert (tmp_path / "tasks/a-1/solution/solve.sh").stat().st_mode & 0o111
    (tmp_path / "tasks/a-1 2").mkdir()
    (tmp_path / "tasks/a-1 2/task.toml").write_text("x = 2\n")
    assert [r.folder for r in folders.list_folders(spark, root).collect()] == ["a-1", "b-2"]
    got = {r.folder: r for r in folders.read_records(spark, root, ["task.toml", "env/reference.py", "absent"]).collect()}
    assert got["a-1"]["env/reference.py"] == "code\n" and got["a-1"]["absent"] is None
    res = {r.folder: r.detail for r in folders.read_results(spark, root, "task.toml", "solution/solve.sh").collect()}
    assert res == {"a-1": "s", "b-2": "t"}
    with pytest.raises(PySparkException):  # what was there stays
        folders.write_folders(folders.files_of(df, F.col("name"), {"../../x": F.col("code")}), root)
    assert [r.folder for r in folders.list_folders(spark, root).collect()] == ["a-1", "b-2"]


def test_newest_and_markdown(spark, tmp_path):
    import os

    for i, name in enumerate(("r1", "r2")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "traces.jsonl").write_text("{}")
        os.utime(tmp_path / name / "traces.jsonl", (1_000_000 * (2 - i), 1_000_000 * (2 - i)))
    assert folders.newest(spark, str(tmp_path), "traces.jsonl").first().path.endswith("r1/traces.jsonl")
    assert folders.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert folders.share_text(1234, 2000) == "1,234 (61.7%)" and folders.share_text(0, 0) == "0"


CHECKS = '''
import os, sys, time, json
def check(row):
    code = row["python_code"]
    if code == "crash": os._exit(3)
    if code == "hang":
        import signal
        signal.pthread_sigmask(signal.SIG_BLOCK, [signal.SIGALRM])
        time.sleep(60)
    if code == "slow": time.sleep(30)
    if code == "forge":
        print(json.dumps({"id": 1, "reason": "forged"})); sys.stdout.flush()
        return "own"
    if code == "raise": raise ConnectionRefusedError("no network")
    return None
'''


def test_isolation(spark, tmp_path, monkeypatch):
    import os

    (tmp_path / "iso_checks.py").write_text(CHECKS)
    monkeypatch.setenv("PYTHONPATH", os.pathsep.join([str(tmp_path), os.environ.get("PYTHONPATH", "")]))
    path = [str(tmp_path)]
    rows = [{"id": i, "python_code": c} for i, c in enumerate(("ok", "forge", "raise", "slow", "crash", "after"))]
    got = isolated.run_child(rows, "iso_checks:check", 1, path)
    assert got == {0: None, 1: "own", 2: "exec: ConnectionRefusedError: no network", 3: "exec: timeout after 1 s"}
    online = "import socket, urllib.request"
    (tmp_path / "iso_online.py").write_text("def check(row):\n    exec(row['python_code'])\n")
    lines = ["socket.create_connection(('127.0.0.1', 9))", "socket.socket().connect(('127.0.0.1', 9))", "socket.getaddrinfo('localhost', 80)", "urllib.request.urlopen('http://127.0.0.1:9')"]
    said = isolated.run_child([{"id": i, "python_code": f"{online}\n{line}"} for i, line in enumerate(lines)], "iso_online:check", 2, path)
    assert all(said[i].startswith("exec:") and "rows have no network" in said[i] for i in range(4))
    assert isolated.run_child([{"id": 9, "python_code": "hang"}], "iso_checks:check", 1, path, grace=1) == {}


def test_isolated_map_retries(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(("x = 1", "def broken(", "", None))] + [(None, "x")], "uuid bigint, python_code string")
    got = {r.id: r.reason for r in isolated.isolated_map(df, "uuid", ["python_code"], "corpusloom.operators.checks:parses", batch=2).collect()}
    assert got[0] is None and got[1].startswith("exec: SyntaxError") and got[2] is None and got[3] is None and len(got) == 4
    lost = {r.id: r.reason for r in isolated.isolated_map(df, "uuid", ["python_code"], "os:_exit", batch=4).collect()}
    assert set(lost.values()) >= {isolated.LOST} or all(v.startswith("exec:") for v in lost.values())


def test_a_crash_costs_one_more_child(spark, tmp_path, monkeypatch):
    """Rows behind one that crashes go on together, and equal rows are run once for all."""
    import os

    log = tmp_path / "starts"
    (tmp_path / "iso_log.py").write_text(f"import os\nopen({str(log)!r}, 'a').write('started\\n')\ndef check(row):\n    open({str(log)!r}, 'a').write(row['python_code'] + '\\n')\n    if row['python_code'] == 'crash': os._exit(3)\n    return row['python_code']\n")
    monkeypatch.setattr(isolated.sys, "path", [*isolated.sys.path, str(tmp_path)])
    rows = [{"id": i, "python_code": c} for i, c in enumerate(("a", "crash", "b", "c", "d", "e"))]
    import pandas as pd

    out = next(isolated._runner("iso_log:check", 25, 2, ["id", "python_code"], 10)(iter([pd.DataFrame(rows)])))
    assert out.reason.tolist() == ["a", None, "b", "c", "d", "e"] and out.answered.tolist() == [True, False, True, True, True, True]
    assert log.read_text().split().count("started") == 2
    df = spark.createDataFrame([(i, "x = 1" if i % 2 else "def broken(") for i in range(60)], "uuid bigint, python_code string")
    got = {r.id: r.reason for r in isolated.isolated_map(df, "uuid", ["python_code"], "corpusloom.operators.checks:parses", once=True).collect()}
    assert len(got) == 60 and all((got[i] is None) == bool(i % 2) for i in range(60))


def test_folders_are_read_by_tasks(spark, tmp_path):
    """Many folders are a few tasks, not one for every four files; hidden and empty files are passed over, as by Spark."""
    for k in range(300):
        (tmp_path / f"t/f{k}/sub").mkdir(parents=True)
        (tmp_path / f"t/f{k}/sub/a=b c.txt").write_text(f"é{k}\n")
        (tmp_path / f"t/f{k}/empty").write_text("")
        (tmp_path / f"t/f{k}/_hidden").write_text("x")
    root = str(tmp_path / "t")
    read = folders.read_files(spark, root)
    assert read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, read.collect())) == sorted((f"f{k}", "sub/a=b c.txt", f"é{k}\n") for k in range(300))


def test_folders_in_waves(spark, sf_dir, monkeypatch):
    """Few folders on storage at a time: the rows are those of the SQL all the same."""
    from corpusloom.plans import queries

    from .oracle import connect, same

    monkeypatch.setattr(queries, "_AT_ONCE", 30)
    same(queries.folder_files(spark, sf_dir), connect(sf_dir), queries.SQL["folder_files"])


def test_spare_folders_are_written_over(spark, tmp_path):
    """Renamed and written over in place, they hold what new ones would, also where a folder's files lie in several tasks."""
    root, spare = tmp_path / "t", tmp_path / "spare"
    spare.mkdir()

    def write(names, files, parts):
        rows = spark.createDataFrame([(n, p, f"{n} {t}", p.endswith(".sh")) for n in names for p, t in files.items()], "folder string, path string, text string, executable boolean")
        folders.write_folders(rows.repartition(parts), str(root), str(spare))
        found = {str(p.relative_to(root)): p for p in root.rglob("*")}
        assert {n: p.read_text() for n, p in found.items() if p.is_file()} == {f"{n}/{p}": f"{n} {t}" for n in names for p, t in files.items()}
        assert {n for n, p in found.items() if p.is_dir()} == {f"{n}/{p}".rsplit("/", k)[0] for n in names for p in files for k in range(1, p.count("/") + 2)}
        assert all(bool(p.stat().st_mode & 0o111) == n.endswith(".sh") for n, p in found.items() if p.is_file())
        return {p.stat().st_ino for n, p in found.items() if n.endswith(("/x/1", "/x/2.sh"))}

    first = write([f"a{k}" for k in range(20)], {"x/1": "long " * 2000, "x/2.sh": "two", "y/z/3": "three", "4": "four", ".h/5": "five"}, 1)
    root.rename(spare / "0")
    second = write(["b0", "b1", "b2"], {"x/1": "é", "x/2.sh": "longer than it was", "4/6": "six"}, 1)
    assert second <= first and len(second) == 6 and len(list(spare.glob("*/*"))) == 17
    root.rename(spare / "1")
    write([f"c{k}" for k in range(30)], {"x/1": "1", "x/2.sh": "2", "y/z/3": "3"}, 5)
    assert not list(spare.iterdir()) and sorted(p.name for p in tmp_path.iterdir()) == ["spare", "t"]


def test_waves_use_the_folders_again(spark, sf_dir, monkeypatch):
    """Only the first waves make folders anew."""
    import glob

    from corpusloom.plans import queries

    spares, write = [], folders.write_folders

    def counted(files, root, spare):
        held = len(glob.glob(f"{spare}/*/*"))
        write(files, root, spare)
        spares.append((held, held - len(glob.glob(f"{spare}/*/*")), len(glob.glob(f"{root}/*"))))

    monkeypatch.setattr(queries, "_AT_ONCE", 25)
    monkeypatch.setattr(folders, "write_folders", counted)
    assert queries.folder_files(spark, sf_dir).count() == sum(n for _, _, n in spares) == 100
    assert len(spares) == 4 and all(used == min(held, n) for held, used, n in spares)
