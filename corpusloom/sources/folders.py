"""Folders of text files as records, written from and read into (folder, path, text) rows."""

from __future__ import annotations

import errno
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files_of(df: DataFrame, folder: Column, files: dict[str, Column]) -> DataFrame:
    """(folder, path, text, executable): one row per file of each record; scripts (.sh) are executable."""
    entries = F.array(*(F.struct(F.lit(p).alias("path"), c.alias("text")) for p, c in files.items()))
    return df.select(folder.alias("folder"), F.explode(entries).alias("f")).select("folder", "f.path", F.coalesce("f.text", F.lit("")).alias("text"), F.col("f.path").endswith(".sh").alias("executable"))


def write_folders(files: DataFrame, root: str, spare: str | None = None) -> None:
    """Replace *root* with the folders, files written by the tasks that hold them.

    *root* must be a path that all executors mount.  The folders are written beside it and put in its place when all
    are there, so a job that fails leaves what there was.

    Folders that were written so before and are in folders of *spare*, on the same file system, are used up: they are
    renamed and their files written over.  New files and directories can be dear where many were removed lately, as on
    ext4 without a journal (README).
    """
    aim, beside = root.rstrip("/"), f"{root.rstrip('/')}.new-{uuid.uuid4().hex[:8]}"
    whole, aside = f"{beside}/whole", f"{beside}/aside"
    os.makedirs(whole)
    os.makedirs(aside)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spares = _spares(spare, TaskContext.get().partitionId()) if spare else iter(())
        name, own, size = "", {}, 0
        for frame in frames:
            for folder, path, text, executable in frame.itertuples(index=False):
                inside = os.path.normpath(os.path.join(folder, path))
                if inside.startswith(("/", "../")) or inside in (".", ".."):
                    raise ValueError(f"path leaves the folder: {path}")
                first, _, rest = inside.partition("/")
                if own and (first != name or size >= _BATCH or "" in {rest, *own}):
                    _put(own, name, whole, aside, spares)
                    own, size = {}, 0
                name, own[rest] = first, (content := text.encode("utf-8"), 0o755 if executable else 0o644)
                size += len(content)
            yield pd.DataFrame({"n": [len(frame)]})
        if own:
            _put(own, name, whole, aside, spares)

    try:
        files.select("folder", "path", "text", "executable").mapInPandas(write, "n long").agg(F.sum("n")).collect()
        shutil.rmtree(aim, ignore_errors=True)
        os.replace(whole, aim)
        for used in os.scandir(spare) if spare else ():
            if not any(os.scandir(used)):
                os.rmdir(used)
    finally:
        shutil.rmtree(beside, ignore_errors=True)


def _spares(spare: str, task: int) -> Iterator[str]:
    """The folders in the folders of *spare*; each task begins elsewhere, since one that is taken is passed over."""
    found = sorted(e.path for d in os.scandir(spare) for e in os.scandir(d) if e.is_dir(follow_symlinks=False))
    start = int(len(found) * (task * 0.618 % 1))
    yield from found[start:]
    yield from found[:start]


def _put(files: dict[str, tuple[bytes, int]], name: str, root: str, aside: str, spares: Iterator[str]) -> None:
    """Put *files*, (content, mode) by path, into the folder *name* of *root*; at the path "" is a file of that name.

    They are written *aside* and moved when all are whole: the folder at once, or file by file where it is there, since
    the task runs twice or another has files of it too.
    """
    own, kept = f"{aside}/{uuid.uuid4().hex}", set()
    if "" in files:
        _write(own, *files[""])
        os.replace(own, f"{root}/{name}")
        return
    for taken in spares:
        try:
            os.rename(taken, own)
        except FileNotFoundError:  # another task has it
            continue
        old = set(_paths(own))
        kept = old & files.keys()
        for path in old - kept:
            os.unlink(f"{own}/{path}")
            while (path := os.path.dirname(path)) and not os.listdir(f"{own}/{path}"):
                os.rmdir(f"{own}/{path}")
        break
    else:
        os.mkdir(own)
    made = {"", *map(os.path.dirname, kept)}
    for path, (content, mode) in files.items():
        if (below := os.path.dirname(path)) not in made:
            os.makedirs(f"{own}/{below}", exist_ok=True)
            made.add(below)
        _write(f"{own}/{path}", content, mode)
    try:
        os.rename(own, f"{root}/{name}")
    except OSError as e:
        if e.errno not in (errno.EEXIST, errno.ENOTEMPTY):
            raise
        for path in files:
            os.makedirs(os.path.dirname(f"{root}/{name}/{path}"), exist_ok=True)
            os.replace(f"{own}/{path}", f"{root}/{name}/{path}")


def _write(target: str, content: bytes, mode: int) -> None:
    """A file of this content, over the one that is there: emptied first, it would get its blocks as soon as it is closed."""
    with open(os.open(target, os.O_WRONLY | os.O_CREAT, mode), "wb", buffering=0) as f:
        f.write(content)
        found = os.fstat(f.fileno())
        if found.st_size > len(content):
            f.truncate(len(content))
        if found.st_mode & 0o777 != mode:
            os.fchmod(f.fileno(), mode)


def _paths(base: str, within: str = "") -> Iterator[str]:
    """Paths in *base* of all files at and below *within*."""
    for entry in os.scandir(f"{base}/{within}"):
        if entry.is_dir(follow_symlinks=False):
            yield from _paths(base, f"{within}{entry.name}/")
        else:
            yield f"{within}{entry.name}"


def _below(base: str, within: str) -> Iterator[tuple[str, bytes]]:
    """(path within *base*, content) of the files at and below *within*, but for hidden and empty ones."""
    for entry in os.scandir(os.path.join(base, within)):
        if not _hidden(entry.name):
            path = f"{within}/{entry.name}"
            if entry.is_dir():
                yield from _below(base, path)
            else:
                with open(entry.path, "rb", buffering=0) as f:
                    if content := f.read():
                        yield path, content


def _hidden(name: str) -> bool:
    """Names that Spark's own scans pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


#: Folders that one task reads, bytes of text that it passes on at a time.
_FOLDERS, _BATCH = 2000, 8 << 20


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, path, text) of every file under the folders of *root*; folders with a space in the name are no records.
    Spark's scan passes over files of no bytes, so an empty file is as one that is missing.

    Under a path that all executors mount, the driver lists the folders only, and tasks read a few thousand of them
    each: Spark's scan lists every file on the driver and opens four in a task.
    """
    if "://" in root:
        return _scanned(spark, root)
    base = os.path.abspath(root)
    names = sorted(n for n in os.listdir(base) if " " not in n and not _hidden(n))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows)], ["folder", "path", "text"])

        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            whole = os.path.join(base, name)
            if os.path.isdir(whole):
                found = _below(base, name)
            else:
                with open(whole, "rb") as f:
                    found = [(name, content)] if (content := f.read()) else []
            for path, content in found:
                rows.append((name, path.removeprefix(f"{name}/"), content.decode("utf-8")))
                size += len(content) + 100
                if size >= _BATCH:
                    yield told()
                    rows, size = [], 0
        if rows:
            yield told()

    tasks = max(spark.sparkContext.defaultParallelism, -(-len(names) // _FOLDERS))
    listed = spark.createDataFrame(pa.table({"name": pa.array(names, pa.string())}), "name string")
    return listed.repartition(tasks).mapInArrow(read, "folder string, path string, text string")


def _scanned(spark: SparkSession, root: str) -> DataFrame:
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = F.substr(F.col("path"), F.lit(len(root.rstrip("/")) + 2))
    named = read.select(inside.alias("p"), F.decode("content", "UTF-8").alias("text"))
    return named.select(F.substring_index("p", "/", 1).alias("folder"), F.expr("substring(p, instr(p, '/') + 1)").alias("path"), "text").where(~F.col("folder").contains(" "))


def list_folders(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """Names of the record folders, sorted.  Here and below, *files* are those of :func:`read_files` if they were read."""
    return (files or read_files(spark, root)).select("folder").distinct().orderBy("folder")


def read_records(spark: SparkSession, root: str, paths: list[str], files: DataFrame | None = None) -> DataFrame:
    """One row per folder with one column per path; a file that is missing is null."""
    return (files or read_files(spark, root)).groupBy("folder").pivot("path", paths).agg(F.first("text"))


def read_results(spark: SparkSession, root: str, result: str, detail: str, files: DataFrame | None = None) -> DataFrame:
    """(folder, result, detail): folders that hold *result*, with *detail* where there is one."""
    files = files or read_files(spark, root)
    there = files.where(F.col("path") == result).select("folder", F.col("text").alias("result"))
    extra = files.where(F.col("path") == detail).select("folder", F.col("text").alias("detail"))
    return there.join(extra, "folder", "left")


def newest(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, modified) of the newest file of that name under *root*, ties by path; only file names are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "modificationTime")
    return listed.agg(F.max(F.struct("modificationTime", "path")).alias("m")).select("m.path", F.col("m.modificationTime").alias("modified"))


def markdown(df: DataFrame, headers: list[str] | None = None) -> str:
    """A Markdown table of a small aggregate."""
    names = headers or df.columns
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in df.toLocalIterator()]
    return "\n".join(lines)


def share_text(n: int, total: int) -> str:
    """``1,234 (5.6%)``; a share of nothing is left out."""
    return f"{n:,} ({100 * n / total:.1f}%)" if total else f"{n:,}"
