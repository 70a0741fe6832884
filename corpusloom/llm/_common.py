"""What the operators of this subpackage share: written intermediates, guarded broadcasts, pairs within groups."""

from __future__ import annotations

import atexit
import uuid as _uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows of two or three numbers up to which a side may be broadcast (about 24 MB); beyond it a shuffled join runs.
BROADCAST_ROWS = 1_000_000
#: Members of a group that one task pairs with as many others.
PAIR_BLOCK = 1024
#: Bytes of text that a worker takes apart at a time.
SLICE = 1 << 20


class Scratch:
    """Intermediates of one query, written as tables in the shared folder; a lost executor costs a re-read, not a re-run.

    They are removed when the Python process ends, or by :meth:`drop` once nothing reads them any more.  Each table is
    an execution of its own, and Spark is told to delete an execution's shuffle files when it is over.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/corpusloom-{name}-{_uuid.uuid4().hex[:12]}"
        self._n = 0
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        atexit.register(self.close)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write *df* and return the table read back."""
        self._n += 1
        path = f"{self.root}/{self._n:02d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone already
            pass


def guarded_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """*df* with a broadcast hint if it has at most BROADCAST_ROWS rows, else with one to merge sorted sides."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")


def pairs_within(members: DataFrame, group: list[str], key: str, a: str, b: str) -> DataFrame:
    """All pairs of different *key* within each group, smaller first, without gathering a group in one task.

    A group of n members is cut into ceil(n / PAIR_BLOCK) blocks by a hash of the key; a task gets two blocks.
    *members* must be distinct by group and key.  Null keys are left out.
    """
    m = members.where(F.col(key).isNotNull()).select(*group, F.col(key).alias("_k"))
    sizes = m.groupBy(*group).agg(F.count("*").alias("_n")).where("_n > 1")
    m = m.join(sizes, group).withColumn("_b", F.ceil(F.col("_n") / PAIR_BLOCK).cast("int"))
    m = m.withColumn("_own", F.pmod(F.hash("_k"), F.col("_b")))
    left = m.select(*group, F.col("_k").alias("_l"), F.col("_own").alias("_i"), F.explode(F.expr("sequence(_own, _b - 1)")).alias("_j"))
    right = m.select(*group, F.col("_k").alias("_r"), F.explode(F.expr("sequence(0, _own)")).alias("_i"), F.col("_own").alias("_j"))
    cell = left.join(right.hint("merge"), [*group, "_i", "_j"]).where("(_i < _j and _l <> _r) or (_i = _j and _l < _r)")
    return cell.select(*group, F.least("_l", "_r").alias(a), F.greatest("_l", "_r").alias(b))


def pairs_across(left: DataFrame, right: DataFrame, group: list[str], key: str) -> DataFrame:
    """All pairs (l, r) of a *left* and a *right* key of one group, with the other columns of *left*.

    Both sides of a group are cut into blocks of about PAIR_BLOCK by a hash of the key; a task gets a block of each.
    """
    blocks = [d.groupBy(*group).agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias(name)) for d, name in ((left, "_bl"), (right, "_br"))]
    cells = blocks[0].join(blocks[1], group)
    own = lambda n: F.pmod(F.hash(key), F.col(n))
    rest = [c for c in left.columns if c not in (*group, key)]
    l_ = left.join(cells, group).select(*group, *rest, F.col(key).alias("l"), own("_bl").alias("_i"), F.explode(F.expr("sequence(0, _br - 1)")).alias("_j"))
    r_ = right.select(*group, key).join(cells, group).select(*group, F.col(key).alias("r"), F.explode(F.expr("sequence(0, _bl - 1)")).alias("_i"), own("_br").alias("_j"))
    return l_.join(r_.hint("merge"), [*group, "_i", "_j"]).drop("_i", "_j")


def slices(batch: pa.RecordBatch, *columns: int) -> Iterator[pa.RecordBatch]:
    """*batch* in pieces of at most SLICE bytes of text in *columns*, at least a row each."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        sizes += np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0))
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def arrow_map(df: DataFrame, fn, schema: str, columns: tuple[int, ...] = ()) -> DataFrame:
    """mapInArrow with *fn* from record batch to record batch or None; batches are cut by the bytes of *columns*."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, *columns) if columns else (whole,):
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)
