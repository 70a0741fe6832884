"""Running untrusted rows in child processes, a batch per child, replies on a pipe of their own."""

from __future__ import annotations

import json
import os
import selectors
import signal
import subprocess
import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

BATCH, ROW_SECONDS, GRACE_SECONDS = 25, 30, 60
LOST = "exec: worker crashed or hung"

#: The child: reads one JSON request a line, runs ``check(row)`` under an alarm, answers on file descriptor 3.
_CHILD = r"""
import importlib, json, os, signal, socket, sys
reply = os.fdopen(int(sys.argv[3]), "w", buffering=1)
module, name, seconds = sys.argv[1].rpartition(":")[0], sys.argv[1].rpartition(":")[2], int(sys.argv[2])
requests = sys.stdin.read().splitlines()
sys.stdin = open(os.devnull)
check = getattr(importlib.import_module(module), name)
def offline(*_, **__): raise ConnectionRefusedError("rows have no network")
class Offline(socket.socket):
    connect = connect_ex = sendto = sendmsg = offline
socket.socket = socket.SocketType = Offline
socket.create_connection = socket.getaddrinfo = socket.gethostbyname = offline
class Timeout(BaseException): pass
def ring(*_): raise Timeout
signal.signal(signal.SIGALRM, ring)
for line in requests:
    row = json.loads(line)
    signal.alarm(seconds)
    try:
        reason = check(row)
    except Timeout:
        reason = f"exec: timeout after {seconds} s"
    except Exception as e:
        reason = f"exec: {type(e).__name__}: {str(e)[:100]}"
    finally:
        signal.alarm(0)
    reply.write(json.dumps({"id": row["id"], "reason": reason}) + "\n")
"""


def run_child(rows: list[dict], check: str, row_seconds: int = ROW_SECONDS, path: list[str] | None = None, grace: int = GRACE_SECONDS) -> dict[int, str | None]:
    """id -> reason of the rows that a child answered for; *check* is ``module:function``.

    The child has its own process group, which is killed when it is done, or no answer came in a row's time and *grace*.
    Sockets in it refuse to connect, to send and to look up names, so a row that downloads fails with a reason.
    Only the reply pipe is read, so what a row prints cannot forge an answer, and only ids that were asked count.
    """
    read, write = os.pipe()
    env = os.environ | {"OMP_NUM_THREADS": "1", "PYTHONPATH": os.pathsep.join([*(path or []), *sys.path])}
    child = subprocess.Popen([sys.executable, "-c", _CHILD, check, str(row_seconds), str(write)], stdin=subprocess.PIPE, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, pass_fds=(write,), env=env, start_new_session=True, text=True)
    os.close(write)
    asked, answers, held = {r["id"] for r in rows}, {}, b""
    end = time.monotonic() + row_seconds + grace
    try:
        try:
            child.stdin.write("".join(json.dumps(r) + "\n" for r in rows))
            child.stdin.close()
        except BrokenPipeError:
            pass
        os.set_blocking(read, False)
        with selectors.DefaultSelector() as wait:
            wait.register(read, selectors.EVENT_READ)
            while len(answers) < len(asked) and time.monotonic() < end:
                if not wait.select(timeout=0.5):
                    continue
                got = os.read(read, 1 << 16)
                if not got:
                    break
                *lines, held = (held + got).split(b"\n")
                for line in lines:
                    try:
                        a = json.loads(line)
                        if a["id"] in asked and a["id"] not in answers:
                            answers[a["id"]] = a["reason"]
                            end = time.monotonic() + row_seconds + grace
                    except (ValueError, KeyError, TypeError):
                        continue
    finally:
        os.close(read)
        try:
            os.killpg(child.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        child.wait()
    return answers


def _runner(check: str, batch: int, row_seconds: int, columns: list[str], grace: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                rows = [{c: (None if pd.isna(v) else int(v) if c == "id" else v) for c, v in zip(columns, values)} for values in part[columns].itertuples(index=False)]
                answers, left = {}, rows
                while left:
                    answers |= run_child(left, check, row_seconds, grace=grace)
                    # Rows are run in order, so the first one without an answer is at fault; those behind it never began.
                    left = [r for r in left if r["id"] not in answers][1:]
                yield pd.DataFrame({"id": [r["id"] for r in rows], "answered": [r["id"] in answers for r in rows], "reason": [answers.get(r["id"]) for r in rows]}).astype({"id": "int64"})

    return run


def isolated_map(df: DataFrame, id_column: str, columns: list[str], check: str, batch: int = BATCH, row_seconds: int = ROW_SECONDS, grace: int = GRACE_SECONDS, once: bool = False) -> DataFrame:
    """(id, reason): *check* applied to each row in child processes; null if the row passes.

    A row that got no answer (the child crashed or hung) is run again in a child of its own, and the rows behind it go
    on in another one; what is still unanswered gets LOST.  Rows with a null id are left out.  The first replies are
    written, so a lost executor makes no untrusted row run again.

    With *once*, rows that are equal in *columns* are run once, with their smallest id, and share the reason; *check*
    must not depend on the id.
    """
    rows = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), *columns)
    if once:
        keyed = rows.withColumn("copy", F.sha2(F.to_json(F.struct(*columns)), 256))
        least = keyed.groupBy("copy").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in columns))
        least = written(least.repartition(df.sparkSession.sparkContext.defaultParallelism), "distinct")
        replies = isolated_map(least, "id", columns, check, batch, row_seconds, grace)
        return keyed.select("id", "copy").join(least.select("copy", F.col("id").alias("own")), "copy").join(replies.withColumnRenamed("id", "own"), "own").select("id", "reason")
    names = ["id", *columns]
    first = rows.mapInPandas(_runner(check, batch, row_seconds, names, grace), "id long, answered boolean, reason string")
    first = written(first, "replies")
    lost = rows.join(first.where("not answered").select("id"), "id", "left_semi")
    again = lost.mapInPandas(_runner(check, 1, row_seconds, names, grace), "id long, answered boolean, reason string")
    return first.where("answered").select("id", "reason").unionByName(again.select("id", F.when(F.col("answered"), F.col("reason")).otherwise(LOST).alias("reason")))


def map_with_errors(df: DataFrame, key: str, columns: list[str], call: Callable[[dict], str | None]) -> DataFrame:
    """(key, result, error): *call* on each row, its exception as a value; the order of rows does not matter."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for values in frame.itertuples(index=False):
                row = dict(zip((key, *columns), values))
                try:
                    out.append((row[key], call(row), None))
                except Exception as e:
                    out.append((row[key], None, f"{type(e).__name__}: {e}"[-500:]))
            yield pd.DataFrame(out, columns=[key, "result", "error"])

    return df.select(key, *columns).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, result string, error string")
