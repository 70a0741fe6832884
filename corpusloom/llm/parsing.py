"""Source files that do not parse: lexer-state maps, bracket summaries, then local parses of balanced statements.

A file is cut into chunks of about ``CHUNK`` characters at line ends that no backslash precedes.  There the lexer is in
one of three states: in code, in a ''' string or in a three-double-quote string.  A chunk's *map* gives for each state
it may start in the state it ends in and the brackets it leaves, reduced to closers of earlier brackets followed by
open ones.  Maps compose associatively.  A task composes those of the files it holds; the chunks of a file longer than
``LONG`` go out over partitions and are composed as a tree, FAN at a time upwards and then downwards, so neither its
text nor all its maps are ever in one task.  The composed prefix tells each chunk its state and depth, hence where
statements begin: at a line that starts in column 0, outside strings and brackets, and does not continue a compound
statement.

Each such statement is parsed by itself, by the language's own parser.  If all parse, so does the file, as a module
is a sequence of them, whatever the lexer took for a boundary.  If one is refused, or the file's map does not balance,
the whole text decides.
"""

from __future__ import annotations

import ast
import keyword
import re
import warnings
from _symtable import symtable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, arrow_map

#: Characters of a chunk; of a file whose chunks go out over partitions; maps that one step composes.
CHUNK, LONG, FAN = 1024, 1 << 20, 64
CODE, SINGLE3, DOUBLE3 = 0, 1, 2

_TOKEN = re.compile(
    r"""\#[^\n\r]*|\([^()\[\]{}"'\#\\]*+\)|\[[^()\[\]{}"'\#\\]*+\]|(?P<q>"{3}|'{3})|"(?:[^"\\\n\r]|\\[\s\S])*"?|'(?:[^'\\\n\r]|\\[\s\S])*'?|(?P<o>[(\[{])|(?P<c>[)\]}])|\\\r?[\n\r]|(?P<n>[\n\r](?=[^\s\#)\]}]))""",
)
_END = {SINGLE3: re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"), DOUBLE3: re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*+"""')}
_QUOTES = {SINGLE3: "'''", DOUBLE3: '"""'}
_IMPORT = re.compile(r"(?:^|(?<=[;:\n\r]))[ \t\f]*(?:from|import)\b[\w., \t]*")
_DOTTED = re.compile(r"\w+(?:[ \t]*\.[ \t]*\w+){64,}")
_CONTINUES = re.compile(r"(?:else|elif|except|finally)\b")
_BEGINS = re.compile(r"(?!\s|#|[)\]}]|(?:else|elif|except|finally)\b)")
_PAIR = {")": "(", "]": "[", "}": "{"}


def scan(text: str, state: int = CODE) -> tuple[int, str, str, bool, list[tuple[int, int]]]:
    """(end state, closers, openers, mismatch, lines) of a chunk that begins in *state*.

    lines holds (offset, closers so far) of each line that begins in column 0, in code and with no bracket of the
    chunk open.
    """
    at, openers, closers, bad, lines = 0, [], [], False, []
    if state != CODE:
        m = _END[state].match(text) if _QUOTES[state] in text else None
        if not m:
            return state, "", "", False, lines
        at = m.end()
    while True:
        for m in _TOKEN.finditer(text, at):
            kind = m.lastgroup
            if kind == "o":
                openers.append(m[0])
            elif kind == "c":
                if openers:
                    bad |= openers.pop() != _PAIR[m[0]]
                else:
                    closers.append(m[0])
            elif kind == "n":
                if not openers:
                    lines.append((m.end(), len(closers)))
            elif kind == "q":
                state = DOUBLE3 if m[0] == '"""' else SINGLE3
                e = _END[state].match(text, m.end())
                if not e:
                    return state, "".join(closers), "".join(openers), bad, lines
                state, at = CODE, e.end()
                break
        else:
            return CODE, "".join(closers), "".join(openers), bad, lines


def statement_starts(text: str, state: int, depth: int, lines: list[tuple[int, int]]) -> list[int]:
    """Offsets at which a statement begins within a chunk that starts in *state* at bracket depth *depth*."""
    out, decorated = [], depth == 0 and state == CODE and text[:1] == "@"
    for at, closed in lines:
        if closed == depth:
            if not (decorated or _CONTINUES.match(text, at)):
                out.append(at)
            decorated = text[at] == "@"
    return out


def compose(a: tuple[int, str, str, bool], b: tuple[int, str, str, bool]) -> tuple[int, str, str, bool]:
    """The summary of two chunks in a row, *b* taken from the state in which *a* ends."""
    k = min(len(a[2]), len(b[1]))
    bad = a[3] or b[3] or any(_PAIR[c] != o for c, o in zip(b[1][:k], reversed(a[2])))
    return b[0], a[1] + b[1][k:], a[2][: len(a[2]) - k] + b[2], bad


Map = tuple[tuple[int, str, str, bool], ...]
IDENTITY: Map = tuple((state, "", "", False) for state in (CODE, SINGLE3, DOUBLE3))


def compose_maps(a: Map, b: Map) -> Map:
    """The map of two stretches in a row; associative, with IDENTITY as its unit."""
    return tuple(compose(x, b[x[0]]) for x in a)


def shortened(text: str) -> str:
    """*text* with each part of a long dotted name in an import once only.

    The parser spells such a name out part by part, in memory by the square of their number, but takes it or not by
    the parts alone; names of any length in other places it ends by its own limits.
    """
    if text.count(".") < 5000:
        return text

    def once(m: re.Match) -> str:
        parts = re.split(r"[ \t]*\.[ \t]*", m[0])
        return ".".join(dict.fromkeys(p if keyword.iskeyword(p) or not p.isidentifier() else "a" for p in parts))

    return _IMPORT.sub(lambda m: _DOTTED.sub(once, m[0]), text)


def refused(text: str) -> bool:
    """Whether the parser refuses *text* as a module.

    The symbol table is built on the same parse without making the tree's Python objects; it refuses more (names used
    against their scope), so only what it refuses is parsed again.
    """
    text = shortened(text)
    try:
        symtable(text, "<text>", "exec")
        return False
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        pass
    try:
        compile(text, "<text>", "exec", ast.PyCF_ONLY_AST)
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        return True
    return False


def verdict(text: str, whole=refused, size: int = CHUNK) -> tuple[str | None, int]:
    """(None if *text* parses, else why not: string (unterminated), brackets (unbalanced) or statement; its chunks)."""
    parts = chunks(text, size)
    scans = [[scan(part, state) for state in (CODE, SINGLE3, DOUBLE3)] for part in parts]
    have, bounds, at = IDENTITY, [0], 0
    for n, (part, by_state) in enumerate(zip(parts, scans)):
        state, closers, openers, _ = have[CODE]
        depth = len(openers)
        if n and state == CODE and not depth and not closers and _opens(part):
            bounds.append(at)
        bounds += [at + x for x in statement_starts(part, state, depth, by_state[state][4])]
        have = compose_maps(have, tuple(x[:4] for x in by_state))
        at += len(part)
    reason = _unbalanced(have[CODE])
    if reason is None:
        bounds.append(len(text))
        if not any(whole(text[a:b]) for a, b in zip(bounds, bounds[1:])):
            return None, len(parts)
        reason = "statement"
    return (reason if whole(text) else None), len(parts)


def _unbalanced(summary: tuple[int, str, str, bool]) -> str | None:
    return "string" if summary[0] != CODE else "brackets" if summary[1] or summary[2] or summary[3] else None


def _opens(chunk: str) -> bool:
    """Whether a chunk that begins in code and outside brackets begins a statement."""
    return bool(_BEGINS.match(chunk))


def _verdicts(size: int, limit: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        warnings.simplefilter("ignore")
        out = [("long", 0) if len(t) > limit else verdict(t, size=size) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32())], ["field", "id", "reason", "chunks"])

    return run


def chunks(text: str, size: int = CHUNK) -> list[str]:
    """*text* cut at line ends into pieces of about *size* characters."""
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while True:
            cut = text.find("\n", cut) + 1
            if not cut:
                return [*out, text[at:]]
            before = text[:cut - 1].rstrip("\r") if cut < 3 else text[cut - 3 : cut - 1].rstrip("\r")
            if not before.endswith("\\"):
                break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def _cut(size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(f, i, n, t) for f, i, text in zip(*(batch.column(c).to_pylist() for c in range(3))) for n, t in enumerate(chunks(text, size))]
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.string()))], ["field", "id", "n", "text"])

    return run


_MAP = "array<struct<state int, closers string, openers string, bad boolean>>"
_NAMES = ("state", "closers", "openers", "bad")
_ARROW_MAP = pa.list_(pa.struct([("state", pa.int32()), ("closers", pa.string()), ("openers", pa.string()), ("bad", pa.bool_())]))


def _listed(m: Map) -> list[dict]:
    return [dict(zip(_NAMES, x)) for x in m]


def _tuples(m: list[dict]) -> Map:
    return tuple(tuple(x[k] for k in _NAMES) for x in m)


def _summaries(batch: pa.RecordBatch) -> pa.RecordBatch:
    maps = [_listed(tuple(scan(t, s)[:4] for s in (CODE, SINGLE3, DOUBLE3))) for t in batch.column(3).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(maps, _ARROW_MAP)], ["field", "id", "n", "map"])


def _up(table: pa.Table) -> pa.Table:
    """The map of FAN neighbours."""
    have = IDENTITY
    for _, m in sorted(zip(table["n"].to_pylist(), table["map"].to_pylist()), key=lambda x: x[0]):
        have = compose_maps(have, _tuples(m))
    return pa.table({"field": table["field"][:1], "id": table["id"][:1], "n": pa.array([table["n"][0].as_py() // FAN], pa.int32()), "map": pa.array([_listed(have)], _ARROW_MAP)})


def _down(table: pa.Table, above: pa.Table) -> pa.Table:
    """The prefix before each of FAN neighbours, from the one before them all."""
    have = _tuples(above["before"][0].as_py()) if above.num_rows else IDENTITY
    ns, out = [], []
    for n, m in sorted(zip(table["n"].to_pylist(), table["map"].to_pylist()), key=lambda x: x[0]):
        ns.append(n)
        out.append(_listed(have))
        have = compose_maps(have, _tuples(m))
    return pa.table({"field": table["field"][: len(ns)], "id": table["id"][: len(ns)], "n": pa.array(ns, pa.int32()), "before": pa.array(out, _ARROW_MAP)})


def prefixes(scratch: Scratch, maps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((field, id, n, state, depth, closed), (field, id, why)): what precedes each chunk, and whether the file balances.

    *maps* is a written table (field, id, n, map).  Rounds grow with the logarithm of the longest file's chunks.
    """
    group = ["field", "id", (F.floor(F.col("n") / FAN)).cast("int").alias("block")]
    levels = [maps]
    while True:
        levels.append(scratch.table(levels[-1].groupBy(*group).applyInArrow(_up, f"field string, id long, n int, map {_MAP}"), "up"))
        if not levels[-1].where("n > 0").limit(1).count():
            break
    start = F.col("map")[CODE]
    why = F.when(start["state"] != CODE, "string").when((start["closers"] != "") | (start["openers"] != "") | start["bad"], "brackets")
    files = levels[-1].select("field", "id", why.alias("why"))
    before = scratch.spark.createDataFrame([], f"field string, id long, n int, before {_MAP}")
    for level in reversed(levels[:-1]):
        above = before.groupBy("field", "id", F.col("n").alias("block"))
        before = scratch.table(level.groupBy(*group).cogroup(above).applyInArrow(_down, f"field string, id long, n int, before {_MAP}"), "down")
    own = F.col("before")[CODE]
    return before.select("field", "id", "n", own["state"].alias("state"), F.length(own["openers"]).alias("depth"), (own["closers"] == "").alias("closed")), files


def _pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Statements of chunks: (piece, part): whole ones are judged here, the first and last part of a chunk are passed on."""
    warnings.simplefilter("ignore")
    rows = []
    for f, i, n, text, state, depth, first in zip(*(batch.column(c).to_pylist() for c in range(7))):
        starts = statement_starts(text, state, depth, scan(text, state)[4])
        if n and first:
            starts = [0, *starts]
        bounds = [0, *starts, len(text)] if not starts or starts[0] else [*starts, len(text)]
        parts = [text[a:b] for a, b in zip(bounds, bounds[1:])]
        opens = bool(starts) and starts[0] == 0
        for k, part in enumerate(parts):
            if 0 < k < len(parts) - 1:
                if refused(part):
                    rows.append((f, i, n, k, None, True))
            else:
                rows.append((f, i, n, k, part, opens or k > 0))
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_()))], ["field", "id", "n", "k", "part", "opens"])


def _stitch(table: pa.Table) -> pa.Table:
    """Statements that lie across chunks, joined from the chunks' ends; one row if any statement of the file is refused."""
    warnings.simplefilter("ignore")
    rows = sorted(zip(table["n"].to_pylist(), table["k"].to_pylist(), table["part"].to_pylist(), table["opens"].to_pylist()))
    bad, held = False, ""
    for _, _, part, opens in rows:
        if part is None:
            bad = True
        elif opens:
            bad = bad or bool(held.strip()) and refused(held)
            held = part
        else:
            held += part
    bad = bad or bool(held.strip()) and refused(held)
    return pa.table({"field": table["field"][:1], "id": table["id"][:1], "reason": pa.array(["statement" if bad else None], pa.string())})


def _confirm(batch: pa.RecordBatch) -> pa.RecordBatch:
    warnings.simplefilter("ignore")
    reasons = [r if refused(t) else None for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(reasons, pa.string())], ["field", "id", "reason"])


def judged(scratch: Scratch, rows: DataFrame, key: str, fields: list[str], chunk: int = CHUNK, limit: int = LONG) -> DataFrame:
    """(field, id, reason, chunks) of each text: why the parser refuses it (null if it doesn't), and the number of its
    chunks whose maps were composed.

    Rows with a null key and null, empty or blank texts are left out.
    """
    # One row per text: fields are unpivoted in the JVM, nothing is shuffled.
    named = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))
    texts = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.explode(named).alias("x")).select("x.field", "id", "x.text")
    texts = texts.where(F.col("text").isNotNull() & F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
    first = scratch.table(arrow_map(texts, _verdicts(chunk, limit), "field string, id long, reason string, chunks int"), "judged")
    if not first.where("reason = 'long'").limit(1).count():
        return first
    # Only if there are such files is the input read again, for their texts.
    long = texts.where(F.length("text") > limit)
    parts = scratch.table(arrow_map(long, _cut(chunk), "field string, id long, n int, text string").repartition("field", "id", "n"), "chunks")
    before, files = prefixes(scratch, scratch.table(arrow_map(parts, _summaries, f"field string, id long, n int, map {_MAP}"), "maps"))
    files = scratch.table(files.join(parts.groupBy("field", "id").agg(F.count("*").cast("int").alias("chunks")), ["field", "id"]), "files")
    placed = parts.join(before, ["field", "id", "n"]).join(files.where("why is null").select("field", "id"), ["field", "id"], "left_semi")
    # A chunk begins a statement if it begins in code, outside brackets, in column 0, and continues none.
    begins = (F.col("state") == CODE) & (F.col("depth") == 0) & F.col("closed") & F.col("text").rlike("^" + _BEGINS.pattern)
    pieces = arrow_map(placed.select("field", "id", "n", "text", "state", "depth", begins.alias("first")), _pieces, "field string, id long, n int, k int, part string, opens boolean")
    stitched = pieces.groupBy("field", "id").applyInArrow(_stitch, "field string, id long, reason string").where("reason is not null")
    doubtful = files.where("why is not null").select("field", "id", F.col("why").alias("reason")).unionByName(stitched)
    whole = long.join(scratch.table(doubtful, "doubtful"), ["field", "id"]).select("field", "id", "reason", "text")
    bad = scratch.table(arrow_map(whole, _confirm, "field string, id long, reason string").where("reason is not null"), "confirmed")
    return first.where("reason is null or reason <> 'long'").unionByName(files.join(bad, ["field", "id"], "left").select("field", "id", "reason", "chunks"))


def unparsable(scratch: Scratch, rows: DataFrame, key: str, fields: list[str], chunk: int = CHUNK, limit: int = LONG) -> DataFrame:
    """(field, id, reason) of each text that the parser refuses; reason is string, brackets or statement.

    Rows with a null key and null, empty or blank texts are no cases.
    """
    return judged(scratch, rows, key, fields, chunk, limit).where("reason is not null").select("field", "id", "reason")


def rates(scratch: Scratch, rows: DataFrame, key: str, fields: list[str], source: str) -> DataFrame:
    """(source, field_name, n_files, n_bad, bad_rate): rates of refused texts; a null or blank source is ``(none)``."""
    files = judged(scratch, rows.select(key, *fields), key, fields).select("id", "field", "reason")
    sources = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(F.nullif(F.trim(source), F.lit("")), F.lit("(none)")).alias("source"))
    out = files.join(sources, "id").groupBy("source", F.col("field").alias("field_name")).agg(F.count("*").alias("n_files"), F.count("reason").alias("n_bad"))
    return out.withColumn("bad_rate", F.round(F.col("n_bad") / F.col("n_files"), 6))
