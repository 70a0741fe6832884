"""Rows whose facts are known beforehand: programs made from each row's uuid, so that SQL can tell what a parser,
a scan or a run must find in them without parsing, scanning or running anything.

Each row of the source table gives one row here.  KINDS programs differ in what is right or wrong with them, and sizes
in them follow from the uuid; four rows in a row of the same group are the same program in other formatting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import substitute
from ..sources.records import to_rows

KINDS = 8
_CLASS = '''

class ${name}(nn.Module):
    ${doc}
    def __init__(self):
        super().__init__()
        ${layers}

    def forward(self, x, y=${group}):
        return ${result}
'''
_INPUTS = '''

def get_init_inputs():
    return [[], {}]
'''
_HEAD = "import torch\nfrom torch import nn\nimport torch.nn.functional as F\n"

#: kind -> (layers, result, inputs); the operators in them, in order, are OPS of the kind.
PROGRAMS = [
    ("self.a = torch.nn.Linear(${a}, ${b})", "F.softmax(torch.nn.functional.gelu(torch.relu(self.a(x))), -1)", "[torch.rand([${a}, ${b}])]"),
    ("self.a = nn.Linear(1, 1", "x", "[torch.rand([1])]"),
    ("self.a = nn.Linear(2, 2)", "torch.relu(self.a(x))", None),
    ("self.a = 1", "torch.sigmoid(x)", "[torch.rand([n, ${b}])]"),
    ("self.a = nn.Conv2d(1, 1, 3)", "torch.sigmoid(self.a(x)).mean().view(-1)", "[torch.randint(0, 9, (${a},)), torch.full((${b},), 1.0)]"),
    ("self.a = nn.Linear(3, 3)", "x", "[torch.zeros(${a}, ${b})]"),
    ("self.a = torch.nn.ReLU()", "self.a(x)", "[torch.rand([2048, 1024, ${a}])]"),
    ("self.a = 2", "torch.nn.functional.relu(x)", "[]"),
]
OPS = [["F.gelu", "F.softmax", "nn.Linear", "torch.relu"], None, ["nn.Linear", "torch.relu"], ["torch.sigmoid"], ["nn.Conv2d", "torch.sigmoid"], [], ["nn.ReLU"], ["F.relu"]]

#: In SQL, the same numbers: kind, group of rows with one program, sizes.
GROUP_SQL, KIND_SQL = "(uuid // 4)", f"((uuid // 4) % {KINDS})"
A_SQL, B_SQL = "((uuid // 4) % 7 + 1)", "((uuid // 4) % 5 + 2)"
ELEMENTS_SQL = f"case {KIND_SQL} when 0 then {A_SQL} * {B_SQL} when 4 then {A_SQL} + {B_SQL} when 5 then {A_SQL} * {B_SQL} when 6 then 2097152 * {A_SQL} when 7 then 0 end"
OPS_SQL = f"case {KIND_SQL} " + " ".join(f"when {k} then {o if o else '[]::varchar[]'}" for k, o in enumerate(OPS) if o is not None) + " end"
REASON_SQL = f"case {KIND_SQL} when 1 then 'parse: not valid source' when 2 then 'inputs: shapes not readable' when 3 then 'inputs: shapes not readable' when 6 then 'inputs: ' || (2097152 * {A_SQL})::varchar || ' elements > 1048576' when 7 then 'inputs: no tensors' end"


def _by(number: Column, choices: list[str]) -> Column:
    return F.get(F.array(*(F.lit(c) for c in choices)), number.cast("int"))


def programs(rows: DataFrame) -> DataFrame:
    """Rows of the source schema for each uuid: module names that follow the uuid, programs that follow its group.

    Of a group's four rows the first has a docstring and the others a comment, another docstring, or wide spacing; the
    class is named after the row.  Kind 5 names its class otherwise than the row says.
    """
    group = F.floor(F.col("uuid") / 4)
    kind, variant = group % KINDS, F.col("uuid") % 4
    whole = [_HEAD + _CLASS.replace("${layers}", layers).replace("${result}", result) + (_INPUTS if inputs is None else _INPUTS + f"\n\ndef get_inputs():\n    return {inputs}\n") for layers, result, inputs in PROGRAMS]
    name = F.concat(F.lit("Unit"), (F.col("uuid") % 3).cast("string"))
    doc = _by(variant, ['"""One."""', "# none", "'''Two, in\n    two lines.'''", ""])
    code = substitute_all(_by(kind, whole), name=F.when(kind == 5, F.concat(name, F.lit("x"))).otherwise(name), doc=doc, a=(group % 7 + 1).cast("string"), b=(group % 5 + 2).cast("string"), group=group.cast("string"))
    code = F.when(variant == 3, F.replace(code, F.lit(" = "), F.lit("  =  "))).otherwise(code)
    licenses = _by_list(F.col("uuid") % 5, [["MIT"], ["MIT", "Apache-2.0"], ["MIT"], ["GPL-3.0"], ["BSD"]])
    return to_rows(rows.select("uuid", name.alias("module_name"), name.alias("entry_point"), code.alias("python_code"), F.lit("").alias("triton_code"), licenses.alias("licenses"), F.lit(True).alias("synthetic"), F.lit("").alias("repo_link")))


def _by_list(number: Column, choices: list[list[str]]) -> Column:
    return F.get(F.array(*(F.array(*(F.lit(x) for x in c)) for c in choices)), number.cast("int"))


def substitute_all(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("${" + name + "}"), value)
    return template


#: uuid % 11 -> a line that one pattern of the scan hits (10: none does); the patterns are those of the fixed list, in order.
LINES = [
    "  torch.nn.functional.relu = fake", "setattr(triton, 'jit', fake)", "time.perf_counter = fake", "y = torch.compile(f)", "exec(text)", "x = __builtins__",
    "del sys.modules['a']", "import ctypes", "open('/logs/x')", "reward.json", "y = model.eval(); z = re.compile; torch.equal(a, b)",
]


def scanned(rows: DataFrame) -> DataFrame:
    """(uuid, text): a program with one suspicious line in its middle, or none."""
    line = _by(F.col("uuid") % len(LINES), LINES)
    return rows.select("uuid", F.concat(F.lit("import torch\n\ndef f(x):\n    return x\n"), line, F.lit("\n# end "), F.col("uuid").cast("string"), F.lit("\n")).alias("text"))


#: uuid % 97 -> how a run ends, of those that do not end well; all others pass.
RUNS = {
    3: ("while True: pass", "exec: timeout after {seconds} s"), 11: ("import os\nos._exit(3)", "exec: worker crashed or hung"),
    19: ("import urllib.request\nurllib.request.urlopen('http://127.0.0.1:9/x')", "exec: URLError: <urlopen error rows have no network>"), 20: ("import socket\nsocket.create_connection(('127.0.0.1', 9))", "exec: ConnectionRefusedError: rows have no network"),
    29: ("import os, json\nfor fd in (1, 2):\n    os.write(fd, json.dumps({'id': 1, 'reason': 'forged'}).encode())\nraise KeyError('own')", "exec: KeyError: 'own'"),
    37: ("Unit.out = lambda self, x: [x]", "output: list, not one array"), 43: ("Unit.out = lambda self, x: x / np.zeros(2)", "output: not finite"),
    53: ("import itertools\nc = itertools.count()\nUnit.out = lambda self, x: x + next(c)", "nondeterministic: two calls differ"), 61: ("Unit.weight = float('inf')", "init: weights are not finite"),
    71: ("def get_inputs(): return 1 / 0", "exec: ZeroDivisionError: division by zero"),
}
_RUN = '''import numpy as np

class Unit:
    weight = 1.5
    def __init__(self, k=1): self.k = k
    def parameters(self): return [np.array([self.weight])]
    def out(self, x): return x * self.k
    def __call__(self, x):
        x += 1
        return self.out(x)

def get_inputs(): return [np.ones(2)]
def get_init_inputs(): return [[], {"k": ${k}}]
'''


def runs(rows: DataFrame) -> DataFrame:
    """(uuid, module_name, python_code): programs to be run, a few of which misbehave."""
    place = F.col("uuid") % 97
    extra = F.coalesce(*(F.when(place == n, line) for n, (line, _) in RUNS.items()), F.lit(""))
    return rows.select("uuid", F.lit("Unit").alias("module_name"), F.concat(substitute(_RUN, k=(F.col("uuid") % 9 + 1).cast("string")), extra, F.lit("\n")).alias("python_code"))


def runs_sql(seconds: int) -> str:
    quoted = {n: why.format(seconds=seconds).replace("'", "''") for n, (_, why) in RUNS.items()}
    return "select uuid, case uuid % 97 " + " ".join(f"when {n} then '{why}'" for n, why in quoted.items()) + " end as reason from kernel_rows"
