"""Hand-computed values of the operators, and their edge cases."""

import math
import warnings

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.functions import arrays, text
from corpusloom.functions.code import analyse, code_facts
from corpusloom.functions.fixed import GATES
from corpusloom.operators import aggregates, dedup, episodes, groups, rules, sampling, validation

BASE = '''import torch
from torch import nn


class Blend(nn.Module):
    """Leans from one input to the other."""

    lean = 0.25

    def forward(self, left, right):
        return torch.lerp(left, right, self.lean)


def get_init_inputs():
    return [[], {}]


def get_inputs():
    return [torch.zeros([3, 5, 2]), torch.ones(3, 5, 2)]
'''


# ---- code analysis

def shapes(body):
    return analyse(f"import torch\ndef get_inputs():\n    return {body}\n", "X")["shapes"]


def test_shapes():
    assert shapes("[torch.zeros([7, 3]), torch.empty(6, 1), torch.randint(2, 5, (8,))]") == [[7, 3], [6, 1], [8]]
    assert shapes("[torch.randn([k, 2])]") is None
    assert shapes("[torch.ones(2, k)]") is None
    assert shapes("[torch.rand(size=(4,))]") is None
    assert shapes("[torch.randint(0, 9, size=(4,))]") is None
    assert shapes("[torch.full((4,), 1.0)]") == [[4]]
    assert shapes("[torch.rand(())]") == [[]]
    assert shapes("[torch.rand(True, 2)]") == [[1, 2]]
    assert shapes("[torch.rand(1.5, 2)]") is None
    assert shapes("[torch.ones_like(x)]") == []
    assert shapes("[torch.rand([2]) for _ in range(4)]") == [[2]]
    assert analyse("x = 1", "X")["shapes"] is None


def test_source_and_structure_keys():
    key = lambda c, m="Blend": analyse(c, m)
    same = BASE.replace('    """Leans from one input to the other."""\n', "    # leans\n").replace("lean = 0.25", "lean   =   0.25")
    assert key(BASE)["source_key"] == key(same)["source_key"]
    assert key(BASE)["source_key"] != key(BASE.replace("0.25", "0.75"))["source_key"]
    assert key(BASE)["structure_key"] == key(BASE.replace("Blend", "Model"), "Model")["structure_key"]
    assert key(BASE, "Missing")["structure_key"] is None
    assert key("def broken(")["source_key"] == key("def broken(")["source_key"] != key("def broken((")["source_key"]
    quoted = BASE.replace('"""Leans from one input to the other."""', 'name = "Blend"')
    assert key(quoted)["structure_key"] != key(quoted.replace("Blend", "Model"), "Model")["structure_key"]


def test_operator_names():
    code = "import torch\nclass A:\n    def f(self, x):\n        torch.nn.functional.silu(x); nn.functional.silu(x); torch.nn.GELU(); x.mean(1)[0].abs(); (x or F).y(1); F.elu(x); torch.stack(x)\n"
    assert analyse(code, "A")["ops"] == ["F.elu", "F.silu", "nn.GELU", "nn.functional.silu", "torch.stack"]


def test_code_facts_rows(spark):
    warnings.simplefilter("ignore")
    df = spark.createDataFrame([(1, BASE), (2, None), (3, ""), (4, "def broken("), (5, BASE.replace("[3, 5, 2]", "[4096, 1024]")), (6, BASE.replace("[torch.zeros([3, 5, 2]), torch.ones(3, 5, 2)]", "[]"))], "id int, code string")
    f = df.withColumn("f", code_facts("code", F.lit("Blend"))).withColumn("reason", rules.first_reason(rules.parse_reason("f.parses"), rules.shapes_reason("f.shapes")))
    got = {r.id: (r.f.parses, r.reason) for r in f.collect()}
    assert got[1] == (True, None)
    assert got[2][1].startswith("parse:") and got[4][1].startswith("parse:")
    assert got[3] == (True, "inputs: shapes not readable")
    assert got[5][1] == "inputs: 4194334 elements > 1048576" and got[6][1] == "inputs: no tensors"


# ---- rules

def test_license_rule(spark):
    cases = [(["MIT"], None), (["MIT", "Apache-2.0"], None), (["MIT", "gpl-3.0"], "license: restricted gpl-3.0"), ([], "license: none listed"), (None, "license: none listed"), ([None], None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, licenses array<string>").withColumn("r", rules.license_reason())
    assert [r.r for r in df.orderBy("i").collect()] == [c[1] for c in cases]


def test_length_rule_and_first_reason(spark):
    df = spark.createDataFrame([(1, "x" + "\n" * 250), (2, "x"), (3, None)], "i int, t string")
    got = rules.decide(df, rules.length_reason("t"), F.when(F.col("i") == 1, "later")).orderBy("i").collect()
    assert [r.reason for r in got] == ["length: 251 lines > 200", None, None]
    assert {(r.category, r.n) for r in rules.reason_histogram(rules.decide(df, rules.length_reason("t"))).collect()} == {("length", 1), ("kept", 2)}


@pytest.mark.parametrize("source,reason", [
    ("torch.allclose = f", "assigns to a torch/triton attribute"), ("x\n  triton.a.b = 1", "assigns to a torch/triton attribute"), ("torch.x == 1", None),
    ("x: torch.Tensor = None", None), ("setattr(torch, 'a', 1)", "patches torch/triton with setattr"), ("time.time = f", "patches a timer"), ("torch.compile(f)", "uses torch.compile instead of writing kernels"),
    ("model.eval()", None), ("eval('1')", "runs hidden code"), ("éeval(1)", None), ("x=exec ('a')", "runs hidden code"), ("import builtins", "touches Python builtins"),
    ("sys.modules['a']", "swaps imported modules"), ("import socket", "uses processes, network or ctypes"), ("open('/tests/x')", "touches grader files"), ("\rtime.time = f", None), (None, None), ("", None),
])
def test_pattern_scan(spark, source, reason):
    import re

    from corpusloom.functions.fixed import SCAN_PATTERNS

    df = spark.createDataFrame([(source,)], "t string")
    assert df.select(rules.pattern_reason("t")).first()[0] == (reason if source != "\rtime.time = f" else next((r for p, r in SCAN_PATTERNS if re.search(p, source, re.M)), None))


# ---- text

def test_text(spark):
    df = spark.createDataFrame([("a\nb\n", "aXXaXXXa", 42, "SumAgg", "p/1/2", "oracle failed: x: y", "", "z")], "t string, o string, n bigint, m string, p string, r string, e string, z string")
    r = df.select(
        text.line_count("t"), text.occurrences("o", "XX"), text.record_name("n", "m"), text.record_name(F.lit(1234567), "m"), text.replace_first("p", "/", "-"), text.category("r"),
        text.first_filled("e", "z"), text.unwrap(text.wrap("t")), text.head_lines(F.lit("  a\nb\nc \n"), 2), text.substitute("${x}-${y}", x="m", y="z")).first()
    assert list(r) == [3, 2, "task-00042-sumagg", "task-1234567-sumagg", "p-1/2", "oracle failed", "z", "a\nb\n", "a\nb", "SumAgg-z"]


def test_unwrap_uses_first_and_last_marker(spark):
    inner = "a\nSOLUTION_EOF\nb <<'SOLUTION_EOF'\nc"
    assert spark.createDataFrame([(inner,)], "t string").select(text.unwrap(text.wrap("t"))).first()[0] == inner


def test_record_number(spark):
    df = spark.createDataFrame([("Name-00042-x",), (" NAME/00007-x 2",), ("none",), (None,)], "t string")
    assert [(r[0], r[1]) for r in df.select(text.record_number("t"), text.tidy_record_name("t")).collect()] == [(42, "name-00042-x"), (7, "name-00007-x"), (None, "none"), (None, None)]


def test_hash_bucket(spark):
    import hashlib

    names = [f"name{i}" for i in range(200)] + ["", "é"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "t string").select(text.hash_bucket("t", 10)).collect()]
    assert got == [int(hashlib.sha256(n.encode()).hexdigest(), 16) % 10 for n in names]


# ---- arrays

def test_arrays(spark):
    df = spark.sql("select array(array(4L, 4L), array(), array(2L, 3L)) s, map('a', named_struct('score', 0.5D, 'weight', 2D), 'b', null) r, map_from_arrays(array(), array()) e, array(1D, 2D) x, array(1.00001D, 2D) y, array(double('nan'), 2D) z, array(1D) w")
    r = df.select(arrays.elements("s"), arrays.weighted_sum("r"), arrays.all_close("x", "y"), arrays.all_close("x", "z"), arrays.all_close("z", "z"), arrays.all_close("x", "w"), F.round(arrays.max_abs_diff("x", "y"), 6)).first()
    assert list(r) == [23, 1.0, True, False, False, False, 1e-05]


def test_only_raises(spark):
    assert spark.sql("select array(7) a").select(arrays.only("a")).first()[0] == 7
    with pytest.raises(PySparkException):
        spark.sql("select array(7, 8) a").select(arrays.only("a")).collect()


# ---- de-duplication

def test_keep_lowest_and_counts(spark):
    df = spark.createDataFrame([(5, "a"), (3, "a"), (9, "b"), (1, None), (2, None)], "uuid int, k string")
    got = {r.uuid: r.r for r in dedup.keep_lowest(df, F.col("k"), "uuid").withColumn("r", dedup.duplicate_reason("uuid")).collect()}
    assert got == {5: "duplicate: same code as uuid 3", 3: None, 9: None, 1: None, 2: None}
    assert list(dedup.duplicate_counts(df, F.col("k"), "uuid").first()) == [5, 5, 4]
    assert list(dedup.duplicate_counts(df.limit(0), F.col("k"), "uuid").first()) == [0, 0, 0]


def test_key_sets(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    keys = dedup.key_union(spark.createDataFrame([("a",), (None,)], "x string"), spark.createDataFrame([("a",), ("c",)], "y string"))
    assert sorted(r.key for r in keys.collect()) == ["a", "c"]
    assert [r.id for r in dedup.in_keys(df, F.col("k"), keys).collect()] == [1]
    assert sorted(r.id for r in dedup.not_in_keys(df, F.col("k"), keys).collect()) == [2, 3]


# ---- aggregates

def test_nearest_rank(spark):
    def rank(values, qs=(0, 10, 50, 99, 100)):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        return {r.percent: r.value for r in aggregates.nearest_rank(df, ["v"], list(qs)).collect()}

    assert rank([1.0, 2.0, 3.0, 4.0])[50] == 3.0
    values = [float((i * 7919) % 1000) for i in range(500)] + [5.0] * 300
    got, ordered = rank(values), sorted(values)
    assert got == {q: ordered[min(len(ordered) - 1, int(q / 100 * len(ordered)))] for q in (0, 10, 50, 99, 100)}
    assert rank([1e300, 1.0, 2.0, 3.0])[50] == 3.0
    assert rank([7.0]) == dict.fromkeys((0, 10, 50, 99, 100), 7.0) and rank([]) == {}


def test_top_k_ties(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "a"), (4, "b"), (5, None)], "o int, v string")
    assert [(r.v, r.n) for r in aggregates.top_k(df, "v", "o", 3).collect()] == [("b", 2), ("c", 1), ("a", 1)]


def test_shares_of_nothing(spark):
    df = spark.createDataFrame([], "x boolean")
    assert [tuple(r) for r in aggregates.count_shares(df, x=F.col("x")).collect()] == [("x", 0, None)]
    df = spark.createDataFrame([(True,), (None,)], "x boolean")
    assert {tuple(r) for r in aggregates.checks_all(df, x=F.col("x")).collect()} == {("x", 1, 0.5), ("all", 1, 0.5)}


# ---- groups and losses

def test_advantages(spark):
    rewards = [1, 0, 0, 1, 0, 0, 0, 0, 1, 1, 1, 1]
    df = spark.createDataFrame([(i, float(r)) for i, r in enumerate(rewards)], "idx bigint, reward double").withColumn("g", groups.positional_group("idx", 4))
    plain = [r.advantage for r in groups.group_advantages(df, "g", "reward").orderBy("idx").collect()]
    assert plain[:8] == [0.5, -0.5, -0.5, 0.5, 0, 0, 0, 0]
    scaled = [r.advantage for r in groups.group_advantages(df, "g", "reward", True).orderBy("idx").collect()]
    assert scaled[:4] == pytest.approx([0.866, -0.866, -0.866, 0.866], abs=1e-4)
    assert [r.informative for r in groups.informative(df, "g", "reward").orderBy("idx").collect()] == [True] * 4 + [False] * 8
    alone = groups.group_advantages(df.limit(1), "g", "reward", True).first()
    assert alone.advantage is None
    held = spark.createDataFrame([(None, 1.0), (None, 0.0), ("g", 3.0)], "g string, reward double")
    assert sorted(r.advantage for r in groups.group_advantages(held, "g", "reward").collect()) == [-0.5, 0.0, 0.5]
    assert sorted(r.informative for r in groups.informative(held, "g", "reward").collect()) == [False, True, True]
    assert [r.group_id for r in groups.positional_groups(df.drop("g"), "idx", 4).orderBy("idx").collect()] == [i // 4 for i in range(12)]
    for wrong in (df.where("idx < 10"), df.where("idx > 3")):
        with pytest.raises(PySparkException):
            groups.positional_groups(wrong.drop("g"), "idx", 4).collect()


@pytest.mark.parametrize("ratio,adv,loss", [(1.5, 1.0, -1.28), (0.5, 1.0, -0.5), (0.5, -1.0, 0.8), (1.5, -1.0, 1.5)])
def test_clipping(spark, ratio, adv, loss):
    df = spark.createDataFrame([(math.log(ratio), 0.0, adv)], "new_logp double, old_logp double, advantage double")
    assert df.select(groups.token_loss()).first()[0] == pytest.approx(loss, abs=1e-6)


def test_losses(spark):
    rows = [(c, g, p, 5.0 if p >= n else 0.0, 0.0, 1.0 if p < n else 0.0, a) for c, g, n, a in ((0, 0, 100, 1.0), (1, 0, 10, 2.0), (2, 1, 10, 4.0)) for p in range(100)]
    df = spark.createDataFrame(rows, "completion_id int, group_id int, pos int, new_logp double, old_logp double, mask double, advantage double")
    want = {"token": -160 / 120, "sequence": -7 / 3, "prompt": -(120 / 110 + 4) / 2}
    for how, loss in want.items():
        assert groups.masked_loss(df, how).first().loss == pytest.approx(loss)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "new_logp", "old_logp", "mask"))).alias("t")
    wide = df.groupBy("completion_id", "group_id", "advantage").agg(ordered).select("*", "t.new_logp", "t.old_logp", "t.mask")
    for how, loss in want.items():
        assert groups.masked_loss_arrays(wide, how).first().loss == pytest.approx(loss)
    nan = df.withColumn("new_logp", F.when(F.col("mask") == 0, float("nan")).otherwise(F.col("new_logp")))
    assert groups.masked_loss(nan, "token").first().loss == pytest.approx(want["token"])
    assert groups.masked_loss(df.limit(0), "token").first().loss is None
    with pytest.raises(ValueError):
        groups.masked_loss(df, "other")


# ---- validation and gates

def test_two_sided(spark):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "task string")
    oracle = spark.createDataFrame([("a", 1.0, None, None), ("b", 0.0, "runs", "boom"), ("d", 1.0, None, None)], "task string, oracle double, failed_gate string, message string")
    nop = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("d", 1.0)], "task string, nop double")
    got = {r.task: (r.keep, r.reason) for r in validation.two_sided(tasks, oracle, nop).collect()}
    assert got == {"a": (True, None), "b": (False, "oracle failed at runs: boom"), "c": (False, "oracle failed at None: None"), "d": (False, "nop scored 1.0")}


def test_gate_funnel(spark):
    df = spark.createDataFrame([(None,), ("runs",), ("exists",), ("crash",)], "failed_gate string")
    got = {r.gate: (r.reached, r.passed) for r in validation.gate_funnel(df).collect()}
    assert got["exists"] == (3, 2) and got["runs"] == (2, 1) and got["correct"] == (1, 1)
    flags = spark.createDataFrame([(1,) * 7, (1, 1, 1, 1, 0, 0, 0), (None,) * 7], ", ".join(f"gate_{g} int" for g in GATES))
    assert [r.failed for r in validation.first_failure(flags).collect()] == [None, "runs", "crash"]


# ---- episodes

def episode(i, task, ok, score, stop=None, weight=1.0, scoring=130.0, rewards="map('solved', named_struct('score', {s}D, 'weight', {w}D))"):
    reward = rewards.format(s=score, w=weight)
    timing = f"named_struct('start_s', 100D, 'boot', named_struct('end_s', 105D), 'setup', named_struct('end_s', 110D), 'agent', named_struct('end_s', 120D), 'finalize', named_struct('end_s', 0D), 'scoring', named_struct('end_s', {scoring}D))"
    nodes = "array(named_struct('sampled', true), named_struct('sampled', cast(null as boolean)), named_struct('sampled', false))"
    stop = f"'{stop}'" if stop else "cast(null as string)"
    return f"select '{i}' episode_id, {str(ok).lower()} ok, 10L num_output_tokens, array(named_struct('task', named_struct('data', named_struct('name', '{task}')), 'rewards', {reward}, 'stop_condition', {stop}, 'nodes', {nodes}, 'timing', {timing})) traces"


def test_episodes(spark):
    empty = "cast(map() as map<string, struct<score: double, weight: double>>)"
    null_entry = "map('a', named_struct('score', 1D, 'weight', 1D), 'b', cast(null as struct<score: double, weight: double>))"
    parts = [episode(1, "m", True, 1.0), episode(2, "m", True, 0.0, "max_turns"), episode(2, "m", True, 0.0, "max_turns"), episode(3, "p", True, 1.0, rewards=null_entry), episode(4, "f", True, 0.0), episode(5, "e", False, 0.0, "sandbox_error", scoring=0.0, rewards=empty), episode(6, "m", False, 0.0)]
    s = episodes.summaries(spark.sql(" union all ".join(parts)))
    by = {r.episode_id: r for r in s.collect()}
    assert len(by) == 6 and by["1"].turns == 1 and by["1"].seconds == 30.0 and by["5"].seconds == 20.0 and by["5"].reward == 0.0 and by["3"].reward == 1.0
    tasks = episodes.attempts_by_task(s)
    got = {r.task: (r.attempts, r.passes, r.errors, r.pass_rate) for r in tasks.collect()}
    assert got == {"m": (2, 1, 1, 0.5), "p": (1, 1, 0, 1.0), "f": (1, 0, 0, 0.0)}
    assert list(episodes.pass_buckets(tasks).first()) == [1, 1, 1]
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "task string")
    assert [tuple(r) for r in episodes.trainable(tasks, names("m", "p", "f")).collect()] == [("m", 0.5, True)]
    assert [tuple(r) for r in episodes.trainable(tasks, names("m", "p")).collect()] == [("m", 0.5, False)]
    assert episodes.run_means(s).first().episodes == 6
    assert {(r.stop, r.n, r.errors) for r in episodes.stop_histogram(s).collect()} == {("(none)", 4, 1), ("max_turns", 1, 0), ("sandbox_error", 1, 1)}


# ---- sampling

def test_seeded_draw(spark):
    df = spark.range(200).withColumnRenamed("id", "uuid")
    ids = lambda d: sorted(r.uuid for r in d.collect())
    a = ids(sampling.seeded_draw(df, "uuid", 20, 0, [0]))
    assert a == ids(sampling.seeded_draw(df.repartition(7), "uuid", 20, 0, [0])) and len(a) == 21 and a[0] == 0
    assert a != ids(sampling.seeded_draw(df, "uuid", 20, 1, [0]))


def test_library_sample_and_positions(spark):
    import random

    ids_ = [i * 3 for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids_], "uuid long").repartition(7)
    assert {r.uuid: r.at for r in sampling.positions(df, "uuid", "at").collect()} == {x: k for k, x in enumerate(ids_)}
    got = sorted(r.uuid for r in sampling.library_sample(df, "uuid", 20, 0, [0]).collect())
    assert got == sorted([0, *random.Random(0).sample(ids_[1:], 20)])
