"""Operators for training data against brute force, exact round trips and labelled examples, with dirty rows."""

import ast
import collections
import itertools
import json
import random
import warnings

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import copies, encode, leak, linking, neardup, overlap, parsing, quality, splits
from corpusloom.llm._common import Scratch, pairs_within
from corpusloom.llm.canonical import canonical_words, words
from corpusloom.llm.components import connected_components
from corpusloom.llm.shingles import RUN, Batch, WordHashes
from corpusloom.llm.suffixes import common_prefix, sorted_runs

warnings.simplefilter("ignore")
SMALL = settings(max_examples=60, deadline=None)


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def frame(spark, rows, schema):
    """A table with further columns, of names that the operators use themselves."""
    df = spark.createDataFrame(rows, schema)
    return df.select("*", F.lit("x").alias("node"), F.lit(1).alias("n"), F.lit("y").alias("key"), F.lit("z").alias("bucket"), F.lit("w").alias("root"))


CODE = '''import torch
import torch.nn as nn
from torch.nn import functional as F


class Net{i}(nn.Module):
    """With {a} over {b}."""

    def __init__(self, w{a}=3, v=5):
        super().__init__()
        self.c{i} = nn.Conv2d(in_channels={a}, out_channels={b}, kernel_size=(3, {i}))
        self.t = {{"one": {a}, "two": [1, {b}], "three": f(x=1, y={i})}}

    def forward(self, x{b}):
        y{a} = torch.clamp(self.c{i}(x{b}), min={a}, max={b})
        z = x{b} * {a}.5 + y{a} / {b}
        return torch.where(z > {i}, y{a}, z{b})


def get_inputs():
    return [torch.rand([{a}, {b}])]
'''


def code(i):
    return CODE.format(i=i, a=i * 7 + 11, b=i * 13 + 5)


# ---- canonical form and copies

@pytest.mark.parametrize("a,b,same", [
    ("f(a=1, b=2)", "F( b = 2,\n a=1, )", True), ("f(1, a=1, b=(2, 3))", "f(1, b=(2, 3), a=1)", True), ("f(1, 2)", "f(2, 1)", False),
    ("def f(a=1, b=2): pass", "def f(b=2, a=1): pass", False), ("x = {'a': 1, 'b': g(c=1, d=2)}", 'x = {"b": g(d=2, c=1), "a": 1}', True), ("{a, b}", "{b, a}", False),
    ("[a, b]", "[b, a]", False), ("import a\nimport b\nx", "import b\nimport a\nx", True), ("import a\nx\nimport b", "import b\nx\nimport a", True), ("a = 1\nb = 2", "b = 2\na = 1", False),
    ("# f(b=1, a=2)", "# f(a=2, b=1)", False), ("'f(b=1, a=2)'", "'f(a=2, b=1)'", False), ("f(k=lambda a, b: a, c=1)", "f(c=1, k=lambda a, b: a)", True),
    ("return x", "return (X);", True), ("f(a==1, b=2, c=3)", "f(a==1, c=3, b=2)", True), ("class A(B, m=1, k=2): pass", "class A(B, k=2, m=1): pass", False),
    ("from a import (b,\n c)\nimport d", "import d\nfrom a import (b, c)", True), ("x[a:b, c:d]", "x[c:d, a:b]", False), ("f(a=1, b=2", "f(b=2, a=1", False), ("f((a=1, b=2)", "f((b=2, a=1)", False),
    ("g(x)(b=1, a=2)", "g(x)(a=2, b=1)", True), ("f(**k, a=1)", "f(a=1, **k)", False),
])
def test_canonical(a, b, same):
    assert (canonical_words(a) == canonical_words(b)) is same


@SMALL
@given(st.text(alphabet="ab1_=,:()[]{}'\"#\n\\ ;", max_size=60))
def test_canonical_keeps_all_words(t):
    assert sorted(canonical_words(t)) == sorted(words(t)) and canonical_words(t) == canonical_words(t.upper())


def brute_copies(rows):
    groups = collections.defaultdict(set)
    for i, t in rows:
        if i is not None and t and not t.isspace():
            groups[tuple(canonical_words(t))].add(i)
    return {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}


@pytest.mark.parametrize("capacity", [200, copies.CAPACITY])
def test_copies(spark, scratch, capacity):
    rows = [(i, code(i % 9)) for i in range(60)] + [(100 + i, code(3).replace("    ", "\t").upper()) for i in range(40)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, code(3)), (203, "###"), (204, "!"), (100, code(3).replace("    ", "\t").upper()), (205, "x" * 5000), (206, "X" * 5000)]
    df = frame(spark, rows, "uuid long, code string").repartition(5)
    got = {tuple(r) for r in copies.copy_pairs(scratch, df, "uuid", "code", "a", "b").collect()}
    assert got == brute_copies(rows)
    classes = {r.id: (r.class_id, r.copies) for r in copies.copy_classes(scratch, df, "uuid", "code", capacity).collect()}
    assert set(classes) == {i for i, t in rows if i is not None and t and not t.isspace()}
    assert classes[3][0] == 3 and classes[3][1] == 48 and classes[205] == (205, 2) and classes[203] == (203, 2)


def test_radix_buckets_split_hot_prefixes(spark, monkeypatch):
    rows = [bytearray(b"import torch " * 20 + str(i).encode()) for i in range(300)] + [bytearray(b"same" * 50)] * 400
    df = spark.createDataFrame([(r,) for r in rows], "canon binary")
    sized = copies.radix_buckets(df, 5000).groupBy("bucket").agg(F.sum(F.length("canon")).alias("b"), F.countDistinct("canon").alias("d")).collect()
    assert all(r.b <= 5000 or r.d == 1 for r in sized) and len(sized) > 3
    literal = {(bytes(r.canon), r.bucket) for r in copies.radix_buckets(df, 500).collect()}
    monkeypatch.setattr(copies, "LITERALS", 2)
    joined = copies.radix_buckets(df, 500)
    assert joined.columns == ["canon", "bucket"] and joined.count() == 700 and {(bytes(r.canon), r.bucket) for r in joined.collect()} == literal
    assert copies.radix_buckets(df.limit(0), 10).count() == 0


def test_pairs_within_blocks(spark, monkeypatch):
    from corpusloom.llm import _common

    monkeypatch.setattr(_common, "PAIR_BLOCK", 4)
    rows = [("g", i) for i in range(23)] + [("h", i) for i in range(2)] + [("s", 1), ("g", None)]
    got = [tuple(r) for r in pairs_within(spark.createDataFrame(rows, "g string, k long"), ["g"], "k", "a", "b").collect()]
    want = [("g", *p) for p in itertools.combinations(range(23), 2)] + [("h", 0, 1)]
    assert sorted(got) == sorted(want)


# ---- source that does not parse

def mutate(rng, t):
    at = rng.randrange(len(t))
    kind = rng.randrange(6)
    if kind == 0:
        return t[:at]
    if kind == 1:
        return t[:at] + t[at + rng.randrange(1, 4):]
    if kind == 2:
        return t[:at] + rng.choice("()[]{}'\":\\#\n\t =,@") + t[at:]
    if kind == 3:
        return t.replace("\n", rng.choice(["\r\n", "\r"]))
    if kind == 4:
        return t[:at] + "\n<<<<<<< HEAD\n" + t[at:]
    return t.replace("    ", "\t", 1)


EXTRA = ["", "x = f'{a!r:>{w}}' f\"{x['k']}\"\n", 'f"{x["a"]}"', "f'{x", "'''a\n'''", "'''a", '"""\n(\n"""', "x = (1,\n2)\n", "if a:\n  b\nelse:\n  c\n", "@d\ndef f(): pass\n", "try:\n a\nfinally:\n b\n", " x = 1", "x = 1\n  y = 2", "a = \\\n 1", "x\x00", "\x0cx = 1", "return 1", "f(a=1, a=1)", "def f(a, a): pass", "nonlocal x", "print 1", "x = 0777", "'\\N{bad}'", "b'é'", "lambda: (yield)", "(" * 300 + ")" * 300, "match x:\n case 1: pass\n", "# only\n", "x = 'a\\\nb'", "class A:\n\tdef f(self):\n        pass\n"]


def refuses(t):
    try:
        ast.parse(t)
        return False
    except Exception:
        return True


def test_verdicts_equal_the_parser():
    rng = random.Random(5)
    texts = EXTRA + [mutate(rng, code(i % 20)) for i in range(1500)]
    wrong = [t for t in texts if t.strip() and (parsing.verdict(t)[0] is not None) != refuses(t)]
    assert not wrong
    assert not [t for t in texts if t.strip() and (parsing.verdict(t, size=40)[0] is not None) != refuses(t)]
    assert sum(map(refuses, texts)) > 200


def test_long_and_deep_texts_end():
    texts = ["(" * 50_000 + "]" * 50_000, "".join(f"f(a{i}=" for i in range(20_000)) + ")" * 20_000, "it's " * 50_000, '\"\"\"a ' * 50_000 + "'''", "from " + "a." * 200_000, "ab+/" * 100_000]
    for t in texts:
        assert parsing.verdict(t)[0] is not None or not refuses(t[:1000])
        assert sorted(canonical_words(t)) == sorted(words(t))
        quality.text_kind(t)


@SMALL
@given(st.text(alphabet="a'\"()[]#\\\n{}:=", max_size=50), st.integers(1, 12))
def test_summaries_compose(t, size):
    parts = parsing.chunks(t, size)
    assert "".join(parts) == t
    maps = [tuple(parsing.scan(p, state)[:4] for state in (parsing.CODE, parsing.SINGLE3, parsing.DOUBLE3)) for p in parts]
    left = right = parsing.IDENTITY
    for m in maps:
        left = parsing.compose_maps(left, m)
    for m in reversed(maps):
        right = parsing.compose_maps(m, right)
    assert [x[:3] for x in left] == [x[:3] for x in right]  # in whatever order they are composed
    have = left[parsing.CODE]
    whole = parsing.scan(t)
    assert have[0] == whole[0]
    if not (have[3] or whole[3]):
        assert have[1:3] == whole[1:3]


def test_unparsable_over_chunks(spark, scratch, monkeypatch):
    rng = random.Random(9)
    rows = [(i, mutate(rng, code(i)), code(i) if i % 3 else code(i)[:-9]) for i in range(60)]
    rows += [(100, None, " "), (101, "", "\n\t"), (None, "x = (", "x"), (102, "\u00a0", "x")] + [(200 + i, t, None) for i, t in enumerate(EXTRA)] + [(300, "\n".join(code(i) for i in range(40)), "'''" + code(1))]
    df = frame(spark, rows, "uuid long, python_code string, triton_code string")
    want = {(f, r[0]) for r in rows for f, t in (("p", r[1]), ("t", r[2])) if r[0] is not None and t and not t.isspace() and refuses(t)}
    monkeypatch.setattr(parsing, "FAN", 4)
    for chunk, limit in ((parsing.CHUNK, parsing.LONG), (150, parsing.LONG), (150, 300)):
        judged = parsing.judged(scratch, df, "uuid", ["python_code", "triton_code"], chunk, limit).collect()
        got = {(r.field[0], r.id) for r in judged if r.reason}
        assert got == want, (chunk, limit)
        counts = {(r.field[0], r.id): r.chunks for r in judged}
        assert counts == {(f, r[0]): len(parsing.chunks(t, chunk)) for r in rows for f, t in (("p", r[1]), ("t", r[2])) if r[0] is not None and t and not t.isspace()}


def test_dotted_names_are_left_to_the_parser():
    run = "w." * 12_000 + "w"
    texts = [f'x = "{run}"\n', f"# {run}\nx = 1\n", "a." * 5500 + "a\n", f"from {run} import x\n", f"import b, {run} as c\n"]
    assert [parsing.verdict(t)[0] for t in texts] == [None] * 5
    assert all(parsing.verdict(t)[0] for t in (f"from {run}.if import x\n", f"from {run}.1a import x\n", f"from {run}\n", f"from {run}. import\n"))


def test_rates(spark, scratch):
    rows = [(1, "x = (", "a"), (2, "x", "a"), (3, "x", None), (4, "", "a"), (5, "(", " ")]
    got = {(r.source, r.n_files, r.n_bad, r.bad_rate) for r in parsing.rates(scratch, spark.createDataFrame(rows, "uuid long, c string, link string"), "uuid", ["c"], "link").collect()}
    assert got == {("a", 2, 1, 0.5), ("(none)", 2, 1, 0.5)}


# ---- components

@pytest.mark.parametrize("seed", range(3))
def test_components(spark, scratch, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2300)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r.v: r.root for r in connected_components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert connected_components(scratch, spark.createDataFrame([], "a long, b long")).count() == 0


# ---- near-duplicates and overlap

def runs(t, n=4):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_groups(rows):
    have = [(i, runs(t)) for i, t in rows if i is not None and runs(t)]
    parent = list(range(len(have)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(range(len(have)), 2):
        a, b = have[x][1], have[y][1]
        if len(a & b) / len(a | b) >= 0.6:
            parent[find(x)] = find(y)
    groups = collections.defaultdict(set)
    for k, (i, _) in enumerate(have):
        groups[find(k)].add(i)
    return {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}


def corpus(seed, n=150, giant=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = list(rng.choice(texts[-30:]))
            for _ in range(rng.randrange(0, 1 + len(w) // 14)):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[at : at + (kind != 1)] = [] if kind == 0 else [rng.choice(vocabulary)]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 160))]
        texts.append(w or ["one"])
    base = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(giant):
        texts.append(base[: 50 + k % 7] + [f"edit{k}"] + base[50 + k % 7 :])
    idiom = "def get inputs return torch rand four four".split()
    rows = [(i, " ".join(idiom + t)) for i, t in enumerate(texts)]
    return rows + [(9001, None), (9002, ""), (9003, "##"), (9004, "two words"), (9005, "Two, words!"), (9006, "other pair"), (None, rows[0][1]), (0, rows[0][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, scratch, seed):
    rows = corpus(seed)
    df = frame(spark, [(i, t, None) for i, t in rows], "uuid long, python_code string, triton_code string")
    got = {tuple(r) for r in neardup.near_duplicate_pairs(scratch, df, "uuid", ["python_code", "triton_code"], "a", "b").collect()}
    assert got == {("python_code", *p) for p in brute_groups(rows)}


def test_star_and_refused_links(spark, scratch, monkeypatch):
    """With buckets of more than two texts taken as large and every key as hot, groups stay the same."""
    rows = corpus(3, 80, 40)
    link = linking.link
    for settings_ in ({"small": 2}, {"small": 2, "hot": 1}):
        monkeypatch.setattr(neardup, "link", lambda *a, s=settings_: link(*a, **s))
        df = spark.createDataFrame([(i, t) for i, t in rows], "uuid long, c string")
        got = {tuple(r)[1:] for r in neardup.near_duplicate_pairs(scratch, df, "uuid", ["c"], "a", "b").collect()}
        assert got == brute_groups(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_cross_split_overlap(spark, scratch, seed):
    rows = corpus(seed)
    split = {i: ("train", "dev", "test", None)[i % 4] for i, _ in rows if i is not None}
    validation = [(f" Name/{i:05d}-x 2" if i % 3 else f"name-{i:05d}-x", s) for i, s in split.items()] + [("name-00001-x", None), ("none", "dev"), (None, "dev")]
    at = overlap.splits_of(spark.createDataFrame(validation, "task string, split_name string"))
    df = frame(spark, rows, "uuid long, python_code string")
    got = {tuple(r) for r in overlap.cross_split_pairs(scratch, df, "uuid", "python_code", at, "a", "b").collect()}
    want = set()
    for a, b in brute_groups(rows):
        x, y = split[a], split[b]
        if x and y and (x == "train") != (y == "train"):
            want.add((y if x == "train" else x, a, b))
    assert got == want and want
    cover = {r.id: r for r in overlap.coverage(scratch, df, "uuid", "python_code", at).collect()}
    assert all(0 <= r.covered <= r.words for r in cover.values())
    assert set(cover) == {i for i, t in rows if i is not None and words(t or "") and split[i] in ("dev", "test")}


def test_one_shared_key_is_enough(spark, scratch):
    """Two texts meet by one key, and by several whose neighbours in the order of keys are not shared."""
    def links(entries):
        df = spark.createDataFrame(entries, "key long, node long, size int")
        verify = linking.Jaccard(scratch, None, 4, 0.6)
        verify.__class__ = type("All", (linking.Jaccard,), {"__call__": lambda self, pairs: scratch.table(pairs.withColumn("ok", F.lit(True)), "all")})
        return {tuple(r) for r in linking.link(scratch, df, verify).collect()}

    # Keys 10 and 20 are shared by nodes 1 and 2, with keys between them that 3 and 4 hold too.
    apart = [(k, 1) for k in (10, 11, 12, 20)] + [(k, 2) for k in (10, 13, 14, 20)] + [(k, 3) for k in (11, 12)] + [(k, 4) for k in (13, 14)]
    assert (1, 2) in links([(k, n, 10) for k, n in apart])


def test_hot_keys_lose_no_pair(spark, scratch, monkeypatch):
    """Pairs that share hot keys only: a common head is in far more texts than a hot key needs."""
    rng = random.Random(11)
    head = [f"h{i}" for i in range(40)]
    texts = []
    for k in range(90):
        tail = [f"t{k}x{i}" for i in range(45)]
        texts += [" ".join(head + tail)]
        if k < 8:
            texts += [" ".join(head + tail[:9] + [f"e{k}"] + tail[10:33] + [f"e{k}b"] + tail[34:])]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "uuid long, c string")
    calls, link = [], neardup.link

    def one_key(scratch, entries, verify):
        calls.append(1)
        return link(scratch, entries.select(F.lit(7).cast("long").alias("key"), "node", "size").distinct(), verify)

    monkeypatch.setattr(neardup, "link", one_key)
    got = {tuple(r)[1:] for r in neardup.near_duplicate_pairs(scratch, df, "uuid", ["c"], "a", "b").collect()}
    want = brute_groups(list(enumerate(texts)))
    assert calls and got == want and want


def test_edited_family_of_idioms(spark, scratch):
    """Members of a large family with a word edited in every 18 share no run of 24 words."""
    base = [f"b{i}" for i in range(144)]
    rows = []
    for k in range(80):
        w = list(base)
        for at in range(k % 18 if k < 2 else 9, 144, 18):
            w[at] = f"e{k}x{at}"
        rows.append((k, " ".join(w)))
    got = {(r.id, r.root) for r in overlap.overlap_groups(scratch, spark.createDataFrame(rows, "uuid long, c string"), "uuid", "c").collect()}
    groups = collections.defaultdict(set)
    for i, root in got:
        groups[root].add(i)
    assert {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)} == brute_groups(rows) != set()


def _by_key(rows):
    out = collections.defaultdict(set)
    for r in rows:
        out[r.key].add(r.node)
    return out


def test_sorted_runs(spark, scratch, monkeypatch):
    """Runs that go on over many partitions, hot keys among them, and tables that are taken in small steps."""
    from corpusloom.llm import suffixes

    rng = random.Random(1)
    rows = [(rng.choice([rng.randrange(500), 7, 8]), rng.randrange(300), 5) for _ in range(3000)]
    by = collections.defaultdict(set)
    for k, n, _ in rows:
        by[k].add(n)
    want = {(k, n): (len(v), min(v), 5) for k, v in by.items() if len(v) > 1 for n in v}
    df = spark.createDataFrame(rows, "key long, node long, size int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [((r.key, r.node), (r.n, r.hub, r.hub_size)) for r in sorted_runs(scratch, df).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(want) and dict(got) == want
    # Pairs of small runs come out at once, those of the others and of runs in several tasks as entries.
    pairs, live = sorted_runs(scratch, df, small=4)
    pairs = {(r.node, r.node_b) for r in pairs.collect()}
    pairs |= {(a, b) for ns in _by_key(live.collect()).values() for a, b in itertools.combinations(sorted(ns), 2)}
    assert pairs == {(a, b) for ns in by.values() for a, b in itertools.combinations(sorted(ns), 2)}
    # In one task, step by step: what a step leaves over is taken up by the next.
    monkeypatch.setattr(suffixes, "STEP", 1)
    walk = suffixes._walk(None, False)
    ordered = sorted(rows)
    batches = [pa.RecordBatch.from_pylist([dict(zip(("key", "node", "size"), r)) for r in ordered[i : i + 100]], pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int32())])) for i in range(0, len(ordered), 100)]
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    out = [r for b in walk(iter(batches)) for r in b.to_pylist()]
    assert {(r["key"], r["node"]): (r["n"], r["hub"], 5) for r in out if r["n"] > 1} == want
    assert [r["edge"] for r in out].count(True) >= 1


def test_common_prefix_and_order_of_suffixes(spark, scratch):
    keys = np.frombuffer(b"aabbaabcabbb", np.uint8).reshape(3, 4)
    assert common_prefix(keys).tolist() == [0, 3, 1]
    # Minimizers: texts that share SPAN + WINDOW - 1 words share a kept place within them.
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(overlap.SPAN + overlap.WINDOW - 1)]
    for _ in range(50):
        held = []
        for _ in range(2):
            w = [f"x{rng.random()}" for _ in range(rng.randrange(40))] + shared + [f"y{rng.random()}" for _ in range(rng.randrange(40))]
            at = w.index("s0")
            b = Batch.of_texts([" ".join(w).replace(".", "")], WordHashes(), RUN)
            runs_, begins = b.grams(RUN)
            places = overlap.minimizers(runs_, begins, b.ends - b.starts - RUN + 1)
            held.append({int(p) - at for p in places if at <= p <= at + overlap.WINDOW - 1})
        assert held[0] & held[1]


def test_short_texts_meet(spark, scratch):
    """Seven words against the same seven and one more: a similarity of 0.8."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "p q r s"), (4, "p q r s t"), (5, "u v"), (6, "z a b c d e f g h i j k l m n o p q")]
    got = {r.id: r.root for r in overlap.overlap_groups(scratch, spark.createDataFrame(rows, "uuid long, c string"), "uuid", "c").collect()}
    assert got[1] == got[2] and got[3] != got[4] and len({*got.values()}) == 5


def test_pairs_at_the_threshold_within_large_families(spark, scratch):
    """Recall of pairs planted at a similarity of 0.60 to 0.70 whose texts share a head with a large family."""
    rng, rows, planted = random.Random(17), [], 0
    heads = [[f"f{f}h{i}" for i in range(30)] for f in range(3)]
    for k in range(330):
        head = heads[k % 3]
        tail = [f"t{k}x{i}" for i in range(rng.randrange(60, 160))]
        rows.append((2 * k, " ".join(head + tail)))
        for edits in range(1, 60):
            w = list(tail)
            for at in random.Random(k).sample(range(len(w)), min(edits, len(w))):
                w[at] = f"e{k}x{at}"
            a, b = runs(" ".join(head + tail)), runs(" ".join(head + w))
            likeness = len(a & b) / len(a | b)
            if likeness < 0.70:
                break
        if likeness >= 0.60:
            planted += 1
            rows.append((2 * k + 1, " ".join(head + w)))
    want = brute_groups(rows)
    assert planted > 200 and len(want) >= planted
    df = spark.createDataFrame(rows, "uuid long, c string").repartition(8)
    found = {tuple(r)[1:] for r in neardup.near_duplicate_pairs(scratch, df, "uuid", ["c"], "a", "b").collect()}
    spans = collections.defaultdict(list)
    for r in overlap.overlap_groups(scratch, df, "uuid", "c").collect():
        spans[r.root].append(r.id)
    spanned = {p for g in spans.values() for p in itertools.combinations(sorted(g), 2)}
    print("recall of variants and of spans:", len(found & want) / len(want), len(spanned & want) / len(want))
    assert found <= want and spanned <= want
    assert len(found) >= 0.995 * len(want) and len(spanned) >= 0.995 * len(want)


def test_coverage_takes_all_places(spark, scratch):
    rng = random.Random(5)
    w = [f"w{rng.randrange(10**6)}" for _ in range(500)]
    other = [f"o{i}" for i in range(300)]
    rows = [(1, " ".join(w)), (2, " ".join(w)), (3, " ".join(w[:100])), (4, " ".join(other[:150] + w[200:208] + other[150:])), (5, "none of these")]
    at = spark.createDataFrame([(1, "train")] + [(i, "dev") for i in (2, 3, 4, 5)], "id long, split_name string")
    got = {r.id: (r.words, r.covered, r.share) for r in overlap.coverage(scratch, spark.createDataFrame(rows, "uuid long, c string"), "uuid", "c", at).collect()}
    assert {i: got[i] for i in (2, 3, 4)} == {2: (500, 500, 1.0), 3: (100, 100, 1.0), 4: (308, 8, round(8 / 308, 6))} and got[5][1] == 0


def test_empty_tables(spark, scratch):
    df = spark.createDataFrame([], "uuid long, python_code string, module_name string")
    at = spark.createDataFrame([], "id long, split_name string")
    assert copies.copy_pairs(scratch, df, "uuid", "python_code", "a", "b").count() == 0
    assert parsing.unparsable(scratch, df, "uuid", ["python_code"]).count() == 0
    assert neardup.near_duplicate_pairs(scratch, df, "uuid", ["python_code"], "a", "b").count() == 0
    assert overlap.cross_split_pairs(scratch, df, "uuid", "python_code", at, "a", "b").count() == 0
    assert overlap.coverage(scratch, df, "uuid", "python_code", at).count() == 0
    assert splits.torn_modules(scratch, df, "uuid", "module_name", at).count() == 0
    assert splits.assign_splits(scratch, df, "uuid", ["module_name"]).count() == 0
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert encode.encode(scratch, docs, "doc_id", "text").count() == 0
    assert leak.passages(scratch, docs, "doc_id", items, "item_id", "text").count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "doc_id long, text string")
    assert leak.passages(scratch, some, "doc_id", items, "item_id", "text").count() == 0
    assert leak.proximity(scratch, some, "doc_id", items, "item_id", "text").count() == 0
    assert quality.kinds(docs, "doc_id", "text").count() == 0


# ---- splits

@SMALL
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 5), max_size=6), st.integers(0, 120))
def test_subset_is_closest(sizes, target):
    flat = [s for s, n in sizes.items() for _ in range(n)]
    sums = {0}
    for s in flat:
        sums |= {x + s for x in sums}
    chosen = splits._subset(sizes, target)
    assert all(n <= sizes[s] for s, n in chosen.items())
    goal = max(0, min(target, sum(flat)))
    assert abs(sum(s * n for s, n in chosen.items()) - goal) == min(abs(x - goal) for x in sums)


def test_assign_splits(spark, scratch):
    rng = random.Random(1)
    rows = [(i, f"m{rng.randrange(60)}" if i % 3 else f"rare{i}", None if i % 5 else f"a{i % 40}") for i in range(1000)] + [(5000 + i, "hot", None) for i in range(300)] + [(None, "hot", "a"), (9000, None, None)]
    df = frame(spark, rows, "uuid long, module string, author string")
    got = {r.id: r for r in splits.assign_splits(scratch, df, "uuid", ["module"]).collect()}
    assert len(got) == 1301
    counts = collections.Counter(r.split for r in got.values())
    assert counts["validation"] == 130 and counts["test"] == 130
    by = collections.defaultdict(set)
    for i, m, _ in rows:
        if i is not None and m is not None:
            by[m].add(got[i].split)
    assert all(len(s) == 1 for s in by.values())
    both = splits.related(scratch, df, "uuid", ["module", "author"]).collect()
    component = {r.id: r.component for r in both}
    for col in (1, 2):
        seen = {}
        for r in rows:
            if r[0] is not None and r[col] is not None:
                assert seen.setdefault(r[col], component[r[0]]) == component[r[0]]


def test_torn_modules(spark, scratch):
    rows = [(1, " Net\t"), (2, "NET"), (3, "net"), (4, "other"), (5, "Other "), (6, None), (7, "\u00a0net"), (None, "net"), (1, " Net\t")]
    at = spark.createDataFrame([(1, "train"), (2, "dev"), (4, "train"), (5, "train"), (6, "dev"), (7, "train")], "id long, split_name string")
    got = sorted(tuple(r) for r in splits.torn_modules(scratch, frame(spark, rows, "uuid long, module_name string"), "uuid", "module_name", at).collect())
    assert got == [("net", 1), ("net", 2), ("net", 7)]


# ---- encoding

TEXTS = [None, "", " ", "  a", "a  \n\n b", "<|endoftext|> it's they'RE 12 345\t\t--- é ёлка 𝒳 \u200b\u00a0x\x1c\x85\ufeff", "def f(x):\r\n    return x  ", "a" * 5000, "\n" * 300 + " x", "   ", "naïve café — 中文字符 テスト 🙂🙃"]


@pytest.mark.parametrize("chunk", [1, 60, encode.CHUNK])
def test_encode(spark, scratch, chunk):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "x y"), (50, "it's a test " * 200)]
    df = frame(spark, rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r.id, tuple(r.ids)) for r in encode.encode(scratch, df, "doc_id", "text", chunk=chunk).collect())
    assert got == collections.Counter((i, tuple(t.encode(x, add_special_tokens=False).ids) if x else ()) for i, x in rows)


def test_decode(spark, scratch):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "doc_id long, text string")
    ids = encode.encode(scratch, df, "doc_id", "text")
    got = {r.id: r.text for r in encode.decode(ids, encode.vocabulary_table(spark)).collect()}
    assert got == {i: x or "" for i, x in enumerate(TEXTS)}
    assert all(r.same for r in encode.round_trip(scratch, df, "doc_id", "text").collect())


# ---- leaks

@pytest.mark.parametrize("limit", [leak.VOCABULARY, 0])
def test_passages(spark, scratch, monkeypatch, limit):
    monkeypatch.setattr(leak, "VOCABULARY", limit)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 30
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60)))) for i in range(15)] + [(20, None), (21, ""), (None, "w1 " * 20), (3, None)]
    docs = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        source = (items[rng.randrange(15)][1] or "").split()
        at, n = rng.randrange(len(source)), rng.randrange(6, 30)
        w[len(w) // 2 : len(w) // 2] = source[at : at + n] * rng.randrange(0, 3)
        docs.append((i, ", ".join(w).upper()))
    docs += [(500, None), (501, ""), (None, items[0][1]), (0, docs[0][1])]
    grams = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 11):
            if i is not None:
                grams[tuple(w[k : k + 12])].add(i)
    want = {(d, i) for d, t in docs if d is not None for k in range(len(words(t)) - 11) for i in grams.get(tuple(words(t)[k : k + 12]), ())}
    found = leak.passages(scratch, frame(spark, docs, "doc_id long, text string"), "doc_id", frame(spark, items, "item_id long, text string"), "item_id", "text").collect()
    assert {(r.id, r.item) for r in found} == want and want
    assert all(r.length >= 12 for r in found)


def test_proximity(spark, scratch):
    item = " ".join(f"t{i}" for i in range(40))
    w = item.split()
    docs = [(1, " ".join(w[20:] + w[:20])), (2, " ".join(w[:10]) + " x" * 300 + " ".join(w[10:20])), (3, "x " * 50 + " ".join(w)), (4, None)]
    got = {r.id: r.share for r in leak.proximity(scratch, spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", spark.createDataFrame([(9, item)], "item_id long, text string"), "item_id", "text").collect()}
    assert set(got) == {1, 3} and got[3] == 1.0


def test_proximity_takes_every_stretch(spark, scratch):
    w = [f"t{i}" for i in range(103)]
    item = " ".join(w)
    docs = []
    for shift in (0, 10, 55):
        text = [f"x{i}" for i in range(400)]
        text[90 + shift : 90 + shift + 28] = w[:28]
        text[230 + shift : 230 + shift + 28] = w[60:88]
        docs.append((shift, " ".join(text)))
    docs.append((99, " ".join(w[:28] * 3)))
    got = {r.id: (r.terms, r.share) for r in leak.proximity(scratch, spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", spark.createDataFrame([(9, item)], "item_id long, text string"), "item_id", "text").collect()}
    assert got == {i: (50, 0.5) for i in (0, 10, 55)}


# ---- quality

LIST = "\n".join(f"- {a} {b}" for a, b in zip("harbour window candle market forest kitchen bottle garden teacher station".split() * 3, "one two three four five six seven eight nine ten".split() * 3))
TABLE = "\n".join("| " + " | ".join(f"{i * j * 1.37:.2f}" for j in range(1, 6)) + " |" for i in range(1, 20))
CSV = "\n".join(",".join(f"{i * j}" for j in range(3, 9)) for i in range(3, 30))
WIDE = "\n".join("".join(f"{i * j * 1.37:>14.3f}" for j in range(1, 6)) for i in range(1, 20))
PROSE = "When the season is heavy, you can see how the weight replaces it over time. " * 6
JUNK = "\n".join("Zm9vYmFyYmF6cXV4" * 5 for _ in range(6))


@pytest.mark.parametrize("text,kind", [
    (LIST, "list"), (TABLE, "table"), (CSV, "table"), (WIDE, "table"), (CSV.replace(",", "\t"), "table"), (PROSE, None), (code(1) + code(2), None), (JUNK, "junk"), ("=" * 400, "junk"),
    ("\n".join("xkcd qwrt zxcvb plmkn grtfd vbnhj" for _ in range(12)), "junk"), (LIST + "\n\n" + PROSE * 3, None), ("```text\n" + TABLE + "\n```\n\n" + PROSE[:80], "table"),
    (LIST[:150], None), (None, None), ("", None), (" " * 1000, None), ("# %% [markdown]\n" + "\n".join("# " + x for x in LIST.split("\n")), "list"),
    ("\n".join(f"({c}) lorem market / ipsum;" for c in "abcdefghijklmnopqrs"), "list"),
])
def test_text_kind(text, kind):
    assert quality.text_kind(text) == kind


def test_kinds_and_long_text(spark):
    rows = [(1, LIST), (2, None), (3, PROSE * 2000), (4, TABLE * 300), (None, LIST), (1, LIST)]
    got = sorted((r.id, r.text_kind) for r in quality.kinds(frame(spark, rows, "doc_id long, text string"), "doc_id", "text").collect())
    assert got == [(1, "list"), (1, "list"), (4, "table")]


def test_statistics(spark):
    common = spark.createDataFrame([("en", "the"), ("en", "is"), ("de", None), ("fr", "the")], "lang string, word string")
    df = frame(spark, [(1, "The cat is\nhere!\n\n"), (2, None), (3, " \n"), (4, "!!")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in quality.statistics(df, "doc_id", "text", common).collect()}
    assert got == {1: (4, 3.0, 0.076923, 0.5, 0.5), 2: (0, None, None, None, None), 3: (0, None, None, None, None), 4: (0, None, 1.0, 1.0, None)}


def test_autocorrelation_and_period():
    assert quality.autocorrelation([5, 5, 5, 5]) == 1.0 and quality.autocorrelation([1, 9, 1, 9, 1, 9]) < -0.5 and quality.autocorrelation([1]) == 0.0
    assert quality.indent_period(["a", "  b", "    c"]) == 1.0 and quality.indent_period(["a", "  b", "   c"]) == 1.0
    # One line indented by a single blank doesn't make the step of the others; a regular nesting is a period.
    assert quality.indent_period(["a", "    b", "a", "    c", "a", "   d"]) < 1.0
    assert quality.rhythm([4, 9, 30] * 20) > 0.9 > quality.rhythm([4, 9, 30, 7, 22, 15, 3, 28])


def test_fitted_weights(spark):
    """The fit leaves the structure's decisions on clear texts, follows labels, and without labels is the prior."""
    clear = [(LIST, "list"), (TABLE, " Table "), (JUNK, "junk"), (PROSE, "prose")]
    docs = [(10 * k + i, t) for k in range(8) for i, (t, _) in enumerate(clear)] + [(900, None), (901, ""), (None, LIST)]
    labels = [(10 * k + i, n) for k in range(8) for i, (_, n) in enumerate(clear)] + [(1, "list"), (2, None), (900, "list"), (None, "junk"), (555, "list")]
    d, n = frame(spark, docs, "doc_id long, text string"), frame(spark, labels, "doc_id long, text_kind string")
    weights = quality.fitted(d, "doc_id", "text", n, "doc_id", "text_kind")
    assert weights.shape == quality.PRIOR.shape and (weights != quality.PRIOR).any()
    assert [quality.text_kind(t, weights) for t, _ in clear] == ["list", "table", "junk", None]
    assert (quality.fitted(d, "doc_id", "text", n.limit(0), "doc_id", "text_kind") == quality.PRIOR).all()
    # Labels enough against a finding outweigh it.
    x = np.array([quality.features(LIST.split("\n"))[0]] * 5000)
    assert int(np.argmax(x[0] @ quality.fit(x, np.full(5000, 3)))) == 3 and int(np.argmax(x[0] @ quality.PRIOR)) == 0


def test_json_notebooks_in_any_order():
    cells = [{"cell_type": "markdown", "source": LIST.splitlines(keepends=True)}]
    for text in (json.dumps({"cells": cells, "metadata": {"k": "v" * 400}}), json.dumps({"metadata": {"k": "v" * 400}, "cells": cells})):
        assert quality.text_kind(text) == "list"
    quality.text_kind('{"cells": [' * 3000)


def test_runs_of_few_texts_are_known_as_frequent(spark, scratch, monkeypatch):
    """However many texts there are: heads that 20 texts of 400 share are no first runs of theirs, so they make no pairs."""
    monkeypatch.setattr(linking, "ORDER_TEXTS", 10)
    codes = lambda words: b"".join(w.to_bytes(4, "big") for w in words)
    texts = [("c", k, codes([*range(1 + k // 20 * 100, 41 + k // 20 * 100), *range(100_000 + 100 * k, 100_040 + 100 * k)])) for k in range(400)]
    table = scratch.table(spark.createDataFrame(texts, "field string, node long, codes binary"))
    first = linking.Jaccard(scratch, table, 4, 0.6).first_runs(scratch.table(table.select("node"))).groupBy("key").count()
    assert first.where("count > 1").count() == 0 and first.count() > 400 * 30


def test_near_duplicates_leave_no_large_table(spark, scratch):
    """What is as large as the texts is dropped as soon as the links are found."""
    from pathlib import Path

    rows = corpus(2, 80, 40)
    df = spark.createDataFrame([(i, t) for i, t in rows], "uuid long, c string")
    neardup.near_duplicate_groups(scratch, df, "uuid", ["c"]).collect()
    left = {p.name[3:] for p in Path(scratch.root.removeprefix("file:")).iterdir()}
    assert "members" in left and not left & {"coded", "texts", "signed", "runs", "pairs", "sorted", "sets"}
