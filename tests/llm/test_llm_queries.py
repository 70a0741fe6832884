"""The subpackage's queries against their SQL, against labels, and its separation from the rest."""

import collections
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from corpusloom.llm import encode, parsing, quality, queries
from corpusloom.llm.canonical import canonical_words, words

from .. import oracle
from .test_llm import brute_copies, refuses

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    oracle.same(queries.queries()[name](spark, sf_dir), oracle.connect(sf_dir), queries.oracle_sql()[name])


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.fixture
def run(spark, sf_dir):
    return lambda name: queries.queries()[name](spark, sf_dir).collect()


def full(t):
    return t is not None and bool(t) and not t.isspace()


def test_copies_against_brute_force(run, con):
    rows = con.execute("select uuid, python_code from kernel_rows").fetchall()
    pairs = brute_copies(rows)
    assert {tuple(r) for r in run("p1_found")} == pairs
    classes = collections.Counter(tuple(canonical_words(t)) for _, t in rows if full(t))
    assert sorted(r.n_copies for r in run("p1_copies")) == sorted(classes.values())


def test_parsing_against_the_parser(run, con):
    rows = [(f, u, t, link) for u, link, *texts in con.execute("select uuid, repo_link, python_code, triton_code from kernel_rows").fetchall() for f, t in zip(("python_code", "triton_code"), texts) if full(t)]
    bad = {(f, u) for f, u, t, _ in rows if refuses(t)}
    assert {tuple(r) for r in run("p2_found")} == bad
    rates = collections.defaultdict(lambda: [0, 0])
    for f, u, _, link in rows:
        rate = rates[(link or "").strip(" ") or "(none)", f]
        rate[0] += 1
        rate[1] += (f, u) in bad
    assert {(r.repo_link, r.field_name): [r.n_files, r.n_bad] for r in run("p2_rates")} == dict(rates)
    chunks = {r.field_name: r for r in run("p2_chunks")}
    for f, got in chunks.items():
        own = [len(parsing.chunks(t)) for g, _, t, _ in rows if g == f]
        assert (got.n_files, got.n_cut, got.n_chunks) == (len(own), sum(n > 1 for n in own), sum(own)) and got.n_cut


def test_splits_keep_modules_together(run, con):
    split = {r.uuid: r.split for r in run("p5_splits")}
    by = collections.defaultdict(set)
    for u, m in con.execute("select uuid, module_name from kernel_rows").fetchall():
        if m is not None:
            by[m.strip().lower()].add(split[u])
    assert all(len(s) == 1 for s in by.values())


def test_ids_against_the_library(run, con):
    encoding = encode._encoder(f"{encode.TOKENIZERS}/{encode.VOCABULARY}")
    want = {d: encoding.encode_ordinary(t or "") for d, t in con.execute("select doc_id, text from documents").fetchall()}
    assert {r.doc_id: list(r.ids) for r in run("p6_ids")} == want


def test_proximity_against_brute_force(run, con):
    runs_ = lambda t: [tuple(w[i : i + 4]) for w in [words(t)] for i in range(len(w) - 3)]
    items = {i: runs_(t) for i, t in con.execute("select item_id, text from benchmark where text is not null").fetchall()}
    where = collections.defaultdict(set)
    for i, terms in items.items():
        for t in terms:
            where[t].add(i)
    want = {}
    for d, text in con.execute("select doc_id, text from documents where text is not null").fetchall():
        hits = collections.defaultdict(list)
        for at, t in enumerate(runs_(text)):
            for i in where.get(t, ()):
                hits[i].append((at, t))
        for i, found in hits.items():
            size, total = len(items[i]), len(set(items[i]))
            best = max(len({t for q, t in found[k:] if q < p + 2 * size}) for k, (p, _) in enumerate(found))
            if best >= total / 2:
                want[d, i] = best
    assert {(r.doc_id, r.item_id): r.terms for r in run("p7_near")} == want


def test_found_kinds_are_those_of_the_texts(run, con, spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    weights = quality.fitted(docs, "doc_id", "text", labels, "doc_id", "text_kind")
    want = {d: quality.text_kind(t, weights) for d, t in con.execute("select doc_id, text from documents").fetchall()}
    assert {r.doc_id: r.text_kind for r in run("p8_found")} == {d: k for d, k in want.items() if k}


def test_every_query_is_covered():
    rest = {"p1_found", "p1_copies", "p2_found", "p2_rates", "p2_chunks", "p5_splits", "p6_ids", "p7_near", "p8_found"}
    assert set(queries.queries()) == rest | set(queries.oracle_sql())


def test_kinds_agree_with_labels(sf_dir):
    con = oracle.connect(sf_dir)
    rows = con.execute("select text, lower(trim(text_kind)) from documents join labels using (doc_id) where text is not null and text_kind is not null").fetchall()
    right = sum(quality.text_kind(t) == (k if k in quality.KINDS else None) for t, k in rows if len("".join(t.split())) >= quality.LEAST)
    assert right >= 0.95 * sum(len("".join(t.split())) >= quality.LEAST for t, _ in rows)


def test_nothing_else_imports_it():
    for p in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M), p


def test_rest_works_without_it(tmp_path):
    shutil.copytree(ROOT / "corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n[0] == 'p' and n[1].isdigit() for n in q))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    n, has = out.stdout.split()
    assert int(n) > 40 and has == "False"
