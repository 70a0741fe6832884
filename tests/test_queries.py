"""Every core query with SQL gives the rows of its SQL; the others run."""

import ast

import pytest

from corpusloom.plans import queries as core

from . import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_against_sql(spark, sf_dir, con, name):
    oracle.same(core.queries()[name](spark, sf_dir), con, core.oracle_sql()[name])


#: Queries without SQL, on the real texts: (rows for each row of kernel_rows or None, columns).
PLAIN = {
    "ast_profile": (1, {"uuid", "parses", "has_get_inputs", "has_get_init_inputs", "has_class", "elements", "tensors", "ops", "reason"}), "op_frequency": (None, {"op", "n"}), "single_op_rows": (None, {"op", "uuid"}),
    "source_key": (None, {"uuid", "source_key", "reason"}), "structure_key": (1, {"uuid", "structure_key"}), "isolated_map": (1, {"uuid", "reason"}), "filter_pipeline": (1, {"uuid", "module_name", "reason"}), "profile_sizes": (None, {"measure", "percent", "value"}),
}


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_plain(spark, sf_dir, con, name):
    """Against the parser itself, row by row, where the query has one row for each."""
    per_row, columns = PLAIN[name]
    got = core.queries()[name](spark, sf_dir).collect()
    assert not got or set(got[0].__fields__) == columns
    rows = con.execute("select uuid, python_code from kernel_rows").fetchall()
    if per_row:
        assert sorted(r.uuid for r in got) == sorted(u for u, _ in rows)
    if name == "ast_profile":
        def fine(code):
            try:
                ast.parse(code)
            except (SyntaxError, ValueError, TypeError):
                return False
            return True

        assert {r.uuid: r.parses for r in got} == {u: fine(c) for u, c in rows}
    if name == "source_key":
        assert {r.uuid for r in got} == {u for u, c in rows if c is not None} and all(len(r.source_key) == 64 for r in got)
    if name == "profile_sizes":
        assert len(got) == 20


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert set(df.columns) == {"category", "n"} and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
