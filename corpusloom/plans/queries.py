"""Queries over the driver's tables, one for each operator or small family, with the SQL that gives the same rows."""

from __future__ import annotations

import functools
import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..functions.code import code_facts
from ..functions.fixed import DEV_BUCKETS, DESCRIPTION_FILE, GATES, INSTRUCTION_FILE, LICENSE_PREFIXES, REFERENCE_FILES, SCAN_PATTERNS, SOLUTION_FILE, SOLUTION_MARKER, SOLUTION_PATH, SOLVE_SCRIPT, TEST_SCRIPT
from ..operators import aggregates, dedup, episodes, groups, isolated, rules, sampling, validation
from ..session import place, read_table, spread, written
from ..sources import folders, records, registry
from . import made, pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---- sources and rules ------------------------------------------------------------------------------------------

_LINES = "length({0}) - length(replace({0}, chr(10), '')) + 1"
_LICENSES = "list_filter(coalesce(licenses, []), lambda x: regexp_matches(upper(x), '^(" + "|".join(LICENSE_PREFIXES) + ")'))"
_REASON = f"""case when len(coalesce(licenses, [])) = 0 then 'license: none listed'
  when len({_LICENSES}) > 0 then 'license: restricted ' || array_to_string({_LICENSES}, ', ')
  when {_LINES.format('python_code')} > 50 then 'length: ' || ({_LINES.format('python_code')}) || ' lines > 50'
  when triton_code is null or triton_code = '' then 'pair: no triton_code' end"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.load_rows(spark, f"{sf_dir}/kernel_rows.parquet")
    missing = F.when(text.first_filled("triton_code").isNull(), "pair: no triton_code")
    return rules.decide(rows, rules.license_reason(), rules.length_reason("python_code", 50), missing)


@query("""select uuid, module_name, entry_point, length(python_code) as py_length, length(triton_code) as triton_length, len(coalesce(licenses, [])) as n_licenses, coalesce(synthetic, false) as synthetic, coalesce(repo_link, '') as repo_link from kernel_rows""")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.load_rows(spark, f"{sf_dir}/kernel_rows.parquet")
    return rows.select("uuid", "module_name", "entry_point", F.length("python_code").cast("long").alias("py_length"), F.length("triton_code").cast("long").alias("triton_length"), F.size("licenses").cast("long").alias("n_licenses"), "synthetic", "repo_link")


@query(f"select uuid, {_REASON} as reason from kernel_rows")
def rule_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("uuid", "reason")


@query(f"select coalesce(split_part(reason, ':', 1), 'kept') as category, count(*) as n from (select {_REASON} as reason from kernel_rows) group by 1")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.reason_histogram(_decided(spark, sf_dir))


@query(f"select 'kept' as output, uuid from (select uuid, {_REASON} as reason from kernel_rows) where reason is null union all select 'dropped', uuid from (select uuid, {_REASON} as reason from kernel_rows) where reason is not null")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = rules.fan_out(written(_decided(spark, sf_dir).select("uuid", "reason"), "decided"))  # decided once
    return kept.select(F.lit("kept").alias("output"), "uuid").unionByName(dropped.select(F.lit("dropped").alias("output"), "uuid"))


_RE2 = [p.replace(r"(?<![\w.])", r"(^|[^\w.])").replace("=(?!=)", r"=([^=]|\z)") for p, _ in SCAN_PATTERNS]


@query("select reason, count(*) as n from (select case " + " ".join(f"when regexp_matches(t, '(?m){p}') then '{r}'" for p, (_, r) in zip(_RE2, SCAN_PATTERNS)) + " end as reason from (select triton_code as t from kernel_rows union all select python_code from kernel_rows union all select text from documents)) group by 1")
def pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "kernel_rows", "python_code", "triton_code")
    texts = rows.select(F.explode(F.array("python_code", "triton_code")).alias("t")).unionByName(read_table(spark, sf_dir, "documents", "text").toDF("t"))
    return texts.select(rules.pattern_reason("t").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_CALLS = [(r"\btl\.where\s*\(", "selects"), (r"^\s*class\s+\w+New\b", "defines a class"), (r"\btl\.s(um|igmoid)\b", "reduces or squashes"), (r"^\s*@triton\.jit", "kernel only")]


@query("select reason, count(*) as n from (select case " + " ".join(f"when regexp_matches(triton_code, '(?m){p}') then '{r}'" for p, r in _CALLS) + " end as reason from kernel_rows) group by 1")
def pattern_scan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scan with a list of its own."""
    rows = read_table(spark, sf_dir, "kernel_rows", "triton_code")
    return rows.select(rules.pattern_reason("triton_code", _CALLS).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


# ---- de-duplication and key sets --------------------------------------------------------------------------------

@query("""with k as (select sha256(python_code) as k, count(*) as c from kernel_rows group by 1)
select (select count(*) from kernel_rows) as n_rows, (select count(distinct uuid) from kernel_rows) as n_ids, (select coalesce(sum(c), 0)::bigint from k where c > 1) as n_duplicate_rows""")
def dup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_counts(read_table(spark, sf_dir, "kernel_rows", "uuid", "python_code"), F.sha2("python_code", 256), "uuid")


@query(f"""with kept as (select uuid, python_code from (select *, {_REASON} as reason from kernel_rows) where reason is null),
o as (select uuid, case when python_code is null then uuid else min(uuid) over (partition by python_code) end as owner from kept)
select uuid, case when owner <> uuid then 'duplicate: same code as uuid ' || owner end as reason from o""")
def dedup_keep_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = rules.fan_out(_decided(spark, sf_dir))
    owned = dedup.keep_lowest(kept.select("uuid", "python_code"), F.sha2("python_code", 256), "uuid")
    return owned.select("uuid", dedup.duplicate_reason("uuid").alias("reason"))


_NUMBER = r"regexp_extract(task, '^\s*[A-Za-z]+[-/](\d+)', 1)"
_SPLITS = f"(select distinct try_cast({_NUMBER} as bigint) as uuid, split_name from validation where split_name is not null)"


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "validation", "task", "split_name").where("split_name is not null")
    return v.select(text.record_number("task").alias("uuid"), "split_name").distinct()


def _held_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read_table(spark, sf_dir, "kernel_rows", "uuid", "module_name")
    named = rows.join(_splits(spark, sf_dir), "uuid")
    parts = [named.where(F.col("split_name") == s) for s in ("dev", "test")]
    return rows, records.held_out_keys(parts, lambda d: F.lower(F.trim("module_name")))


_HELD = f"(select distinct lower(trim(k.module_name)) from kernel_rows k join {_SPLITS} s using (uuid) where split_name in ('dev', 'test') and module_name is not null)"


@query(f"select lower(trim(k.module_name)) as key, count(*) as n from kernel_rows k join {_SPLITS} s using (uuid) where split_name in ('dev', 'test') group by 1")
def held_out_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = _held_out(spark, sf_dir)
    named = rows.join(_splits(spark, sf_dir).where("split_name in ('dev', 'test')"), "uuid").select(F.lower(F.trim("module_name")).alias("key"))
    return named.join(dedup.small(keys), "key").groupBy("key").agg(F.count("*").alias("n"))


@query(f"select uuid from kernel_rows where lower(trim(module_name)) in {_HELD}")
def held_out_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = _held_out(spark, sf_dir)
    return dedup.in_keys(rows, F.lower(F.trim("module_name")), keys).select("uuid")


@query(f"select uuid from kernel_rows where lower(trim(module_name)) not in {_HELD} or module_name is null")
def held_out_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = _held_out(spark, sf_dir)
    return dedup.not_in_keys(rows, F.lower(F.trim("module_name")), keys).select("uuid")


# ---- profile ----------------------------------------------------------------------------------------------------

@query("""select measure, n, round(n / nullif(total, 0)::double, 6) as share from (
select count(*) as total, count(*) filter (synthetic) as synthetic, count(*) filter (len(coalesce(licenses, [])) = 0) as no_license, count(*) filter (coalesce(repo_link, '') = '') as no_link, count(*) filter (contains(triton_code, 'tl.sigmoid')) as mentions from kernel_rows)
unpivot (n for measure in (synthetic, no_license, no_link, mentions))""")
def count_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.load_rows(spark, f"{sf_dir}/kernel_rows.parquet")
    return aggregates.count_shares(rows, synthetic=F.col("synthetic"), no_license=F.size("licenses") == 0, no_link=F.col("repo_link") == "", mentions=F.contains("triton_code", F.lit("tl.sigmoid")))


@query("select license, count(*) as n from (select unnest(licenses) as license, uuid from kernel_rows) group by 1 order by n desc, min(uuid), license limit 15")
def topk_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "kernel_rows", "uuid", "licenses")
    return aggregates.top_k(rows.select("uuid", F.explode("licenses").alias("license")), "license", "uuid", 15)


@query("""select line, count(*) as n from (select uuid, trim(unnest(string_split(triton_code, chr(10)))) as line from kernel_rows) where starts_with(line, 'import ') or starts_with(line, 'from ') group by 1 order by n desc, min(uuid), line limit 10""")
def topk_import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "kernel_rows", "uuid", "triton_code")
    lines = rows.select("uuid", F.explode(F.split("triton_code", "\n")).alias("line")).withColumn("line", F.trim("line"))
    return aggregates.top_k(lines.where(F.startswith("line", F.lit("import ")) | F.startswith("line", F.lit("from "))), "line", "uuid", 10)


_RANK = """(select '{0}' as measure, p.percent, s.v[1 + least(len(s.v) - 1, floor(p.percent / 100.0::double * len(s.v)))::bigint]::double as value
from (select list_sort(list({1})) as v from kernel_rows where {1} is not null) s, (select unnest([10, 50, 90, 99, 100])::int as percent) p)"""


@query(" union all ".join(_RANK.format(m, e) for m, e in (("py_lines", _LINES.format("python_code")), ("triton_lines", _LINES.format("triton_code")), ("kernels", "((length(triton_code) - length(replace(triton_code, '@triton.jit', ''))) // 11)"))))
def pct_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "kernel_rows", "python_code", "triton_code")
    sized = rows.select(text.line_count("python_code").alias("py_lines"), text.line_count("triton_code").alias("triton_lines"), text.occurrences("triton_code", "@triton.jit").alias("kernels"))
    return aggregates.nearest_rank(sized, ["py_lines", "triton_lines", "kernels"], [10, 50, 90, 99, 100])


@query("select case when k >= 4 then '4+' else k::varchar end as label, count(*) as n from (select (length(triton_code) - length(replace(triton_code, 'tl.load', ''))) // 7 as k from kernel_rows where triton_code is not null) group by 1")
def histogram_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "kernel_rows", "triton_code").where("triton_code is not null")
    return aggregates.capped_histogram(rows, text.occurrences("triton_code", "tl.load"))


_CHECKS = {
    "get_inputs": "contains(python_code, 'def get_inputs(')",
    "get_init_inputs": "contains(python_code, 'def get_init_inputs(')",
    "class_exists": "contains(python_code, 'class ' || module_name || '(')",
    "triton_class": "contains(triton_code, 'class ' || module_name || 'New')",
    "entry_point": "entry_point = module_name",
}


@query("select measure, n, round(n / nullif(total, 0)::double, 6) as share from (select count(*) as total, " + ", ".join(f"count(*) filter ({c}) as {n}" for n, c in _CHECKS.items()) + ', count(*) filter (' + " and ".join(_CHECKS.values()) + ') as "all" from kernel_rows) unpivot (n for measure in (' + ", ".join(_CHECKS) + ', "all"))')
def checks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "kernel_rows", "module_name", "entry_point", "python_code", "triton_code")
    return aggregates.checks_all(rows, **{n: F.expr(c) for n, c in _CHECKS.items()})


@query(r"select uuid, array_to_string(list_slice(string_split(regexp_replace(regexp_replace(python_code, '^\s+', ''), '\s+$', ''), chr(10)), 1, 20), chr(10)) as excerpt from kernel_rows")
def head_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "kernel_rows", "uuid", "python_code").select("uuid", text.head_lines("python_code").alias("excerpt"))


@query()
def ast_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of each text by one parse: what the interface checks, size rules and operator counts need."""
    rows = spread(read_table(spark, sf_dir, "kernel_rows", "uuid", "python_code", "module_name")).withColumn("f", code_facts("python_code", F.trim("module_name")))
    n = arrays.elements("f.shapes")
    reason = rules.first_reason(rules.parse_reason("f.parses"), rules.shapes_reason("f.shapes"))
    return rows.select("uuid", "f.parses", "f.has_get_inputs", "f.has_get_init_inputs", "f.has_class", n.alias("elements"), F.size("f.shapes").alias("tensors"), F.col("f.ops").alias("ops"), reason.alias("reason"))


@query()
def op_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(read_table(spark, sf_dir, "kernel_rows", "uuid", "python_code", "module_name")).select("uuid", F.explode(code_facts("python_code", F.trim("module_name"))["ops"]).alias("op"))
    return aggregates.top_k(rows, "op", "op", 30)


@query()
def single_op_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each operator, the first row whose set of operators is just that."""
    rows = spread(read_table(spark, sf_dir, "kernel_rows", "uuid", "python_code", "module_name")).select("uuid", code_facts("python_code", F.trim("module_name"))["ops"].alias("ops"))
    return rows.where(F.size("ops") == 1).groupBy(F.col("ops")[0].alias("op")).agg(F.min("uuid").alias("uuid"))


@query()
def source_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical duplicates: lowest uuid per fingerprint that ignores comments, docstrings and formatting."""
    rows = spread(read_table(spark, sf_dir, "kernel_rows", "uuid", "python_code").where("python_code is not null"))
    keyed = written(rows.select("uuid", code_facts("python_code", F.lit(""))["source_key"].alias("source_key")), "keys")  # both sides of the join read it
    return dedup.keep_lowest(keyed, F.col("source_key"), "uuid").select("uuid", "source_key", dedup.duplicate_reason("uuid").alias("reason"))


@query()
def structure_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each row's class under a fixed name; null where the class is missing."""
    rows = spread(read_table(spark, sf_dir, "kernel_rows", "uuid", "python_code", "module_name"))
    return rows.select("uuid", code_facts("python_code", F.trim("module_name"))["structure_key"].alias("structure_key"))


@query()
def isolated_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row through a check in child processes; here the check compiles the text."""
    return isolated.isolated_map(spread(read_table(spark, sf_dir, "kernel_rows", "uuid", "python_code")), "uuid", ["python_code"], "corpusloom.operators.checks:parses", batch=500).withColumnRenamed("id", "uuid")


@query()
def filter_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order: static rules, duplicates, held-out classes (those of rows in dev or test), isolated check."""
    rows = records.load_rows(spark, f"{sf_dir}/kernel_rows.parquet")
    held = rows.join(_splits(spark, sf_dir).where("split_name in ('dev', 'test')"), "uuid", "left_semi")
    keys = spread(held).select(code_facts("python_code", F.trim("module_name"))["structure_key"].alias("key")).where("key is not null")
    return pipelines.filter_pipeline(rows, keys, "corpusloom.operators.checks:parses")


@query()
def profile_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size section of the profile."""
    return pipelines.profile(records.load_rows(spark, f"{sf_dir}/kernel_rows.parquet"))["sizes"]


# ---- rows whose facts are known beforehand -----------------------------------------------------------------------

def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.programs(read_table(spark, sf_dir, "kernel_rows", "uuid"))


def _made_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_made(spark, sf_dir)).withColumn("f", code_facts("python_code", F.col("module_name")))


@query(f"""select uuid, {made.KIND_SQL} <> 1 as parses, {made.KIND_SQL} not in (1, 2) as has_get_inputs, {made.KIND_SQL} <> 1 as has_get_init_inputs, {made.KIND_SQL} not in (1, 5) as has_class,
{made.ELEMENTS_SQL} as elements, case {made.KIND_SQL} when 0 then 1 when 4 then 2 when 5 then 1 when 6 then 1 when 7 then 0 end::bigint as tensors, array_to_string({made.OPS_SQL}, ' ') as ops, {made.REASON_SQL} as reason from kernel_rows""")
def made_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one parse finds: definitions, shapes, operators under their short names, and the rules' reason."""
    reason = rules.first_reason(rules.parse_reason("f.parses"), rules.shapes_reason("f.shapes"))
    return _made_facts(spark, sf_dir).select(
        "uuid", "f.parses", "f.has_get_inputs", "f.has_get_init_inputs", "f.has_class", arrays.elements("f.shapes").alias("elements"),
        F.when(F.col("f.shapes").isNotNull(), F.size("f.shapes")).cast("long").alias("tensors"), F.array_join("f.ops", " ").alias("ops"), reason.alias("reason"))


@query(f"select op, count(*) as n from (select unnest({made.OPS_SQL}) as op from kernel_rows) group by 1 order by n desc, op limit 30")
def made_op_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_k(_made_facts(spark, sf_dir).select(F.explode("f.ops").alias("op")), "op", "op", 30)


@query(f"select ops[1] as op, min(uuid) as uuid from (select uuid, {made.OPS_SQL} as ops from kernel_rows) where len(ops) = 1 group by 1")
def made_single_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each operator, the first row whose set of operators is just that."""
    ops = _made_facts(spark, sf_dir).select("uuid", F.col("f.ops").alias("ops"))
    return ops.where(F.size("ops") == 1).groupBy(F.col("ops")[0].alias("op")).agg(F.min("uuid").alias("uuid"))


#: Rows of one program and one class name have one source key, whatever their formatting; programs that do not parse are
#: told apart by their text.
_SOURCE = f"{made.GROUP_SQL}, uuid % 3, case when {made.KIND_SQL} = 1 then uuid % 4 end"


@query(f"select uuid, min(uuid) over (partition by {_SOURCE}) as owner from kernel_rows")
def made_source_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by a fingerprint that ignores comments, docstrings and spacing."""
    keyed = written(_made_facts(spark, sf_dir).select("uuid", F.col("f.source_key").alias("k")), "keys")
    return dedup.keep_lowest(keyed, F.col("k"), "uuid").select("uuid", "owner")


@query(f"select uuid, case when {made.KIND_SQL} in (1, 5) then null else min(uuid) over (partition by {made.GROUP_SQL}) end as owner from kernel_rows")
def made_structure_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners by a fingerprint of the class under a fixed name; without such a class there is none."""
    keyed = written(_made_facts(spark, sf_dir).select("uuid", F.col("f.structure_key").alias("k")), "keys")
    return dedup.keep_lowest(keyed, F.col("k"), "uuid").select("uuid", F.when(F.col("k").isNotNull(), F.col("owner")).alias("owner"))


@query(f"""with r as (select uuid, {_SOURCE.replace(', uuid % 3', ' as g, uuid % 3 as m').replace(', case', ', case')} as v, case {made.KIND_SQL} when 1 then 'parse: not valid source' end as parse,
  case when uuid % 5 = 3 then 'license: restricted GPL-3.0' end as license, {made.REASON_SQL} as size from kernel_rows),
s as (select *, coalesce(parse, license, size) as static from r), o as (select uuid, g, min(uuid) over (partition by g, m) as owner from s where static is null),
d as (select uuid, g, case when owner <> uuid then 'duplicate: same code as uuid ' || owner end as dup from o),
h as (select uuid, case when g % 9 = 0 and {made.KIND_SQL} not in (1, 5) then 'held out: class of the evaluation set' end as held from d where dup is null)
select uuid, 'Unit' || (uuid % 3) as module_name, coalesce(static, dup, held) as reason from s left join d using (uuid) left join h using (uuid)""")
def made_filter_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; the classes of every ninth program are held out, and the check lets all pass."""
    rows = _made(spark, sf_dir)
    held = _made_facts(spark, sf_dir).where(F.floor(F.col("uuid") / 4) % 9 == 0).select(F.col("f.structure_key").alias("key")).where("key is not null")
    return pipelines.filter_pipeline(rows, held, "corpusloom.operators.checks:parses").select("uuid", "module_name", "reason")


@query(" union all ".join(_RANK.format(m, e).replace("from kernel_rows", f"from (select uuid, {made.ELEMENTS_SQL} as elements from kernel_rows)") for m, e in (("elements", "elements"), ("kernels", "(uuid * 0)"), ("triton_lines", "(uuid * 0 + 1)"))))
def made_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size section of the profile."""
    return pipelines.profile(_made(spark, sf_dir))["sizes"].where("measure <> 'python_lines'")


_PROFILE = f"""with m as (select uuid, {made.KIND_SQL} as k, {made.ELEMENTS_SQL} as n, {made.OPS_SQL} as ops, case {made.KIND_SQL} when 0 then 1 when 4 then 2 when 5 then 1 when 6 then 1 when 7 then 0 end as t from kernel_rows),
capped as (select 'ops_per_row' as section, case when coalesce(len(ops), 0) >= 4 then '4+' else coalesce(len(ops), 0)::varchar end as label from m union all select 'tensors', t::varchar from m where t is not null
union all select 'ops', unnest(ops) from m union all select 'licenses', unnest(case uuid % 5 when 1 then ['MIT', 'Apache-2.0'] when 3 then ['GPL-3.0'] when 4 then ['BSD'] else ['MIT'] end) from m)
select section, label, count(*) as n from capped group by 1, 2
union all (select section, label, n from (select count(*) as rows, count(*) filter (k <> 1) as parses, count(*) filter (k not in (1, 2)) as get_inputs, count(*) filter (k not in (1, 5)) as class_exists, count(*) filter (n <= 1024) as tiny, count(*) filter (n > 1000000) as large from m),
lateral (values ('interface', 'parses', parses), ('interface', 'get_inputs', get_inputs), ('interface', 'get_init_inputs', parses), ('interface', 'class_exists', class_exists), ('interface', 'triton_class', 0), ('interface', 'entry_point', rows), ('interface', 'all', 0),
('provenance', 'synthetic', rows), ('provenance', 'no_license', 0), ('inputs', 'tiny', tiny), ('inputs', 'large', large)) v(section, label, n))"""


@query(_PROFILE)
def made_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted sections of the profile in one table."""
    sections = pipelines.profile(_made(spark, sf_dir))
    named = {"interface": "measure", "provenance": "measure", "inputs": "measure", "tensors": "label", "ops_per_row": "label", "ops": "op", "licenses": "license"}
    parts = [sections[s].select(F.lit(s).alias("section"), F.col(label).alias("label"), F.col("n").cast("long").alias("n")) for s, label in named.items()]
    return functools.reduce(DataFrame.unionByName, parts)


@query("select case uuid % 11 " + " ".join(f"when {i} then '{r}'" for i, (_, r) in enumerate(SCAN_PATTERNS)) + f" when 9 then '{SCAN_PATTERNS[-1][1]}' end as reason, count(*) as n from kernel_rows group by 1")
def made_pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pattern of the scan hits, and harmless lines do not."""
    texts = made.scanned(read_table(spark, sf_dir, "kernel_rows", "uuid"))
    return texts.select(rules.pattern_reason("text").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(made.runs_sql(2))
def made_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's program run twice in child processes: rows that hang, crash, go online, forge replies or give other
    things than one finite, repeatable array have a reason of their own, and cost their batch nothing.  Equal programs
    are run once for all their rows."""
    rows = spread(made.runs(read_table(spark, sf_dir, "kernel_rows", "uuid")))
    return isolated.isolated_map(rows, "uuid", ["python_code", "module_name"], "corpusloom.operators.checks:runs_deterministically", row_seconds=2, grace=10, once=True).withColumnRenamed("id", "uuid")


# ---- splits -----------------------------------------------------------------------------------------------------

_BUCKET = "list_reduce(list_prepend(0::bigint, list_transform(string_split(sha256({0}), ''), lambda d: (strpos('0123456789abcdef', d) - 1)::bigint)), lambda a, d: (a * 16 + d) % {1})"
_HASHED = f"(select uuid, lower(trim(module_name)) as module_group, case when {_BUCKET.format('lower(trim(module_name))', DEV_BUCKETS)} = 0 then 'dev' else 'train' end as split from kernel_rows where module_name is not null)"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "kernel_rows", "uuid", "module_name").where("module_name is not null")
    group = F.lower(F.trim("module_name"))
    return rows.select("uuid", group.alias("module_group"), F.when(text.hash_bucket(group, DEV_BUCKETS) == 0, "dev").otherwise("train").alias("split"))


@query(f"select * from {_HASHED}")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir)


@query(f"select split, count(*) as n_rows, count(distinct module_group) as n_groups from {_HASHED} group by 1")
def split_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("module_group").alias("n_groups"))


@query(f"select (select count(*) from (select module_group from {_HASHED} group by 1 having count(distinct split) > 1)) as n_torn_groups, count(*) as n_rows, count(split) as n_split_rows from {_HASHED}")
def split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.split_check(_hashed(spark, sf_dir), "module_group", "split")


_NAMED = f"(select lower(trim(k.module_name)) as module_group, split_name from kernel_rows k join {_SPLITS} s using (uuid))"


@query(f"select module_group from {_NAMED} where split_name = 'train' intersect select module_group from {_NAMED} where split_name = 'dev'")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = read_table(spark, sf_dir, "kernel_rows", "uuid", "module_name").join(_splits(spark, sf_dir), "uuid").select(F.lower(F.trim("module_name")).alias("module_group"), "split_name")
    return dedup.common_groups(named, "module_group", "split_name", "train", "dev")


# ---- validation and gates ---------------------------------------------------------------------------------------

@query(rf"""with v as (select regexp_replace(replace(regexp_replace(lower(trim(task)), '\s+\d+$', ''), '/', '-'), 'x^', '') as task, * exclude (task) from validation),
t as (select distinct task from v), o as (select task, max(oracle) as oracle, max(split_part(split_part(reason, 'oracle failed at ', 2), ':', 1)) filter (starts_with(reason, 'oracle failed')) as failed_gate from v where mode = 'direct' group by 1),
n as (select task, max(nop) as nop from v where mode = 'direct' group by 1)
select task, oracle, nop, (oracle is not distinct from 1.0) and (nop is not distinct from 0.0) as keep,
case when oracle is distinct from 1.0 then 'oracle failed at ' || coalesce(failed_gate, 'None') || ': None' when nop is distinct from 0.0 then 'nop scored ' || coalesce(nop::varchar, 'None') end as reason
from t left join o using (task) left join n using (task)""")
def two_sided_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "validation", "task", "mode", "oracle", "nop", "reason").withColumn("task", text.tidy_record_name("task"))
    direct = v.where(F.col("mode") == "direct")
    gate = F.when(F.startswith("reason", F.lit("oracle failed")), F.split_part(F.split_part("reason", F.lit("oracle failed at "), F.lit(2)), F.lit(":"), F.lit(1)))
    oracle = direct.groupBy("task").agg(F.max("oracle").alias("oracle"), F.max(gate).alias("failed_gate"), F.lit(None).cast("string").alias("message"))
    return validation.two_sided(v.select("task").distinct(), oracle, direct.groupBy("task").agg(F.max("nop").alias("nop")))


@query("select coalesce(split_part(reason, ':', 1), 'kept') as category, count(*) as n from validation group by 1")
def drop_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.reason_histogram(read_table(spark, sf_dir, "validation", "reason"))


@query("select coalesce(failed_gate, 'passed') as failed_gate, count(*) as n from gate_results group by 1")
def gate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.gate_histogram(read_table(spark, sf_dir, "gate_results", "failed_gate"))


_PLACES = ", ".join(f"({i + 1}, '{g}')" for i, g in enumerate(GATES))


@query(f"""with g(place, gate) as (values {_PLACES}), r as (select case when failed_gate is null then {len(GATES) + 1} else coalesce((select place from g where gate = failed_gate), 0) end as upto from gate_results)
select place, gate, count(*) filter (upto >= place) as reached, count(*) filter (upto > place) as passed from r, g where upto > 0 group by 1, 2""")
def gate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.gate_funnel(read_table(spark, sf_dir, "gate_results", "failed_gate"))


@query("select failed, coalesce(failed_gate, 'passed') as failed_gate, count(*) as n from (select failed_gate, case when " + " or ".join(f"gate_{g} is null" for g in GATES) + " then 'crash' " + " ".join(f"when gate_{g} = 0 then '{g}'" for g in GATES) + " end as failed from gate_results) group by 1, 2")
def gate_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = validation.first_failure(read_table(spark, sf_dir, "gate_results", "failed_gate", *(f"gate_{g}" for g in GATES)))
    return r.groupBy("failed", F.coalesce("failed_gate", F.lit("passed")).alias("failed_gate")).agg(F.count("*").alias("n"))


@query("select count(*) as n, count(*) filter (reward >= 1) as passed, round(count(*) filter (reward >= 1) / count(*)::double, 6) as share from gate_results")
def pass_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_table(spark, sf_dir, "gate_results", "reward")
    return r.agg(F.count("*").alias("n"), F.count_if(F.col("reward") >= 1).alias("passed"), r6(F.count_if(F.col("reward") >= 1) / F.count("*")).alias("share"))


@query("select attempt::double as attempt, reward, kernel_launches::double as kernel_launches, max_abs_diff, " + ", ".join(f"gate_{g}::double as gate_{g}" for g in GATES) + " from gate_results")
def numbers_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.numbers_only(read_table(spark, sf_dir, "gate_results"))


@query("select task, message, left(message, 8) as head, right(message, 8) as tail, coalesce(nullif(message, ''), failed_gate) as shown from gate_results")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read_table(spark, sf_dir, "gate_results", "task", "message", "failed_gate")
    return r.select("task", "message", text.head("message", 8).alias("head"), text.tail("message", 8).alias("tail"), text.first_filled("message", "failed_gate").alias("shown"))


# ---- episodes ---------------------------------------------------------------------------------------------------

_SUMMARY = """(select episode_id, t.task.data.name as task,
  coalesce(list_sum(list_transform(list_filter(map_values(t.rewards), lambda r: r is not null), lambda r: r.score * r.weight)), 0.0) as reward,
  coalesce(ok, false) as ok, t.stop_condition as stop, coalesce(len(list_filter(t.nodes, lambda n: coalesce(n.sampled, false))), 0)::bigint as turns, num_output_tokens as output_tokens,
  greatest(t.timing.boot.end_s, t.timing.setup.end_s, t.timing.agent.end_s, t.timing.finalize.end_s, t.timing.scoring.end_s) - t.timing.start_s as seconds
  from (select distinct on (episode_id) episode_id, ok, num_output_tokens, traces[1] as t from episodes))"""
_TASKS = f"""(select task, count(*) filter (ok) as attempts, count(*) filter (ok and reward >= 1) as passes, count(*) filter (not ok) as errors,
  avg(turns) filter (ok) as mean_turns, avg(output_tokens) filter (ok) as mean_output_tokens, avg(seconds) filter (ok) as mean_seconds,
  count(*) filter (ok and reward >= 1) / (count(*) filter (ok))::double as pass_rate from {_SUMMARY} group by 1 having count(*) filter (ok) > 0)"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.summaries(read_table(spark, sf_dir, "episodes", "episode_id", "ok", "num_output_tokens", "traces"))


@query(f"select episode_id, task, round(reward, 6) as reward, ok, stop, turns, output_tokens, round(seconds, 3) as seconds from {_SUMMARY}")
def episode_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _summary(spark, sf_dir)
    return s.withColumns({"reward": r6("reward"), "seconds": F.round("seconds", 3)})


@query(f"select task, attempts, passes, errors, round(mean_turns, 6) as mean_turns, round(mean_output_tokens, 4) as mean_output_tokens, round(mean_seconds, 3) as mean_seconds, round(pass_rate, 6) as pass_rate from {_TASKS}")
def attempts_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = episodes.attempts_by_task(_summary(spark, sf_dir))
    return t.withColumns({"mean_turns": r6("mean_turns"), "mean_output_tokens": F.round("mean_output_tokens", 4), "mean_seconds": F.round("mean_seconds", 3), "pass_rate": r6("pass_rate")})


@query(f"select count(*) filter (pass_rate = 0) as always_fail, count(*) filter (pass_rate > 0 and pass_rate < 1) as mixed, count(*) filter (pass_rate = 1) as always_pass from {_TASKS}")
def pass_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.pass_buckets(episodes.attempts_by_task(_summary(spark, sf_dir)))


_TRAIN = r"(select distinct regexp_replace(replace(lower(trim(task)), '/', '-'), '\s+\d+$', '') as task from validation where split_name = 'train')"


@query(f"select replace(t.task, '/', '-') as task, round(pass_rate, 6) as pass_rate, (select count(*) = 0 from {_TASKS} u where replace(u.task, '/', '-') not in (from {_TRAIN})) as allowed from {_TASKS} t where pass_rate > 0 and pass_rate < 1 and replace(t.task, '/', '-') in (from {_TRAIN})")
def trainable(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = episodes.attempts_by_task(_summary(spark, sf_dir)).withColumn("task", F.replace("task", F.lit("/"), F.lit("-")))
    train = read_table(spark, sf_dir, "validation", "task", "split_name").where("split_name = 'train'").select(text.tidy_record_name("task").alias("task"))
    return episodes.trainable(tasks, train).withColumn("pass_rate", r6("pass_rate"))


@query(f"select coalesce(stop, '(none)') as stop, count(*) as n, count(*) filter (not ok) as errors from {_SUMMARY} group by 1")
def stop_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.stop_histogram(_summary(spark, sf_dir))


@query(f"select count(*) as episodes, round(avg(turns), 6) as mean_turns, round(avg(output_tokens), 4) as mean_output_tokens, round(avg(seconds), 3) as mean_seconds from {_SUMMARY}")
def run_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = episodes.run_means(_summary(spark, sf_dir))
    return m.withColumns({"mean_turns": r6("mean_turns"), "mean_output_tokens": F.round("mean_output_tokens", 4), "mean_seconds": F.round("mean_seconds", 3)})


# ---- group statistics and losses --------------------------------------------------------------------------------

def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "gate_results", "task", "attempt", "reward")


@query("select task, attempt, round(reward - avg(reward) over (partition by task), 6) as advantage from gate_results")
def adv_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_advantages(_rewards(spark, sf_dir), "task", "reward").select("task", "attempt", r6("advantage").alias("advantage"))


@query("select task, attempt, round((reward - avg(reward) over (partition by task)) / (stddev_samp(reward) over (partition by task) + 1e-6), 4) as advantage from gate_results")
def adv_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_advantages(_rewards(spark, sf_dir), "task", "reward", True).select("task", "attempt", F.round("advantage", 4).alias("advantage"))


@query("select task, attempt, coalesce(min(reward) over (partition by task) <> max(reward) over (partition by task), false) as informative from gate_results")
def informative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.informative(_rewards(spark, sf_dir), "task", "reward").select("task", "attempt", "informative")


@query("select position, position // 4 as group_id, round(l - avg(l) over (partition by position // 4), 6) as advantage from (select row_number() over (order by uuid) - 1 as position, length(module_name)::double as l from kernel_rows) where position < (select count(*) // 4 * 4 from kernel_rows)")
def positional_groups_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of four by position, of as many rows as divide into groups; other numbers of rows are an error."""
    rows = sampling.positions(read_table(spark, sf_dir, "kernel_rows", "uuid", "module_name"), "uuid", "position")
    whole = rows.count() // 4 * 4
    placed = groups.positional_groups(rows.where(F.col("position") < whole).withColumn("l", F.length("module_name").cast("double")), "position", 4)
    return groups.group_advantages(placed, "group_id", "l").select("position", "group_id", r6("advantage").alias("advantage"))


@query("select o_orderkey, o_orderkey // 4 as group_id, round(o_totalprice - avg(o_totalprice) over (partition by o_orderkey // 4), 4) as advantage from orders")
def positional_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").withColumn("group_id", groups.positional_group("o_orderkey", 4))
    return groups.group_advantages(o, "group_id", "o_totalprice").select("o_orderkey", "group_id", F.round("advantage", 4).alias("advantage"))


_TOKENS = """(select l_orderkey as completion_id, l_orderkey % 100 as group_id, exp(l_tax - l_discount) as ratio, case when l_returnflag = 'A' then 0.0 else (l_linenumber % 3) / 2.0 end::double as mask, ((l_orderkey % 7) - 3) / 2.0::double as advantage from lineitem)"""
_LOSS = f"(select completion_id, group_id, mask, -least(ratio * advantage, least(greatest(ratio, 0.8), 1.28) * advantage) * mask as l from {_TOKENS})"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as tokens: an order is a completion, a hundredth of the orders a group."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_tax", "l_discount", "l_returnflag")
    mask = F.when(F.col("l_returnflag") == "A", 0.0).otherwise((F.col("l_linenumber") % 3) / F.lit(2.0))
    return li.select(F.col("l_orderkey").alias("completion_id"), (F.col("l_orderkey") % 100).alias("group_id"), F.col("l_tax").cast("double").alias("new_logp"), F.col("l_discount").cast("double").alias("old_logp"), mask.alias("mask"), (((F.col("l_orderkey") % 7) - 3) / F.lit(2.0)).alias("advantage"))


@query(f"select round(sum(l) / nullif(sum(mask), 0), 6) as loss from {_LOSS}")
def loss_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.masked_loss(_tokens(spark, sf_dir), "token").select(r6("loss").alias("loss"))


@query(f"select round(avg(m), 6) as loss from (select sum(l) / nullif(sum(mask), 0) as m from {_LOSS} group by completion_id)")
def loss_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.masked_loss(_tokens(spark, sf_dir), "sequence").select(r6("loss").alias("loss"))


@query(f"select round(avg(m), 6) as loss from (select sum(l) / nullif(sum(mask), 0) as m from {_LOSS} group by group_id)")
def loss_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.masked_loss(_tokens(spark, sf_dir), "prompt").select(r6("loss").alias("loss"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("expected")), "vec_id")


_DIFFS = "list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::double - z[2]::double))"


@query(f"select a.vec_id, round(list_max({_DIFFS}), 6) as diff from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def array_max_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", r6(arrays.max_abs_diff("embedding", "expected")).alias("diff"))


@query("select a.vec_id, len(list_filter(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::double - z[2]::double) > 0.3 + 0.01 * abs(z[2]::double))) = 0 as close from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def array_allclose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", arrays.all_close("embedding", "expected", 0.01, 0.3).alias("close"))


# ---- materialisation, names and samples -------------------------------------------------------------------------

@query("select uuid, 'task-' || case when length(uuid::varchar) < 5 then lpad(uuid::varchar, 5, '0') else uuid::varchar end || '-' || lower(trim(module_name)) as task from kernel_rows")
def task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "kernel_rows", "uuid", "module_name").select("uuid", text.record_name("uuid", F.trim("module_name")).alias("task"))


@query(rf"select task, try_cast(nullif({_NUMBER}, '') as bigint) as uuid, case when strpos(task, '/') > 0 then left(task, strpos(task, '/') - 1) || '-' || substring(task, strpos(task, '/') + 1) else task end as first, regexp_replace(replace(lower(trim(task)), '/', '-'), '\s+\d+$', '') as tidy from validation")
def name_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "validation", "task")
    return v.select("task", text.record_number("task").alias("uuid"), text.replace_first("task", "/", "-").alias("first"), text.tidy_record_name("task").alias("tidy"))


_WRAPPED = len(f"#!/bin/bash\ncat > {SOLUTION_PATH} <<'{SOLUTION_MARKER}'\n\n{SOLUTION_MARKER}\n")


@query(f"select uuid, triton_code as code, length(triton_code) + {_WRAPPED} as script_length from kernel_rows")
def heredoc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = read_table(spark, sf_dir, "kernel_rows", "uuid", "triton_code").withColumn("s", text.wrap("triton_code"))
    return wrapped.select("uuid", text.unwrap("s").alias("code"), F.length("s").cast("long").alias("script_length"))


_NAME = "'task-' || case when length(uuid::varchar) < 5 then lpad(uuid::varchar, 5, '0') else uuid::varchar end || '-' || lower(trim(module_name))"
_ESCAPED = r"replace({0}, chr(9), '\u0009')"
_TOML = f"""'schema_version = "1.4"' || chr(10) || 'artifacts = ["{SOLUTION_PATH}"]' || chr(10) || chr(10) || '[task]' || chr(10) || 'name = "' || {_ESCAPED.format(_NAME)} || '"' || chr(10) || chr(10) || '[metadata]' || chr(10) || 'uuid = ' || uuid || chr(10) || 'module_name = "' || {_ESCAPED.format('trim(module_name)')} || '"' || coalesce(chr(10) || 'license = "' || licenses[1] || '"', '') || chr(10)"""
_FILES = {DESCRIPTION_FILE: _TOML, INSTRUCTION_FILE: "'Implement ' || trim(module_name) || 'New.' || chr(10)", SOLUTION_FILE: "''", **dict.fromkeys(REFERENCE_FILES, "coalesce(python_code, '')"), TEST_SCRIPT: "'#!/bin/bash' || chr(10)", SOLVE_SCRIPT: f"coalesce('#!/bin/bash' || chr(10) || 'cat > {SOLUTION_PATH} <<''{SOLUTION_MARKER}''' || chr(10) || triton_code || chr(10) || '{SOLUTION_MARKER}' || chr(10), '')"}


@query(f"select {_NAME} as folder, unnest({list(_FILES)}) as path, unnest([" + ", ".join(f"sha256({t})" for t in _FILES.values()) + "]) as digest, unnest([" + ", ".join("true" if p.endswith(".sh") else "false" for p in _FILES) + "]) as executable from kernel_rows where module_name is not null")
def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each record's folder with the digest of their text, as rows; sources.folders writes them."""
    rows = read_table(spark, sf_dir, "kernel_rows", "uuid", "module_name", "python_code", "triton_code", "licenses").where("module_name is not null")
    return pipelines.task_files(rows).select("folder", "path", F.sha2("text", 256).alias("digest"), "executable")


_KEPT = rf"(select distinct regexp_replace(replace(lower(trim(task)), '/', '-'), '\s+\d+$', '') as task from validation where keep)"
_PLACED = f"(select task, module_group, case when {_BUCKET.format('module_group', DEV_BUCKETS)} = 0 then 'dev' when module_group is not null then 'train' end as split from {_KEPT} left join (select uuid, lower(trim(module_name)) as module_group from kernel_rows) k on k.uuid = try_cast(nullif({_NUMBER}, '') as bigint))"


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kept = read_table(spark, sf_dir, "validation", "task", "keep").where("keep").select("task")
    return pipelines.split_kept(kept, read_table(spark, sf_dir, "kernel_rows", "uuid", "module_name"))


@query(f"select task, module_group, split from {_PLACED}")
def kept_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept tasks with the module of their record and the split that follows from it."""
    return _kept(spark, sf_dir)[0]


@query(f"select (select count(*) from (select module_group from {_PLACED} group by 1 having count(distinct split) > 1)) as n_torn_groups, count(*) as n_rows, count(split) as n_split_rows from {_PLACED}")
def kept_split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No group in both splits, no kept task in none."""
    return _kept(spark, sf_dir)[1]


@query("select 'tasks' as name, '0.1' as version, 'kept tasks' as description, count(*) as n_tasks, min(task) as first, max(task) as last from (select distinct task from validation where keep)")
def registry_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = read_table(spark, sf_dir, "validation", "task", "keep").where("keep").select(F.col("task").alias("name")).distinct().withColumn("path", F.concat(F.lit("tasks/"), "name"))
    entry = registry.registry(kept, "tasks", "kept tasks")
    return entry.select("name", "version", "description", F.size("tasks").cast("long").alias("n_tasks"), F.col("tasks")[0]["name"].alias("first"), F.element_at("tasks", -1)["name"].alias("last"))


# ---- written and read back ---------------------------------------------------------------------------------------

@query("select task, mode, oracle, nop, keep, reason from validation")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines in order, nulls among them, and read back by their schema."""
    at = place(spark, "lines")
    records.write_json_lines(read_table(spark, sf_dir, "validation", "task", "mode", "oracle", "nop", "keep", "reason"), at, "task")
    return records.read_json_lines(spark, at, records.VALIDATION_SCHEMA)


@query(f"select case when reason is null then 'kept' else 'dropped' end as output, uuid, module_name, reason from (select uuid, module_name, {_REASON} as reason from kernel_rows)")
def fan_out_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decided table written to a file of kept and one of dropped rows."""
    kept, dropped = place(spark, "kept"), place(spark, "dropped")
    records.write_fan_out(_decided(spark, sf_dir), kept, dropped)
    schema = "uuid bigint, module_name string, reason string"
    both = [records.read_json_lines(spark, at, schema).withColumn("output", F.lit(name)) for name, at in (("kept", kept), ("dropped", dropped))]
    return both[0].unionByName(both[1]).select("output", "uuid", "module_name", "reason")


@query("select distinct lower(trim(entry_point)) as task from kernel_rows where trim(entry_point) <> '' and not regexp_matches(trim(entry_point), '\\s')")
def list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of names, one a line, written and read."""
    at = place(spark, "list")
    names = read_table(spark, sf_dir, "kernel_rows", "entry_point").select(F.lower(F.trim("entry_point")).alias("task")).where("task <> ''").distinct()
    records.write_list(names.where(~F.col("task").rlike(r"\s")), "task", at)
    return records.read_list(spark, at)


@query(rf"select row_number() over (order by task) - 1 as index, task as name, 'tasks/' || task as path from {_KEPT}")
def registry_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of the kept tasks and an empty one, written as one document; the tasks of the first, numbered."""
    at = place(spark, "registry")
    kept = read_table(spark, sf_dir, "validation", "task", "keep").where("keep").select(text.tidy_record_name("task").alias("name")).distinct().withColumn("path", F.concat(F.lit("tasks/"), "name"))
    registry.write_registry(registry.registry(kept, "tasks", "kept tasks").unionByName(registry.registry(kept.limit(0), "none", "no tasks")), at)
    return registry.read_registry(spark, at, "tasks").withColumn("index", F.col("index").cast("long"))


_FOLDER = f"'task-' || case when length(uuid::varchar) < 5 then lpad(uuid::varchar, 5, '0') else uuid::varchar end || '-' || 'unit' || (uuid % 3)"


#: Folders that folder_files has on storage at a time (some 45 KB each with their directories).
_AT_ONCE = 8_000


@query(f"select {_FOLDER} as folder, 'Implement Unit' || (uuid % 3) || 'New.' || chr(10) as instruction, null::varchar as solution, null::varchar as absent, uuid as number, 'Unit' || (uuid % 3) as class_name, true as solvable, '#!/bin/bash' || chr(10) as test from kernel_rows")
def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's folder written to storage and read back: files by name, the TOML description by its schema, and
    result files with their detail.  Storage holds some _AT_ONCE folders at a time, each about eleven blocks of it: when
    they are read they are renamed and written over, all files of them, for the next records."""
    at, spare = (place(spark, name).removeprefix("file://") for name in ("tasks", "spare"))
    waved, kept = place(spark, "waves"), place(spark, "files")
    numbers = read_table(spark, sf_dir, "kernel_rows", "uuid")
    waves = max(1, -(-numbers.count() // _AT_ONCE))
    os.makedirs(spare)
    numbers.withColumn("wave", F.pmod(F.xxhash64("uuid"), F.lit(waves))).repartition("wave").write.partitionBy("wave").parquet(waved)
    placed, cores = spark.read.schema("uuid long, wave long").parquet(waved), spark.sparkContext.defaultParallelism
    for wave in range(waves):
        own = placed.where(F.col("wave") == wave).select("uuid")
        folders.write_folders(pipelines.task_files(made.programs(own.repartition(cores))), at, spare)
        folders.read_files(spark, at).write.mode("append").option("compression", "zstd").parquet(kept)
        os.replace(at, f"{spare}/{wave}")
    shutil.rmtree(spare)
    files = spark.read.schema("folder string, path string, text string").parquet(kept)
    read = folders.read_records(spark, at, [INSTRUCTION_FILE, SOLUTION_FILE, DESCRIPTION_FILE, "absent"], files).repartition(max(waves, cores))  # else few tasks parse all descriptions
    described = F.from_json(registry.json_of_toml(F.col(f"`{DESCRIPTION_FILE}`")), "metadata struct<uuid: bigint, module_name: string>")
    results = folders.read_results(spark, at, SOLVE_SCRIPT, TEST_SCRIPT, files).select("folder", F.startswith("result", F.lit("#!/bin/bash")).alias("solvable"), F.col("detail").alias("test"))
    listed = folders.list_folders(spark, at, files)
    rows = read.select("folder", F.col(f"`{INSTRUCTION_FILE}`").alias("instruction"), F.col(f"`{SOLUTION_FILE}`").alias("solution"), "absent", described.alias("d"))
    return rows.join(listed, "folder").join(results, "folder").select("folder", "instruction", "solution", "absent", F.col("d.metadata.uuid").alias("number"), F.col("d.metadata.module_name").alias("class_name"), "solvable", "test")


# ---- samples -----------------------------------------------------------------------------------------------------

@query("select uuid, module_name from kernel_rows order by uuid limit 100")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_n(read_table(spark, sf_dir, "kernel_rows", "uuid", "module_name"), "uuid", 100)


@query("select uuid from (select uuid from kernel_rows where uuid <> 0 order by sha256('0:' || uuid), uuid limit 20) union all select uuid from kernel_rows where uuid = 0")
def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_draw(read_table(spark, sf_dir, "kernel_rows", "uuid"), "uuid", 20, 0, [0]).select("uuid")


@query("select uuid from kernel_rows order by sha256(uuid || ':7'), uuid limit 60")
def shuffle_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_shuffle(read_table(spark, sf_dir, "kernel_rows", "uuid"), "uuid", 7, 60)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
