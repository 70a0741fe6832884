"""The queries of this subpackage; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table as _read
from ._common import Scratch
from .copies import copy_classes, copy_pairs
from .encode import encode, round_trip
from .leak import passages, proximity
from .neardup import near_duplicate_groups, near_duplicate_pairs
from .overlap import coverage, cross_split_pairs, splits_of
from .parsing import judged, rates, unparsable
from .quality import fitted, kinds, statistics
from .splits import assign_splits, module_group, torn_modules


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_pairs(Scratch(spark, "p1"), _read(spark, sf_dir, "kernel_rows", "uuid", "python_code"), "uuid", "python_code", "uuid_a", "uuid_b")


def p1_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per class of copies, with the number of its copies."""
    rows = copy_classes(Scratch(spark, "p1c"), _read(spark, sf_dir, "kernel_rows", "uuid", "python_code"), "uuid", "python_code")
    return rows.where("id = class_id").select(F.col("id").alias("uuid"), F.col("copies").alias("n_copies")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["python_code", "triton_code"]
    return near_duplicate_pairs(Scratch(spark, "p4"), _read(spark, sf_dir, "kernel_rows", "uuid", *fields), "uuid", fields, "uuid_a", "uuid_b")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with words and its group, named by the group's smallest uuid, with the group's size."""
    fields = ["python_code", "triton_code"]
    scratch = Scratch(spark, "p4g")
    grouped = scratch.table(near_duplicate_groups(scratch, _read(spark, sf_dir, "kernel_rows", "uuid", *fields), "uuid", fields), "groups")
    named = grouped.groupBy("field", "root").agg(F.min("id").alias("group_uuid"), F.count("*").alias("group_size"))
    return grouped.join(named, ["field", "root"]).select(F.col("field").alias("field_name"), F.col("id").alias("uuid"), "group_uuid", "group_size")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["python_code", "triton_code"]
    bad = unparsable(Scratch(spark, "p2"), _read(spark, sf_dir, "kernel_rows", "uuid", *fields), "uuid", fields)
    return bad.select(F.col("field").alias("field_name"), F.col("id").alias("uuid"))


def p2_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: files, files of more than one chunk, and chunks whose maps were composed."""
    fields = ["python_code", "triton_code"]
    files = judged(Scratch(spark, "p2c"), _read(spark, sf_dir, "kernel_rows", "uuid", *fields), "uuid", fields)
    return files.groupBy(F.col("field").alias("field_name")).agg(F.count("*").alias("n_files"), F.count_if(F.col("chunks") > 1).alias("n_cut"), F.sum("chunks").alias("n_chunks"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of refused texts per repository and language (the field)."""
    fields = ["python_code", "triton_code"]
    out = rates(Scratch(spark, "p2r"), _read(spark, sf_dir, "kernel_rows", "uuid", "repo_link", *fields), "uuid", fields, "repo_link")
    return out.withColumnRenamed("source", "repo_link")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, splits = _read(spark, sf_dir, "kernel_rows", "uuid", "python_code"), splits_of(_read(spark, sf_dir, "validation", "task", "split_name"))
    return cross_split_pairs(Scratch(spark, "p3"), rows, "uuid", "python_code", splits, "uuid_a", "uuid_b")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: rows of the split that stand in training too, and their overlapping pairs."""
    scratch = Scratch(spark, "p3c")
    rows = _read(spark, sf_dir, "kernel_rows", "uuid", "python_code", "repo_link")
    splits = splits_of(_read(spark, sf_dir, "validation", "task", "split_name"))
    pairs = scratch.table(cross_split_pairs(scratch, rows, "uuid", "python_code", splits, "a", "b"), "pairs")
    held = pairs.select("split_name", F.explode(F.array("a", "b")).alias("id")).join(splits, ["id", "split_name"])
    source = rows.select(F.col("uuid").alias("id"), F.coalesce(F.nullif(F.trim("repo_link"), F.lit("")), F.lit("(none)")).alias("source"))
    return held.join(source, "id").groupBy("split_name", "source").agg(F.countDistinct("id").alias("n_rows"), F.count("*").alias("n_pairs"))


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, splits = _read(spark, sf_dir, "kernel_rows", "uuid", "python_code"), splits_of(_read(spark, sf_dir, "validation", "task", "split_name"))
    return coverage(Scratch(spark, "p3v"), rows, "uuid", "python_code", splits).withColumnRenamed("id", "uuid")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, splits = _read(spark, sf_dir, "kernel_rows", "uuid", "module_name"), splits_of(_read(spark, sf_dir, "validation", "task", "split_name"))
    return torn_modules(Scratch(spark, "p5"), rows, "uuid", "module_name", splits).withColumnRenamed("id", "uuid")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of each row; rows of one module get the same."""
    rows = _read(spark, sf_dir, "kernel_rows", "uuid", "module_name").withColumn("module_group", module_group("module_name"))
    return assign_splits(Scratch(spark, "p5s"), rows, "uuid", ["module_group"]).select(F.col("id").alias("uuid"), "split")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split, and modules that are torn apart (none)."""
    rows = _read(spark, sf_dir, "kernel_rows", "uuid", "module_name").withColumn("module_group", module_group("module_name"))
    scratch = Scratch(spark, "p5h")
    placed = scratch.table(assign_splits(scratch, rows, "uuid", ["module_group"]), "placed")
    named = placed.join(rows.select(F.col("uuid").alias("id"), "module_group").distinct(), "id")
    torn = named.where("module_group is not null").groupBy("module_group").agg(F.countDistinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("n_torn"))
    return placed.groupBy("split").agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(torn))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(Scratch(spark, "p6"), _read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(Scratch(spark, "p6r"), _read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _leaks(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    return Scratch(spark, name), _read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", _read(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text"


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(*_leaks(spark, sf_dir, "p7")).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that leaked: how many documents hold a passage, and the longest one in words."""
    found = passages(*_leaks(spark, sf_dir, "p7i")).groupBy("item", "id").agg(F.max("length").alias("length"))
    return found.groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("n_docs"), F.max("length").cast("long").alias("longest"))


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches: documents that hold half of an item's terms close together, in any order."""
    return proximity(*_leaks(spark, sf_dir, "p7n")).withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    weights = fitted(docs, "doc_id", "text", _read(spark, sf_dir, "labels", "doc_id", "text_kind"), "doc_id", "text_kind")
    return kinds(docs, "doc_id", "text", weights).withColumnRenamed("id", "doc_id")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(_read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", _read(spark, sf_dir, "common_words", "word"))


_QUERIES = [
    p1_found, p1_copies, p2_found, p2_chunks, p2_rates, p3_found, p3_counts, p3_coverage, p4_found, p4_groups,
    p5_found, p5_splits, p5_shares, p6_ids, p6_round_trip, p7_found, p7_items, p7_near, p8_found, p8_stats,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9_]+')"
_GRAMS = "list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' '))"
_RATIO = "round(({0})::double / nullif({1}, 0), 6)"
_SPLITS = r"(select distinct try_cast(regexp_extract(task, '^\s*[A-Za-z]+[-/](\d+)', 1) as bigint) as uuid, lower(trim(split_name)) as split_name from validation where split_name is not null)"
#: Groups by all pairs that share a run of four words, and the closure of those that are similar enough.
_GROUPS = f"""t as (select field_name, uuid, {_WORDS.format('txt')} as w from (select 'python_code' as field_name, uuid, python_code as txt from kernel_rows union all select 'triton_code', uuid, triton_code from kernel_rows) where txt is not null),
g as (select distinct field_name, uuid, unnest(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: hash(array_to_string(w[i:i + 3], ' ')))) as g from t where len(w) > 0),
n as (select field_name, uuid, count(*) as n from g group by 1, 2),
c as (select a.field_name, a.uuid as x, b.uuid as y, count(*) as shared from g a join g b on a.field_name = b.field_name and a.g = b.g and a.uuid < b.uuid group by 1, 2, 3),
e as (select c.field_name, x, y from c join n a on a.field_name = c.field_name and a.uuid = x join n b on b.field_name = c.field_name and b.uuid = y where shared / (a.n + b.n - shared)::double >= 0.6),
l as (select field_name, x, y from e union all select field_name, y, x from e),
r as (select field_name, uuid, uuid as root from n union select l.field_name, l.y, r.root from r join l on l.field_name = r.field_name and l.x = r.uuid),
groups as (select field_name, uuid, min(root) as root from r group by 1, 2)"""
_OVERLAPS = f"""pairs as (select distinct s.split_name, least(a.uuid, b.uuid) as uuid_a, greatest(a.uuid, b.uuid) as uuid_b
from groups a join groups b on a.field_name = b.field_name and a.root = b.root and a.uuid <> b.uuid join {_SPLITS} s on s.uuid = a.uuid join {_SPLITS} t on t.uuid = b.uuid
where a.field_name = 'python_code' and s.split_name in ('dev', 'test') and t.split_name = 'train')"""
_SQL = {
    "p3_found": f"with recursive {_GROUPS}, {_OVERLAPS} select split_name, uuid_a, uuid_b from pairs",
    "p3_counts": f"""with recursive {_GROUPS}, {_OVERLAPS} select split_name, coalesce(nullif(trim(repo_link), ''), '(none)') as source, count(distinct uuid) as n_rows, count(*) as n_pairs
from (select split_name, unnest([uuid_a, uuid_b]) as uuid from pairs) join {_SPLITS} using (uuid, split_name) join kernel_rows using (uuid) group by 1, 2""",
    "p3_coverage": f"""with w as (select uuid, w || list_transform(range(greatest(8 - len(w), 0)), lambda i: '') as w from (select uuid, {_WORDS.format('python_code')} as w from kernel_rows where python_code is not null) where len(w) > 0),
g as (select uuid, unnest(range(1, len(w) - 6)) as i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as g from w),
h as (select distinct g from g join {_SPLITS} using (uuid) where split_name = 'train'),
c as (select uuid, count(distinct p) as covered from (select uuid, unnest(range(i, i + 8)) as p from g where g in (select g from h)) group by 1)
select uuid, split_name, len(w)::bigint as words, coalesce(covered, 0)::bigint as covered, round(coalesce(covered, 0) / len(w)::double, 6) as share from w join {_SPLITS} using (uuid) left join c using (uuid) where split_name in ('dev', 'test')""",
    "p4_found": f"with recursive {_GROUPS} select a.field_name, a.uuid as uuid_a, b.uuid as uuid_b from groups a join groups b on a.field_name = b.field_name and a.root = b.root and a.uuid < b.uuid",
    "p4_groups": f"with recursive {_GROUPS} select field_name, uuid, root as group_uuid, count(*) over (partition by field_name, root) as group_size from groups",
    "p5_shares": "select split, n_rows, 0::bigint as n_torn from (select count(*) as n, round(count(*) * 0.1)::bigint as k from kernel_rows), lateral (values ('train', n - 2 * k), ('validation', k), ('test', k)) v(split, n_rows)",
    "p6_round_trip": "select doc_id, length(coalesce(text, ''))::bigint as n_chars, true as same from documents",
    "p7_items": f"""with d as (select doc_id, {_WORDS.format('text')} as w from documents), b as (select item_id, {_WORDS.format('text')} as w from benchmark),
dg as (select doc_id, unnest(range(1, len(w) - 10)) as i, unnest({_GRAMS}) as g from d where len(w) >= 12), bg as (select item_id, unnest(range(1, len(w) - 10)) as j, unnest({_GRAMS}) as g from b where len(w) >= 12),
h as (select distinct doc_id, item_id, i - j as off, i from dg join bg using (g)), s as (select *, i - row_number() over (partition by doc_id, item_id, off order by i) as island from h),
l as (select item_id, doc_id, count(*) + 11 as length from s group by doc_id, item_id, off, island)
select item_id, count(distinct doc_id) as n_docs, max(length)::bigint as longest from l group by 1""",
    "p5_found": r"""with s as (select distinct regexp_extract(task, '^\s*[A-Za-z]+[-/](\d+)', 1)::bigint as uuid, split_name from validation where split_name is not null),
k as (select uuid, lower(regexp_replace(module_name, '^\s+|\s+$', '', 'g')) as module_group, split_name from kernel_rows join s using (uuid) where module_name is not null)
select distinct module_group, uuid from k where module_group in (select module_group from k group by 1 having count(distinct split_name) > 1)""",
    "p7_found": f"""with d as (select doc_id, {_WORDS.format('text')} as w from documents), b as (select item_id, {_WORDS.format('text')} as w from benchmark)
select distinct doc_id, item_id from (select doc_id, unnest({_GRAMS}) as g from d where len(w) >= 12) join (select item_id, unnest({_GRAMS}) as g from b where len(w) >= 12) using (g)""",
    "p8_stats": f"""with t as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, {_WORDS.format('t')} as w, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\\s\\v\\x85\\p{{Z}}]+', '', 'g') <> '') as l from t),
c as (select doc_id, count(*) as hits from (select doc_id, unnest(w) as word from w) where word in (select word from common_words) group by 1)
select doc_id, len(w)::bigint as n_words, {_RATIO.format('list_sum(list_transform(w, lambda x: length(x)))', 'len(w)')} as mean_word_length,
{_RATIO.format("length(regexp_replace(t, '[\\s\\v\\x85\\p{Z}\\p{L}\\p{N}]+', '', 'g'))", "length(regexp_replace(t, '[\\s\\v\\x85\\p{Z}]+', '', 'g'))")} as symbol_ratio,
{_RATIO.format("len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;,][\\s\\v\\x85\\p{Z}]*$')))", "len(l)")} as line_end_share,
{_RATIO.format('coalesce(hits, 0)', 'len(w)')} as common_share from w left join c using (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
