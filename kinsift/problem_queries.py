"""Queries on rows that fail to parse (p4) and on references that do not resolve (p6), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.functions.ids import ref_id_sql, strip_sql
from kinsift.functions.labels import STRICT_NEGATIVE, STRICT_POSITIVE, number_sql
from kinsift.operators.orphans import find_orphans, parents, references
from kinsift.operators.parse_rows import parse_rows, unusable_rows
from kinsift.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unusable_rows(table(spark, sf_dir, "raw_lines")).distinct()


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rows(table(spark, sf_dir, "raw_lines"), "pairs")[0]


def p4_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rows(table(spark, sf_dir, "raw_lines"), "qrels")[0]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels, pairs = table(spark, sf_dir, "qrels"), table(spark, sf_dir, "pairs")
    refs = references(qrels, "qrels", "query_id", "judged_at", "queries")
    refs = refs.unionByName(references(qrels, "qrels", "document_id", "judged_at", "corpus"))
    for side in ("left_id", "right_id"):
        refs = refs.unionByName(references(pairs, "pairs", side, "labelled_at", "files"))
    known = parents(table(spark, sf_dir, "queries"), "query_id", "created_at", None, "queries")
    known = known.unionByName(parents(table(spark, sf_dir, "corpus"), "document_id", "added_at", "removed_at", "corpus"))
    known = known.unionByName(parents(table(spark, sf_dir, "files"), "file_id", "created_at", "deleted_at", "files"))
    return find_orphans(refs, known)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, field and month: how many distinct references do not resolve, by reason."""
    return p6_found(spark, sf_dir).groupBy("table_name", "field_name", "period", "reason").agg(F.count("*").alias("n_refs"))


def _parsed_sql(target: str) -> str:
    quoted = '"[^"]*(?:""[^"]*)*"'
    field = f'(?:{quoted}|[^",]*)'
    return f"""select raw_id, regexp_full_match(body, '(?s){field}(?:,{field})*') as well,
      list_transform(regexp_extract_all(','||body, '(?s),({quoted}|[^",]*)', 1),
        lambda x: case when starts_with(x, '"') then replace(substr(x, 2, length(x)-2), '""', '"') else x end) as f
      from (select raw_id, regexp_replace(coalesce(line, ''), '\\r\\z', '') as body from raw_lines where target = '{target}')"""


def _third(target: str) -> str:
    text = strip_sql("f[3]")
    if target == "qrels":
        return f"case when isfinite({number_sql(text)}) and ({number_sql(text)}) >= 0 then ({number_sql(text)}) end"
    words = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
    return f"""case when lower({text}) in {words(STRICT_POSITIVE)} or ({number_sql(text)}) = 1 then 1
        when lower({text}) in {words(STRICT_NEGATIVE)} or ({number_sql(text)}) = 0 then 0 end"""


def _bad_key(field: str) -> str:
    return rf"""({strip_sql(field)} = '' or contains({field}, '/') or contains({field}, '\'))"""


def _reason(target: str) -> str:
    return f"""case when not well then 'bad_quoting' when len(f) <> 4 then 'column_count'
        when {_bad_key("f[1]")} or {_bad_key("f[2]")} or ({_third(target)}) is null then 'bad_value' end"""


def _usable_sql(target: str, names: tuple[str, str, str, str]) -> str:
    return f"""select raw_id, {strip_sql("f[1]")} as {names[0]}, {strip_sql("f[2]")} as {names[1]}, {_third(target)} as {names[2]}, f[4] as {names[3]}
      from ({_parsed_sql(target)}) where ({_reason(target)}) is null"""


_P4_FOUND = " union ".join(f"select raw_id, {_reason(t)} as reason from ({_parsed_sql(t)}) where ({_reason(t)}) is not null" for t in ("pairs", "qrels"))


def _orphans_sql() -> str:
    refs = []
    for tab, field, time, target, key, born, gone in (
        ("qrels", "query_id", "judged_at", "queries", "query_id", "created_at", "null"),
        ("qrels", "document_id", "judged_at", "corpus", "document_id", "added_at", "removed_at"),
        ("pairs", "left_id", "labelled_at", "files", "file_id", "created_at", "deleted_at"),
        ("pairs", "right_id", "labelled_at", "files", "file_id", "created_at", "deleted_at"),
    ):
        refs.append(f"""
          select distinct '{tab}' as table_name, '{field}' as field_name, coalesce(strftime(r.{time}, '%Y-%m'), 'unknown') as period, r.ref_id,
            case when p.key is null then 'missing' when r.{time} is null then null
              when p.born > r.{time} then 'early' when p.gone <= r.{time} then 'deleted' end as reason
          from (select {ref_id_sql(field)} as ref_id, {time} from {tab}) r
          left join (select {ref_id_sql(key)} as key, min(coalesce({born}, timestamp '0001-01-01')) as born,
              max(coalesce({gone}, timestamp '9999-01-01')) as gone from {target} group by 1) p on p.key = r.ref_id
          where r.ref_id is not null""")
    return "select * from (" + " union all ".join(refs) + ") where reason is not null"


QUERIES = {
    "p4_found": (p4_found, _P4_FOUND),
    "p4_pairs": (p4_pairs, _usable_sql("pairs", ("left_id", "right_id", "label", "problem"))),
    "p4_qrels": (p4_qrels, _usable_sql("qrels", ("query_id", "document_id", "relevance", "comment"))),
    "p6_found": (p6_found, _orphans_sql()),
    "p6_report": (p6_report, f"select table_name, field_name, period, reason, count(*) as n_refs from ({_orphans_sql()}) group by all"),
}
