"""The queries on training data, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.functions.ids import ref_id, ref_id_sql, strip_sql
from kinsift.llm.groups import group_matches, undirected
from kinsift.llm.mixing import check_mix, draw_mix, quality_weight, reached_shares
from kinsift.llm.packing import check_packing, pack
from kinsift.llm.pieces import check_pieces, split_long
from kinsift.llm.pii import find_pii, redact
from kinsift.llm.spans import shared_runs, shared_share, span_clusters, submissions
from kinsift.llm.splits import assign_roles, check_roles, leaking_entities, pair_components, pair_entities, share_report
from kinsift.llm.tokens import token_count, token_count_sql
from kinsift.llm.top_n import top_n
from kinsift.session import cut, table

CAPACITY = 256
TOP = 10
LIMIT, OVERLAP = 2000, 200


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_components(pair_entities(table(spark, sf_dir, "pairs"), table(spark, sf_dir, "files")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaking_entities(table(spark, sf_dir, "data_splits"), _components(spark, sf_dir))


def p1_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_roles(_components(spark, sf_dir))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share_report(p1_roles(spark, sf_dir))


def p1_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p1_roles: no entity with two roles, no role off its share by the largest component."""
    entities = cut(pair_entities(table(spark, sf_dir, "pairs"), table(spark, sf_dir, "files")))
    return check_roles(cut(assign_roles(pair_components(entities))), entities)


_P1 = f"""
  with f as (select {ref_id_sql("file_id")} as id, min(nullif(lower({strip_sql("author_id")}), '')) as author from files group by 1),
  side as (select dataset_name, row_index, {ref_id_sql("left_id")} as id from pairs union all select dataset_name, row_index, {ref_id_sql("right_id")} from pairs),
  ent as (select distinct dataset_name, row_index, coalesce(f.author, s.id) as entity_id from side s left join f on f.id = s.id where s.id is not null),
  lists as (select name, dataset_name, unnest(train_indices) as row_index, 1 as role from data_splits
    union select name, dataset_name, unnest(validation_indices), 2 from data_splits
    union select name, dataset_name, unnest(test_indices), 3 from data_splits)
  select name, entity_id from lists join ent using (dataset_name, row_index) group by all having count(distinct role) > 1"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_runs(submissions(table(spark, sf_dir, "pairs")))


def p2_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = submissions(table(spark, sf_dir, "pairs"))
    return shared_share(records, shared_runs(records))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submissions that share passages, by connected component."""
    return span_clusters(submissions(table(spark, sf_dir, "pairs")))


_P2_WINDOWS = f"""
  with rec as materialized (select id, min(t) as t from (select {ref_id_sql("left_id")} as id, left_text as t from pairs union all select {ref_id_sql("right_id")}, right_text from pairs)
      where id is not null and t is not null group by 1),
  c as (select id, string_split(t, '') as c, length(t) as n from rec where length(t) >= 120),
  w as materialized (select id, unnest(range(0, n - 119)) as s, unnest(list_transform(range(0, n - 119), lambda i: md5_number_lower(array_to_string(c[i + 1 : i + 120], '')))) as h from c),
  hit as materialized (select id, s, h from w where h in (select h from w group by 1 having min(id) <> max(id))),
  runs as (select id, s, s - coalesce(lag(s) over (partition by id order by s), -1000) > 120 as new from hit),
  num as (select id, s, sum(cast(new as int)) over (partition by id order by s) as run from runs),
  found as (select id as file_id, min(s) as start_pos, max(s) - min(s) + 120 as span_chars from num group by id, run)"""
_P2_CLUSTERS = f"""{_P2_WINDOWS.replace("with rec", "with recursive rec")},
  edge as (select distinct h.id as a, m.id as b from hit h join (select h, min(id) as id from hit group by 1) m using (h)),
  arc as (select a, b from edge union select b, a from edge),
  walk as (select a as file_id, b as seen from arc union select w.file_id, arc.b from walk w join arc on arc.a = w.seen),
  grouped as (select file_id, min(seen) as cluster_id from walk group by 1)
  select file_id, cluster_id, count(*) over (partition by cluster_id) as size from grouped"""
_P2_SHARED = f"""{_P2_WINDOWS}
  select id as file_id, length(t) as n_chars, coalesce(n, 0) as shared_chars, round(coalesce(coalesce(n, 0) / nullif(length(t), 0), 0.0), 6) as share
  from rec left join (select file_id, sum(span_chars) as n from found group by 1) f on f.file_id = rec.id"""


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "pairs")
    # A side's text is the same in all its rows: what is short or empty need not be grouped.
    trimmed = [pairs.where(F.char_length(f"{s}_text") > LIMIT).select(F.col(f"{s}_id").alias("left_id"), F.col(f"{s}_text").alias("left_text"), F.lit(None).cast("string").alias("right_id"), F.lit(None).cast("string").alias("right_text")) for s in ("left", "right")]
    return split_long(submissions(trimmed[0].unionByName(trimmed[1])), LIMIT, OVERLAP)


def p3_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p3_pieces: none too long, each from 200 characters before the last one's end, the text whole."""
    return check_pieces(p3_pieces(spark, sf_dir), submissions(table(spark, sf_dir, "pairs")), LIMIT, OVERLAP)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("piece_no = 1").select("file_id")


_P3 = f"""
  select distinct id as file_id from (select {ref_id_sql("left_id")} as id, left_text as t from pairs union all select {ref_id_sql("right_id")}, right_text from pairs)
  where id is not null and length(t) > {LIMIT}"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = table(spark, sf_dir, "pairs").where("label = 1")
    return group_matches(undirected(matches, "left_id", "right_id")).withColumnRenamed("node", "file_id")


_P7 = f"""
  with recursive edge as (select distinct {ref_id_sql("left_id")} as a, {ref_id_sql("right_id")} as b from pairs
      where label = 1 and {ref_id_sql("left_id")} <> {ref_id_sql("right_id")}),
  arc as (select a, b from edge union select b, a from edge),
  walk as (select distinct a as file_id, a as seen from arc union select w.file_id, arc.b from walk w join arc on arc.a = w.seen)
  select file_id, min(seen) as group_id from walk group by 1"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "queries").select(ref_id("query_id").alias("query_id")).where("query_id is not null").distinct()
    judged = table(spark, sf_dir, "qrels").where("relevance >= 0").select(ref_id("query_id").alias("query_id"), ref_id("document_id").alias("document_id"), "relevance")
    best = top_n(judged, "query_id", "document_id", "relevance", TOP)
    return best.join(asked, "query_id", "left_semi").select("query_id", "document_id")


_P5 = f"""
  select query_id, document_id from (
    select *, row_number() over (partition by query_id order by relevance desc, document_id) as place from (
      select {ref_id_sql("query_id")} as query_id, {ref_id_sql("document_id")} as document_id, max(relevance) as relevance
      from qrels where isfinite(relevance) and relevance >= 0 group by all)
    where document_id is not null and query_id in (select {ref_id_sql("query_id")} from queries))
  where place <= {TOP}"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir), "doc_id", "tokens", CAPACITY)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_containers(spark, sf_dir).where("part_no > 0").select("doc_id").distinct()


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p8_containers: nothing lost, none overfull, no small segment divided, as few as can be."""
    return check_packing(cut(p8_containers(spark, sf_dir)), _sizes(spark, sf_dir), "doc_id", "tokens", CAPACITY)


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least number possible by the tokens, and the share of unused space."""
    packed = p8_containers(spark, sf_dir)
    total = packed.agg(F.sum("tokens").alias("tokens"), F.coalesce(F.max("container_id") + 1, F.lit(0)).alias("containers"))
    return total.select("tokens", "containers", F.ceil(F.col("tokens") / CAPACITY).alias("least"), F.round(1 - F.try_divide(F.col("tokens"), F.col("containers") * CAPACITY), 6).alias("unused"))


def _mix_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens"), quality_weight(F.col("align_score")).alias("weight"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return draw_mix(_mix_input(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id")[0]


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p9_mix: no source above its goal, none a record or more below, no record used too often."""
    return check_mix(*draw_mix(_mix_input(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached_shares(*draw_mix(_mix_input(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws, plan = draw_mix(_mix_input(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id")
    return reached_shares(draws, plan).where("short").select("source")  # short is what the draw came to, not a plan


_P9_GOALS = f"""
  with own as (select lower({strip_sql("source")}) as key, sum({token_count_sql("text")}) as t from documents group by 1),
  both_ as (select m.source, m.target_pct, m.max_repeats, coalesce(o.t, 0) as t from mix_targets m left join own o on o.key = lower({strip_sql("m.source")}))
  select source, least(target_pct * (select sum(t) from both_) // 100, max_repeats * t) as goal, 0 as over, 0 as far, 0 as beyond from both_"""
_P9 = f"""
  with own as (select lower({strip_sql("source")}) as key, sum({token_count_sql("text")}) as t from documents group by 1),
  both_ as (select m.source, m.target_pct, m.max_repeats, coalesce(o.t, 0) as t from mix_targets m left join own o on o.key = lower({strip_sql("m.source")}))
  select source from both_ where 100 * max_repeats * t < target_pct * (select sum(t) from both_)"""



def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_hints")).select("doc_id", "kind", "pii_text").distinct()


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_hints"))


QUERIES = {
    "p1_found": (p1_found, _P1),
    "p1_check": (p1_check, "select dataset_name, count(*) as pairs, 0 as divided, 0 as off from pairs group by 1"),
    "p1_roles": (p1_roles, None),
    "p1_shares": (p1_shares, None),
    "p2_found": (p2_found, f"{_P2_WINDOWS} select * from found"),
    "p2_shared": (p2_shared, _P2_SHARED),
    "p2_clusters": (lambda spark, sf_dir: p2_clusters(spark, sf_dir).drop("links"), _P2_CLUSTERS),
    "p3_found": (p3_found, _P3),
    "p3_pieces": (p3_pieces, None),
    "p3_check": (p3_check, f"""select id as file_id, length(min(t)) as n_chars, 0 as too_long, 0 as apart, true as whole from (select {ref_id_sql("left_id")} as id, left_text as t from pairs
      union all select {ref_id_sql("right_id")}, right_text from pairs) where id is not null and length(t) > {LIMIT} group by 1"""),
    "p7_found": (p7_found, _P7),
    "p5_found": (p5_found, _P5),
    "p8_found": (p8_found, f"select doc_id from documents where {token_count_sql('text')} > {CAPACITY}"),
    "p8_containers": (p8_containers, None),
    "p8_check": (p8_check, f"select sum({token_count_sql('text')}) as tokens, 0 as lost, 0 as overfull, 0 as divided, 0 as beyond_least from documents"),
    "p8_summary": (
        p8_summary,
        f"""select t as tokens, ceil(t / {CAPACITY})::bigint as containers, ceil(t / {CAPACITY})::bigint as least, round(1 - t / (ceil(t / {CAPACITY}) * {CAPACITY}), 6) as unused
          from (select sum({token_count_sql('text')}) as t from documents)""",
    ),
    "p9_found": (p9_found, _P9),
    "p9_mix": (p9_mix, None),
    "p9_check": (p9_check, _P9_GOALS),
    "p9_shares": (p9_shares, None),
    "p10_found": (p10_found, None),
    "p10_redacted": (p10_redacted, None),
}
