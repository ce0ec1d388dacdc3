"""Queries for the library's operators over whole test tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.functions import strings, text, tokens, vectors, weights
from kinsift.functions.ids import WHITE, WHITE_CLASS, ref_id, ref_id_sql
from kinsift.functions.labels import binary_label, binary_label_sql, relevance_sql, relevance_value
from kinsift.functions.chunks import chunks
from kinsift.operators import classify, code_metrics, compare, datasets, explain, leaderboard, resample, retrieval, set_blocks, validate, winnowing
from kinsift.operators.search import vector_search
from kinsift.session import cut, spread, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(run):
        QUERIES[name or run.__name__] = (run, sql)
        return run

    return add


_WHITE_SQL = "||".join(f"chr({ord(c)})" for c in WHITE)
_LINES = "string_split({0}, chr(10))"


def _newlines(e: str) -> str:
    return rf"regexp_replace(coalesce({e}, ''), '\r\n?', chr(10), 'g')"


def _trimmed(e: str) -> str:
    return f"array_to_string(list_transform({_LINES.format(_newlines(e))}, lambda x: rtrim(x, {_WHITE_SQL})), chr(10))"


def _unblank(e: str) -> str:
    return f"array_to_string(list_filter({_LINES.format(_newlines(e))}, lambda x: rtrim(x, {_WHITE_SQL}) <> ''), chr(10))"


def _collapsed(e: str) -> str:
    return f"trim(regexp_replace(coalesce({e}, ''), '[{WHITE_CLASS}]+', ' ', 'g'), {_WHITE_SQL})"


_STR = r"""`(?:[^`\\]|\\[^\n])*`|"(?:[^"\\]|\\[^\n])*"|''(?:[^''\\]|\\[^\n])*''"""
_NUM = r"\b\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\b"


def _literals(e: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({e}, ''), '{_STR}', ' <STR> ', 'g'), '{_NUM}', ' <NUM> ', 'g')"


_NAME_TOKENS = rf"[A-Za-z_][A-Za-z0-9_]*|<STR>|<NUM>|[^\p{{L}}\p{{N}}_{WHITE_CLASS}]"
_WORDS = "[" + ", ".join(f"'{k}'" for k in text.KEYWORDS) + "]"
_CANON = f"""
  with t as (select file_id, regexp_extract_all(coalesce(text, ''), '{_NAME_TOKENS}') as t from files),
  n as (select file_id, t, list_filter(t, lambda x, i: regexp_matches(x, '^[A-Za-z_]') and not list_contains({_WORDS}, lower(x)) and list_position(t, x) = i) as n from t)
  select file_id, array_to_string(list_transform(t, lambda x: case when not regexp_matches(x, '^[A-Za-z_]') then x
    when list_contains({_WORDS}, lower(x)) then lower(x) else 'id' || list_position(n, x) end), ' ') as out from n"""


def _files_text(name: str, make: Callable, sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "files").select("file_id", make(F.col("text")).alias("out"))

    QUERIES[name] = (run, f"select file_id, {sql} as out from files" if sql and not sql.lstrip().startswith("with") else sql)


_files_text("normalize_newlines", text.normalize_newlines, _newlines("text"))
_files_text("trim_trailing_ws", text.trim_trailing_whitespace, _trimmed("text"))
_files_text("drop_blank_lines", text.drop_blank_lines, _unblank("text"))
_files_text("collapse_whitespace", text.collapse_whitespace, _collapsed("text"))
_files_text("preprocess_none", lambda t: text.preprocess(t, "none"), f"trim({_trimmed('text')}, {_WHITE_SQL})")
_files_text("preprocess_normalize", lambda t: text.preprocess(t, "normalize"), f"trim({_unblank(_trimmed('text'))}, {_WHITE_SQL})")
_files_text("literal_placeholders", text.literal_placeholders, _literals("text"))
_files_text("canonicalize_identifiers", text.canonicalize_identifiers, _CANON)
_files_text("preprocess_basic", lambda t: text.preprocess(t, "basic"), None)
_files_text("preprocess_advanced", lambda t: text.preprocess(t, "advanced"), None)
_files_text("strip_block_comments", text.strip_block_comments, None)
_files_text("strip_line_comments", text.strip_line_comments, None)
_files_text("strip_imports", text.strip_imports, None)

# ---------------------------------------------------------------- tokens
_CODE_SQL = f"regexp_extract_all(coalesce({{{{0}}}}, ''), '{tokens.CODE}')".replace('{{0}}', '{0}')
_TRANX_SQL = r"""list_filter(string_split(translate(regexp_replace(regexp_replace(regexp_replace(coalesce({0}, ''), '([^A-Za-z0-9_])', ' \1 ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '[\s\p{Z}]+', ' ', 'g'), '"''', '``'), ' '), lambda x: x <> '')"""
_SPACE_SQL = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\s\p{Z}]+'), lambda x: x <> '')"


def _doc_tokens(name: str, make: Callable, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = make(F.col("text"))
        return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))

    QUERIES[name] = (run, f"select doc_id, len(t) as n, array_to_string(t, ' ') as tokens from (select doc_id, {sql} as t from documents)")


_doc_tokens("code_tokens", tokens.code_tokens, _CODE_SQL.replace("{0}", "text"))
_doc_tokens("static_tokens", lambda t: tokens.code_tokens(t, True), f"list_transform({_CODE_SQL.replace('{0}', 'text')}, lambda x: lower(x))")
_doc_tokens("tranx_tokens", tokens.tranx_tokens, _TRANX_SQL.replace("{0}", "text"))
_doc_tokens("whitespace_tokens", tokens.whitespace_tokens, _SPACE_SQL.replace("{0}", "text"))


def _grams_sql(t: str, n: int, sep: str = "' '") -> str:
    return f"list_transform(range(1, len({t}) - {n} + 2), lambda i: array_to_string({t}[i:i+{n - 1}], {sep}))"


@_query(f"select doc_id, len(g) as n, array_to_string(g, '|') as grams from (select doc_id, {_grams_sql('t', 3)} as g from (select doc_id, {_CODE_SQL.replace('{0}', 'text')} as t from documents))")
def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tokens.ngrams(tokens.code_tokens("text"), 3)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(g).alias("n"), F.array_join(g, "|").alias("grams"))


@_query(f"select gram, count(*) as n from (select unnest({_grams_sql('t', 2)}) as gram from (select {_CODE_SQL.replace('{0}', 'text')} as t from documents)) group by 1")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tokens.ngrams(tokens.code_tokens("text"), 2)
    return table(spark, sf_dir, "documents").select(F.explode(g).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- strings
_LEV_SQL = "1.0 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))"


@_query(f"select p_partkey, round({_LEV_SQL}, 6) as similarity from part")
def levenshtein_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(strings.levenshtein_similarity("p_name", "p_type"), 6).alias("similarity"))


_NEXT_SQL = "1.0 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))"


@_query(f"select a.p_partkey, round({_NEXT_SQL}, 6) as similarity from part a join part b on b.p_partkey = a.p_partkey + 1 where {_NEXT_SQL} >= 0.5")
def levenshtein_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name with the next one's, where they are at least half equal."""
    part = table(spark, sf_dir, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    least = strings.levenshtein_at_least("p_name", "other", 0.5)
    return part.join(after, "p_partkey").select("p_partkey", F.round(least, 6).alias("similarity")).where("similarity is not null")


@_query("select p_partkey, round(jaro_winkler_similarity(p_name, p_type), 6) as similarity from part")
def jaro_winkler_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(strings.jaro_winkler("p_name", "p_type"), 6).alias("similarity"))


@_query()
def weighted_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(strings.weighted_levenshtein("p_name", "p_type", 3, 1, 2), 6).alias("similarity"))


@_query(f"select p_partkey, round(0.75 * ({_LEV_SQL}) + 0.25 * jaro_winkler_similarity(p_name, p_type), 6) as similarity_score from part")
def weighted_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights.parse_weights("levenshtein=3,jaro_winkler=1")
    columns = {"levenshtein": strings.levenshtein_similarity("p_name", "p_type"), "jaro_winkler": strings.jaro_winkler("p_name", "p_type")}
    return table(spark, sf_dir, "part").select("p_partkey", F.round(weights.blend(w, columns), 6).alias("similarity_score"))


# ---------------------------------------------------------------- winnowing
K, W = 5, 4


def _fps_sql(t: str) -> str:
    kk = f"least({K}, len({t}))"
    grams = f"list_transform(range(1, len({t}) - {kk} + 2), lambda i: md5(array_to_string({t}[i:i+{kk}-1], chr(31))))"
    return f"""case when len({t}) = 0 then [] else (select list_sort(list_distinct(list_transform(range(1, len(h) - least({W}, len(h)) + 2), lambda j: list_min(h[j:j+least({W}, len(h))-1]))))
      from (select {grams} as h)) end"""


_DOC_FPS = f"select doc_id, {_fps_sql('t')} as fps from (select file_id as doc_id, {_CODE_SQL.replace('{0}', 'text')} as t from files)"


def _doc_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "files").select(F.col("file_id").alias("doc_id"), "text")).select("doc_id", winnowing.fingerprints(tokens.code_tokens("text"), K, W).alias("fps"))


@_query(f"select doc_id, len(fps) as n, array_to_string(fps, '') as fps from ({_DOC_FPS})")
def winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_fps(spark, sf_dir).select("doc_id", F.size("fps").alias("n"), F.array_join("fps", "").alias("fps"))


_CLASSES = f"select doc_id, min(doc_id) over (partition by array_to_string(fps, '')) as class_id, fps from ({_DOC_FPS})"
_CLASS_PAIRS = f"""
  with d as materialized (select distinct class_id as doc_id, fps from ({_CLASSES})), v as materialized (select doc_id, len(fps) as n, unnest(fps) as f from d)
  select a.doc_id as left_id, b.doc_id as right_id, count(*) / (a.n + b.n - count(*)) as similarity
  from v a join v b on a.f = b.f and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n"""
SIMILAR = 0.8


@_query(f"select doc_id, class_id from ({_CLASSES})")
def winnowing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.classes(_doc_fps(spark, sf_dir), "doc_id", "fps")[0]


@_query(f"select left_id, right_id, round(similarity, 6) as similarity from ({_CLASS_PAIRS}) where similarity >= {SIMILAR} - 1e-12")
def winnowing_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = winnowing.classes(_doc_fps(spark, sf_dir), "doc_id", "fps")[1]
    return winnowing.similar_classes(reps, SIMILAR).withColumn("similarity", F.round("similarity", 6))


@_query(f"select left_id, right_id, round(similarity, 6) as similarity from ({_CLASS_PAIRS}) where similarity >= 0.5 - 1e-12 order by round(similarity, 6) desc, left_id, right_id limit 10")
def winnowing_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar pairs of classes of files."""
    reps = winnowing.classes(_doc_fps(spark, sf_dir), "doc_id", "fps")[1]
    return winnowing.best_pairs(winnowing.most_similar(reps, 10).withColumn("similarity", F.round("similarity", 6)), 10)


@_query()
def winnowing_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = strings.blake_fingerprints(tokens.code_tokens("text"))
    return table(spark, sf_dir, "files").select("file_id", F.array_join(fps, "").alias("fps"))


# ---------------------------------------------------------------- vectors
_V = "(select vec_id as id, cast(embedding as double[]) as e from embeddings)"
_VECTOR_SQL = {
    "cosine": "list_cosine_similarity(q.e, v.e)",
    "dot": "list_inner_product(q.e, v.e)",
    "euclidean": "-list_distance(q.e, v.e)",
    "manhattan": "-list_sum(list_transform(range(1, len(q.e) + 1), lambda i: abs(q.e[i] - v.e[i])))",
}


def _vector_query(function: str, normalized: bool) -> None:
    raw = _VECTOR_SQL[function]
    score = raw if not normalized else f"greatest(0, least(1, {raw}))" if function in ("cosine", "dot") else f"1 / (1 - ({raw}))"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        return vector_search(v, v.where("id % 20 = 0"), 10, function, normalized)

    QUERIES[f"{function}_search{'_normalized' if normalized else ''}"] = (
        run,
        f"""select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
          select q.id as query_id, v.id as vec_id, round({score}, 6) + 0.0 as score from {_V} q, {_V} v where q.id % 20 = 0)) where rank <= 10""",
    )


for _f in vectors.FUNCTIONS:
    for _n in (False, True):
        _vector_query(_f, _n)

#: Five neighbouring vectors as the chunks of one document.
_CHUNKS = "select vec_id // 5 as id, list(cast(embedding as double[]) order by vec_id) as m from embeddings group by 1"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("id"), "vec_id", "embedding")
    own = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))  # five rows each
    return own.select("id", F.transform("x", lambda s: s["embedding"]).alias("m"))


@_query(f"""
  with c as ({_CHUNKS}), p as (select a.id as left_id, b.id as right_id, a.m as x, b.m as y from c a join c b on b.id = a.id + 1),
  r as (select left_id, right_id, unnest(x) as e, y from p)
  select left_id, right_id, round(avg(list_max(list_transform(y, lambda s: list_cosine_similarity(e, s)))), 6) as similarity from r group by all""")
def maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chunks(spark, sf_dir)
    both = c.select(F.col("id").alias("left_id"), F.col("m").alias("x"), (F.col("id") + 1).alias("right_id")).join(c.select(F.col("id").alias("right_id"), F.col("m").alias("y")), "right_id")
    return both.select("left_id", "right_id", F.round(vectors.max_sim("x", "y"), 6).alias("similarity"))


def _chunk_query(how: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _chunks(spark, sf_dir).select("id", F.posexplode(vectors.aggregate_chunks("m", how)).alias("dim", "value")).withColumn("value", F.round("value", 6))

    QUERIES[f"chunk_agg_{how}"] = (run, f"select id, d - 1 as dim, round({sql}, 6) as value from (select id, m, unnest(range(1, len(m[1]) + 1)) as d from ({_CHUNKS}))")


_chunk_query("mean", "list_avg(list_transform(m, lambda v: v[d]))")
_chunk_query("max", "list_max(list_transform(m, lambda v: v[d]))")
_chunk_query("first", "m[1][d]")


_HEX = "0123456789ABCDEF"
_CRC_TABLE = """with recursive r as (select i::bigint as i, 0 as k, i::bigint as v from range(256) t(i) union all
    select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from r where k < 8),
  tab as materialized (select list(v order by i) as tab from r where k = 8)"""
_CRC = f"""{_CRC_TABLE},
  tok as materialized (select doc_id, unnest(list_transform({_CODE_SQL.replace('{0}', 'text')}, lambda x: lower(x))) as t from documents),
  word as materialized (select t, hex(encode(t)) as h from (select distinct t from tok)),
  bytes as (select t, list_transform(range(0, length(h) // 2), lambda i: (strpos('{_HEX}', substr(h, i * 2 + 1, 1)) - 1) * 16 + strpos('{_HEX}', substr(h, i * 2 + 2, 1)) - 1) as b from word),
  crc as materialized (select t, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(b, lambda x: x::bigint)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 64 as dim from bytes, tab),
  n as (select doc_id, dim, count(*) as c from tok join crc using (t) group by all)
  select doc_id, dim, round(c / sqrt(sum(c * c) over (partition by doc_id)), 9) as value from n"""


@_query(_CRC)
def static_hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(vectors.hash_vector("text", 64)).alias("dim", "value")).where("value > 0").withColumn("value", F.round("value", 9))


# ---------------------------------------------------------------- labelled pairs
_SCORED = f"""
  select dataset_name, row_index, {ref_id_sql("left_id")} as left_id, {ref_id_sql("right_id")} as right_id, label,
    round(case when len(x) = 0 and len(y) = 0 then 1.0 else len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) end, 6) as score
  from (select *, {_fps_sql('lt')} as x, {_fps_sql('rt')} as y from (select *, {_CODE_SQL.replace('{0}', 'left_text')} as lt, {_CODE_SQL.replace('{0}', 'right_text')} as rt from pairs
    where label in (0, 1) and left_text is not null and right_text is not null))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pairs").where("label in (0, 1) and left_text is not null and right_text is not null")
    x, y = (winnowing.fingerprints(tokens.code_tokens(f"{s}_text"), K, W) for s in ("left", "right"))
    fps = spread(rows).select("dataset_name", "row_index", ref_id("left_id").alias("left_id"), ref_id("right_id").alias("right_id"), "label", x.alias("x"), y.alias("y"))
    return fps.select("dataset_name", "row_index", "left_id", "right_id", "label", F.round(winnowing.jaccard(F.col("x"), F.col("y")), 6).alias("score"))


QUERIES["score_pairs"] = (_scored, _SCORED)


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_RATIOS = """coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0) as accuracy"""


def _confusion_sql(by: str, threshold: float, source: str, op: str = ">=") -> str:
    head = f"{by}, " if by else ""
    return f"""select {head}pair_count, tp, fp, tn, fn, {_r("precision", "recall", "f1", "accuracy")}, cast({threshold} as double) as threshold from (select *, {_RATIOS} from (
      select {head}count(*) as pair_count, count_if(score {op} {threshold} and label = 1) as tp, count_if(score {op} {threshold} and label = 0) as fp,
        count_if(not score {op} {threshold} and label = 0) as tn, count_if(not score {op} {threshold} and label = 1) as fn from ({source}) {f"group by {by}" if by else ""}))"""


_FOUR = ("precision", "recall", "f1", "accuracy")


@_query(_confusion_sql("", 0.5, _SCORED))
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(classify.confusion(classify.checked(_scored(spark, sf_dir)), 0.5), *_FOUR)


@_query(_confusion_sql("", 0.3, _SCORED, "<="))
def lower_is_match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(classify.confusion(classify.checked(_scored(spark, sf_dir)), 0.3, greater=False), *_FOUR)


@_query(_confusion_sql("dataset_name", 0.5, _SCORED))
def pair_metrics_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(classify.confusion(_scored(spark, sf_dir), 0.5, by=["dataset_name"]), *_FOUR)


_ENDS = "(select min(score) as lo, max(score) as hi, greatest(case when min(score) = max(score) then abs(min(score)) else max(score) - min(score) end * 1e-12, 1e-12) as m from s)"
_AT = f"""select threshold, ps as positive_count, ns as negative_count, tp, fp, ns - fp as tn, ps - tp as fn from (
  select threshold, (select count_if(label = 1) from s) as ps, (select count_if(label = 0) from s) as ns,
    coalesce((select sum(label) from s where score >= threshold), 0) as tp, coalesce((select sum(1 - label) from s where score >= threshold), 0) as fp from marks)"""
_MARKS = f"select distinct score as threshold from s union select lo - m from {_ENDS} union select hi + m from {_ENDS}"
_MIDDLES = "union select (score + nxt) / 2 from (select score, lead(score) over (order by score) as nxt from (select distinct score from s)) where nxt is not null"
_SWEEP = f"with s as materialized ({_SCORED}), marks as ({_MARKS} {_MIDDLES}), at_ as ({_AT})"
_CURVE = f"with s as materialized ({_SCORED}), marks as ({_MARKS}), at_ as ({_AT})"


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("threshold", F.round("threshold", 9))


@_query(f"{_SWEEP} select round(threshold, 9) as threshold, positive_count, negative_count, tp, fp, tn, fn, {_r(*_FOUR)} from (select *, {_RATIOS} from at_)")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(_round(classify.threshold_sweep(classify.checked(_scored(spark, sf_dir))), *_FOUR))


@_query(f"{_CURVE} select round(threshold, 9) as threshold, tp, fp, round(tp / positive_count, 6) as tpr, round(fp / negative_count, 6) as fpr from at_")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _key(_round(classify.roc_curve(classify.checked(_scored(spark, sf_dir))), "tpr", "fpr").select("threshold", "tp", "fp", "tpr", "fpr"))


@_query(f"""with s as ({_SCORED}), r as (select label, rank() over (order by score) as lo, count(*) over (partition by score) as same from s)
  select round((sum(case when label = 1 then lo + (same - 1) / 2 end) - count_if(label = 1) * (count_if(label = 1) + 1) / 2) / (count_if(label = 1) * count_if(label = 0)), 6) as auroc,
  count_if(label = 1) as positive_count, count_if(label = 0) as negative_count from r""")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(classify.auroc(classify.checked(_scored(spark, sf_dir))), "auroc")


@_query(f"{_CURVE} select round(threshold, 9) as threshold, tp + fp as predicted_positive, round(precision, 6) as precision, round(recall, 6) as recall from (select *, {_RATIOS} from at_)")
def precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.precision_recall_curve(classify.checked(_scored(spark, sf_dir))).select("threshold", "predicted_positive", "precision", "recall")
    return _key(_round(out, "precision", "recall"))


@_query(f"""{_CURVE}, p as (select *, {_RATIOS} from at_), d as (select threshold, precision, recall - coalesce(lag(recall) over (order by threshold desc), 0) as step from p)
  select round(sum(greatest(step, 0) * precision), 6) as average_precision from d""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(classify.average_precision(classify.checked(_scored(spark, sf_dir))), "average_precision")


def _best_query(metric: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _key(_round(classify.best_threshold(classify.checked(_scored(spark, sf_dir)), metric), *_FOUR))

    QUERIES[f"best_threshold_{metric}"] = (
        run,
        f"""{_SWEEP} select round(threshold, 9) as threshold, positive_count, negative_count, tp, fp, tn, fn, {_r(*_FOUR)}, (select count(*) from marks) as candidate_count, '{metric}' as optimized_metric
          from (select *, {_RATIOS} from at_) order by at_.{metric} desc, at_.precision desc, at_.recall desc, at_.accuracy desc, at_.threshold desc limit 1""".replace("from (select *, " + _RATIOS + " from at_)", f"from (select *, {_RATIOS} from at_) at_"),
    )


for _m in classify.METRICS:
    _best_query(_m)

# ---------------------------------------------------------------- labels and relevance of raw records
_RAW = "split_part(coalesce(line, ''), ',', 3)"


def _label_query(vocabulary: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = F.split_part(F.coalesce("line", F.lit("")), F.lit(","), F.lit(3))
        return table(spark, sf_dir, "raw_lines").select("raw_id", binary_label(raw, vocabulary).alias("label"))

    QUERIES[f"label_coercion_{vocabulary}"] = (run, f"select raw_id, {binary_label_sql(_RAW, vocabulary)} as label from raw_lines")


for _v in ("strict", "adapter", "validator"):
    _label_query(_v)


@_query(f"select raw_id, {relevance_sql(_RAW)} as relevance from raw_lines")
def relevance_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.split_part(F.coalesce("line", F.lit("")), F.lit(","), F.lit(3))
    return table(spark, sf_dir, "raw_lines").select("raw_id", relevance_value(raw).alias("relevance"))


# ---------------------------------------------------------------- retrieval
_FILE_FPS = f"select id, {_fps_sql('t')} as fps from (select {ref_id_sql('file_id')} as id, {_CODE_SQL.replace('{0}', 'text')} as t from files where text is not null)"
_FILE_RAW = f"select id, {_fps_sql('t')} as fps from (select file_id as id, {_CODE_SQL.replace('{0}', 'text')} as t from files where text is not null)"
_RESULTS = f"""
  with f as materialized ({_FILE_FPS}),
  qs as materialized (select {ref_id_sql("query_id")} as query_id, fps from queries join f on f.id = {ref_id_sql("file_id")}),
  ds as materialized (select {ref_id_sql("document_id")} as document_id, fps from corpus join f on f.id = {ref_id_sql("file_id")}),
  met as (select query_id, document_id, count(*) as c from (select query_id, unnest(fps) as v from qs) join (select document_id, unnest(fps) as v from ds) using (v) group by all)
  select q.query_id, d.document_id, round(case when len(q.fps) = 0 and len(d.fps) = 0 then 1.0 else coalesce(c, 0) / (len(q.fps) + len(d.fps) - coalesce(c, 0)) end, 6) as similarity_score
  from qs q cross join ds d left join met on met.query_id = q.query_id and met.document_id = d.document_id"""


def _index(spark: SparkSession, sf_dir: str) -> set_blocks.Index:
    """The queries and the corpus documents whose file has a text, by their files' fingerprints."""
    files = spread(table(spark, sf_dir, "files").where("text is not null").select("file_id", "text")).select(ref_id("file_id").alias("item"), winnowing.fingerprints(tokens.code_tokens("text"), K, W).alias("fps"))
    q = table(spark, sf_dir, "queries").select(ref_id("query_id").alias("id"), ref_id("file_id").alias("item"))
    d = table(spark, sf_dir, "corpus").select(ref_id("document_id").alias("id"), ref_id("file_id").alias("item"))
    return set_blocks.index(files, q, d)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query's file against every corpus file, those that share no fingerprint at 0."""
    return set_blocks.scores(_index(spark, sf_dir))


QUERIES["retrieval_scores"] = (_results, _RESULTS)
_QRELS = f"""select {ref_id_sql("query_id")} as query_id, {ref_id_sql("document_id")} as document_id, max(relevance) as relevance from qrels
  where isfinite(relevance) and relevance >= 0 and {ref_id_sql("query_id")} is not null and {ref_id_sql("document_id")} is not null group by 1, 2"""


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qrels").select(ref_id("query_id").alias("query_id"), ref_id("document_id").alias("document_id"), "relevance")


@_query(_QRELS)
def qrels_max_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.judged(_qrels(spark, sf_dir))


_PER_QUERY = f"""
  with res as materialized ({_RESULTS}), j as materialized ({_QRELS}),
  r as (select res.*, coalesce(j.relevance, 0) as relevance, row_number() over (partition by query_id order by similarity_score desc, document_id) as rank from res left join j using (query_id, document_id)),
  h as (select *, sum(cast(relevance > 0 as int)) over (partition by query_id order by rank) as hits from r),
  found as (select query_id, count(*) as results, sum(case when relevance > 0 then hits / rank end) as ap, min(case when relevance > 0 then rank end) as first,
    count_if(relevance > 0 and rank <= 10) as top, sum(case when relevance > 0 and rank <= 10 then relevance / log2(rank + 1) end) as dcg from h group by 1),
  i as (select *, row_number() over (partition by query_id order by relevance desc) as rank from j),
  want as (select query_id, count_if(relevance > 0) as relevant, sum(case when rank <= 10 and relevance > 0 then relevance / log2(rank + 1) end) as idcg from i group by 1),
  q as (select query_id, coalesce(results, 0) as results, coalesce(relevant, 0) as relevant, coalesce(ap / nullif(relevant, 0), 0) as average_precision, coalesce(1 / first, 0) as reciprocal_rank,
    coalesce(top / 10, 0) as precision_at_k, coalesce(top / nullif(relevant, 0), 0) as recall_at_k, coalesce(dcg / nullif(idcg, 0), 0) as ndcg_at_k from found full join want using (query_id))"""
_FIVE = ("average_precision", "reciprocal_rank", "precision_at_k", "recall_at_k", "ndcg_at_k")


@_query(f"{_PER_QUERY} select query_id, results, relevant, {_r(*_FIVE)} from q")
def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(retrieval.set_metrics(_index(spark, sf_dir), _qrels(spark, sf_dir), k=10), *_FIVE)


@_query(f"""{_PER_QUERY} select count(*) as query_count, sum(results) as result_count, sum(relevant) as relevant_count, round(avg(average_precision), 6) as map,
  round(avg(reciprocal_rank), 6) as mrr, {", ".join(f"round(avg({c}), 6) as {c}" for c in _FIVE[2:])} from q""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(retrieval.averaged(retrieval.set_metrics(_index(spark, sf_dir), _qrels(spark, sf_dir), k=10)), "map", "mrr", *_FIVE[2:])


# ---------------------------------------------------------------- code metrics
def _text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pairs").where("left_text is not null and right_text is not null"))


_UNIT = "chr(31)"
_TRIVIAL = " union all ".join(
    f"""select {n} as n, ngram, count, rank from (select *, row_number() over (order by count desc, doc, pos) as rank from (
      select ngram, count(*) as count, arg_min(doc, {{'d': doc, 'p': pos}}) as doc, arg_min(pos, {{'d': doc, 'p': pos}}) as pos from (
        select file_id as doc, unnest({_grams_sql('t', n, _UNIT)}) as ngram, unnest(range(0, greatest(len(t) - {n} + 1, 0))) as pos from (select file_id, {_CODE_SQL.replace('{0}', 'text')} as t from files)) group by 1)) where rank <= 50"""
    for n in range(1, 5)
)


def _trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "files").select("file_id", "text")).select("file_id", tokens.code_tokens("text").alias("t"))
    return code_metrics.trivial_ngrams(docs, "file_id", "t", 4, 50)


QUERIES["crystalbleu_trivial_ngrams"] = (_trivial, _TRIVIAL)


def _gram_counts_sql(tok: str) -> str:
    """(dataset_name, row_index, n, g, a, b): counts of every n-gram on the left and the right."""
    parts = []
    for n in range(1, 5):
        for side, a, b in (("left", 1, 0), ("right", 0, 1)):
            parts.append(f"select dataset_name, row_index, {n} as n, unnest({_grams_sql('t', n, _UNIT)}) as g, {a} as a, {b} as b from (select dataset_name, row_index, {tok.replace('{0}', side + '_text')} as t from p)")
    return f"select dataset_name, row_index, n, g, sum(a) as a, sum(b) as b from ({' union all '.join(parts)}) group by all"


_P = "p as materialized (select * from pairs where left_text is not null and right_text is not null)"


def _lengths_sql(tok: str) -> str:
    return f"select dataset_name, row_index, len({tok.replace('{0}', 'left_text')}) as la, len({tok.replace('{0}', 'right_text')}) as lb from p"


_CRYSTAL = f"""
  with {_P}, triv as materialized ({_TRIVIAL}), c as materialized ({_gram_counts_sql(_CODE_SQL)}), l as ({_lengths_sql(_CODE_SQL)}),
  f as (select c.* from c left join triv on triv.n = c.n and triv.ngram = c.g where triv.n is null),
  s as (select dataset_name, row_index, n, sum(b) as whole, sum(least(a, b)) as common from f group by all),
  k as (select l.*, x.n, coalesce(s.whole, 0) as whole, coalesce(s.common, 0) as common from l cross join (select unnest([1, 2, 3, 4]) as n) x left join s using (dataset_name, row_index, n)),
  z as (select dataset_name, row_index, la, lb, min(case when whole > 0 and common = 0 then 0 else 1 end) as ok, sum(case when whole = 0 then ln(1e-12) when common = 0 then 0 else ln(common / whole) end) / 4 as lg from k group by all)
  select dataset_name, row_index, round(case when la = 0 or lb = 0 or ok = 0 then 0.0 else (case when lb > la then 1.0 else exp(1 - la / lb) end) * exp(lg) end, 6) as score from z"""


@_query(_CRYSTAL)
def crystalbleu_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = code_metrics.crystalbleu(tokens.code_tokens("left_text"), tokens.code_tokens("right_text"), _trivial(spark, sf_dir))
    return _text_pairs(spark, sf_dir).select("dataset_name", "row_index", F.round(score, 6).alias("score"))


_RUBY = f"""
  with {_P}, c as materialized ({_gram_counts_sql(_CODE_SQL)}), l as ({_lengths_sql(_CODE_SQL)}),
  s as (select dataset_name, row_index, n, 2 * sum(least(a, b)) / (sum(a) + sum(b)) as f1 from c group by all),
  m as (select dataset_name, row_index, avg(f1) as v from s group by all)
  select dataset_name, row_index, round(case when la = 0 and lb = 0 then 1.0 when la = 0 or lb = 0 then 0.0 else v end, 6) as score from l left join m using (dataset_name, row_index)"""


@_query(_RUBY)
def ruby_ngram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = code_metrics.ruby_ngram(tokens.code_tokens("left_text"), tokens.code_tokens("right_text"))
    return _text_pairs(spark, sf_dir).select("dataset_name", "row_index", F.round(score, 6).alias("score"))


def _bleu_sql(weight: str) -> str:
    return f"""
  with {_P}, c as materialized ({_gram_counts_sql(_SPACE_SQL)}), l as ({_lengths_sql(_SPACE_SQL)}),
  s as (select dataset_name, row_index, n, sum(least(a, b) * {weight}) as above, greatest(1.0, sum(b * {weight})) as below from c group by all),
  k as (select l.*, x.n, coalesce(s.above, 0) as above, coalesce(s.below, 1.0) as below from l cross join (select unnest([1, 2, 3, 4]) as n) x left join s using (dataset_name, row_index, n)),
  z as (select dataset_name, row_index, la, lb, min(case when n = 1 and above = 0 then 0 else 1 end) as ok, sum(ln((case when above = 0 then 0.1 else above end) / below)) / 4 as lg from k group by all)
  select dataset_name, row_index, round(case when ok = 0 or lb = 0 then 0.0 else (case when lb > la then 1.0 else exp(1 - la / lb) end) * exp(lg) end, 6) as score from z"""


@_query(_bleu_sql("1.0"))
def bleu_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = code_metrics.bleu(tokens.whitespace_tokens("left_text"), tokens.whitespace_tokens("right_text"))
    return _text_pairs(spark, sf_dir).select("dataset_name", "row_index", F.round(score, 6).alias("score"))


def _weighted_bleu(language: str) -> None:
    words = "[" + ", ".join(f"'{k}'" for k in sorted(code_metrics.keywords_of(language))) + "]"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        score = code_metrics.weighted_bleu(tokens.whitespace_tokens("left_text"), tokens.whitespace_tokens("right_text"), code_metrics.keywords_of(language))
        return _text_pairs(spark, sf_dir).select("dataset_name", "row_index", F.round(score, 6).alias("score"))

    QUERIES[f"weighted_bleu_{language}"] = (run, _bleu_sql(f"(case when n > 1 or list_contains({words}, g) then 1.0 else 0.2 end)"))


for _l in ("java", "python"):
    _weighted_bleu(_l)


@_query()
def gst_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = strings.gst(tokens.code_tokens("left_text"), tokens.code_tokens("right_text"))
    return _text_pairs(spark, sf_dir).select("dataset_name", "row_index", F.round(score, 6).alias("score"))


@_query()
def ruby_string_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = strings.ruby_string(tokens.tranx_tokens("left_text"), tokens.tranx_tokens("right_text"))
    return _text_pairs(spark, sf_dir).select("dataset_name", "row_index", F.round(score, 6).alias("score"))


# ---------------------------------------------------------------- resampling
_FOLDS = f"select *, ntile(5) over (order by dataset_name, row_index) as fold from ({_SCORED})"


@_query(_confusion_sql("fold", 0.5, _FOLDS))
def kfold_unshuffled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(classify.confusion(resample.unshuffled_folds(_scored(spark, sf_dir), ["dataset_name", "row_index"], 5), 0.5, by=["fold"]), *_FOUR)


def _by_dataset(threshold: float) -> str:
    return _confusion_sql("dataset_name", threshold, _SCORED)


_SUMMARY = ("mean", "std", "standard_error", "min", "median", "max", "ci_lower", "ci_upper")


@_query(
    f"with d as materialized ({_by_dataset(0.5)}) "
    + " union all ".join(
        f"""select '{m}' as metric, count(*) as count, round(avg({m}), 6) as mean, round(coalesce(stddev_samp({m}), 0), 6) as std, round(coalesce(stddev_samp({m}), 0) / sqrt(count(*)), 6) as standard_error,
        round(min({m}), 6) as min, round(quantile_cont({m}, 0.5), 6) as median, round(max({m}), 6) as max, round(quantile_cont({m}, 0.025), 6) as ci_lower, round(quantile_cont({m}, 0.975), 6) as ci_upper from d"""
        for m in ("accuracy", "f1")
    )
)
def metric_summary_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _round(classify.confusion(_scored(spark, sf_dir), 0.5, by=["dataset_name"]), *_FOUR)
    return _round(resample.metric_summary(rows, ["accuracy", "f1"]), *_SUMMARY)


_PAIRED = f"""with a as ({_by_dataset(0.5)}), b as ({_by_dataset(0.3)}), p as (select a.accuracy as x, b.accuracy as y, b.accuracy - a.accuracy as d from a join b using (dataset_name)),
  c as (select count(*) as count, avg(x) as baseline_mean, avg(y) as candidate_mean, avg(d) as mean_difference, quantile_cont(d, 0.5) as median_difference, quantile_cont(d, 0.025) as ci_lower, quantile_cont(d, 0.975) as ci_upper,
    count_if(d > 0) as win_count, count_if(d < 0) as loss_count, count_if(d = 0) as tie_count from p)
  select *, coalesce(win_count / nullif(win_count + loss_count, 0), 0) as improvement_rate,
    case when win_count + loss_count = 0 then 1.0 else least(1.0, 2 * list_sum(list_transform(range(0, cast(least(win_count, loss_count) + 1 as bigint)),
      lambda k: factorial(cast(win_count + loss_count as int)) / (factorial(cast(k as int)) * factorial(cast(win_count + loss_count - k as int))))) / pow(2, win_count + loss_count)) end as sign_test_p_value,
    case when ci_lower > 0 then 'candidate_better' when ci_upper < 0 then 'baseline_better' else 'inconclusive' end as conclusion from c"""
_PAIRED_COLUMNS = ("baseline_mean", "candidate_mean", "mean_difference", "median_difference", "ci_lower", "ci_upper", "improvement_rate", "sign_test_p_value")


@_query(f"select * replace ({', '.join(f'round({c}, 6) as {c}' for c in _PAIRED_COLUMNS)}) from ({_PAIRED})")
def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by data set at two thresholds, as paired samples."""
    scored = cut(_scored(spark, sf_dir))
    a, b = (_round(classify.confusion(scored, t, by=["dataset_name"]), "accuracy").select("dataset_name", F.col("accuracy").alias(n)) for t, n in ((0.5, "at_50"), (0.3, "at_30")))
    return _round(resample.compare_samples(a.join(b, "dataset_name"), "at_50", "at_30"), *_PAIRED_COLUMNS)


@_query()
def bootstrap_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics on the labelled pairs that 20 bootstrap draws leave out."""
    scored = resample.bootstrap_left_out(cut(_scored(spark, sf_dir)), ["dataset_name", "row_index"], 20, seed=7)
    return _round(classify.confusion(scored, 0.5, by=["split"]), *_FOUR)


def _retrieval_folds() -> str:
    parts = f"{_PER_QUERY}, named as (select query_id, ntile(5) over (order by query_id) as fold from (select distinct query_id from res))"
    return f"""{parts} select 'fold_' || fold as split, count(*) as query_count, sum(results) as result_count, sum(relevant) as relevant_count, round(avg(average_precision), 6) as map,
      round(avg(reciprocal_rank), 6) as mrr, {", ".join(f"round(avg({c}), 6) as {c}" for c in _FIVE[2:])} from q join named using (query_id) group by 1"""


@_query(_retrieval_folds())
def retrieval_resamples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking metrics on five unshuffled folds of the queries."""
    metrics = retrieval.set_metrics(_index(spark, sf_dir), _qrels(spark, sf_dir), k=10)
    return _round(resample.evaluate_query_folds(metrics, 5), "map", "mrr", *_FIVE[2:])


@_query(f"""{_SWEEP}, best as (select threshold, round(f1, 6) as f1 from (select *, {_RATIOS} from at_) order by f1 desc, precision desc, recall desc, accuracy desc, threshold desc limit 1),
  ranks as (select label, rank() over (order by score) as lo, count(*) over (partition by score) as same from s),
  area as (select round((sum(case when label = 1 then lo + (same - 1) / 2 end) - count_if(label = 1) * (count_if(label = 1) + 1) / 2) / (count_if(label = 1) * count_if(label = 0)), 6) as auroc from ranks)
  select (select count(*) from s) as pair_count, round(threshold, 9) as threshold, f1, auroc, (select count(*) from marks) as candidate_count from best, area""")
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = classify.calibration_report(classify.checked(_scored(spark, sf_dir)))
    return _key(_round(report["summary"], "f1", "auroc")).select("pair_count", "threshold", "f1", "auroc", "candidate_count")


# ---------------------------------------------------------------- leaderboards
_THRESHOLDS = (0.3, 0.5, 0.7)
_BOARD = " union all ".join(
    f"select 'pairs' as task_family, dataset_name, 'winnowing@{t}' as algorithm_name, '{m}' as metric, {m} as score, pair_count as sample_count from ({_by_dataset(t)})" for t in _THRESHOLDS for m in ("f1", "accuracy")
)


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cut(_scored(spark, sf_dir))
    out = None
    for t in _THRESHOLDS:
        rows = _round(classify.confusion(scored, t, by=["dataset_name"]), *_FOUR)
        long = rows.select(
            F.lit("pairs").alias("task_family"), "dataset_name", F.lit(f"winnowing@{t}").alias("algorithm_name"),
            F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in ("f1", "accuracy")])), F.col("pair_count").alias("sample_count"),
        )
        out = long if out is None else out.unionByName(long)
    return out


@_query(f"select *, rank() over (partition by task_family, dataset_name, metric order by score desc nulls last) as rank from ({_BOARD})")
def leaderboard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.ranked(_board(spark, sf_dir))


_AGG = f"""select task_family, algorithm_name, metric, round(avg(score), 6) as mean_score, round(median(score), 6) as median_score, count(distinct dataset_name) as dataset_count, sum(sample_count) as sample_count from ({_BOARD}) group by all"""


@_query(f"select *, rank() over (partition by task_family, metric order by mean_score desc nulls last) as rank from ({_AGG})")
def leaderboard_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(leaderboard.aggregated(_board(spark, sf_dir)), "mean_score", "median_score")


@_query(f"""select run_name, count(*) as pair_count, round(avg(s), 4) as mean_score, round(median(s), 4) as median_score, round(max(s), 4) as max_score, round(min(s), 4) as min_score,
  round(stddev_pop(s), 4) as std_score, max({{'s': s, 'l': left_id, 'r': right_id}}).l as top_left, max({{'s': s, 'l': left_id, 'r': right_id}}).r as top_right
  from (select dataset_name as run_name, score as s, left_id, right_id from ({_SCORED}) where left_id is not null and right_id is not null) group by 1""")
def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _scored(spark, sf_dir).where("left_id is not null and right_id is not null").select(F.col("dataset_name").alias("run_name"), "left_id", "right_id", F.col("score").alias("similarity_score"))
    return leaderboard.suite_summary(runs)


_RUNS = f"""select case when algorithm_name = 'winnowing@0.3' then 'run-a' when algorithm_name = 'winnowing@0.5' then 'run-b' else 'run-c' end as run_id,
  case when algorithm_name = 'winnowing@0.3' then '2024-01-02' when algorithm_name = 'winnowing@0.5' then '2024-01-01' else '2024-01-03' end as created_at, task_family, metric, mean_score from ({_AGG})"""


@_query(f"""with r as ({_RUNS}) select r.run_id, r.created_at, r.task_family, 'winnowing' as algorithm_name, r.metric, r.mean_score, b.run_id as baseline_run, b.mean_score as baseline_score,
  round(r.mean_score - b.mean_score, 6) as delta from r left join (select * from r where run_id = 'run-b') b using (task_family, metric)""")
def registry_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = _round(leaderboard.aggregated(_board(spark, sf_dir)), "mean_score")
    name = F.col("algorithm_name")
    pick = lambda a, b, c: F.when(name == "winnowing@0.3", a).when(name == "winnowing@0.5", b).otherwise(c)
    runs = agg.select(pick("run-a", "run-b", "run-c").alias("run_id"), pick("2024-01-02", "2024-01-01", "2024-01-03").alias("created_at"), "task_family", F.lit("winnowing").alias("algorithm_name"), "metric", "mean_score")
    return _round(leaderboard.compare_runs(runs), "delta")


# ---------------------------------------------------------------- data sets
@_query(f"select id as file_id, count(*) as pair_count from (select distinct dataset_name, row_index, unnest([{ref_id_sql('left_id')}, {ref_id_sql('right_id')}]) as id from pairs) where id is not null group by 1")
def pair_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.pair_file_counts(table(spark, sf_dir, "pairs"))


@_query(f"""select file_id, case bit_or(r) when 1 then 'query' when 2 then 'document' else 'both' end as role from
  (select {ref_id_sql("file_id")} as file_id, 1 as r from queries union all select {ref_id_sql("file_id")}, 2 from corpus) where file_id is not null group by 1""")
def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.file_roles(table(spark, sf_dir, "queries"), table(spark, sf_dir, "corpus"))


@_query("select dataset_name, count_if(label = 1) as positive_count, count_if(label = 0) as negative_count from pairs group by 1")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.class_counts(table(spark, sf_dir, "pairs"))


_ADAPTED = f"""with rows as (select *, row_number() over (order by dataset_name, row_index) - 1 as pos, {binary_label_sql('cast(label as varchar)', 'adapter')} as y from pairs),
  good as (select *, {ref_id_sql("left_id")} as li, {ref_id_sql("right_id")} as ri from rows where y is not null),
  side as (select pos, 0 as side, li as id, left_text as text from good where coalesce(nullif(left_id, ''), nullif(left_text, '')) is not null and coalesce(nullif(right_id, ''), nullif(right_text, '')) is not null
    union all select pos, 1, ri, right_text from good where coalesce(nullif(left_id, ''), nullif(left_text, '')) is not null and coalesce(nullif(right_id, ''), nullif(right_text, '')) is not null),
  keyed as (select *, case when id is not null then 'id' when text is not null then 'text' end as kind, coalesce(id, text) as value from side),
  f as (select kind, value, arg_min(case when kind = 'id' then 'source' when side = 0 then 'left' else 'right' end, pos * 2 + side) || '_' || substr(sha1(value), 1, 16) as file_id,
    arg_min({{'t': text}}, pos * 2 + side).t as text from keyed where kind is not null group by 1, 2),
  named as (select k.pos, k.side, f.file_id from keyed k join f using (kind, value))"""


@_query(f"{_ADAPTED} select l.file_id as left_id, r.file_id as right_id, y as label, pos as row_index from good join (select * from named where side = 0) l using (pos) join (select * from named where side = 1) r using (pos)")
def adapter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.adapt_pairs(table(spark, sf_dir, "pairs"), order=["dataset_name", "row_index"])[1]


@_query(f"{_ADAPTED} select file_id, text from f")
def adapter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.adapt_pairs(table(spark, sf_dir, "pairs"), order=["dataset_name", "row_index"])[0].select("file_id", "text")


_JUDGED = f"""with rows as (select *, row_number() over (order by dataset_name, row_index) - 1 as pos, {relevance_sql('cast(label as varchar)')} as y from pairs),
  good as (select *, {ref_id_sql("left_id")} as qi, {ref_id_sql("right_id")} as di from rows where y is not null),
  side as (select pos, 0 as side, qi as id, left_text as text from good union all select pos, 1, di, right_text from good),
  keyed as (select *, case when id is not null then 'id' || side when text is not null then 'text' end as kind, coalesce(id, text) as value from side),
  f as (select kind, value, arg_min(case when side = 0 then 'query' else 'document' end, pos * 2 + side) || '_' || substr(sha1(value), 1, 16) as file_id from keyed where kind is not null group by 1, 2),
  named as (select k.pos, k.side, k.id, f.file_id from keyed k join f using (kind, value)),
  typed as (select g.pos, y, coalesce(q.id, 'query_' || substr(sha1(q.file_id), 1, 16)) as query_id, q.file_id as qf, coalesce(d.id, 'document_' || substr(sha1(d.file_id), 1, 16)) as document_id, d.file_id as df
    from good g join (select * from named where side = 0) q using (pos) join (select * from named where side = 1) d using (pos))"""


def _judged_pairs(part: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return datasets.adapt_retrieval(table(spark, sf_dir, "pairs"), order=["dataset_name", "row_index"])[part]

    QUERIES[f"adapter_retrieval_{part}"] = (run, f"{_JUDGED} {sql}")


_judged_pairs("queries", "select query_id, arg_min(qf, pos) as file_id from typed group by 1")
_judged_pairs("corpus", "select document_id, arg_min(df, pos) as file_id from typed group by 1")
_judged_pairs("qrels", "select query_id, document_id, max(y) as relevance from typed group by 1, 2")


@_query(f"""select query_id, document_id, max(relevance) as relevance from (select {ref_id_sql("query_id")} as query_id, {ref_id_sql("document_id")} as document_id, {relevance_sql("cast(relevance as varchar)")} as relevance from qrels)
  where query_id is not null and document_id is not null and relevance is not null group by all""")
def adapter_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.adapt_qrels(table(spark, sf_dir, "qrels"))


@_query("""select 'q' as dataset_name, 'q__' || query_id as query_id, 'q__' || file_id as file_id, null::varchar as document_id from queries
  union all select 'c', null, 'c__' || file_id, 'c__' || document_id from corpus""")
def merge_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = datasets.merge_tables({"q": table(spark, sf_dir, "queries").select("query_id", "file_id")}, ["query_id", "file_id"])
    c = datasets.merge_tables({"c": table(spark, sf_dir, "corpus").select("document_id", "file_id")}, ["document_id", "file_id"])
    return q.unionByName(c, allowMissingColumns=True)


def _key_issues_sql(tab: str, key: str) -> list[str]:
    return [
        f"select 'error' as severity, 'missing_ids' as code, '{tab}' as table_name, count(*) as count from {tab} where {key} is null",
        f"select 'error', 'blank_ids', '{tab}', count(*) from {tab} where {key} is not null and {ref_id_sql(key)} is null",
        f"select 'error', 'duplicate_ids', '{tab}', coalesce(sum(n), 0) from (select count(*) as n from {tab} where {ref_id_sql(key)} is not null group by {ref_id_sql(key)} having count(*) > 1)",
    ]


def _unknown_sql(tab: str, field: str, parent: str, key: str, code: str) -> str:
    return f"select 'error', '{code}', '{tab}', count(*) from {tab} where {ref_id_sql(field)} is not null and {ref_id_sql(field)} not in (select {ref_id_sql(key)} from {parent} where {ref_id_sql(key)} is not null)"


_L, _R = ref_id_sql("left_id"), ref_id_sql("right_id")
_STRICT = binary_label_sql("cast(label as varchar)", "strict")
_PAIR_ISSUES = [
    *_key_issues_sql("files", "file_id"),
    "select 'warning', 'empty_files', 'files', count(*) from files where coalesce(length(text), 0) = 0",
    f"select 'warning', 'duplicate_pairs', 'pairs', coalesce(sum(n), 0) from (select count(*) as n from pairs where {_L} is not null and {_R} is not null group by least({_L}, {_R}), greatest({_L}, {_R}) having count(*) > 1)",
    "select 'error', 'missing_pair_labels', 'pairs', count(*) from pairs where label is null",
    f"select 'error', 'invalid_pair_labels', 'pairs', count(*) from pairs where label is not null and ({_STRICT}) is null",
    _unknown_sql("pairs", "left_id", "files", "file_id", "unknown_pair_file_ids"), _unknown_sql("pairs", "right_id", "files", "file_id", "unknown_pair_file_ids"),
    f"select 'warning', 'single_class_labels', 'pairs', cast((select count(distinct {_STRICT}) from pairs) = 1 as int)",
]
_BAD_REL = "relevance is null or not isfinite(relevance) or relevance < 0"
_RETRIEVAL_ISSUES = [
    *_key_issues_sql("files", "file_id"), *_key_issues_sql("queries", "query_id"), *_key_issues_sql("corpus", "document_id"),
    f"select 'error', 'duplicate_qrels', 'qrels', coalesce(sum(n), 0) from (select count(*) as n from qrels where {ref_id_sql('query_id')} is not null and {ref_id_sql('document_id')} is not null group by {ref_id_sql('query_id')}, {ref_id_sql('document_id')} having count(*) > 1)",
    f"select 'error', 'invalid_qrel_relevance', 'qrels', count(*) from qrels where {_BAD_REL}",
    f"select 'warning', 'no_positive_qrels', 'qrels', cast((select count(*) from qrels where not ({_BAD_REL}) and relevance > 0) = 0 as int)",
    _unknown_sql("queries", "file_id", "files", "file_id", "unknown_query_file_ids"), _unknown_sql("corpus", "file_id", "files", "file_id", "unknown_corpus_file_ids"),
    _unknown_sql("qrels", "query_id", "queries", "query_id", "unknown_qrel_query_ids"), _unknown_sql("qrels", "document_id", "corpus", "document_id", "unknown_qrel_document_ids"),
]


def _issues_sql(parts: list[str]) -> str:
    return f"select severity, code, table_name, sum(count) as count from ({' union all '.join(parts)}) group by all having sum(count) > 0"


@_query(_issues_sql(_PAIR_ISSUES))
def validation_issues_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.pair_issues(table(spark, sf_dir, "files"), table(spark, sf_dir, "pairs"))


@_query(_issues_sql(_RETRIEVAL_ISSUES))
def validation_issues_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.retrieval_issues(*(table(spark, sf_dir, t) for t in ("files", "queries", "corpus", "qrels")))


# ---------------------------------------------------------------- whole runs
_NORMAL = f"trim({_unblank(_trimmed('text'))}, {_WHITE_SQL})"
_FILE_GRAMS = " union all ".join(f"select id, {n} as n, unnest({_grams_sql('t', n, _UNIT)}) as g from f" for n in range(1, 5))
_EVALUATED = f"""
  with f as materialized (select id, t, {_fps_sql('t')} as fps from (select {ref_id_sql("file_id")} as id, {_CODE_SQL.replace('{0}', '(' + _NORMAL + ')')} as t from files)),
  g as materialized (select id, n, g, count(*) as c from ({_FILE_GRAMS}) group by all),
  tot as (select id, n, sum(c) as c from g group by all),
  p as (select row_number() over () as k, dataset_name, {ref_id_sql("left_id")} as l, {ref_id_sql("right_id")} as r, label from pairs where label in (0, 1)),
  pj as materialized (select p.*, a.fps as af, b.fps as bf, len(a.t) as la, len(b.t) as lb from p join f a on a.id = p.l join f b on b.id = p.r),
  both_ as (select k, a.n, sum(least(a.c, b.c)) as c from pj join g a on a.id = pj.l join g b on b.id = pj.r and b.n = a.n and b.g = a.g group by all),
  x as (select k, n.n, coalesce(ta.c, 0) + coalesce(tb.c, 0) as whole from pj cross join (select unnest([1, 2, 3, 4]) as n) n left join tot ta on ta.id = pj.l and ta.n = n.n left join tot tb on tb.id = pj.r and tb.n = n.n),
  ruby as (select x.k, avg(2 * coalesce(both_.c, 0) / x.whole) as v from x left join both_ on both_.k = x.k and both_.n = x.n where x.whole > 0 group by 1)
  select dataset_name, label, round((2 * (case when len(af) = 0 and len(bf) = 0 then 1.0 else len(list_intersect(af, bf)) / (len(af) + len(bf) - len(list_intersect(af, bf))) end)
    + case when la = 0 and lb = 0 then 1.0 when la = 0 or lb = 0 then 0.0 else v end) / 3, 6) as score from pj left join ruby using (k)"""


@_query(_confusion_sql("dataset_name", 0.5, _EVALUATED))
def evaluate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs scored by two features at once and measured by data set."""
    files = table(spark, sf_dir, "files").select(ref_id("file_id").alias("file_id"), "text")
    pairs = table(spark, sf_dir, "pairs").where("label in (0, 1)").select("dataset_name", ref_id("left_id").alias("left_id"), ref_id("right_id").alias("right_id"), "label")
    o = compare.Options(feature_weights="winnowing=2,code_metric=1", code_metric="ruby", ruby_mode="ngram", preprocess_mode="normalize")
    scored = compare.score_pairs(files, pairs, o).withColumn("score", F.round("similarity_score", 6))
    return _round(classify.confusion(scored, 0.5, by=["dataset_name"]), *_FOUR)


@_query(f"""with f as materialized ({_FILE_RAW}),
  met as (select l, r, count(*) as c from (select id as l, unnest(fps) as v from f) join (select id as r, unnest(fps) as v from f) using (v) where l < r group by all),
  scored as (select a.id as l, b.id as r, case when len(a.fps) = 0 and len(b.fps) = 0 then 1.0 else coalesce(c, 0) / (len(a.fps) + len(b.fps) - coalesce(c, 0)) end as s
    from f a join f b on a.id < b.id left join met on met.l = a.id and met.r = b.id)
  select l as file_name_1, r as file_name_2, round(s, 4) as similarity_score from scored where s >= 0.5 order by s desc, l desc, r desc limit 10""")
def compare_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files").where("text is not null").select(F.col("file_id").alias("file_name"), F.col("text").alias("code"))
    return compare.compare_collection(files, compare.Options(feature_weights={"winnowing": 1.0}), threshold=0.5, number_results=10)


@_query()
def pair_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching lines of every pair, whatever its label."""
    rows = table(spark, sf_dir, "pairs").select(F.concat_ws("/", "dataset_name", "row_index").alias("pair_id"), "left_text", "right_text")
    return explain.explain_pairs(rows)


@_query()
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.project(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


@_query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks("text", "sentence", 40)).alias("chunk_no", "chunk"))
