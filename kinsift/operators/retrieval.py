"""Ranked retrieval: relevance lookup, ranking, MAP, MRR, precision, recall and nDCG at k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsift.operators import set_blocks
from kinsift.plans.skew import numbered


def judged(qrels: DataFrame) -> DataFrame:
    """(query_id, document_id, relevance): repeated judgements as their maximum."""
    ok = F.col("relevance").isNotNull() & ~F.isnan("relevance") & (F.col("relevance") >= 0) & (F.col("relevance") < float("inf"))
    return qrels.where(ok & F.col("query_id").isNotNull() & F.col("document_id").isNotNull()).groupBy("query_id", "document_id").agg(F.max("relevance").alias("relevance"))


def with_relevance(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """results with `relevance`, 0 where nothing was judged."""
    return results.join(judged(qrels), ["query_id", "document_id"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))


def duplicates(results: DataFrame) -> DataFrame:
    """Result pairs that are there more than once; metrics are not defined on them."""
    return results.groupBy("query_id", "document_id").agg(F.count("*").alias("n")).where("n > 1")


def reject_duplicates(results: DataFrame) -> None:
    bad = duplicates(results).orderBy("query_id", "document_id").limit(5).collect()
    if bad:
        raise ValueError("duplicate results: " + ", ".join(f"({r.query_id}, {r.document_id})" for r in bad))


def ranked(results: DataFrame, score: str = "similarity_score") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("document_id"))
    return results.withColumn("rank", F.row_number().over(order))


def whole_ranks(results: DataFrame, qrels: DataFrame, queries: DataFrame, documents: DataFrame, score: str = "similarity_score") -> DataFrame:
    """(query_id, rank, relevance) of the relevant documents (judged above 0) when every one of queries (query_id,
    unique) is ranked against every one of documents (document_id, unique), and pairs that results doesn't have
    score 0. Scores are at least 0.

    The documents that score 0 follow the others in the order of their ids, so their ranks are counted, not
    formed: what scores above 0, plus the document's place among all ids, less what of it scores above 0. Places
    come from ranges of the document ids."""
    above = results.where(F.col(score) > 0).select("query_id", "document_id", F.col(score).alias("s"))
    wanted = judged(qrels).where("relevance > 0").join(queries.select("query_id"), "query_id", "left_semi")
    places = numbered(documents.select("document_id"), ["document_id"], "place")[0].withColumn("place", F.col("place") + 1)
    wanted = wanted.join(places, "document_id")
    both = above.join(wanted, ["query_id", "document_id"], "full").select("query_id", "document_id", F.coalesce("s", F.lit(0.0)).alias("s"), "relevance", "place")
    met = (F.col("s") > 0).cast("int")
    earlier = Window.partitionBy("query_id").orderBy("document_id").rowsBetween(Window.unboundedPreceding, 0)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("s"), F.asc("document_id"))
    rows = both.withColumn("earlier", F.sum(met).over(earlier)).withColumn("met", F.sum(met).over(Window.partitionBy("query_id"))).withColumn("rank", F.row_number().over(by_score))
    rank = F.when(F.col("s") > 0, F.col("rank")).otherwise(F.col("met") + F.col("place") - F.col("earlier"))
    return rows.where("relevance > 0").select("query_id", rank.alias("rank"), "relevance")


def query_metrics(results: DataFrame, qrels: DataFrame, k: int = 10, score: str = "similarity_score", over: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per query: results, relevant (judged above 0), average precision over all relevant documents, reciprocal
    rank, precision, recall and nDCG at k. Every query with results or judgements counts; one without relevant
    documents or results has 0 throughout. Precision divides by k whatever there is; gains are linear.

    over: (queries, documents), if results leaves out pairs that score 0: the metrics are those of all queries
    against all documents, see whole_ranks()."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = ranked(with_relevance(results, qrels), score) if over is None else whole_ranks(results, qrels, *over, score)
    return _by_query(rows, qrels, k, over and _totals(*over))


def set_metrics(x: set_blocks.Index, qrels: DataFrame, k: int = 10) -> DataFrame:
    """query_metrics() of all left ids of an index of sets against all its right ids, by similarity to 6 decimals."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = set_blocks.ranks(x, judged(qrels).where("relevance > 0"))
    return _by_query(rows, qrels, k, _totals(x.left.select(F.col("id").alias("query_id")), x.right))


def _totals(queries: DataFrame, documents: DataFrame) -> DataFrame:
    return queries.select("query_id").crossJoin(documents.agg(F.count("*").alias("results"))).where("results > 0")


def _by_query(rows: DataFrame, qrels: DataFrame, k: int, totals: DataFrame | None) -> DataFrame:
    """query_metrics() of rows (query_id, rank, relevance). totals: (query_id, results) if rows leaves results out."""
    hit = F.col("relevance") > 0
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hits", F.sum(hit.cast("int")).over(running))
    gain = F.col("relevance") / F.log2(F.col("rank") + 1)
    found = rows.groupBy("query_id").agg(
        F.count("*").alias("results"), F.sum(F.when(hit, F.col("hits") / F.col("rank"))).alias("ap"), F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum((hit & (F.col("rank") <= k)).cast("int")).alias("top"), F.sum(F.when(hit & (F.col("rank") <= k), gain)).alias("dcg"),
    )
    if totals is not None:
        found = totals.join(found.drop("results"), "query_id", "left")
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "document_id")
    ideal = judged(qrels).withColumn("rank", F.row_number().over(best))
    wanted = ideal.groupBy("query_id").agg(F.sum((F.col("relevance") > 0).cast("int")).alias("relevant"), F.sum(F.when((F.col("rank") <= k) & (F.col("relevance") > 0), gain)).alias("idcg"))
    both = found.join(wanted, "query_id", "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "query_id", F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("relevant", F.lit(0)).alias("relevant"),
        zero(F.try_divide(F.col("ap"), F.col("relevant"))).alias("average_precision"), zero(F.lit(1.0) / F.col("first")).alias("reciprocal_rank"),
        zero(F.col("top") / F.lit(float(k))).alias("precision_at_k"), zero(F.try_divide(F.col("top"), F.col("relevant"))).alias("recall_at_k"),
        zero(F.try_divide(F.col("dcg"), F.col("idcg"))).alias("ndcg_at_k"),
    )


def retrieval_metrics(results: DataFrame, qrels: DataFrame, k: int = 10, score: str = "similarity_score", over: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row: counts and the mean of every metric over queries."""
    return averaged(query_metrics(results, qrels, k, score, over))


def averaged(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """query_metrics() as one row (or one a group): counts and means over the queries."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("query_count"), F.sum("results").alias("result_count"), F.sum("relevant").alias("relevant_count"), F.avg("average_precision").alias("map"),
        F.avg("reciprocal_rank").alias("mrr"), F.avg("precision_at_k").alias("precision_at_k"), F.avg("recall_at_k").alias("recall_at_k"), F.avg("ndcg_at_k").alias("ndcg_at_k"),
    )
