"""A stored inverted index of sparse vectors, and the exact best rows by dot product from the blocks that can matter.

The postings of a bucket are cut into levels of falling weight, and levels into blocks of one segment of rows. A search reads levels in
the order of what they can add to a score and stops where all levels left, taken together, cannot lift a row to the
``k``-th best score that is known already. Everything is DataFrame work; no bucket is one task, however common it is. Whole blocks move to
the task of their segment, where the scores of its rows are added up: single postings are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from docsift.operators.neighbours import SCORE_DIGITS, _ranked
from docsift.session import MAX_PUSHED_IDS, written

# A level spans a factor of 2 ** (1 / STEPS); the last one takes all smaller weights.
STEPS, LAST_LEVEL = 4, 47
SEGMENT_ROWS = 8192
# A first look reads at least this many postings of each query.
FIRST_POSTINGS = 4096
# So many levels of queries, each some 50 bytes, are sent to every task; more are joined by a shuffle of postings.
MAX_SENT_LEVELS = 1_000_000
# Levels are read until those left add less than this part of the known score, so that few rows need their vectors.
READ_TO = 0.25
# Sums of doubles differ by their order; scores are compared with this much room.
SLACK = 1e-9


@dataclass(frozen=True)
class TermIndex:
    """``vectors`` (row, doc_id, terms), ``blocks`` (bucket, level, part, postings) and ``levels`` (bucket, level, postings, heaviest)."""

    vectors: DataFrame
    blocks: DataFrame
    levels: DataFrame


def build_term_index(docs: DataFrame, path: str, id_col: str = "doc_id", terms_col: str = "terms") -> TermIndex:
    """Store ``array<struct<bucket,weight>>`` vectors below a new path.

    The buckets of a vector must differ; a weight below zero is an error, one of zero or null is none. Rows without a
    vector are no hits and left out. Rows are numbered, so that repeated and null ids stay rows of their own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(terms_col).alias("terms"))
    rows.filter(F.size("terms") > 0).write.parquet(f"{path}/vectors")
    heavy = F.when(F.col("weight") >= 0, F.col("weight")).when(F.col("weight") < 0, F.raise_error(F.lit("a weight is below zero")))
    level = F.floor(-F.log2("weight") * STEPS)
    entries = (
        spark.read.parquet(f"{path}/vectors")
        .select("row", F.inline("terms").alias("bucket", "weight"))
        .withColumn("weight", heavy.cast("double"))
        .filter("weight > 0")
        .withColumn("level", F.greatest(F.lit(0), F.least(F.lit(LAST_LEVEL), level)).cast("int"))
    )
    sizes = entries.groupBy("bucket", "level").agg(F.count("*").alias("postings"), F.max("weight").alias("heaviest"))
    sizes.write.parquet(f"{path}/levels")
    segments = max(1, -(-spark.read.parquet(f"{path}/vectors").count() // SEGMENT_ROWS))
    part = F.pmod(F.xxhash64("row"), F.lit(segments)).cast("int")
    # Ranges keep the blocks of a bucket side by side, so that a search for a few buckets skips row groups.
    (
        entries.select("bucket", "level", part.alias("part"), "row", "weight")
        .repartitionByRange("bucket", "level", "part")
        .groupBy("bucket", "level", "part")
        .agg(F.collect_list(F.struct("row", "weight")).alias("postings"))
        .sortWithinPartitions("bucket", "level", "part")
        .write.parquet(f"{path}/blocks")
    )
    return open_term_index(spark, path)


def open_term_index(spark: SparkSession, path: str) -> TermIndex:
    return TermIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("vectors", "blocks", "levels")))


def _numbered(queries: DataFrame, query_id: str, query_terms: str) -> DataFrame:
    columns = [F.monotonically_increasing_id().alias("ask"), F.col(query_id).alias("query_id"), F.col(query_terms).alias("terms")]
    return written(queries.select(*columns), "asks")


def _weights(asked: DataFrame) -> DataFrame:
    """``ask, bucket, asked``; entries of one bucket are added up."""
    entries = asked.select("ask", F.inline("terms").alias("bucket", "weight"))
    wanted = F.when(F.col("weight") < 0, F.raise_error(F.lit("a weight is below zero"))).otherwise(F.col("weight")).cast("double")
    return entries.groupBy("ask", "bucket").agg(F.sum(wanted).alias("asked")).filter("asked > 0")


def _levels(index: TermIndex, weights: DataFrame) -> DataFrame:
    """Every level of every asked bucket, with ``upper``, the most that one of its postings adds to a score.

    ``left`` is what this level and all later ones can add together, ``before`` how many postings come earlier.
    """
    found = weights.join(index.levels, "bucket").withColumn("upper", F.col("asked") * F.col("heaviest"))
    own = Window.partitionBy("ask", "bucket").orderBy("level")
    drop = F.col("upper") - F.coalesce(F.lead("upper").over(own), F.lit(0.0))
    order = Window.partitionBy("ask").orderBy(F.col("upper").desc(), "bucket", "level")
    return (
        found.withColumn("drop", drop)
        .withColumn("left", F.sum("drop").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("before", F.coalesce(F.sum("postings").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("drop")
    )


def _postings(index: TermIndex, levels: DataFrame) -> DataFrame:
    """``part, row, weight`` and the columns of ``levels`` for the postings of the given levels of each query.

    Few buckets reach the scan as values, which skips row groups. The blocks are brought to their segments first.
    """
    wanted = levels.select("bucket", "level").distinct()
    buckets = [row[0] for row in wanted.select("bucket").distinct().limit(MAX_PUSHED_IDS + 1).collect()]
    blocks = index.blocks.filter(F.col("bucket").isin(buckets)) if len(buckets) <= MAX_PUSHED_IDS else index.blocks
    blocks = blocks.withColumnRenamed("postings", "listed").join(wanted, ["bucket", "level"], "left_semi").repartition("part")
    few = levels.limit(MAX_SENT_LEVELS + 1).count() <= MAX_SENT_LEVELS
    return blocks.join(F.broadcast(levels) if few else levels, ["bucket", "level"]).select("part", *levels.columns, F.inline("listed"))


def _exact(index: TermIndex, pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """``ask, row, doc_id, score`` of pairs of query and row, from the stored vectors."""
    entries = pairs.select("ask", "row").join(index.vectors, "row").select("ask", "row", "doc_id", F.inline("terms").alias("bucket", "weight"))
    score = F.round(F.sum(F.col("asked") * F.col("weight")), SCORE_DIGITS)
    return entries.join(weights, ["ask", "bucket"]).groupBy("ask", "row", "doc_id").agg(score.alias("score"))


def _known(index: TermIndex, levels: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``ask, known``: the least exact score of the ``k`` rows that look best by the heaviest levels, if there are ``k``."""
    first = _postings(index, levels.filter(F.col("before") < FIRST_POSTINGS))
    partial = first.groupBy("part", "ask", "row").agg(F.sum(F.col("asked") * F.col("weight")).alias("partial"))
    best = Window.partitionBy("ask").orderBy(F.col("partial").desc(), "row")
    top = partial.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    return _exact(index, top, weights).groupBy("ask").agg(F.min("score").alias("known"), F.count("*").alias("n")).filter(F.col("n") >= k)


def _with_needed(levels: DataFrame, known: DataFrame) -> DataFrame:
    """Mark the levels a search has to read. ``rest`` and ``unread``: what the others of the bucket, and of all, can add."""
    needed = F.col("known").isNull() | (F.col("left") >= F.col("known") * READ_TO - SLACK)
    skipped = F.when(~F.col("needed"), F.col("upper"))
    rest = F.coalesce(F.max(skipped).over(Window.partitionBy("ask", "bucket")), F.lit(0.0))
    unread = F.coalesce(F.max(F.when(~F.col("needed"), F.col("left"))).over(Window.partitionBy("ask")), F.lit(0.0))
    marked = levels.join(known.select("ask", "known"), "ask", "left").withColumn("needed", needed)
    return marked.withColumn("rest", rest).withColumn("unread", unread)


def _kth_low(met: DataFrame, k: int) -> DataFrame:
    """``ask, kth``: a score that ``k`` rows reach by what is known of them, if there are ``k``."""
    best = Window.partitionBy("ask").orderBy(F.col("low").desc(), "row")
    top = met.select("ask", "row", "low").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    return top.groupBy("ask").agg(F.min("low").alias("kth"), F.count("*").alias("n")).filter(F.col("n") >= k).select("ask", "kth")


def _plan(index: TermIndex, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The query weights, and every level of every query with what the search makes of it."""
    weights = written(_weights(asked), "ask-weights")
    levels = written(_levels(index, weights), "ask-levels")
    return weights, written(_with_needed(levels, _known(index, levels, weights, k)), "ask-plan")


def read_share(index: TermIndex, queries: DataFrame, k: int, query_id: str = "query_id", query_terms: str = "terms") -> DataFrame:
    """``query_id, levels, levels_read, postings, postings_read``: what a search for the ``k`` best reads of the asked buckets."""
    asked = _numbered(queries, query_id, query_terms)
    _, plan = _plan(index, asked, k)
    read = F.col("needed")
    counts = plan.groupBy("ask").agg(
        F.count("*").alias("levels"), F.count_if(read).alias("levels_read"),
        F.sum("postings").alias("postings"), F.coalesce(F.sum(F.when(read, F.col("postings"))), F.lit(0)).alias("postings_read"),
    )
    return asked.select("ask", "query_id").join(counts, "ask").drop("ask")


def _read_on(index: TermIndex, plan: DataFrame, able: DataFrame) -> DataFrame:
    """``ask`` of the queries whose unread postings are fewer than the entries of the vectors that are left to score."""
    entries, vectors = index.levels.agg(F.sum("postings")).first()[0] or 0, index.vectors.count()
    unread = plan.groupBy("ask").agg(F.coalesce(F.sum(F.when(~F.col("needed"), F.col("postings"))), F.lit(0)).alias("postings"))
    cost = able.groupBy("ask").agg((F.count("*") * F.lit(entries / max(1, vectors))).alias("entries"))
    return unread.join(cost, "ask").filter("postings < entries").select("ask")


def _completed(index: TermIndex, plan: DataFrame, able: DataFrame) -> DataFrame:
    """``ask, row, doc_id, score`` of the rows left, from what is known of them and the postings not read so far."""
    rest = _postings(index, plan.filter("NOT needed").select("ask", "bucket", "level", "asked")).join(able.select("ask", "row"), ["ask", "row"], "left_semi")
    parts = able.unionByName(rest.select("ask", "row", (F.col("asked") * F.col("weight")).alias("low")))
    scored = parts.groupBy("ask", "row").agg(F.round(F.sum("low"), SCORE_DIGITS).alias("score"))
    return scored.join(index.vectors.select("row", "doc_id"), "row").select("ask", "row", "doc_id", "score")


def best_in_term_index(index: TermIndex, queries: DataFrame, k: int, query_id: str = "query_id", query_terms: str = "terms") -> DataFrame:
    """``query_id, doc_id, score, rank`` of the ``k`` highest dot products, ties by id, as ``nearest_terms`` finds them.

    A row that shares no bucket with the query is no hit. A row found in the levels read is scored only if its known
    part and all it may have in unread levels reach the known score: from its vector, or from the unread levels where
    those hold less than the vectors of all such rows.
    """
    asked = _numbered(queries, query_id, query_terms)
    weights, plan = _plan(index, asked, k)
    read = _postings(index, plan.filter("needed").select("ask", "bucket", "level", "asked", "rest"))
    met = read.groupBy("part", "ask", "row").agg(F.sum(F.col("asked") * F.col("weight")).alias("low"), F.sum("rest").alias("seen"))
    bounds = plan.groupBy("ask").agg(F.max("known").alias("known"), F.max("unread").alias("unread"))
    reached = F.col("known").isNull() | (F.col("low") + F.col("unread") - F.col("seen") >= F.col("known") - SLACK)
    met = written(met.join(bounds, "ask").filter(reached).drop("part"), "ask-met")
    able = met.join(_kth_low(met, k), "ask", "left").withColumn("known", F.greatest("known", "kth")).filter(reached)
    able = written(able.select("ask", "row", "low"), "ask-rows")
    late = written(_read_on(index, plan, able), "ask-late")
    scored = _exact(index, able.join(late, "ask", "left_anti"), weights)
    scored = scored.unionByName(_completed(index, plan.join(late, "ask", "left_semi"), able.join(late, "ask", "left_semi")))
    found = asked.select("ask", "query_id").join(scored, "ask").select("query_id", "doc_id", "score")
    return _ranked(found, k, "dot")
