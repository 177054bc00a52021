"""Exact duplicates: frequent digests are settled by broadcast, all others by an ordinary shuffle.

Texts are compared by the SHA-256 of their normalised form. A Misra-Gries summary finds the digests that more than
one in ``COUNTERS`` rows has. Blocks of rows are counted exactly; the counters of a block are lowered by the
(COUNTERS + 1)-th largest of them, and those that stay above zero are its summary. Summaries are added up in groups
and lowered again until one is left, so that no step sees more than a bounded number of rows at once and every
digest above the share is in the last summary. Its digests are then counted in full; the verified ones, at most
COUNTERS, travel with the tasks, so that no copy of a frequent text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docsift.llm.common import stored, unwrapped, wrapped

COUNTERS = 4096
BLOCK_ROWS = 1 << 16  # rows of a block of the first summaries
FAN_IN = 16  # summaries added up at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and all else as it is; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    # lower() knows no other letters than A-Z in a text of ASCII only, and is much faster
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _lowered(counts: DataFrame, counters: int) -> DataFrame:
    """The counters of each block, less the (counters + 1)-th largest of the block, as far as they stay above zero."""
    block = Window.partitionBy("block").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    less = F.coalesce(F.nth_value("n", counters + 1).over(block), F.lit(0))
    return counts.select("block", "digest", (F.col("n") - less).alias("n")).where("n > 0")


def frequent_digests(
    rows: DataFrame, total: int, counters: int = COUNTERS, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN
) -> DataFrame:
    """``digest``, at most ``counters`` of them: every one that more than ``total / (counters + 1)`` rows have, and others."""
    blocks = max(1, -(-total // block_rows))
    counts = rows.groupBy(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "digest").agg(F.count("*").alias("n"))
    while True:
        summary = _lowered(counts, counters)
        if blocks == 1:
            return summary.select("digest")
        blocks = -(-blocks // fan_in)
        counts = summary.groupBy(F.floor(F.col("block") / fan_in).alias("block"), "digest").agg(F.sum("n").alias("n"))


def _group() -> dict[str, Column]:
    return {"group_size": F.count("*"), "stays": F.max(F.struct("doc", "row"))}


def _digests(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    rows = docs.select(
        docs[f"`{id_column}`"].alias("doc"), digest_of(docs[f"`{text_column}`"]).alias("digest"), F.monotonically_increasing_id().alias("row")
    )
    return stored(rows, "digests")


def _winners(rows: DataFrame, counters: int, block_rows: int) -> DataFrame:
    """``digest``, ``group_size`` and ``stays`` of the frequent digests: a row for each of at most ``counters``."""
    total = rows.count()
    likely = F.broadcast(frequent_digests(rows, total, counters, block_rows))
    counted = rows.join(likely, "digest", "left_semi").groupBy("digest").agg(*[c.alias(n) for n, c in _group().items()])
    least = max(2, total // (counters + 1) + 1)
    return stored(counted.where(F.col("group_size") >= least), "winners")


def exact_duplicates(
    docs: DataFrame, id_column: str, text_column: str, counters: int = COUNTERS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``doc``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every row.

    Rows are equal if their normalised texts are; of equal rows that with the largest id stays, null ids come last.
    Null texts are empty ones. Of rows equal in id and text one stays, the others go. Other columns are not read.

    A group that no task gets by broadcast has at most one in ``counters`` of all rows. Only ids and digests are
    shuffled.
    """
    rows = _digests(docs, id_column, text_column)
    winners = _winners(rows, counters, block_rows)
    often = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.select(*rows.columns, *[c.over(group).alias(n) for n, c in _group().items()])
    every = often.select(*rest.columns).unionAll(rest)
    return every.select(
        "doc", F.col("stays.doc").alias("keep_id"), "group_size", (F.col("row") == F.col("stays.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_duplicates(
    docs: DataFrame, id_column: str, text_column: str, counters: int = COUNTERS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns. Copies of frequent texts go before anything is shuffled."""
    winners = _winners(_digests(docs, id_column, text_column), counters, block_rows)
    rows = wrapped(docs, doc=id_column, text=text_column).select("row", "doc", digest_of(F.col("text")).alias("digest"))
    stays = winners.select("digest", F.col("stays.doc").alias("stays"), F.lit(True).alias("often"))
    left = rows.join(F.broadcast(stays), "digest", "left").where(F.col("often").isNull() | F.col("doc").eqNullSafe(F.col("stays")))
    first = Window.partitionBy("digest").orderBy(F.desc_nulls_last("doc"))
    return unwrapped(left.withColumn("nth", F.row_number().over(first)).where("nth <= 1"), docs.columns)
