"""Token counts: an exact histogram of encoded lengths, and suffix sums that answer for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docsift.llm.common import batch_of, stored

BUCKET = 256  # lengths that one window of the suffix sums holds


def token_lengths(docs: DataFrame, id_column: str, text_column: str, ranks_path: str, pattern: str) -> DataFrame:
    """``doc`` and ``n_tokens`` of every row by a byte-level BPE ranks file; null and empty texts have none.

    The strings of special tokens count as ordinary text. Whole texts are encoded, one at a time.
    """
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(docs[f"`{id_column}`"].alias("doc"), docs[f"`{text_column}`"].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            lengths = [len(encoding.encode_ordinary(text)) if text else 0 for text in batch.column(1).to_pylist()]
            yield batch_of(pa.schema([batch.schema.field(0), ("n_tokens", pa.int64())]), [batch.column(0), lengths])

    return rows.mapInArrow(work, f"doc {dict(rows.dtypes)['doc']}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per length that occurs, with sums over all documents from that length on.

    ``n_tokens``, ``n_docs``; ``docs_at_least`` and ``tokens_at_least``: documents of this length or more and their tokens;
    ``truncated_tokens``: all tokens if every document is cut to this length; ``docs_at_most`` and ``share_at_most``:
    documents of this length or less. Rows with a null length are not counted; an empty table has no rows.

    Documents are counted before the exchange. Sums run over blocks of ``BUCKET`` lengths and then over the blocks,
    so that the longest window has a row per block.
    """
    # stored, as both the lengths and their blocks are made of it: texts are encoded once
    counts = stored(lengths.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    behind = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(behind), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(behind), F.lit(0)).alias("later_tokens"),
        F.sum("block_docs").over(everything).alias("all_docs"),
        F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    suffix = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "all_tokens",
        (F.sum("n_docs").over(suffix) + F.col("later_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(suffix) + F.col("later_tokens")).alias("tokens_at_least"),
    )
    at_most = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return sums.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        at_most.alias("docs_at_most"), (at_most / F.col("all_docs")).alias("share_at_most"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """All tokens if every document is cut to ``limit`` tokens, whether or not that length occurs."""
    shorter = F.when(F.col("n_tokens") <= limit, F.col("n_tokens")).otherwise(limit)
    return histogram.agg(F.sum(shorter * F.col("n_docs"))).head()[0] or 0


def length_quantile(histogram: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of the documents does not exceed; null without documents."""
    return histogram.where(F.col("share_at_most") >= share).agg(F.min("n_tokens")).head()[0]
