"""Offset pages of ranked results, and the numbers shown with a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def page_of(ranked: DataFrame, page: int, page_size: int, rank: str = "rank") -> DataFrame:
    """Rows of one page by their global result number."""
    first = (page - 1) * page_size
    return ranked.filter((F.col(rank) > first) & (F.col(rank) <= first + page_size))


def renumber(hits: DataFrame, *order: Column, within: str | None = None, rank: str = "rank") -> DataFrame:
    """Global result numbers of the rows that passed the filters."""
    window = Window.partitionBy(F.col(within) if within else F.lit(0)).orderBy(*order)
    return hits.withColumn(rank, F.row_number().over(window).cast("bigint"))


def page_info(hits: DataFrame, page: int, page_size: int, shown: Column | None = None) -> DataFrame:
    """One row: totals, neighbours and first and last result of a page.

    ``shown`` marks the rows a page may hold; by default all do.
    """
    first = (page - 1) * page_size
    here = F.count("*") if shown is None else F.count_if(shown)
    counts = hits.agg(F.count("*").alias("total_results"), here.alias("__shown"))
    total = F.col("total_results")
    pages = F.when(total > 0, F.ceil(total / page_size)).otherwise(1).cast("bigint")
    filled = F.col("__shown") > first
    big = lambda value: value.cast("bigint")
    return counts.select(
        big(F.lit(page)).alias("current_page"),
        big(F.lit(page_size)).alias("page_size"),
        "total_results",
        pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
        big(F.when(filled, F.lit(first + 1)).otherwise(0)).alias("start_index"),
        big(F.when(filled, F.least(F.lit(first + page_size), total)).otherwise(0)).alias("end_index"),
    )
