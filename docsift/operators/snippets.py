"""Matching snippets: every occurrence of a query in a text, grouped and ranked."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Set

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from docsift.functions.text import WINDOW, extract_keywords

# Grouping key and scores.
KEY_CHARS = 50
MAX_SNIPPETS = 3
PHRASE_SCORE, TOP_KEYWORD_SCORE, BASE_SCORE, SCORE_SPAN = 1.0, 0.95, 0.5, 0.45
# A task holds windows of about so many characters; then they are handed on.
BATCH_CHARS = 2_000_000
# A hit is decided in a task while it has so few rows, by their characters (ROW_CHARS at least for each), and so few window starts.
HELD_CHARS, ROW_CHARS, HELD_STARTS = 8_000_000, 1000, 200_000
_FOUND = [("keyword_count", IntegerType()), ("needle_no", IntegerType()), ("position", IntegerType()), ("term", StringType()), ("snippet", StringType())]
_FOUND_ARROW = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]


def _windows(text: str, lowered: str, query: str, needles: list[str], starts: Set[str] | None = None) -> Iterator[tuple[int, int, int, str, str]]:
    """Every occurrence of every needle with its window, in the order of ``_FOUND``; positions are those in ``lowered``.

    With ``starts``, only those whose window starts like one of them.
    """
    for number, needle in enumerate(needles):
        term = needle if number else query
        for hit in re.finditer(re.escape(needle), lowered):
            at = hit.start()
            begin = max(0, at - WINDOW)
            if starts is None or text[begin : begin + KEY_CHARS] in starts:
                yield len(needles) - 1, number, at, term, text[begin : at + len(term) + WINDOW]


def _rank(group: list[int]) -> tuple[float, int, int]:
    """The order of :func:`ranked_snippets`, for the needle and position of the first occurrence, keyword hits and keywords."""
    needle_no, position, count, keywords = group
    score = min(TOP_KEYWORD_SCORE, BASE_SCORE + count / keywords * SCORE_SPAN) if needle_no else PHRASE_SCORE
    return -score, needle_no, position


def _best_starts(rows: list[tuple[str, str, str, list[str]]], best: int) -> Set[str] | None:
    """The window starts that rank among the ``best`` of a hit, given by all its rows; None if there are too many to hold.

    Starts that tie with the last one are kept, too.
    """
    groups: dict[str, list[int]] = {}
    for phrase in (True, False):
        if len(groups) >= best:
            break  # a keyword ranks after every phrase
        for text, lowered, _, needles in rows:
            keywords = len(needles) - 1
            for number in (0,) if phrase else range(1, len(needles)):
                for hit in re.finditer(re.escape(needles[number]), lowered):
                    at = hit.start()
                    begin = max(0, at - WINDOW)
                    start = text[begin : begin + KEY_CHARS]
                    group = groups.get(start)
                    if group is None:
                        if len(groups) == HELD_STARTS:
                            return None
                        groups[start] = [number, at, int(number > 0), keywords]
                        continue
                    group[:2] = min(group[:2], [number, at])
                    group[2] += number > 0
                    group[3] = max(group[3], keywords)
    last = max(heapq.nsmallest(best, map(_rank, groups.values())), default=None)
    return {start for start, group in groups.items() if _rank(group) <= last}


def _texts(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[tuple[pa.RecordBatch, int, tuple]]:
    """Each row with a text: its batch, its number there, and what :func:`_windows` takes, from column ``first`` (from the end) on."""
    for batch in batches:
        columns = batch.columns[first:][:4]
        for row in range(batch.num_rows):
            if columns[0][row].is_valid:
                yield batch, row, tuple(column[row].as_py() for column in columns)


def _decided(batches: Iterator[pa.RecordBatch], best: int) -> Iterator[tuple[pa.RecordBatch, int, tuple, Set[str] | None]]:
    """The rows as by :func:`_texts`, each with the window starts that rank among the ``best`` of its hit.

    The rows of a hit come one after another, with their number as one more column. Those of a hit
    too large to be held come without starts, so that all its windows are handed on.
    """
    held, left, chars, too_large = [], 0, 0, False
    for batch, row, asked in _texts(batches, -5):
        if not left:
            left, chars, too_large = batch.columns[-1][row].as_py(), 0, False
        left -= 1
        chars += max(len(asked[0]), ROW_CHARS)
        held.append((batch, row, asked))
        too_large = too_large or (left > 0 and chars > HELD_CHARS)
        if left and not too_large:
            continue
        starts = None if too_large else _best_starts([one for _, _, one in held], best)
        for one in held:
            yield *one, starts
        held = []


def _found(batches: Iterator[pa.RecordBatch], best: int | None = None) -> Iterator[pa.RecordBatch]:
    """Keys and then text, lower-cased text, query and needles, made into keys and occurrences.

    With ``best``, the rows and the occurrences of :func:`_decided`.
    """
    batch, owners, found, chars = None, [], [], 0

    def rows() -> pa.RecordBatch:
        keys = batch.select(range(batch.num_columns - (4 if best is None else 5)))
        columns = [key.take(pa.array(owners, pa.int64())) for key in keys.columns]
        columns += [pa.array(values, kind) for values, kind in zip(zip(*found), _FOUND_ARROW)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys.schema.names, *[name for name, _ in _FOUND]])

    asked_rows = ((*one, None) for one in _texts(batches, -4)) if best is None else _decided(batches, best)
    for of, row, asked, starts in asked_rows:
        if found and of is not batch:
            yield rows()
            owners, found, chars = [], [], 0
        batch = of
        for one in _windows(*asked, starts):
            owners.append(row)
            found.append(one)
            chars += len(one[-1])
            if chars >= BATCH_CHARS:
                yield rows()
                owners, found, chars = [], [], 0
    if found:
        yield rows()


def occurrences(hits: DataFrame, keys: list[str], text: Column, query: Column, best: int | None = None) -> DataFrame:
    """One row per occurrence of the whole query (``needle_no`` 0) or a keyword.

    Positions are those in the lower-cased text; the window is cut from the
    text as it is. A query without keywords has no occurrences. Windows are many
    times the text, so a task hands them on in small batches; a text has no list of its windows.

    With ``best``, only the occurrences in windows that :func:`ranked_snippets` ranks among so many of a hit,
    those that tie with the last included. The texts are dealt by ``keys`` for that, as a hit may have several rows; the
    windows, many times their size, are not. A hit too large to be decided in one task keeps all its occurrences.
    """
    needles = F.concat(F.array(F.lower(query)), extract_keywords(query))
    asked = hits.select(*keys, text.alias("__text"), query.alias("__query"), needles.alias("__needles")).filter(F.size("__needles") > 1)
    columns = [*keys, "__text", F.lower("__text"), "__query", "__needles"]
    if best is not None:
        asked = asked.filter(F.col("__text").isNotNull()).withColumn("__rows", F.count("*").over(Window.partitionBy(*keys)))
        columns.append("__rows")
    schema = StructType([*asked.select(*keys).schema.fields, *[StructField(name, kind) for name, kind in _FOUND]])
    found = asked.select(*columns).mapInArrow(lambda batches: _found(batches, best), schema)
    return found.withColumn("snippet_key", F.substring("snippet", 1, KEY_CHARS))


def ranked_snippets(found: DataFrame, keys: list[str]) -> DataFrame:
    """The best three snippets of each hit, one row each with ``snippet_rank``.

    Occurrences are combined per window start before anything is ranked, so a
    text with very many hits is spread over its windows. A phrase match wins
    over keyword matches of the same start.
    """
    order = F.struct("needle_no", "position")
    is_phrase = F.col("needle_no") == 0
    keyword_only = F.when(~is_phrase, order)
    groups = found.groupBy(*keys, "snippet_key").agg(
        F.max("keyword_count").alias("__keywords"),
        F.bool_or(is_phrase).alias("__phrase"),
        F.min(order).alias("__first"),
        F.min_by("snippet", order).alias("snippet"),
        F.min_by("term", order).alias("__first_term"),
        F.count(keyword_only).alias("__count"),
        F.collect_set(F.when(~is_phrase, F.col("term"))).alias("__terms"),
    )
    keyword_score = F.least(
        F.lit(TOP_KEYWORD_SCORE), F.lit(BASE_SCORE) + F.col("__count") / F.col("__keywords") * F.lit(SCORE_SPAN)
    )
    scored = groups.select(
        *keys,
        "snippet",
        F.when(F.col("__phrase"), PHRASE_SCORE).otherwise(keyword_score).alias("score"),
        F.when(F.col("__phrase"), F.array("__first_term")).otherwise(F.array_sort("__terms")).alias("matched_terms"),
        F.when(F.col("__phrase"), "exact_phrase").otherwise("keywords").alias("match_type"),
        "__first",
    )
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "__first")
    ranked = scored.withColumn("snippet_rank", F.row_number().over(best).cast("bigint"))
    return ranked.filter(F.col("snippet_rank") <= MAX_SNIPPETS).drop("__first")


def with_snippets(hits: DataFrame, keys: list[str], text: Column, query: Column) -> DataFrame:
    """Add ``snippets``, an array of up to three structs, empty if none match."""
    ranked = ranked_snippets(occurrences(hits, keys, text, query), keys)
    entry = F.struct("snippet_rank", "snippet", "score", "matched_terms", "match_type")
    grouped = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("__ranked"))
    shown = F.transform(
        "__ranked",
        lambda s: F.struct(
            s["snippet"].alias("snippet"),
            s["score"].alias("score"),
            s["matched_terms"].alias("matched_terms"),
            s["match_type"].alias("match_type"),
        ),
    )
    none = F.array().cast("array<struct<snippet:string,score:double,matched_terms:array<string>,match_type:string>>")
    joined = hits.join(grouped.select(*keys, shown.alias("snippets")), keys, "left")
    return joined.withColumn("snippets", F.coalesce("snippets", none))
