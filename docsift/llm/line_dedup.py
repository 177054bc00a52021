"""Repeated runs of lines: a suffix array over line ids, and removal of later copies.

The text of a document is a sequence of lines. A line with at least one word gets an id, equal for
equal lines. Distributed prefix doubling ranks the suffixes of all these sequences: the rank of the
first 2^(k+1) lines of a suffix is the place of the pair (rank of its first 2^k lines, rank of the
2^k lines behind them) among all such pairs. A pair that occurs once has no other suffix to share a
prefix with, so that suffix leaves the array.

Suffixes that agree over at least ``min_words`` words form one interval of the array (longest
common prefix of that length). The first of the interval, by document id and line, is kept; the
lines under the others are later copies. As this is asked from both ends of every repeated run, the
deleted lines are exactly those of all maximal repeated runs of ``min_words`` words or more, but
for their first copies. A run of ``min_words`` words has at most ``min_words`` lines, so that
log2(min_words) doublings are enough, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docsift.llm.common import let, stored, unwrapped, wrapped

MIN_WORDS = 50
WORD = r"[^ \t\n\x0B\f\r]+"


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: document, line, place among such lines, words, line hashes."""
    lines = F.transform(F.split("text", "\n", -1), lambda line, at: F.struct(at.alias("line"), line.alias("t")))
    worded = F.filter(lines, lambda s: s["t"].rlike(r"[^ \t\n\x0B\f\r]"))
    rows = docs.where(F.length("text") > 0).select("doc", text_key(F.col("text")).alias("key"), F.posexplode(worded).alias("at", "s"))
    return rows.select(
        "doc", "key", "at", F.col("s.line").alias("line"),
        F.regexp_count("s.t", F.lit(WORD)).alias("words"),
        F.xxhash64("s.t").alias("h"), F.hash("s.t").alias("g"),
    )


def _ranked(groups: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """An increasing number for each row in the order of the keys, from a distributed sort."""
    return groups.orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias(name))


def _repeated_lines(docs: DataFrame) -> DataFrame:
    """The lines that occur more than once, with their rank among the different lines."""
    lines = _lines(docs)
    seen = lines.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1")
    rows = lines.join(_ranked(seen, ["h", "g"]), ["h", "g"]).select("doc", "key", "at", "words", "rank")
    # rows equal in id and text are one document; one exchange serves this and the windows below
    return rows.repartition("doc", "key").groupBy("doc", "key", "at").agg(F.first("words").alias("words"), F.first("rank").alias("rank"))


def _sizes(min_words: int) -> list[int]:
    return [2**k for k in range(min_words.bit_length())]


def _with_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """Adds the shortest runs of min_words words that start, or end, at each line.

    ``ahead``: lines of the run that starts here. ``back``: an array that has for each block size the lines
    of the run that ends where the block of that size from here ends, if that block is its last one.
    Null where the repeated lines end before there are so many words. ``deepest``: the longest in the document.
    """
    doc = Window.partitionBy("doc", "key")
    in_doc = doc.orderBy("at")
    rows = rows.withColumn("ends", F.sum("words").over(in_doc)).withColumn("begins", F.col("ends") - F.col("words"))

    def run(window) -> Column:
        count = F.count("*").over(window)
        unbroken = F.max("at").over(window) - F.min("at").over(window) + 1 == count
        enough = F.max("ends").over(window) - F.min("begins").over(window) >= min_words
        return F.when(unbroken & enough, count).cast("int")

    rows = rows.withColumn("ahead", run(doc.orderBy("begins").rangeBetween(0, min_words - 1)))
    rows = rows.withColumn("up_to", run(doc.orderBy("ends").rangeBetween(1 - min_words, 0)))
    rows = rows.withColumn("deepest", F.max(F.greatest("ahead", "up_to")).over(doc)).where("deepest IS NOT NULL")
    back = [F.first("up_to").over(in_doc.rangeBetween(size - 1, size - 1)) for size in _sizes(min_words)]
    return rows.select("doc", "key", "at", "rank", "ahead", F.array(*back).alias("back"), "deepest")


def _with_names(rows: DataFrame, level: int, size: int) -> DataFrame:
    """Adds the rank ``size`` lines on, and the runs of size..2*size-1 lines with their names.

    Two overlapping blocks of ``size`` lines cover such a run: their ranks and the length name it.
    """
    in_doc = Window.partitionBy("doc", "key").orderBy("at")
    near = F.collect_list(F.struct("at", "rank")).over(in_doc.rangeBetween(1 - size, size - 1))
    rows = rows.select(
        "*", F.first("rank").over(in_doc.rangeBetween(size, size)).alias("next"), near.alias("near")
    )

    def rank_at(place: Column) -> Column:
        return F.get(F.filter("near", lambda s: s["at"] == place), F.lit(0))["rank"]

    at, rank, ahead, back = F.col("at"), F.col("rank"), F.col("ahead"), F.get("back", F.lit(level))
    here = F.when(ahead.between(size, 2 * size - 1), F.struct(
        at.alias("from"), ahead.alias("n"), rank.alias("a"), rank_at(at + ahead - size).alias("b")))
    there = F.when(back.between(size, 2 * size - 1), F.struct(
        (at + size - back).alias("from"), back.alias("n"), rank_at(at + size - back).alias("a"), rank.alias("b")))
    runs = F.filter(F.array_distinct(F.array(here, there)), lambda r: r["a"].isNotNull() & r["b"].isNotNull())
    return rows.select("doc", "key", "at", "rank", "next", "ahead", "back", "deepest", runs.alias("runs"))


def _later_copies(named: DataFrame) -> DataFrame:
    """The runs of an interval of the suffix array but for its first, as places from..to."""
    runs = named.select("doc", "key", F.explode("runs").alias("r")).select("doc", "key", "r.*")
    place = F.struct("doc", "key", "from")
    first = runs.groupBy("a", "b", "n").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1")
    later = runs.join(first, ["a", "b", "n"]).where(~place.eqNullSafe(F.col("first")))
    return later.select("doc", "key", "from", (F.col("from") + F.col("n") - 1).alias("to"))


def _doubled(named: DataFrame, size: int) -> DataFrame:
    """The ranks of the first 2 * size lines from the pairs of ranks of size lines."""
    pairs = named.where((F.col("deepest") >= 2 * size) & F.col("next").isNotNull()).drop("runs")
    groups = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1")
    return pairs.join(_ranked(groups, ["rank", "next"], "doubled"), ["rank", "next"]).drop("rank", "next").withColumnRenamed("doubled", "rank")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines of later copies: doc, key and an array ``gone`` of disjoint, sorted (from, to) places.

    ``docs`` has ``doc`` and ``text``. A place counts the lines with words of a document.
    """
    rows, copies = stored(_with_runs(_repeated_lines(docs), min_words), "lines"), None
    for level, size in enumerate(_sizes(min_words)):
        named = stored(_with_names(rows, level, size), f"runs{size}")
        found = _later_copies(named)
        copies = found if copies is None else copies.unionAll(found)
        if 2 * size > min_words or named.where(F.col("deepest") >= 2 * size).isEmpty():
            break
        rows = _doubled(named, size)
    doc = Window.partitionBy("doc", "key")
    before = F.max("to").over(doc.orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1))
    starts = copies.repartition("doc", "key").withColumn("new", F.coalesce(F.col("from") > before + 1, F.lit(True)).cast("int"))
    merged = starts.withColumn("island", F.sum("new").over(doc.orderBy("from", "to").rowsBetween(Window.unboundedPreceding, 0)))
    islands = merged.groupBy("doc", "key", "island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return islands.groupBy("doc", "key").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("gone"))


def dedup_lines(docs: DataFrame, id_column: str, text_column: str, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, the text without later copies of repeated line runs.

    A run is a sequence of whole lines of one text, of ``min_words`` words or more, that occurs again anywhere
    in the corpus. Its first copy by (id, text hash, line) stays, all others go, with the blank lines inside
    them. A word is a sequence of characters other than space and \\t \\n \\x0b \\f \\r. Blank lines are no lines
    of a run, but stay outside of runs. Adds ``deleted_lines`` (lines with words) and ``lines`` (of those, before).

    Null and empty texts stay as they are, with 0 lines. Rows equal in id and text are one document: a copy inside
    of it is deleted in each of the rows, but they are no copies of each other. Null ids come first in order.
    Other columns are kept, whatever their names, but a column called ``lines`` or ``deleted_lines`` is replaced.
    """
    columns = [c for c in docs.columns if c not in ("lines", "deleted_lines")]
    rows = wrapped(docs.select(*[f"`{c}`" for c in columns]), doc=id_column, text=text_column)
    gone = later_copies(rows.select("doc", "text"), min_words).select(
        F.col("doc").alias("gone_doc"), F.col("key.a").alias("gone_a"), F.col("key.b").alias("gone_b"), "gone"
    )
    key = text_key(F.col("text"))
    keyed = rows.withColumn("a", key["a"]).withColumn("b", key["b"])
    joined = keyed.join(
        gone, F.col("doc").eqNullSafe(F.col("gone_doc")) & (F.col("a") == F.col("gone_a")) & (F.col("b") == F.col("gone_b")), "left"
    )
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without("text", "gone"))
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)))
    deleted = F.aggregate("gone", F.lit(0), lambda n, g: n + (g["to"] - g["from"] + 1).cast("int"))
    done = joined.select(
        "row", kept.alias("kept"), F.coalesce(F.greatest(lines, F.lit(0)), F.lit(0)).cast("long").alias("lines"),
        F.coalesce(deleted, F.lit(0)).cast("long").alias("deleted_lines"),
    )
    return unwrapped(
        done, [*columns, "lines", "deleted_lines"], **{text_column: F.col("kept")}, lines=F.col("lines"), deleted_lines=F.col("deleted_lines")
    )


def _without(text: str, gone: str) -> Column:
    """The text without the lines between the first and the last place of each range, in one pass."""
    lines = F.split(text, "\n", -1)
    places = F.filter(F.transform(lines, lambda line, at: F.when(line.rlike(WORD), at)), lambda at: at.isNotNull())
    ranges = let(
        F.struct(places.alias("p"), F.col(gone).alias("g")),
        lambda v: F.transform(v["g"], lambda g: F.struct(F.get(v["p"], g["from"]).alias("from"), F.get(v["p"], g["to"]).alias("to"))),
    )
    parts = let(
        F.struct(lines.alias("l"), ranges.alias("r")),
        lambda v: F.concat(
            F.flatten(F.transform(v["r"], lambda r, at: let(
                F.when(at == 0, F.lit(0)).otherwise(F.get(v["r"], at - 1)["to"] + 1),
                lambda start: F.slice(v["l"], start + 1, F.greatest(r["from"] - start, F.lit(0))),
            ))),
            let(F.element_at(v["r"], -1)["to"] + 1, lambda start: F.slice(v["l"], start + 1, F.size(v["l"]) - start)),
        ),
    )
    return F.array_join(parts, "\n")
