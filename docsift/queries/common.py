"""Inputs and SQL pieces that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docsift.session import prepare
from docsift.sources.tables import dealt_out, read_table

MANIFEST_EXTENSIONS = (".txt", ".md", ".py", ".html", ".json", ".jsonl", ".pdf", ".modfem", ".exe")
# Files whose whole text is indexed, for the search queries.
TEXT_EXTENSIONS = (".txt", ".md", ".py", ".html")
_NOW_MICROS = 1_767_225_600_000_000
_DAY_MICROS = 86_400_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(prepare(spark), folder, name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents table, dealt out for row-by-row text work."""
    return dealt_out(table(spark, folder, "documents"))


def manifest(spark: SparkSession, folder: str, names: tuple[str, ...] = MANIFEST_EXTENSIONS) -> DataFrame:
    """The documents as files: path, size, times, mode and content."""
    docs = documents(spark, folder)
    extensions = F.array(*[F.lit(ext) for ext in names])
    ext = F.get(extensions, (F.col("doc_id") % len(names)).cast("int"))
    path = F.concat(
        F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext
    )
    created = F.timestamp_micros(F.lit(_NOW_MICROS) - F.col("doc_id") * _DAY_MICROS)
    return docs.select(
        path.alias("path"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        created.alias("created_time"),
        created.alias("modified_time"),
        (F.lit(32768) + F.col("doc_id") % 512).alias("mode"),
        F.col("text").alias("content"),
        (F.col("n_chars") / 10000).alias("seconds"),
    )


def now() -> Column:
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)




def sql_manifest(names: tuple[str, ...] = MANIFEST_EXTENSIONS) -> str:
    """The manifest as SQL; "m" is the relation."""
    listed = ", ".join(f"'{ext}'" for ext in names)
    return f"""
m AS (
  SELECT '/corpus/' || source || '/' || lang || '/doc_' || doc_id
           || ([{listed}])[(doc_id % {len(names)}) + 1] AS path,
         ([{listed}])[(doc_id % {len(names)}) + 1] AS ext,
         strlen(text)::BIGINT AS size_bytes,
         TIMESTAMP '2026-01-01' - doc_id * INTERVAL 1 DAY AS created_time,
         (32768 + doc_id % 512)::BIGINT AS mode,
         text AS content, doc_id, source, lang, n_chars / 10000.0::DOUBLE AS seconds
  FROM documents)
"""


SQL_MANIFEST = sql_manifest()

SQL_WS = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_NON_WS = SQL_WS.replace("[", "[^", 1)


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SQL_WS}+'), lambda w: w <> '')"


def sql_strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{SQL_WS}+', ''), '{SQL_WS}+$', '')"


def sql_count(text: str, literal: str) -> str:
    quoted = literal.replace("'", "''")
    if "\n" in literal:
        quoted = "' || chr(10) || '".join(quoted.split("\n"))
    return f"((length({text}) - length(replace({text}, '{quoted}', ''))) // {len(literal)})"


def sql_empty(text: str) -> str:
    return (
        f"(length({sql_strip(text)}) < 10 OR contains(lower({text}), 'no extractable text content')"
        f" OR contains(lower({text}), 'image file:') OR contains(lower({text}), 'exif data:'))"
    )


def sql_size(value: str) -> str:
    v = f"({value})::DOUBLE"
    cases = [
        f"WHEN {v} / {1024.0 ** power} < 1024 THEN printf('%.1f {unit}', {v} / {1024.0 ** power})"
        for power, unit in enumerate(("B", "KB", "MB", "GB"))
    ]
    return f"CASE {' '.join(cases)} ELSE printf('%.1f TB', {v} / {1024.0 ** 4}) END"


def sql_l2(a: str, b: str) -> str:
    term = f"({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)"
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {term}))"


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def sql_cosine(a: str, b: str) -> str:
    return f"{sql_dot(a, b)} / (sqrt({sql_dot(a, a)}) * sqrt({sql_dot(b, b)}))"
