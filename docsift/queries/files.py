"""Queries over file facts and indexing reports, on the documents seen as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.functions import files as ff
from docsift.operators import stats
from docsift.plans.index import process_files
from docsift.queries.common import (
    SQL_MANIFEST, SQL_NON_WS, manifest, now, rounded, sql_empty, sql_size, sql_words, table,
)
from docsift.queries.texts import _sql_code_score, _sql_text_score
from docsift.sources.files import (
    DEFAULT_EXCLUDES, dispatch, excluded_names, has_skipped_suffix, in_excluded_folder, loader_rows,
    supported_extensions,
)

USER_EXCLUDES = ("src3", "de")
REQUESTED = (".md", ".py", ".json", ".modfem")


def _named(columns: dict) -> list:
    return [column.alias(name) for name, column in columns.items()]


def loader_dispatch(spark, folder):
    return dispatch(manifest(spark, folder)).select("path", "extension", "loader")


def extension_allow_list(spark, folder):
    routed = dispatch(manifest(spark, folder), REQUESTED)
    return routed.filter(F.col("loader").isNotNull()).select("path", "loader")


def exclude_dirs(spark, folder):
    kept = ~in_excluded_folder(F.col("path"), excluded_names(USER_EXCLUDES), "/corpus")
    return manifest(spark, folder).filter(kept).select("path")


def skip_suffix(spark, folder):
    return manifest(spark, folder).filter(~has_skipped_suffix(F.col("path"))).select("path")


def extensions_in_use(spark, folder):
    """Extensions of the files that some loader takes, by set intersection."""
    used = manifest(spark, folder).select(ff.extension(F.col("path")).alias("extension"))
    return used.intersect(supported_extensions(spark))


def path_parts(spark, folder):
    return manifest(spark, folder).select("path", *_named(ff.path_parts(F.col("path"))))


def url_parts(spark, folder):
    return table(spark, folder, "pages").select("page_id", *_named(ff.path_parts(F.col("url"))))


def doc_ids(spark, folder):
    return manifest(spark, folder).select("path", ff.doc_id(F.col("path")).alias("document_id"))


def file_hash(spark, folder):
    hashes = {name: ff.file_hash(F.col("content").cast("binary"), name) for name in ("sha256", "md5", "sha1")}
    return manifest(spark, folder).select("path", *_named(hashes))


def size_categories(spark, folder):
    return manifest(spark, folder).select("path", ff.size_category(F.col("size_bytes")).alias("size_category"))


def format_size(spark, folder):
    return manifest(spark, folder).select("path", ff.format_size(F.col("size_bytes")).alias("size_human"))


def ages(spark, folder):
    columns = ff.age_columns(F.col("created_time"), F.col("modified_time"), now())
    shown = {name: column if name.startswith("is_") else rounded(column) for name, column in columns.items()}
    return manifest(spark, folder).select("path", *_named(shown))


def event_times(spark, folder):
    moment = F.col("ts").cast("timestamp")
    return table(spark, folder, "events").select(
        "event_id", ff.iso_time(moment).alias("iso"), ff.human_time(moment).alias("human")
    )


def permissions(spark, folder):
    return manifest(spark, folder).select(
        "path", ff.octal_permissions(F.col("mode")).alias("octal"), ff.readable_permissions(F.col("mode")).alias("readable")
    )


def file_classes(spark, folder):
    return manifest(spark, folder).select("path", *_named(ff.kind_columns(ff.extension(F.col("path")))))


def match_labels(spark, folder):
    routed = dispatch(manifest(spark, folder))
    source = F.when(F.col("loader") == "modfem", "metadata_only").when(F.col("loader").isNotNull(), "file_content")
    return routed.select("path", ff.match_label(F.coalesce(source, F.lit("unknown"))).alias("match_label"))


def match_targets(spark, folder):
    routed = dispatch(manifest(spark, folder))
    source = F.when(F.col("loader") == "modfem", "metadata_only").otherwise("file_content")
    target = ff.match_target(source, F.col("content"), ff.file_name(F.col("path")), F.col("path"))
    return routed.select("path", F.md5(target).alias("target_md5"))


def _processed(spark, folder):
    return process_files(manifest(spark, folder), now())


def enriched_metadata(spark, folder):
    return _processed(spark, folder).select(
        "path", "status", "type", "match_source", "embedding_type", "size_human", "size_category", "permissions", "depth",
        "age_days", "is_recent", "is_old", "is_code_file", "created_date", "word_count", "char_count", "line_count", "unique_terms",
        rounded("complexity_score").alias("complexity_score"),
    )


def index_summary(spark, folder):
    return stats.index_summary(_processed(spark, folder))


def file_status(spark, folder):
    return _processed(spark, folder).groupBy("status", "error").agg(F.count("*").alias("files"))


def corpus_totals(spark, folder):
    return stats.corpus_totals(manifest(spark, folder)).withColumn("average_bytes", rounded("average_bytes"))


def size_histogram(spark, folder):
    return stats.size_histogram(manifest(spark, folder).withColumn("size_category", ff.size_category(F.col("size_bytes"))))


def type_distribution(spark, folder):
    docs = _processed(spark, folder).filter("status = 'added'")
    return stats.type_distribution(docs).withColumn("percentage", rounded("percentage"))


def oldest_newest(spark, folder):
    return stats.oldest_newest(manifest(spark, folder).withColumn("filename", ff.file_name(F.col("path"))))


def timing_summary(spark, folder):
    timed = stats.timing_summary(manifest(spark, folder), "seconds")
    return timed.select("files", *[rounded(name).alias(name) for name in timed.columns if name != "files"])


def slowest_files(spark, folder):
    return stats.slowest_files(manifest(spark, folder), "seconds", "path").withColumn("seconds", rounded("seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        loader_dispatch, extension_allow_list, exclude_dirs, skip_suffix, extensions_in_use, path_parts, url_parts,
        doc_ids, file_hash, size_categories, format_size, ages, event_times, permissions, file_classes, match_labels,
        match_targets, enriched_metadata, index_summary, file_status, corpus_totals, size_histogram, type_distribution,
        oldest_newest, timing_summary, slowest_files,
    )
}


def _loaders_sql(rows) -> str:
    values = ", ".join(f"('{ext}', '{loader}')" for ext, loader, _ in rows)
    return f"loaders(extension, loader) AS (VALUES {values})"


def _list(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def _parts_sql(key: str, path: str, relation: str) -> str:
    return f"""
SELECT {key}, filename, lower(suffix) AS extension, left(filename, length(filename) - length(suffix)) AS stem,
  CASE WHEN slashes = 0 THEN '.' WHEN slashes = 1 AND path[1] = '/' THEN '/' ELSE left(path, length(path) - length(filename) - 1) END AS parent_dir,
  CASE WHEN path[1] = '/' THEN slashes - 1 ELSE slashes END AS depth, filename[1] = '.' AS is_hidden
FROM (SELECT *, regexp_extract(filename, '^\\.*[^.].*?(\\.[^.]*)$', 1) AS suffix FROM (
  SELECT {key}, {path} AS path, string_split({path}, '/')[-1] AS filename, length({path}) - length(replace({path}, '/', '')) AS slashes
  FROM {relation}))"""


_CATEGORY = """CASE WHEN size_bytes < 1024 THEN 'tiny' WHEN size_bytes < 10240 THEN 'very_small' WHEN size_bytes < 102400 THEN 'small'
  WHEN size_bytes < 1048576 THEN 'medium' WHEN size_bytes < 10485760 THEN 'large' ELSE 'very_large' END"""
_AGE = "epoch(TIMESTAMP '2026-01-01' - created_time)::DOUBLE"
_BITS = " || ' ' || ".join(
    f"CASE WHEN mode & {1 << (8 - place)} <> 0 THEN '{letter}' ELSE '-' END" for place, letter in enumerate("rwxrwxrwx")
)
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END"

# Documents of the manifest after loading; "c" has the content and the status.
# None of the texts holds a JSON line.
SQL_PROCESSED = f"""
{SQL_MANIFEST},
f AS (SELECT *, CASE WHEN ext IN ('.txt', '.md') THEN 'text' WHEN ext IN ('.html', '.json') THEN 'markup' WHEN ext = '.py' THEN 'code'
    WHEN ext = '.jsonl' THEN 'jsonl' WHEN ext = '.pdf' THEN 'pdf' WHEN ext = '.modfem' THEN 'femap_model' END AS type,
  CASE WHEN ext IN ('.txt', '.md', '.html', '.json', '.py') THEN content WHEN ext = '.jsonl' THEN 'JSONL file with 0 lines' || chr(10)
    WHEN ext = '.modfem' THEN 'Femap 3D model file: ' || string_split(path, '/')[-1] || chr(10) || 'Size: ' || size_bytes || ' bytes'
      || chr(10) || 'Note: Binary format - only metadata is searchable' END AS body FROM m),
c AS (SELECT *, CASE WHEN type IS NULL THEN 'unsupported' WHEN type = 'pdf' THEN 'failed' WHEN {sql_empty("body")} THEN 'empty' ELSE 'added' END AS status,
  CASE WHEN type = 'femap_model' THEN 'metadata_only' ELSE 'file_content' END AS match_source,
  CASE WHEN type = 'text' THEN 'bert' ELSE 'ollama' END AS embedding_type FROM f)"""

ORACLES = {
    "loader_dispatch": f"WITH {SQL_MANIFEST}, {_loaders_sql(loader_rows())} SELECT path, ext AS extension, loader FROM m LEFT JOIN loaders ON ext = extension",
    "extension_allow_list": f"""WITH {SQL_MANIFEST}, {_loaders_sql(loader_rows())}
SELECT path, loader FROM m JOIN loaders ON ext = extension WHERE ext IN ({_list(REQUESTED)})""",
    "exclude_dirs": f"""WITH {SQL_MANIFEST} SELECT path FROM m
WHERE NOT list_has_any(list_slice(string_split(path, '/'), 3, -2), [{_list((*DEFAULT_EXCLUDES, *USER_EXCLUDES))}])""",
    "skip_suffix": f"WITH {SQL_MANIFEST} SELECT path FROM m WHERE NOT regexp_matches(path, '\\.(pyc|bak|pyo|so|dll|exe)$')",
    "extensions_in_use": f"WITH {SQL_MANIFEST}, {_loaders_sql(loader_rows())} SELECT ext AS extension FROM m INTERSECT SELECT extension FROM loaders",
    "path_parts": f"WITH {SQL_MANIFEST} " + _parts_sql("m_path", "path", "(SELECT path, path AS m_path FROM m)").replace("SELECT m_path", "SELECT m_path AS path", 1),
    "url_parts": _parts_sql("page_id", "url", "pages"),
    "doc_ids": f"WITH {SQL_MANIFEST} SELECT path, md5(path) AS document_id FROM m",
    "file_hash": f"WITH {SQL_MANIFEST} SELECT path, sha256(content) AS sha256, md5(content) AS md5, sha1(content) AS sha1 FROM m",
    "size_categories": f"WITH {SQL_MANIFEST} SELECT path, {_CATEGORY} AS size_category FROM m",
    "format_size": f"WITH {SQL_MANIFEST} SELECT path, {sql_size('size_bytes')} AS size_human FROM m",
    "ages": f"""WITH {SQL_MANIFEST} SELECT path, round({_AGE} / 86400, 6) AS age_days, round({_AGE} / 3600, 6) AS age_hours,
  round({_AGE} / 60, 6) AS age_minutes, round({_AGE} / 86400, 6) AS days_since_modified,
  {_AGE} / 86400 < 30 AS is_recent, {_AGE} / 86400 > 365 AS is_old FROM m""",
    "event_times": f"SELECT event_id, {_ISO} AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS human FROM events",
    "permissions": f"WITH {SQL_MANIFEST} SELECT path, right(to_base(mode, 8), 3) AS octal, {_BITS} AS readable FROM m",
    "file_classes": f"""WITH {SQL_MANIFEST} SELECT path, ext IN ({_list(ff.CODE_EXTENSIONS)}) AS is_code_file,
  ext IN ({_list(ff.DOCUMENT_EXTENSIONS)}) AS is_document, ext IN ({_list(ff.IMAGE_EXTENSIONS)}) AS is_image FROM m""",
    "match_labels": f"""WITH {SQL_MANIFEST} SELECT path, CASE ext WHEN '.modfem' THEN 'ℹ Match from metadata only'
  WHEN '.exe' THEN '? Unknown match source' ELSE '✓ Match from file content' END AS match_label FROM m""",
    "match_targets": f"""WITH {SQL_MANIFEST} SELECT path,
  md5(CASE WHEN ext = '.modfem' THEN string_split(path, '/')[-1] || ' ' || path ELSE content END) AS target_md5 FROM m""",
    "enriched_metadata": f"""WITH {SQL_PROCESSED},
code AS ({_sql_code_score("(SELECT path, coalesce(body, '') AS body FROM c)", "path", "body")}),
prose AS ({_sql_text_score("(SELECT path, coalesce(body, '') AS body FROM c)", "path", "body")})
SELECT c.path, status, type, CASE WHEN type IS NULL THEN 'file_content' ELSE match_source END AS match_source, embedding_type,
  {sql_size("size_bytes")} AS size_human, {_CATEGORY} AS size_category, right(to_base(mode, 8), 3) AS permissions, 3::BIGINT AS depth,
  {_AGE} / 86400 AS age_days, {_AGE} / 86400 < 30 AS is_recent, {_AGE} / 86400 > 365 AS is_old, ext = '.py' AS is_code_file,
  strftime(created_time, '%Y-%m-%dT%H:%M:%S') AS created_date,
  len({sql_words("body")}) AS word_count, length(body) AS char_count, len(string_split(body, chr(10))) AS line_count,
  len(list_distinct({sql_words("lower(body)")})) AS unique_terms,
  round(CASE WHEN body IS NULL OR NOT regexp_matches(body, '{SQL_NON_WS}') THEN 0.0 WHEN ext = '.py' THEN code.score ELSE prose.score END, 6) AS complexity_score
FROM c JOIN code ON c.path = code.path JOIN prose ON c.path = prose.path""",
    "index_summary": f"""WITH {SQL_PROCESSED}
SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'empty') AS empty,
  count(*) FILTER (status = 'added' AND match_source = 'file_content') AS content_matches,
  count(*) FILTER (status = 'added' AND match_source = 'metadata_only') AS metadata_matches,
  count(*) FILTER (status = 'added' AND embedding_type = 'bert') AS bert_embedded,
  count(*) FILTER (status = 'added' AND embedding_type <> 'bert') AS other_embedded, count(*) FILTER (status <> 'added') AS failed FROM c""",
    "file_status": f"""WITH {SQL_PROCESSED}
SELECT status, CASE status WHEN 'unsupported' THEN 'no loader takes this extension' WHEN 'failed' THEN 'no parser registered'
  WHEN 'empty' THEN 'no meaningful content' END AS error, count(*) AS files FROM c GROUP BY ALL""",
    "corpus_totals": f"""WITH {SQL_MANIFEST}, t AS (SELECT count(*) AS n, sum(size_bytes)::BIGINT AS b FROM m)
SELECT n AS total_files, b AS total_bytes, round(b / n, 6) AS average_bytes, {sql_size("b")} AS total_size, {sql_size("b / n")} AS average_size FROM t""",
    "size_histogram": f"""WITH {SQL_MANIFEST}, k AS (SELECT {_CATEGORY} AS size_category FROM m)
SELECT size_category, count(*) AS files, list_position(['tiny', 'very_small', 'small', 'medium', 'large', 'very_large'], size_category)::BIGINT AS position
FROM k GROUP BY size_category""",
    "type_distribution": f"""WITH {SQL_PROCESSED}
SELECT type, count(*) AS files, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage FROM c WHERE status = 'added' GROUP BY type""",
    "oldest_newest": f"""WITH {SQL_MANIFEST},
o AS (SELECT *, row_number() OVER (ORDER BY created_time, path) AS old, row_number() OVER (ORDER BY created_time DESC, path) AS new FROM m)
SELECT max(CASE WHEN old = 1 THEN string_split(path, '/')[-1] END) AS oldest_file,
  max(CASE WHEN old = 1 THEN strftime(created_time, '%Y-%m-%d %H:%M:%S') END) AS oldest_date,
  max(CASE WHEN new = 1 THEN string_split(path, '/')[-1] END) AS newest_file,
  max(CASE WHEN new = 1 THEN strftime(created_time, '%Y-%m-%d %H:%M:%S') END) AS newest_date FROM o""",
    "timing_summary": f"""WITH {SQL_MANIFEST}
SELECT count(seconds) AS files, round(avg(seconds), 6) AS avg_seconds, round(min(seconds), 6) AS min_seconds,
  round(max(seconds), 6) AS max_seconds, round(sum(seconds), 6) AS total_seconds, round(count(seconds) / sum(seconds), 6) AS files_per_second FROM m""",
    "slowest_files": f"""WITH {SQL_MANIFEST}, s AS (SELECT path, seconds FROM m ORDER BY seconds DESC, path LIMIT 5)
SELECT path, round(seconds, 6) AS seconds FROM s WHERE (SELECT max(seconds) FROM s) > 0.5""",
}
