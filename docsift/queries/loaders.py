"""Queries over loaders: markup, JSON, JSON Lines, pages, paragraphs, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docsift.functions.json_text import (
    format_value, is_json, json_path, json_to_text, nesting_depth, with_structure,
)
from docsift.operators.embed import embed_by_type, hashed_embedding
from docsift.plans.index import process_files
from docsift.queries.common import SQL_MANIFEST, TEXT_EXTENSIONS, manifest, now, sql_manifest, table
from docsift.queries.files import SQL_PROCESSED
from docsift.schema import columns_of
from docsift.session import shared_path
from docsift.sources.files import dispatch
from docsift.sources.loaders import jsonl_documents, load_documents, load_with_file_parsers, metadata_text, union_documents
from docsift.sources.parts import cells_documents, column_letter, paged_documents, paragraph_documents, table_to_cells
from docsift.sources.tables import dealt_out
from docsift.sources.store import append_documents, count_documents, open_documents, upsert_documents


def _page_files(spark, folder) -> DataFrame:
    pages = table(spark, folder, "pages")
    return pages.select(
        F.concat(F.lit("/pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.octet_length("html").cast("bigint").alias("size_bytes"),
        F.col("html").cast("binary").alias("content"),
    )


def markup_docs(spark, folder):
    loaded = load_documents(dispatch(_page_files(spark, folder)))
    return loaded.select(
        "path", "type", "match_source", "embedding_type", "status",
        F.length("content").cast("bigint").alias("chars"), F.md5("content").alias("content_md5"),
    )


def code_docs(spark, folder):
    loaded = load_documents(dispatch(manifest(spark, folder))).filter("loader = 'code'")
    return loaded.select("path", "type", "language", "lines_total", "lines_code", "lines_comments")


def metadata_docs(spark, folder):
    text = metadata_text(F.col("loader"), F.col("path"), F.col("size_bytes"))
    return dispatch(manifest(spark, folder)).filter("loader = 'modfem'").select("path", text.alias("content"))


_PARSED_EXTENSIONS = (".txt", ".md", ".pdf", ".exe", ".modfem")


def _pdf_text(path: str, body: bytes) -> tuple[str, dict[str, str]]:
    return f"{len(body)} bytes\n{body.decode()}", {"name": path.rsplit("/", 1)[1]}


def _even_text(path: str, body: bytes) -> str | None:
    return body.decode() if len(body) % 2 == 0 else None


def _long_text(path: str, body: bytes) -> str:
    if len(body) < 500:
        raise ValueError(path)
    return body.decode()


def parsed_files(spark, folder):
    """The documents as files, three kinds of them through parsers that fail on some, in one scan."""
    files = dispatch(manifest(spark, folder, _PARSED_EXTENSIONS))
    loaded = load_with_file_parsers(files, {".pdf": _pdf_text, ".exe": _even_text, ".modfem": _long_text})
    return loaded.select("path", "type", "status", "error", "content", F.col("facts")["name"].alias("name"))


def json_structure(spark, folder):
    props = F.col("props")
    events = table(spark, folder, "events").select("event_id", "props", is_json(props).alias("valid"), nesting_depth(props).alias("depth"))
    checked = events.withColumn("props", F.when(F.col("valid"), props))
    return with_structure(checked, "props").select("event_id", "valid", "depth", "structure_type")


def json_keys(spark, folder):
    return with_structure(table(spark, folder, "events"), "props").select("event_id", "key_count", "top_keys")


def json_paths(spark, folder):
    found = {name: F.array_join(json_path(F.col("props"), path), ",") for name, path in (("k", "k"), ("missing", "k.x[0]"))}
    return table(spark, folder, "events").select("event_id", *[column.alias(name) for name, column in found.items()])


def json_values(spark, folder):
    events = table(spark, folder, "events")
    kind = F.concat(F.lit('"'), "event_type", F.lit('"'))
    number = F.get_json_object("props", "$.k")
    return events.select("event_id", format_value(kind).alias("kind"), format_value(number).alias("number"))


def _order_json(orders: DataFrame) -> DataFrame:
    """Every order as a nested JSON document."""
    text = F.concat(
        F.lit('{"order": '), F.col("o_orderkey").cast("string"), F.lit(', "status": "'), "o_orderstatus",
        F.lit('", "customer": {"key": '), F.col("o_custkey").cast("string"), F.lit(', "tags": ["'), "o_orderpriority",
        F.lit('", null, true, [1]]}, "notes": []}'),
    )
    return orders.select("o_orderkey", text.alias("json"))


def json_documents(spark, folder):
    docs = with_structure(_order_json(dealt_out(table(spark, folder, "orders"))), "json")
    return docs.select(
        "o_orderkey", "structure_type", "nesting_depth", "key_count", "top_keys", json_to_text("json").alias("content")
    )


def nested_json_paths(spark, folder):
    docs = _order_json(table(spark, folder, "orders"))
    paths = {"customer_key": "customer.key", "first_tag": "customer.tags[0]", "second_tag": "customer.tags[1]", "none": "customer.x"}
    found = [F.array_join(json_path(F.col("json"), path), ",").alias(name) for name, path in paths.items()]
    return docs.select("o_orderkey", *found)


def _turn_lines(spark, folder) -> DataFrame:
    """Every turn with its whole text as a line of JSON."""
    turns = table(spark, folder, "conversations")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    return turns.select("conv_id", (F.col("turn") + 1).alias("line_no"), line.alias("line"))


def jsonl_docs(spark, folder):
    return jsonl_documents(_turn_lines(spark, folder), "conv_id")


def jsonl_one_file(spark, folder):
    """All lines of the table as one file: the largest document there can be, in parts."""
    lines = _turn_lines(spark, folder).withColumns({"file": F.lit("turns.jsonl"), "line_no": F.col("conv_id") * 100 + F.col("line_no")})
    return jsonl_documents(lines, "file").select("file", "part", "line_count", "total_chars", F.md5("content").alias("content_md5"))


def paged_docs(spark, folder):
    return paged_documents(table(spark, folder, "conversations"), "conv_id", "turn", "text")


def paragraph_docs(spark, folder):
    return paragraph_documents(table(spark, folder, "conversations"), "conv_id", "turn", "text")


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def cells_docs(spark, folder):
    """Each order as a workbook of a filled and an empty sheet."""
    orders = dealt_out(table(spark, folder, "orders"))
    doc = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    filled = table_to_cells(orders, doc, 0, "Order", F.lit(2), _ORDER_COLUMNS)
    empty = orders.select(
        doc.alias("doc"), F.lit(1).alias("sheet_no"), F.lit("Notes").alias("sheet"),
        F.lit(1).cast("bigint").alias("row"), F.lit(0).alias("col"), F.lit(None).cast("string").alias("value"),
    )
    return cells_documents(filled.unionByName(empty))


def region_cells(spark, folder):
    """Nations as rows of one sheet per region, at rows given by their key."""
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = table_to_cells(nations, F.col("r_name"), 0, "Nations", F.col("n_nationkey") + 2, ["n_nationkey", "n_name"])
    return cells_documents(cells)


def column_letters(spark, folder):
    return table(spark, folder, "events").select("event_id", column_letter(F.col("event_id")).alias("letters"))


def union_loaders(spark, folder):
    paged = paged_documents(table(spark, folder, "conversations"), "conv_id", "turn", "text")
    lines = jsonl_documents(_turn_lines(spark, folder), "conv_id")
    markup = load_documents(dispatch(_page_files(spark, folder)))
    return union_documents(paged, lines, markup).groupBy("type").agg(
        F.count("*").alias("documents"),
        F.sum(F.length("content")).cast("bigint").alias("chars"),
        F.count("pages").alias("with_pages"),
        F.count("line_count").alias("with_lines"),
    )


def embedder_routing(spark, folder):
    """Text files through one embedder, all others through another."""
    docs = load_documents(dispatch(manifest(spark, folder))).filter("status = 'loaded'")
    routed = embed_by_type(docs, lambda text: hashed_embedding(text, 64), lambda text: hashed_embedding(text, 32))
    return routed.select("path", F.size("embedding").cast("bigint").alias("dimension"))


_STORED = "doc_id string, path string, type string, content string, match_source string"


def _storable(spark, folder) -> DataFrame:
    """Every document as a processed file that holds its whole text; empty ones are not worth storing."""
    processed = process_files(manifest(spark, folder, TEXT_EXTENSIONS), now())
    return processed.filter("status = 'added'").select(*[name for name, _ in columns_of(_STORED)])


def append_count(spark, folder):
    """Indexing the same files twice stores every document twice."""
    path, docs = shared_path(spark, "append"), _storable(spark, folder)
    append_documents(docs, path, _STORED)
    append_documents(open_documents(spark, path, _STORED), path, _STORED)
    return count_documents(open_documents(spark, path, _STORED))


def upsert_count(spark, folder):
    """Changed versions of all documents replace the stored ones."""
    first, second, docs = shared_path(spark, "upsert"), shared_path(spark, "upsert"), _storable(spark, folder)
    append_documents(docs, first, _STORED)
    stored = open_documents(spark, first, _STORED)
    upsert_documents(stored, stored.withColumn("content", F.upper("content")), second)
    after = open_documents(spark, second, _STORED)
    return after.groupBy("type").agg(
        F.count("*").alias("documents"), F.count_if(F.col("content") == F.upper("content")).alias("replaced")
    )


QUERIES = {
    f.__name__: f
    for f in (
        markup_docs, code_docs, metadata_docs, json_structure, json_keys, json_paths, json_values, json_documents,
        nested_json_paths, jsonl_docs, jsonl_one_file, paged_docs, paragraph_docs, cells_docs, region_cells,
        column_letters, union_loaders, parsed_files, embedder_routing, append_count, upsert_count,
    )
}


_ORDER_JSON = """o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, '{"order": ' || o_orderkey || ', "status": "' || o_orderstatus
  || '", "customer": {"key": ' || o_custkey || ', "tags": ["' || o_orderpriority || '", null, true, [1]]}, "notes": []}' AS j FROM orders)"""
_LINE = "CAST(to_json({'conv_id': conv_id, 'turn': turn, 'role': role, 'text': text}) AS VARCHAR)"
_NL = "chr(10)"
_PRETTY = f"""'{{' || {_NL} || '  "conv_id": ' || conv_id || ',' || {_NL} || '  "turn": ' || turn || ',' || {_NL}
    || '  "role": ' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || ',' || {_NL}
    || '  "text": ' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || {_NL} || '}}'"""
_PAGED = f"""SELECT conv_id, 'pdf' AS type,
  CASE WHEN regexp_matches(t, '\\S') THEN t ELSE '[PDF document with ' || pages || ' pages - no extractable text content]' END AS content,
  CASE WHEN regexp_matches(t, '\\S') THEN 'file_content' ELSE 'metadata_only' END AS match_source, pages, regexp_matches(t, '\\S') AS has_text_content
FROM (SELECT conv_id, count(*) AS pages, coalesce(string_agg(text || {_NL}, '' ORDER BY turn) FILTER (text <> ''), '') AS t FROM conversations GROUP BY conv_id)"""


def _jsonl_sql(doc: str, line_no: str, relation: str) -> str:
    return f"""SELECT {doc}, (({line_no} - 1) // 100)::BIGINT AS part, 'jsonl' AS type, 'JSONL file with ' || count(*) || ' lines' || {_NL}
    || string_agg({_NL} || '[Line ' || {line_no} || ']:' || {_NL} || {_PRETTY}, {_NL} ORDER BY {line_no}) AS content,
  count(*) AS line_count, sum(length({_LINE}))::BIGINT AS total_chars
FROM {relation} GROUP BY {doc}, part"""


_LETTERS = """CASE WHEN e < 26 THEN chr(65 + e) WHEN e < 702 THEN chr(64 + e // 26) || chr(65 + e % 26)
  WHEN e < 18278 THEN chr(65 + (e - 702) // 676) || chr(65 + (e - 702) // 26 % 26) || chr(65 + e % 26 )
  ELSE chr(65 + (e - 18278) // 17576) || chr(65 + (e - 18278) // 676 % 26) || chr(65 + (e - 18278) // 26 % 26) || chr(65 + (e - 18278) % 26) END"""

# The processed documents, as files of the kinds whose whole text is indexed.
_STORABLE = SQL_PROCESSED.replace(SQL_MANIFEST, sql_manifest(TEXT_EXTENSIONS))

ORACLES = {
    "markup_docs": """SELECT '/pages/' || page_id || '.html' AS path, 'markup' AS type, 'file_content' AS match_source, 'ollama' AS embedding_type,
  'loaded' AS status, length(html) AS chars, md5(html) AS content_md5 FROM pages""",
    "code_docs": f"""WITH {SQL_MANIFEST} SELECT path, 'code' AS type, 'py' AS language, len(string_split(content, {_NL})) AS lines_total,
  len(list_filter(string_split(content, {_NL}), lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^\\s*(#|//)'))) AS lines_code,
  len(list_filter(string_split(content, {_NL}), lambda x: regexp_matches(x, '^\\s*(#|//)'))) AS lines_comments FROM m WHERE ext = '.py'""",
    "metadata_docs": f"""WITH {SQL_MANIFEST} SELECT path, 'Femap 3D model file: ' || string_split(path, '/')[-1] || {_NL}
  || 'Size: ' || size_bytes || ' bytes' || {_NL} || 'Note: Binary format - only metadata is searchable' AS content FROM m WHERE ext = '.modfem'""",
    "json_structure": """SELECT event_id, json_valid(props) AS valid, 2::BIGINT AS depth,
  CASE json_type(props) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' ELSE 'primitive' END AS structure_type FROM events""",
    "json_keys": "SELECT event_id, len(json_keys(props)) AS key_count, array_to_string(json_keys(props), ',') AS top_keys FROM events",
    "json_paths": "SELECT event_id, props->>'$.k' AS k, props->>'$.k.x[0]' AS missing FROM events",
    "json_values": "SELECT event_id, '\"' || event_type || '\"' AS kind, props->>'$.k' AS number FROM events",
    "json_documents": f"""WITH {_ORDER_JSON} SELECT o_orderkey, 'nested' AS structure_type, 5::BIGINT AS nesting_depth,
  len(json_keys(j)) AS key_count, array_to_string(json_keys(j), ',') AS top_keys,
  'order: ' || o_orderkey || {_NL} || 'status: "' || o_orderstatus || '"' || {_NL} || 'customer:' || {_NL} || '  key: ' || o_custkey || {_NL}
    || '  tags:' || {_NL} || '    [0]: "' || o_orderpriority || '"' || {_NL} || '    [1]: null' || {_NL} || '    [2]: true' || {_NL}
    || '    [3]:' || {_NL} || '      [0]: 1' || {_NL} || 'notes:' || {_NL} AS content FROM o""",
    "nested_json_paths": f"""WITH {_ORDER_JSON} SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer_key, '"' || o_orderpriority || '"' AS first_tag,
  (j->'$.customer.tags[1]')::VARCHAR AS second_tag, j->>'$.customer.x' AS none FROM o""",
    "jsonl_docs": _jsonl_sql("conv_id", "turn + 1", "conversations"),
    "jsonl_one_file": f"""SELECT file, part, line_count, total_chars, md5(content) AS content_md5 FROM (
{_jsonl_sql("file", "conv_id * 100 + turn + 1", "(SELECT *, 'turns.jsonl' AS file FROM conversations)")})""",
    "paged_docs": _PAGED,
    "paragraph_docs": f"""SELECT conv_id, 'document' AS type, string_agg(text, {_NL} ORDER BY turn) AS content,
  'file_content' AS match_source, 'bert' AS embedding_type FROM conversations GROUP BY conv_id""",
    "cells_docs": f"""SELECT 'order-' || o_orderkey AS doc, {_NL} || '[Sheet: Order]' || {_NL} || 'Dimensions: 2 rows × 4 columns' || {_NL} || {_NL}
  || 'Row 1: A1: o_orderkey | B1: o_custkey | C1: o_orderstatus | D1: o_orderpriority' || {_NL}
  || 'Row 2: A2: ' || o_orderkey || ' | B2: ' || o_custkey || ' | C2: ' || o_orderstatus || ' | D2: ' || o_orderpriority || {_NL}
  || {_NL} || {_NL} || '[Sheet: Notes] - Empty sheet' || {_NL} AS content,
  2::BIGINT AS total_sheets, 3::BIGINT AS total_rows, 8::BIGINT AS total_cells, 1::BIGINT AS sheets_with_data, 'Order,Notes' AS sheet_names,
  'Order:2x4; Notes:1x1' AS sheet_info, 'excel' AS type, 'file_content' AS match_source, 1::BIGINT AS has_data FROM orders""",
    "region_cells": f"""SELECT r_name AS doc, {_NL} || '[Sheet: Nations]' || {_NL} || 'Dimensions: ' || max(n_nationkey) + 2 || ' rows × 2 columns' || {_NL} || {_NL}
  || 'Row 1: A1: n_nationkey | B1: n_name' || {_NL} || string_agg('Row ' || n_nationkey + 2 || ': A' || n_nationkey + 2 || ': ' || n_nationkey
  || ' | B' || n_nationkey + 2 || ': ' || n_name || {_NL}, '' ORDER BY n_nationkey) AS content,
  1::BIGINT AS total_sheets, (max(n_nationkey) + 2)::BIGINT AS total_rows, 2 + 2 * count(*) AS total_cells, 1::BIGINT AS sheets_with_data,
  'Nations' AS sheet_names, 'Nations:' || max(n_nationkey) + 2 || 'x2' AS sheet_info, 'excel' AS type, 'file_content' AS match_source,
  1::BIGINT AS has_data FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "column_letters": f"SELECT event_id, {_LETTERS} AS letters FROM (SELECT event_id, event_id::INTEGER AS e FROM events)",
    "union_loaders": f"""
WITH p AS ({_PAGED}), j AS ({_jsonl_sql("conv_id", "turn + 1", "conversations")})
SELECT 'pdf' AS type, count(*) AS documents, sum(length(content))::BIGINT AS chars, count(*) AS with_pages, 0::BIGINT AS with_lines FROM p
UNION ALL SELECT 'jsonl', count(*), sum(length(content))::BIGINT, 0, count(*) FROM j
UNION ALL SELECT 'markup', count(*), sum(length(html))::BIGINT, 0, 0 FROM pages""",
    "parsed_files": f"""WITH {sql_manifest(_PARSED_EXTENSIONS)}, s AS (SELECT path, ext, content, strlen(content) AS bytes FROM m),
f AS (SELECT *, CASE WHEN ext = '.exe' AND bytes % 2 = 1 THEN 'parser returned nothing'
  WHEN ext = '.modfem' AND bytes < 500 THEN 'parser failed: ValueError' WHEN ext IN ('.pdf', '.exe', '.modfem') AND content IS NULL
  THEN 'no bytes to parse' WHEN content IS NULL THEN 'not valid UTF-8' END AS error FROM s)
SELECT path, CASE WHEN ext IN ('.txt', '.md') THEN 'text' ELSE ext[2:] END AS type, CASE WHEN error IS NULL THEN 'loaded' ELSE 'failed' END AS status, error,
  CASE WHEN error IS NOT NULL THEN NULL WHEN ext = '.pdf' THEN bytes || ' bytes' || chr(10) || content
    WHEN ext IN ('.txt', '.md') THEN regexp_replace(content, '\\r\\n?', chr(10), 'g') ELSE content END AS content,
  CASE WHEN ext = '.pdf' THEN string_split(path, '/')[-1] END AS name FROM f""",
    "embedder_routing": f"""WITH {SQL_MANIFEST} SELECT path, (CASE WHEN ext IN ('.txt', '.md') THEN 64 ELSE 32 END)::BIGINT AS dimension
FROM m WHERE ext NOT IN ('.pdf', '.exe')""",
    "append_count": f"WITH {_STORABLE} SELECT 2 * count(*) AS document_count FROM c WHERE status = 'added'",
    "upsert_count": f"WITH {_STORABLE} SELECT type, count(*) AS documents, count(*) AS replaced FROM c WHERE status = 'added' GROUP BY type",
}
