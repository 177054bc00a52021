"""Files to documents in one pass: every built-in loader is a set of Column rules.

The input has one row per file with ``path``, ``extension``, ``loader``,
``size_bytes`` and ``content`` (bytes, or text that was decoded before). The
output keeps one row per file and adds the document columns, ``status``
(``loaded``, ``failed`` or ``unsupported``) and ``error``; nothing raises.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docsift.functions.files import file_name, raw_extension
from docsift.functions.json_text import is_json, json_preview, json_to_text, pretty_items, pretty_json, with_structure
from docsift.functions.text import code_line_counts, py_strip

# Limits of previews of JSON Lines and of large JSON files.
JSONL_ENTRIES, ENTRY_CHARS = 100, 500
LARGE_JSON_BYTES, SAMPLE_ITEMS = 10 * 1024 * 1024, 10
LINES_PER_PART = 100

Parser = Callable[[DataFrame], DataFrame]
# Path and bytes of a file to its text, or to its text and facts; None if there is no text.
FileParser = Callable[[str, bytes], "str | tuple[str | None, dict[str, str]] | None"]


def decode_text(content: Column) -> Column:
    """Strict UTF-8 with line ends made ``\\n``; null if the bytes are not UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "\r\n?", "\n"))


def metadata_text(loader: Column, path: Column, size: Column) -> Column:
    """Text made of file facts, for files whose bytes hold none."""
    name = file_name(path)
    model = F.concat_ws(
        "\n",
        F.concat(F.lit("Femap 3D model file: "), name),
        F.concat(F.lit("Size: "), size.cast("string"), F.lit(" bytes")),
        F.lit("Note: Binary format - only metadata is searchable"),
    )
    empty_sheet = F.concat(F.lit("Empty Excel file: "), name)
    return F.when(loader == "modfem", model).when((loader == "excel") & (size == 0), empty_sheet)


def image_text(path: Column, width: Column, height: Column, fmt: Column, mode: Column) -> Column:
    """Text made of image facts that a manifest brings along."""
    return F.concat(
        F.lit("Image file: "), file_name(path),
        F.lit("\nDimensions: "), width.cast("string"), F.lit("x"), height.cast("string"),
        F.lit("\nFormat: "), fmt, F.lit("\nMode: "), mode, F.lit("\n"),
    )


def jsonl_entries(text: Column) -> Column:
    """Valid lines of a JSON Lines text as ``array<struct<line_no, line>>``."""
    lines = F.transform(
        F.split(text, "\n"), lambda line, n: F.struct((n + 1).alias("line_no"), py_strip(line).alias("line"))
    )
    return F.filter(lines, lambda entry: (entry["line"] != "") & is_json(entry["line"]))


def _jsonl_text(count: Column, numbers: Column, pretty: Column, preview: bool = False) -> Column:
    def entry(number: Column, body: Column) -> Column:
        shown = F.substring(body, 1, ENTRY_CHARS) if preview else body
        return F.concat(F.lit("\n[Line "), number.cast("string"), F.lit("]:\n"), shown)

    entries = F.zip_with(numbers, pretty, entry)
    if preview:
        more = F.when(count > JSONL_ENTRIES, F.array(F.lit("\n... and 1 more lines")))
        entries = F.concat(entries, more.otherwise(F.array().cast("array<string>")))
    head = F.concat(F.lit("JSONL file with "), count.cast("string"), F.lit(" lines\n"))
    return F.concat(head, F.array_join(entries, "\n"))


def jsonl_documents(
    lines: DataFrame, doc: str, line_no: str = "line_no", line: str = "line", lines_per_part: int = LINES_PER_PART
) -> DataFrame:
    """JSON Lines documents from a table with one row per line, in numbered parts that hold every line whole.

    ``part`` is set by the line number, so a part brings together at most ``lines_per_part`` lines (with numbers from 1),
    and a document of any length is no hot group. A part without a valid line says so.
    """
    number = F.col(line_no).cast("bigint")
    part = F.floor((number - 1) / lines_per_part).alias("part")
    clean = lines.select(doc, part, number.alias("line_no"), py_strip(F.col(line)).alias("line"))
    valid = (F.col("line") != "") & is_json(F.col("line"))
    # collect_list passes over nulls
    entry = F.when(valid, F.struct("line_no", "line"))
    parts = clean.groupBy(doc, "part").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    pretty = pretty_json(F.transform("entries", lambda entry: entry["line"]))
    numbers = F.transform("entries", lambda entry: entry["line_no"])
    count = F.size("entries").cast("bigint")
    total = F.aggregate("entries", F.lit(0).cast("bigint"), lambda chars, entry: chars + F.length(entry["line"]))
    return parts.withColumn("__pretty", pretty).select(
        doc,
        "part",
        F.lit("jsonl").alias("type"),
        _jsonl_text(count, numbers, F.col("__pretty")).alias("content"),
        count.alias("line_count"),
        total.alias("total_chars"),
    )


def large_json_text(text: Column, samples: Column) -> Column:
    """Header with the number of root keys, then sample items of a root array.

    Keys are counted for a root object only and items are sampled from a root
    array only, so one of the two is always empty; the count in the last line
    is taken from the keys.
    """
    keys = F.coalesce(F.size(F.array_distinct(F.json_object_keys(text))), F.lit(0))
    items = F.coalesce(F.json_array_length(text), F.lit(0))
    shown = F.transform(
        samples,
        lambda item, n: F.concat(F.lit("\nItem "), (n + 1).cast("string"), F.lit(":\n"), F.substring(item, 1, ENTRY_CHARS)),
    )
    rest = F.concat(F.lit("\n... and "), (keys - SAMPLE_ITEMS).cast("string"), F.lit(" more items"))
    more = F.when(items > SAMPLE_ITEMS, F.array(rest)).otherwise(F.array().cast("array<string>"))
    head = F.concat(F.lit("JSON file with "), keys.cast("string"), F.lit(" top-level items\n"))
    return F.array_join(F.concat(F.array(head), shown, more), "\n")


# Document type and embedder label of each loader.
_TYPES = {
    "text": "text", "markup": "markup", "pdf": "pdf", "excel": "excel",
    "image": "image", "code": "code", "json": "json", "modfem": "femap_model",
}
DOCUMENT_EMBEDDERS = {"text": "bert"}
OTHER_EMBEDDER = "ollama"


def load_documents(files: DataFrame, large_json_bytes: int = LARGE_JSON_BYTES, preview: bool = False) -> DataFrame:
    """Apply the built-in loaders to dispatched files.

    ``content`` holds all of a file, whatever its size. With ``preview`` JSON files show only their beginning: the first
    hundred lines of JSON Lines, an outline with limits, and ten items of a file above ``large_json_bytes``.
    """
    loader, path, size = F.col("loader"), F.col("path"), F.col("size_bytes")
    is_jsonl = (loader == "json") & (F.col("extension") == ".jsonl")
    is_tree = (loader == "json") & (F.col("extension") != ".jsonl")
    reads_text = loader.isin("text", "markup", "code", "json")

    df = files.withColumn("__text", F.when(reads_text, decode_text(F.col("content"))))
    text = F.col("__text")
    df = df.withColumns(
        {
            "__tree": F.when(is_tree & is_json(text), text),
            "__entries": F.when(is_jsonl, jsonl_entries(text)),
        }
    )
    big = size > large_json_bytes
    sampled = big if preview else F.lit(False)
    first = F.slice("__entries", 1, JSONL_ENTRIES) if preview else F.col("__entries")
    outline = json_preview if preview else json_to_text
    df = df.withColumns(
        {
            "__outline": outline(F.when(~sampled, F.col("__tree"))),
            "__pretty": pretty_json(F.transform(first, lambda entry: entry["line"])),
        }
    )
    df = with_structure(df.withColumn("__small_tree", F.when(~sampled, F.col("__tree"))), "__small_tree")
    count = F.size("__entries").cast("bigint")
    tree_text = F.col("__outline")
    if preview:
        df = df.withColumn("__samples", pretty_items(F.when(big, F.col("__tree")), F.lit(SAMPLE_ITEMS)))
        tree_text = F.when(big, large_json_text(F.col("__tree"), F.col("__samples"))).otherwise(tree_text)
    facts_text = metadata_text(loader, path, size)
    content = (
        F.when(loader.isin("text", "markup", "code"), text)
        .when(is_jsonl, _jsonl_text(count, F.transform(first, lambda entry: entry["line_no"]), F.col("__pretty"), preview))
        .when(is_tree, tree_text)
        .otherwise(facts_text)
    )
    kind = None
    for name, shown in _TYPES.items():
        kind = F.when(loader == name, shown) if kind is None else kind.when(loader == name, shown)
    is_code = loader == "code"
    lines = code_line_counts(F.when(is_code, text))
    error = (
        F.when(loader.isNull(), "no loader takes this extension")
        .when(reads_text & text.isNull(), "not valid UTF-8")
        .when(is_tree & F.col("__tree").isNull(), "not valid JSON")
        .when(loader.isin("pdf", "image", "excel") & facts_text.isNull(), "no parser registered")
    )
    all_lines = F.array_join(F.transform("__entries", lambda entry: entry["line"]), "")
    loaded = df.withColumns(
        {
            "type": F.when(is_jsonl, "jsonl").otherwise(kind),
            "match_source": F.when(facts_text.isNotNull(), "metadata_only").otherwise("file_content"),
            "embedding_type": F.when(loader.isin(*DOCUMENT_EMBEDDERS), "bert").otherwise(OTHER_EMBEDDER),
            "language": F.when(is_code, F.substring(raw_extension(path), F.lit(2), F.length(path))),
            **{name: F.when(is_code, column) for name, column in lines.items()},
            "is_large_file": F.when(is_tree, big.cast("bigint")),
            "parsing_method": F.when(is_tree, F.when(sampled, "streaming").otherwise("full_load")),
            "total_chars": F.when(is_jsonl, F.length(all_lines).cast("bigint")),
            "format": F.when(loader == "modfem", "binary"),
            "has_data": F.when((loader == "excel") & (size == 0), 0).cast("bigint"),
            "error": error,
            "status": F.when(loader.isNull(), "unsupported").when(error.isNotNull(), "failed").otherwise("loaded"),
            "__content": content,
        }
    )
    internal = ("__text", "__tree", "__small_tree", "__entries", "__outline", "__samples", "__pretty", "content")
    return loaded.drop(*internal).withColumnRenamed("__content", "content")


def load_with_parsers(files: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    """Built-in loaders plus user parsers, keyed by extension.

    A parser is a DataFrame-to-DataFrame function (for example a
    ``mapInPandas``): it gets the rows of its extension and returns them with
    ``content`` set, null where it failed, and any document columns it knows.
    """
    plugged = F.coalesce(F.col("extension").isin(*parsers), F.lit(False))
    parts = [load_documents(files.filter(~plugged))]
    for ext, parse in parsers.items():
        parsed = parse(files.filter(F.col("extension") == ext))
        failed = F.col("content").isNull()
        defaults = {
            "type": F.substring("extension", 2, 100),
            "match_source": F.lit("file_content"),
            "embedding_type": F.lit(OTHER_EMBEDDER),
        }
        missing = {name: column for name, column in defaults.items() if name not in parsed.columns}
        parts.append(
            parsed.withColumns(
                {
                    **missing,
                    "error": F.when(failed, "parser returned nothing"),
                    "status": F.when(failed, "failed").otherwise("loaded"),
                }
            )
        )
    return union_documents(*parts)


def load_with_file_parsers(files: DataFrame, parsers: dict[str, FileParser]) -> DataFrame:
    """Built-in loaders plus functions for single files, keyed by extension, in one pass over the files.

    Only the bytes of files with such an extension go to Python. A parser that raises or returns no text makes its file
    ``failed``, with the kind of the exception in ``error``, and the run goes on; a file without bytes is not parsed.
    ``facts`` holds what else a parser returns about its file.
    """
    plugged = F.coalesce(F.col("extension").isin(*parsers), F.lit(False))

    @F.pandas_udf("text string, problem string, facts map<string,string>")
    def parse(paths: pd.Series, extensions: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for path, ext, body in zip(paths, extensions, bodies):
            text, problem, facts = None, None, None
            if body is not None:
                try:
                    found = parsers[ext](path, bytes(body))
                    text, facts = found if isinstance(found, tuple) else (found, None)
                    problem = "parser returned nothing" if text is None else None
                except Exception as error:  # whatever a file does to its parser, the others go on
                    problem = f"parser failed: {type(error).__name__}"
            rows.append((text, problem, facts))
        return pd.DataFrame(rows, columns=["text", "problem", "facts"])

    body = F.when(plugged, F.col("content").cast("binary"))
    # no filter moves below a nondeterministic function and runs it again
    parsed = files.withColumns({"__found": parse.asNondeterministic()("path", "extension", body), "__loader": F.col("loader")})
    routed = parsed.withColumns(
        {"loader": F.when(plugged, "parser").otherwise(F.col("loader")), "content": F.when(~plugged, F.col("content"))}
    )
    loaded = load_documents(routed)
    text, problem = F.col("__found")["text"], F.col("__found")["problem"]
    unread = F.when(text.isNull(), F.coalesce(problem, F.lit("no bytes to parse")))
    return loaded.withColumns(
        {
            "loader": F.col("__loader"),
            "type": F.when(plugged, F.substring("extension", 2, 100)).otherwise(F.col("type")),
            "content": F.when(plugged, text).otherwise(F.col("content")),
            "error": F.when(plugged, unread).otherwise(F.col("error")),
            "status": F.when(plugged, F.when(text.isNull(), "failed").otherwise("loaded")).otherwise(F.col("status")),
            "facts": F.col("__found")["facts"],
        }
    ).drop("__found", "__loader")


def union_documents(*parts: DataFrame) -> DataFrame:
    """Union loader outputs by name; columns a loader lacks become null."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole

