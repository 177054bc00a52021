"""From files to a document table in one lazy plan without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from docsift.functions import files as ff
from docsift.functions.complexity import with_complexity
from docsift.functions.text import content_counts, content_density, is_empty, lexical_counts, lexical_ratios, py_strip, py_words
from docsift.operators.embed import Embedder, embed
from docsift.sources.files import dispatch
from docsift.sources.loaders import Parser, load_with_parsers


def with_file_facts(files: DataFrame, now: Column) -> DataFrame:
    """Path, size, time, permission and kind columns of a file row.

    Only the kind and hash of the raw bytes need ``content``; they are added by
    :func:`process_files` before the bytes become text.
    """
    path, size = F.col("path"), F.col("size_bytes")
    parts = {name: column for name, column in ff.path_parts(path).items() if name != "extension"}
    times = {name: F.col(name) for name in ("created_time", "modified_time")}
    created, modified = times["created_time"], times["modified_time"]
    ages = ff.age_columns(created, modified, now)
    mode = F.col("mode") if "mode" in files.columns else F.lit(None).cast("bigint")
    return files.withColumns(
        {
            "doc_id": ff.doc_id(path),
            **parts,
            "size_human": ff.format_size(size),
            "size_category": ff.size_category(size),
            **ages,
            "age_days": F.bround(ages["age_days"], 1),
            "age_hours": F.bround(ages["age_hours"], 1),
            "created_date": ff.iso_time(created),
            "modified_date": ff.iso_time(modified),
            "permissions": ff.octal_permissions(mode),
            **ff.kind_columns(F.col("extension")),
        }
    )


def with_content_facts(docs: DataFrame) -> DataFrame:
    """Counts, ratios and complexity of ``content``; the text is split into words once."""
    text, words = F.col("content"), F.col("__words")
    split = docs.withColumn("__words", py_words(text)).withColumn("__terms", F.transform("__words", F.lower))
    counted = split.withColumns({**content_counts(text, words), **lexical_counts(text, F.col("__terms"))})
    ratios = lexical_ratios(*[F.col(name) for name in ("term_count", "unique_terms", "term_chars", "sentence_count")])
    rated = counted.withColumns({**ratios, "content_density": content_density(F.col("word_count"), F.col("size_bytes"))})
    return with_complexity(rated, words="__words").drop("term_count", "term_chars", "__words", "__terms")


def process_files(
    files: DataFrame,
    now: Column | None = None,
    extensions: Iterable[str] | None = None,
    parsers: dict[str, Parser] | None = None,
) -> DataFrame:
    """One row per file with all document columns, ``status`` and ``error``.

    Status is ``added``, ``empty``, ``failed`` or ``unsupported``; a file that
    cannot be read never stops the run. What a scan has found about a file
    (``status`` other than ``read``, with ``error``) stays as it is.
    """
    now = F.current_timestamp() if now is None else now
    scanned = {"status": "__scan_status", "error": "__scan_error"} if {"status", "error"} <= set(files.columns) else {}
    files = files.withColumnsRenamed(scanned)
    raw = F.col("content")
    own = {ext: [ext] for ext in parsers or {}}
    routed = dispatch(files, extensions, own)
    text = ff.is_text(raw)
    known = routed.withColumns(
        {
            "is_text": text,
            "is_binary": ~text,
            "is_archive": ff.is_archive(raw.cast("binary")),
            "file_hash_sha256": ff.file_hash(raw.cast("binary")),
        }
    )
    loaded = load_with_parsers(known, parsers or {})
    full = with_content_facts(with_file_facts(loaded, now))
    # Kept with the document, so that a search can filter without its content.
    facts = {"is_empty": is_empty(F.col("content")), "text_chars": F.length(py_strip(F.col("content"))).cast("bigint")}
    full = full.withColumns(facts)
    if scanned:
        unread = F.coalesce(F.col("__scan_status") != "read", F.lit(False))
        kept = {name: F.when(unread, F.col(old)).otherwise(F.col(name)) for name, old in scanned.items()}
        full = full.withColumns(kept).drop(*scanned.values())
    empty = (F.col("status") == "loaded") & F.col("is_empty")
    return full.withColumns(
        {
            "error": F.when(empty, "no meaningful content").otherwise(F.col("error")),
            "status": F.when(empty, "empty").when(F.col("status") == "loaded", "added").otherwise(F.col("status")),
        }
    )


def added_documents(processed: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Documents worth storing, with their vectors if an embedder is given."""
    docs = processed.filter(F.col("status") == "added")
    return embed(docs, embedder=embedder) if embedder else docs
