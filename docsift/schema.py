"""The one fixed schema of stored documents; loader-specific columns are nullable."""

from pyspark.sql import Column, DataFrame, functions as F

DOCUMENT_SCHEMA = """
    row_id string, doc_id string, path string, filename string, extension string, parent_dir string, depth bigint,
    type string, match_source string, embedding_type string, content string,
    size_bytes bigint, size_human string, size_category string,
    created_time timestamp, modified_time timestamp, age_days double, age_hours double,
    is_recent boolean, is_old boolean, created_date string, modified_date string,
    word_count bigint, char_count bigint, line_count bigint, paragraph_count bigint, sentence_count bigint,
    unique_terms bigint, lexical_diversity double, avg_word_length double, avg_sentence_length double,
    has_content boolean, is_empty boolean, text_chars bigint, content_density double, complexity_score double,
    is_text boolean, is_binary boolean, is_code_file boolean, is_document boolean, is_image boolean,
    is_archive boolean, file_hash_sha256 string, permissions string,
    language string, lines_total bigint, lines_code bigint, lines_comments bigint,
    pages bigint, has_text_content boolean, width bigint, height bigint, format string,
    total_sheets bigint, total_rows bigint, total_cells bigint, sheets_with_data bigint, has_data bigint,
    sheet_names string, sheet_info string,
    structure_type string, item_count bigint, key_count bigint, nesting_depth bigint, top_keys string,
    first_item_type string, parsing_method string, is_large_file bigint, total_chars bigint,
    embedding array<float>
"""


def row_key(df: DataFrame) -> str:
    """The column that names one stored row; only tables without copies may do with ``doc_id``."""
    return "row_id" if "row_id" in df.columns else "doc_id"


def columns_of(schema: str) -> list[tuple[str, str]]:
    """(name, type) of every column of a schema text."""
    return [tuple(part.split()) for part in schema.split(",")]


def conform(df: DataFrame, schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """Select the schema's columns in order, null where the input has none."""

    def column(name: str, kind: str) -> Column:
        source = F.col(name) if name in df.columns else F.lit(None)
        return source.cast(kind).alias(name)

    return df.select(*[column(name, kind) for name, kind in columns_of(schema)])
