"""File-fact columns: path parts, ids, hashes, sizes, ages, permissions, kinds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extensions by kind of file.
CODE_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h",
    ".hpp", ".cs", ".go", ".rs", ".php", ".rb", ".swift", ".kt", ".kts",
    ".scala", ".sql", ".sh", ".bash", ".zsh", ".pl", ".pm", ".lua", ".r",
)
DOCUMENT_EXTENSIONS = (".txt", ".md", ".rst", ".pdf", ".doc", ".docx", ".odt", ".rtf")
IMAGE_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif",
    ".webp", ".svg", ".ico", ".heic", ".heif", ".nef", ".arw", ".dng",
)
# First bytes (hex) of archive formats, and the tar mark at byte 257.
ARCHIVE_HEADERS = ("504B", "1F8B", "52617221", "377A", "425A", "FD377A585A00")
TAR_MARK = "7573746172"

# Size classes with their exclusive upper bounds in bytes.
SIZE_CATEGORIES = (
    ("tiny", 1024),
    ("very_small", 10 * 1024),
    ("small", 100 * 1024),
    ("medium", 1024 * 1024),
    ("large", 10 * 1024 * 1024),
    ("very_large", None),
)
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
RECENT_DAYS, OLD_DAYS = 30, 365
PERMISSION_LETTERS = "rwxrwxrwx"


def doc_id(path: Column) -> Column:
    return F.md5(path)


def file_hash(content: Column, algorithm: str = "sha256") -> Column:
    if algorithm == "sha256":
        return F.sha2(content, 256)
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    raise ValueError(f"unknown hash algorithm: {algorithm}")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def raw_extension(path: Column) -> Column:
    """Last dotted suffix of the base name; leading dots start no suffix."""
    return F.regexp_extract(file_name(path), r"(?s)\A\.*+[^.].*?(\.[^.]*)\z", 1)


def extension(path: Column) -> Column:
    return F.lower(raw_extension(path))


def path_parts(path: Column) -> dict[str, Column]:
    name = file_name(path)
    suffix = raw_extension(path)
    parent = F.substring(path, F.lit(1), F.length(path) - F.length(name) - 1)
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    absolute = F.startswith(path, F.lit("/"))
    return {
        "filename": name,
        "extension": F.lower(suffix),
        "stem": F.substring(name, F.lit(1), F.length(name) - F.length(suffix)),
        "parent_dir": F.when(slashes == 0, ".").when(absolute & (slashes == 1), "/").otherwise(parent),
        "depth": F.when(absolute, slashes - 1).otherwise(slashes).cast("bigint"),
        "is_hidden": F.startswith(name, F.lit(".")),
    }


def size_category(size: Column) -> Column:
    label = None
    for name, bound in SIZE_CATEGORIES:
        if bound is None:
            return label.otherwise(name)
        label = F.when(size < bound, name) if label is None else label.when(size < bound, name)
    return label


def format_size(size: Column) -> Column:
    """Human size with one decimal, halves rounded to even."""
    value = size.cast("double")
    text = None
    for power, unit in enumerate(SIZE_UNITS):
        scaled = value / float(1024**power)
        shown = F.format_string(f"%.1f {unit}", F.bround(scaled, 1))
        if unit == SIZE_UNITS[-1]:
            return text.otherwise(shown)
        text = F.when(scaled < 1024, shown) if text is None else text.when(scaled < 1024, shown)
    return text


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def age_columns(created: Column, modified: Column, now: Column) -> dict[str, Column]:
    seconds = _seconds(now, created)
    days = seconds / 86400
    return {
        "age_days": days,
        "age_hours": seconds / 3600,
        "age_minutes": seconds / 60,
        "days_since_modified": _seconds(now, modified) / 86400,
        "is_recent": days < RECENT_DAYS,
        "is_old": days > OLD_DAYS,
    }


def iso_time(moment: Column) -> Column:
    """ISO 8601; microseconds are written only when there are any."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    fine = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.unix_micros(moment) % 1_000_000 == 0, whole).otherwise(fine)


def human_time(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def octal_permissions(mode: Column) -> Column:
    return F.right(F.conv(mode.cast("string"), 10, 8), F.lit(3))


def readable_permissions(mode: Column) -> Column:
    """Nine letters or dashes, blank-separated, from owner to others."""
    mode = mode.cast("bigint")
    letters = [
        F.when(mode.bitwiseAND(F.lit(1 << (8 - place)).cast("bigint")) != 0, letter).otherwise("-")
        for place, letter in enumerate(PERMISSION_LETTERS)
    ]
    return F.concat_ws(" ", *letters)


def kind_columns(ext: Column) -> dict[str, Column]:
    return {
        "is_code_file": ext.isin(*CODE_EXTENSIONS),
        "is_document": ext.isin(*DOCUMENT_EXTENSIONS),
        "is_image": ext.isin(*IMAGE_EXTENSIONS),
    }


def is_archive(content: Column) -> Column:
    header = F.hex(F.substring(content, 1, 8))
    found = F.hex(F.substring(content, 258, 5)) == TAR_MARK
    for magic in ARCHIVE_HEADERS:
        found = found | F.startswith(header, F.lit(magic))
    return found


def is_text(content: Column) -> Column:
    """The first 1024 characters decode as UTF-8."""
    return F.is_valid_utf8(F.substring(content.cast("string"), 1, 1024))


# What a hit says about where it matched.
MATCH_LABELS = {
    "file_content": "✓ Match from file content",
    "metadata_only": "ℹ Match from metadata only",
}
UNKNOWN_MATCH = "? Unknown match source"


def match_label(source: Column) -> Column:
    label = None
    for value, shown in MATCH_LABELS.items():
        label = F.when(source == value, shown) if label is None else label.when(source == value, shown)
    return label.otherwise(UNKNOWN_MATCH)


def match_target(source: Column, content: Column, name: Column, path: Column) -> Column:
    """Text that snippets are cut from: the content, else the name and the path."""
    named = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(path, F.lit("")))
    return F.when(source == "file_content", content).otherwise(named)
