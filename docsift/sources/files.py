"""File scan, exclusions and loader dispatch."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docsift.functions.files import extension

# Folders that are never scanned, and suffixes that are skipped.
DEFAULT_EXCLUDES = (
    "__pycache__", "node_modules", ".git", "venv", ".venv", "env",
    "dist", "build", ".angular", ".cache", ".idea", ".vscode",
    "python3.12", "python3.11", "python3.10", "python3.9",
    "lib/python3", "local/lib/python",
)
SKIPPED_SUFFIXES = (".pyc", ".bak", ".pyo", ".so", ".dll", ".exe")

# Loaders in order of precedence with their extensions.
LOADERS = {
    "text": (".txt", ".md", ".rst", ".text", ".dat", ".inp", ".neu"),
    "markup": (".html", ".css", ".json", ".xml", ".yaml", ".yml"),
    "pdf": (".pdf",),
    "excel": (".xlsx", ".xls"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff"),
    "code": (
        ".py", ".cpp", ".c", ".h", ".hpp", ".js", ".ts", ".java",
        ".go", ".rs", ".rb", ".php", ".sh", ".bash", ".cc", ".kt", ".lua",
    ),
    "json": (".json", ".jsonl", ".geojson"),
    "modfem": (".modfem",),
}


def excluded_names(user_excludes: Iterable[str] = ()) -> list[str]:
    return sorted({*DEFAULT_EXCLUDES, *user_excludes})


def in_excluded_folder(path: Column, excludes: Iterable[str], root: str = "") -> Column:
    """A folder below ``root`` on the way to the file has an excluded name."""
    prefix = root.rstrip("/") + "/"
    below = F.when(F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
    parts = F.split(below, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(name) for name in excludes]))


def has_skipped_suffix(path: Column) -> Column:
    pattern = "|".join(suffix.replace(".", "\\.") for suffix in SKIPPED_SUFFIXES)
    return path.rlike(f"(?:{pattern})\\z")


def scan_files(
    spark: SparkSession,
    root: str,
    exclude_dirs: Iterable[str] | None = None,
    glob: str | None = None,
) -> DataFrame:
    """One row per file below ``root``: path, size, times and bytes.

    With ``exclude_dirs`` (possibly empty) the default and the given folder
    names and the skipped suffixes are left out; with ``None`` nothing is.
    The bytes are only read if a later step selects them, and never those of
    left-out files. A file that is too long for one value
    (``spark.sql.sources.binaryFile.maxLength``) has null bytes.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    plain = F.regexp_replace("path", r"\Afile:/*", "/")
    below = root.removeprefix("file:")
    found = reader.load(root)
    if exclude_dirs is not None:
        # a filter on the file's own address keeps the scan from opening the file
        address = F.regexp_replace(F.col("_metadata.file_path"), r"\Afile:/*", "/")
        plain_names = [name for name in excluded_names(exclude_dirs) if re.fullmatch(r"[\w.-]+", name, re.ASCII)]
        found = found.filter(~in_excluded_folder(address, plain_names, below) & ~has_skipped_suffix(address))
    longest = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))

    def facts(rows: DataFrame, content: Column) -> DataFrame:
        return rows.select(
            plain.alias("path"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified_time"),
            F.col("modificationTime").alias("created_time"),
            content.alias("content"),
        )

    long = facts(found.filter(F.col("length") > longest), F.lit(None).cast("binary"))
    files = facts(found.filter(F.col("length") <= longest), F.col("content")).unionAll(long)
    if exclude_dirs is None:
        return files
    return files.filter(~in_excluded_folder(F.col("path"), excluded_names(exclude_dirs), below)).filter(
        ~has_skipped_suffix(F.col("path"))
    )


def loader_rows(extensions: Iterable[str] | None = None, extra: dict[str, Iterable[str]] | None = None) -> list[tuple]:
    """(extension, loader, order), where the first loader of an extension wins."""
    allowed = set(extensions) if extensions else None
    rows: dict[str, tuple] = {}
    for order, (loader, own) in enumerate([*LOADERS.items(), *(extra or {}).items()]):
        for ext in own:
            if allowed is None or ext in allowed:
                rows.setdefault(ext, (ext, loader, order))
    return sorted(rows.values())


def loader_table(
    spark: SparkSession,
    extensions: Iterable[str] | None = None,
    extra: dict[str, Iterable[str]] | None = None,
) -> DataFrame:
    """The dispatch table; a few dozen rows, fixed by the code."""
    rows = loader_rows(extensions, extra)
    table = {name: pa.array([row[at] for row in rows], pa.string()) for at, name in enumerate(("extension", "loader"))}
    return spark.createDataFrame(pa.table(table))


def dispatch(
    files: DataFrame,
    extensions: Iterable[str] | None = None,
    extra: dict[str, Iterable[str]] | None = None,
    path: str = "path",
) -> DataFrame:
    """Add ``extension`` and ``loader`` (null if no loader takes the file)."""
    table = loader_table(files.sparkSession, extensions, extra)
    return files.withColumn("extension", extension(F.col(path))).join(F.broadcast(table), "extension", "left")


def supported_extensions(spark: SparkSession, extensions: Iterable[str] | None = None) -> DataFrame:
    return loader_table(spark, extensions).select("extension").distinct()


def matching_loaders(spark: SparkSession, extensions: Iterable[str]) -> DataFrame:
    """Loaders that share an extension with the request, by set intersection."""
    pairs = [(ext, loader) for loader, own in LOADERS.items() for ext in own]
    own = spark.createDataFrame(pairs, "extension string, loader string")
    wanted = spark.createDataFrame([(ext,) for ext in extensions], "extension string")
    shared = own.select("extension").intersect(wanted)
    return own.join(shared, "extension", "left_semi").select("loader").distinct()
