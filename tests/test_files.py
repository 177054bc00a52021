import hashlib
import os
import stat
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from docsift.functions import files as ff
from docsift.operators import stats
from docsift.sources import files as scan

C = F.col("c")


def test_path_parts(spark):
    paths = ["/a/b/c.TXT", "/c.txt", "c.txt", "a/b.tar.gz", "/x/.bashrc", "/x/..x", "/x/.hid.py", "/x/noext", "/x/dot.", "/a.b/c"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for row in df.select("path", *[c.alias(n) for n, c in ff.path_parts(F.col("path")).items()]).collect():
        path = PurePosixPath(row.path)
        stem, suffix = os.path.splitext(path.name)
        assert (row.filename, row.extension, row.stem) == (path.name, suffix.lower(), stem)
        assert (row.parent_dir, row.depth) == (str(path.parent), len(path.parents) - 1)
        assert row.is_hidden == path.name.startswith(".")


def test_ids_and_hashes(column):
    assert column(["/a/b.txt"], ff.doc_id(C)) == [hashlib.md5(b"/a/b.txt").hexdigest()]
    for name in ("sha256", "md5", "sha1"):
        assert column(["é"], ff.file_hash(C.cast("binary"), name)) == [hashlib.new(name, "é".encode()).hexdigest()]
    with pytest.raises(ValueError):
        ff.file_hash(C, "crc")


def test_sizes(column):
    sizes = [0, 1023, 1024, 1280, 1048576, 10240, 102400, 10485760, 5 * 1024**4]
    assert column(sizes, ff.format_size(C), "c bigint") == [
        "0.0 B", "1023.0 B", "1.0 KB", "1.2 KB", "1.0 MB", "10.0 KB", "100.0 KB", "10.0 MB", "5.0 TB",
    ]
    sizes = [1023, 1024, 10240, 102400, 1048576, 10485760]
    assert column(sizes, ff.size_category(C), "c bigint") == ["tiny", "very_small", "small", "medium", "large", "very_large"]


def test_permissions(column):
    modes = [0o100644, 0o100755, 0o100000, 0o100777, 0o100421]
    assert column(modes, ff.octal_permissions(C), "c bigint") == [oct(mode)[-3:] for mode in modes]
    expected = [" ".join(stat.filemode(mode)[1:]) for mode in modes]
    assert column(modes, ff.readable_permissions(C), "c bigint") == expected


def test_times_and_ages(spark):
    df = spark.sql("select timestamp'2025-12-02 12:00:00' a, timestamp'2024-12-31 00:00:00.5' b, timestamp'2026-01-01' now")
    ages = ff.age_columns(F.col("a"), F.col("b"), F.col("now"))
    row = df.select(*[c.alias(n) for n, c in ages.items()], ff.iso_time(F.col("b")), ff.human_time(F.col("b"))).first()
    assert (row.age_days, row.age_hours, row.age_minutes, row.is_recent, row.is_old) == (29.5, 708, 42480, True, False)
    assert row.days_since_modified == pytest.approx(366 - 0.5 / 86400)
    assert tuple(row)[-2:] == ("2024-12-31T00:00:00.500000", "2024-12-31 00:00:00")


def test_raw_bytes(column):
    tar = b"x" * 257 + b"ustar" + b"x"
    samples = [b"PK\x03\x04", b"\x1f\x8b", b"Rar!x", b"7z", b"BZh", b"\xfd7zXZ\x00", tar, b"plain", b"", b"xPK"]
    assert column(samples, ff.is_archive(C), "c binary") == [True] * 7 + [False] * 3
    long = ("é" * 1024).encode()
    samples = [b"text", b"\xff\xfe", long, long + b"\xff", b"", b"a\xc3"]
    assert column(samples, ff.is_text(C), "c binary") == [True, False, True, True, True, False]


def test_first_loader_wins():
    table = {ext: loader for ext, loader, _ in scan.loader_rows()}
    assert len(table) == 42
    assert (table[".json"], table[".jsonl"], table[".geojson"], table[".c"]) == ("markup", "json", "json", "code")
    assert {ext for ext, _, _ in scan.loader_rows([".md", ".exe", ".json"])} == {".md", ".json"}


def test_dispatch(spark):
    paths = ["/a/x.PY", "/a/x.exe", "/a/x.json", "/a/x"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.loader for r in scan.dispatch(df).collect()} == {
        "/a/x.PY": "code", "/a/x.exe": None, "/a/x.json": "markup", "/a/x": None,
    }
    assert {r.loader for r in scan.dispatch(df, [".py"]).collect()} == {"code", None}
    assert {r.loader for r in scan.matching_loaders(spark, [".json", ".md"]).collect()} == {"json", "markup", "text"}
    assert scan.supported_extensions(spark).count() == 42


@pytest.fixture
def tree(tmp_path):
    for name in ("a.txt", "sub/b.py", "node_modules/c.js", "sub/dist/d.md", "lib/python3/e.py", "f.pyc", "my dir/g.txt", "skip/h.md"):
        file = tmp_path / "dist" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(name)
    return tmp_path / "dist"


def _names(df, root):
    return sorted(os.path.relpath(row.path, root) for row in df.select("path").collect())


def test_scan(spark, tree):
    assert len(_names(scan.scan_files(spark, str(tree)), tree)) == 8
    # The root may have an excluded name; names with a slash never match.
    assert _names(scan.scan_files(spark, str(tree), ["skip"]), tree) == ["a.txt", "lib/python3/e.py", "my dir/g.txt", "sub/b.py"]
    row = scan.scan_files(spark, str(tree)).filter(F.col("path").endswith("a.txt")).first()
    assert (row.size_bytes, bytes(row.content)) == (5, b"a.txt")


def test_reports(spark):
    df = spark.createDataFrame(
        [("/a", "tiny", 10, 0.2), ("/b", "large", 30, 0.9), ("/c", "tiny", 20, 0.4)], "path string, size_category string, size_bytes int, s double"
    )
    total = stats.corpus_totals(df).first()
    assert (total.total_files, total.total_bytes, total.average_bytes, total.total_size, total.average_size) == (3, 60, 20, "60.0 B", "20.0 B")
    assert [(r.size_category, r.files) for r in stats.size_histogram(df).collect()] == [("tiny", 2), ("large", 1)]
    assert [r.path for r in stats.slowest_files(df, "s", "path", 2).collect()] == ["/b", "/c"]
    assert stats.slowest_files(df.filter("s < 0.5"), "s", "path").count() == 0
    timed = stats.timing_summary(df, "s", F.lit(3.0)).first()
    assert (timed.files, timed.min_seconds, timed.max_seconds, timed.files_per_second) == (3, 0.2, 0.9, 1.0)
    assert stats.corpus_totals(df.limit(0)).first().total_files == 0


def test_oldest_and_newest_take_the_first_path(spark):
    df = spark.sql(
        "select * from values ('/b', 'b', timestamp'2020-01-01'), ('/a', 'a', timestamp'2020-01-01'), "
        "('/d', 'd', timestamp'2021-01-01'), ('/c', 'c', timestamp'2021-01-01'), ('/z', 'z', null) as t(path, filename, created_time)"
    )
    row = stats.oldest_newest(df).first()
    assert (row.oldest_file, row.newest_file, row.newest_date) == ("a", "c", "2021-01-01 00:00:00")
