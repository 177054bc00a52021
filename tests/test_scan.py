import os

import pytest
from pyspark.sql import functions as F

from docsift.plans.index import process_files
from docsift.sources.files import scan_files
from docsift.sources.scan import FileScan, _Reader, scan_each_file


@pytest.fixture
def folder(tmp_path):
    for name, body in {
        "a.txt": b"some words here, and more of them", "deep/b.md": b"\xc3\xa9t\xc3\xa9 and a few more words", "venv/c.txt": b"left out",
        "deep/d.pyc": b"left out", "empty.txt": b"", "long.txt": b"x" * 5000,
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    return tmp_path


def _by_name(rows):
    return {os.path.basename(r.path): (r.status, r.error, None if r.content is None else bytes(r.content)) for r in rows}


def test_every_file_is_a_row(spark, folder):
    rows = scan_each_file(spark, str(folder), exclude_dirs=[], longest=1000).collect()
    assert _by_name(rows) == {
        "a.txt": ("read", None, b"some words here, and more of them"), "b.md": ("read", None, "été and a few more words".encode()),
        "c.txt": ("skipped", "excluded folder", None), "d.pyc": ("skipped", "skipped suffix", None), "empty.txt": ("read", None, b""),
        "long.txt": ("failed", "longer than one value", None),
    }
    whole = scan_each_file(spark, str(folder))
    assert whole.filter("status = 'read'").count() == 6
    facts = ["path", "size_bytes", F.date_trunc("second", "modified_time"), "content"]
    # Spark's file sources pass over empty files
    assert sorted(map(tuple, whole.filter("size_bytes > 0").select(*facts).collect())) == sorted(map(tuple, scan_files(spark, str(folder)).select(*facts).collect()))


def test_unreadable_and_vanished_files_fail_alone(spark, folder):
    """One file without read permission, one removed and one made a folder after the listing."""
    reader = _Reader({"path": str(folder)})
    [part] = reader.partitions()
    (folder / "long.txt").unlink()
    (folder / "empty.txt").unlink()
    (folder / "empty.txt").mkdir()
    (folder / "a.txt").chmod(0)
    found = {os.path.basename(row["path"]): (row["status"], row["content"]) for batch in reader.read(part) for row in batch.to_pylist()}
    assert found["long.txt"] == ("failed", None) and found["empty.txt"] == ("failed", None)
    assert found["b.md"][0] == "read"
    # the superuser may read everything
    assert found["a.txt"][0] == ("read" if os.geteuid() == 0 else "failed")


def test_partitions_are_cut_by_bytes(folder):
    parts = _Reader({"path": str(folder), "partitionbytes": "100"}).partitions()
    assert len(parts) > 1 and sum(len(part.files) for part in parts) == 6
    assert all(sum(size for _, size, _, _ in part.files) <= 100 or len(part.files) == 1 for part in parts)


def test_failed_and_skipped_files_are_counted(spark, folder):
    processed = process_files(scan_each_file(spark, str(folder), exclude_dirs=[], longest=1000))
    statuses = {row["status"]: row["count"] for row in processed.groupBy("status").count().collect()}
    assert statuses == {"added": 2, "skipped": 2, "empty": 1, "failed": 1}
    errors = {os.path.basename(row.path): row.error for row in processed.filter("status in ('skipped', 'failed')").collect()}
    assert errors == {"c.txt": "excluded folder", "d.pyc": "skipped suffix", "long.txt": "longer than one value"}


def test_missing_root_and_empty_folder(spark, tmp_path):
    assert scan_each_file(spark, str(tmp_path)).count() == 0
    assert FileScan.name() == "docsift_files"
    with pytest.raises(Exception, match="missing"):
        scan_each_file(spark, str(tmp_path / "missing")).count()
