import json

import pytest
from pyspark.sql import functions as F

from docsift.functions import json_text as jt
from docsift.operators.embed import embed_by_type, hashed_embedding
from docsift.plans.index import added_documents, process_files
from docsift.schema import DOCUMENT_SCHEMA, columns_of
from docsift.queries.loaders import append_count, parsed_files, upsert_count
from docsift.sources.files import dispatch, scan_files
from docsift.sources.loaders import image_text, jsonl_documents, load_documents, load_with_file_parsers, load_with_parsers
from docsift.sources.parts import cells_documents, column_letter, paged_documents, paragraph_documents, table_to_cells
from docsift.sources.store import (
    append_documents, clear_documents, count_documents, newest_documents, open_documents, upsert_documents,
)

C = F.col("c")
NESTED = {
    "name": "Test Document",
    "version": "1.0",
    "metadata": {"author": "John Doe", "created": "2024-01-01", "tags": ["test", "json", "loader"]},
    "data": [1, 2, 3, 4, 5],
}


def files(spark, contents):
    rows = [(path, len(body), bytearray(body)) for path, body in contents.items()]
    df = spark.createDataFrame(rows, "path string, size_bytes bigint, content binary")
    return df.withColumns({"created_time": F.lit("2025-12-31").cast("timestamp"), "modified_time": F.lit("2025-12-31").cast("timestamp")})


def load(spark, contents, **options):
    loaded = load_documents(dispatch(files(spark, contents)), **options)
    return {row.path: row for row in loaded.collect()}


def test_text_markup_code(spark):
    rows = load(
        spark,
        {
            "/t.txt": b"a\r\nb\rc",
            "/m.json": json.dumps({"name": "test"}, indent=2).encode(),
            "/c.Py": b"#!/usr/bin/env python3\n# Sample\n\nimport os\n\ndef hello():\n    # greet\n    print(1)\n    return 2\n",
            "/bad.txt": b"caf\xe9",
            "/x.exe": b"MZ",
            "/m.modfem": b"12345",
            "/e.xlsx": b"",
            "/f.pdf": b"%PDF",
        },
    )
    assert (rows["/t.txt"].content, rows["/t.txt"].type, rows["/t.txt"].embedding_type) == ("a\nb\nc", "text", "bert")
    assert (rows["/m.json"].type, json.loads(rows["/m.json"].content)) == ("markup", {"name": "test"})
    code = rows["/c.Py"]
    assert (code.type, code.language, code.lines_total, code.lines_code, code.lines_comments) == ("code", "Py", 10, 4, 3)
    assert (rows["/bad.txt"].status, rows["/bad.txt"].error) == ("failed", "not valid UTF-8")
    assert rows["/x.exe"].status == "unsupported"
    assert rows["/m.modfem"].content == "Femap 3D model file: m.modfem\nSize: 5 bytes\nNote: Binary format - only metadata is searchable"
    assert (rows["/m.modfem"].match_source, rows["/m.modfem"].type) == ("metadata_only", "femap_model")
    assert (rows["/e.xlsx"].content, rows["/e.xlsx"].match_source) == ("Empty Excel file: e.xlsx", "metadata_only")
    assert (rows["/f.pdf"].status, rows["/f.pdf"].error) == ("failed", "no parser registered")


def test_jsonl_file(spark):
    three = b'{"id": 1, "name": "First"}\n\n{"id": 2, "name": "Second"}\nnot json\n{"id": 3, "name": "Third"} '
    many = "\n".join(json.dumps({"n": n}) for n in range(102)).encode()
    bodies = {"/a.jsonl": three, "/b.jsonl": many, "/c.jsonl": b"{} trailing"}
    rows, previews = load(spark, bodies), load(spark, bodies, preview=True)
    a = rows["/a.jsonl"]
    assert (a.type, a.total_chars) == ("jsonl", 79)
    assert a.content.startswith('JSONL file with 3 lines\n\n[Line 1]:\n{\n  "id": 1,\n  "name": "First"\n}\n\n[Line 3]:\n')
    assert rows["/b.jsonl"].content.endswith('[Line 101]:\n{\n  "n": 100\n}\n\n[Line 102]:\n{\n  "n": 101\n}')
    assert previews["/b.jsonl"].content.endswith('[Line 100]:\n{\n  "n": 99\n}\n\n... and 1 more lines')
    assert rows["/c.jsonl"].content == "JSONL file with 0 lines\n"


def test_jsonl_lines_agree_with_files(spark):
    bodies = {"/a.jsonl": b'{"k": [1, {"x": "y"}]}\nnope\n  [2]  \n', "/b.jsonl": b"\n\n", "/c.jsonl": b"7\n" * 150}
    whole = load(spark, bodies)
    lines = [(path, n, line) for path, body in bodies.items() for n, line in enumerate(body.decode().split("\n"), 1)]
    table = spark.createDataFrame(lines, "path string, line_no int, line string")
    for row in jsonl_documents(table, "path", lines_per_part=1000).collect():
        assert (row.part, row.content, row.total_chars) == (0, whole[row.path].content, whole[row.path].total_chars)
    parts = jsonl_documents(table.where("path = '/c.jsonl'"), "path").orderBy("part").collect()
    assert [(r.part, r.line_count) for r in parts] == [(0, 100), (1, 50)]
    body = "".join(r.content.split("lines\n", 1)[1] + "\n" for r in parts)
    assert body == whole["/c.jsonl"].content.split("lines\n", 1)[1] + "\n"


def test_json_documents(spark):
    array = [{"id": n, "name": f"Item {n}"} for n in (1, 2, 3)]
    rows = load(spark, {"/o.geojson": json.dumps(NESTED).encode(), "/a.geojson": json.dumps(array).encode(), "/bad.geojson": b"{"})
    o, a = rows["/o.geojson"], rows["/a.geojson"]
    assert (o.structure_type, o.nesting_depth, o.key_count, o.top_keys, o.item_count) == ("nested", 4, 4, "name,version,metadata,data", None)
    assert o.content.startswith('name: "Test Document"\nversion: "1.0"\nmetadata:\n  author: "John Doe"\n')
    assert (a.structure_type, a.key_count, a.item_count, a.nesting_depth) == ("array_of_objects", None, None, None)
    assert (rows["/bad.geojson"].status, rows["/bad.geojson"].error) == ("failed", "not valid JSON")


def test_large_json_is_sampled(spark):
    items = json.dumps([{"n": n} for n in range(12)]).encode()
    rows = load(spark, {"/a.geojson": items, "/o.geojson": b'{"x": 1, "y": {"x": 2}}', "/s.geojson": b'["s"]'}, large_json_bytes=4, preview=True)
    head = 'JSON file with 0 top-level items\n\n\nItem 1:\n{\n  "n": 0\n}\n\nItem 2:'
    assert rows["/a.geojson"].content.startswith(head)
    assert rows["/a.geojson"].content.endswith('Item 10:\n{\n  "n": 9\n}\n\n... and -10 more items')
    assert rows["/o.geojson"].content == "JSON file with 2 top-level items\n"
    assert rows["/s.geojson"].content == 'JSON file with 0 top-level items\n\n\nItem 1:\n"s"'
    assert (rows["/o.geojson"].is_large_file, rows["/o.geojson"].parsing_method) == (1, "streaming")
    whole = load(spark, {"/a.geojson": items}, large_json_bytes=4)["/a.geojson"]
    assert whole.content.endswith("[11]:\n  n: 11") and whole.content.count("n: ") == 12
    assert (whole.is_large_file, whole.parsing_method, whole.item_count) == (1, "full_load", None)


JSONS = ["[]", "[1]", "[[1]]", "{}", '{"a":1}', '{"a":{"b":1}}', "5", '"{["', '{"a":"}{","b":[[],{}]}', ' [ "]" , 2.5 ]']


def test_json_structure(spark, column):
    df = jt.with_structure(spark.createDataFrame(list(enumerate(JSONS)), "n int, j string"), "j").orderBy("n")
    assert [row.structure_type for row in df.collect()] == [
        "array", "array", "array_of_objects", "object", "object", "nested", "primitive", "primitive", "nested", "array",
    ]

    def depth(value, level=1):
        inner = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []
        return max([level, *(depth(item, level + 1) for item in inner)])

    assert column(JSONS, jt.nesting_depth(C)) == [depth(json.loads(text)) for text in JSONS]
    assert [row.first_item_type for row in df.collect()][:2] == [None, "int"]
    many = json.dumps({f"k{n}": n for n in range(21)})
    row = jt.with_structure(spark.createDataFrame([(many,)], "j string"), "j").first()
    assert (row.key_count, row.top_keys) == (21, ",".join(f"k{n}" for n in range(10)) + ",...")


def test_json_validity(column):
    good = ['{"a":1}', " [1] ", "5", '"x"', "null", '{"a":1,"a":2}']
    bad = ["", "{", '{"a":1} x', "1]", "1} {", "1,2", "1] [2", '{"a":01}', "[1,]", "nul", "'a'"]
    assert column(good + bad, jt.is_json(C)) == [True] * len(good) + [False] * len(bad)


def test_json_outline(column):
    deep = json.dumps({"a": {"b": {"c": {"d": 1}}}, "list": list(range(22)), "s": "x" * 201, "t": True, "n": None, "f": 1e16})
    shown = column([deep], jt.json_preview(C))[0]
    assert shown.startswith("a:\n  b:\n    c:\n      [Deep nesting truncated]\n\nlist:\n  [0]: 0\n")
    assert "\n  [19]: 19\n  ... and 2 more items\n" in shown
    assert shown.endswith(f's: "{"x" * 200}..."\nt: true\nn: null\nf: 1e+16')
    whole = column([deep], jt.json_to_text(C))[0]
    assert whole.startswith("a:\n  b:\n    c:\n      d: 1\nlist:\n  [0]: 0\n") and "\n  [21]: 21\ns: " in whole
    assert f's: "{"x" * 201}"\nt: true' in whole
    assert column(['{"": 1, "e": {}, "l": [[], 2]}'], jt.json_to_text(C)) == [": 1\ne:\n\nl:\n  [0]:\n\n  [1]: 2"]
    for shown in (jt.json_to_text, jt.json_preview):
        assert column(["5", '"q"', "[]", "not json"], shown(C)) == ["5", '"q"', "", None]


def test_json_values_and_paths(column):
    values = ['"a\\"b"', "1", "true", "null", "2.50", f'"{"y" * 201}"']
    assert column(values, jt.format_value(C, 200)) == ['"a"b"', "1", "true", "null", "2.5", f'"{"y" * 200}..."']
    assert column(values, jt.format_value(C))[-1] == f'"{"y" * 201}"'
    text = json.dumps({"a": {"b": [{"c": 1}, {"c": None}]}})
    assert column([text], jt.json_path(C, "a.b[0].c")) == [["1"]]
    assert column([text], jt.json_path(C, "a.b[1].c")) == [["null"]]
    assert column([text], jt.json_path(C, "a.x")) == [None]
    with pytest.raises(ValueError):
        jt.json_path(C, "a.b[*].c")


def test_pages_and_paragraphs(spark):
    pages = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one"), ("a", 3, ""), ("b", 1, ""), ("b", 2, " ")], "d string, n int, t string")
    a, b = paged_documents(pages, "d", "n", "t").orderBy("d").collect()
    assert (a.content, a.pages, a.match_source, a.has_text_content) == ("one\ntwo\n", 3, "file_content", True)
    assert (b.content, b.match_source) == ("[PDF document with 2 pages - no extractable text content]", "metadata_only")
    assert paragraph_documents(pages.filter("d = 'a'"), "d", "n", "t").first().content == "one\ntwo\n"


def test_cells(spark):
    table = spark.createDataFrame(
        [(2, "John Doe", "Engineering", "75000"), (3, "Jane Smith", "Marketing", "68000")], "r int, Name string, Department string, Salary string"
    )
    cells = table_to_cells(table, F.lit("book"), 0, "Employees", F.col("r"), ["Name", "Department", "Salary"])
    row = cells_documents(cells).first()
    assert (row.total_rows, row.total_cells, row.sheets_with_data, row.has_data) == (3, 9, 1, 1)
    assert (row.sheet_names, row.sheet_info) == ("Employees", "Employees:3x3")
    assert "\nRow 2: A2: John Doe | B2: Engineering | C2: 75000\n" in row.content


def test_blank_and_zero_rows(spark):
    cells = spark.createDataFrame(
        [("w", 0, "S", 1, 0, "x"), ("w", 0, "S", 2, 0, " "), ("w", 0, "S", 3, 1, "0"), ("w", 1, "E", 1, 0, None)],
        "doc string, sheet_no int, sheet string, row int, col int, value string",
    )
    row = cells_documents(cells).first()
    assert row.content == "\n[Sheet: S]\nDimensions: 3 rows × 2 columns\n\nRow 1: A1: x\nRow 3: B3: 0\n\n\n[Sheet: E] - Empty sheet\n"
    assert (row.total_cells, row.sheets_with_data, row.total_sheets) == (2, 1, 2)
    assert cells_documents(cells, legacy_zeros=True).first().total_cells == 1


def test_column_letters(column):
    numbers = [0, 25, 26, 701, 702, 18277, 18278, -1]
    assert column(numbers, column_letter(C), "c bigint") == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ", "AAAA", "?"]


def test_image_facts_make_an_empty_document(spark, column):
    text = image_text(C, F.lit(4), F.lit(3), F.lit("PNG"), F.lit("RGB"))
    assert column(["/a/p.png"], text) == ["Image file: p.png\nDimensions: 4x3\nFormat: PNG\nMode: RGB\n"]


def test_user_parser(spark):
    def parse(batches):
        for pdf in batches:
            yield pdf.assign(content=[None if b"bad" in bytes(body) else f"pages of {path}" for path, body in zip(pdf.path, pdf.content)])

    def parser(df):
        schema = ", ".join(f"{f.name} {'string' if f.name == 'content' else f.dataType.simpleString()}" for f in df.schema)
        return df.mapInPandas(parse, schema)

    bodies = {"/a.pdf": b"x", "/b.pdf": b"bad", "/c.txt": b"plain text"}
    rows = {r.path: r for r in load_with_parsers(dispatch(files(spark, bodies)), {".pdf": parser}).collect()}
    assert (rows["/a.pdf"].content, rows["/a.pdf"].type, rows["/a.pdf"].status) == ("pages of /a.pdf", "pdf", "loaded")
    assert (rows["/b.pdf"].status, rows["/c.txt"].content) == ("failed", "plain text")
    new = {r.path: r for r in process_files(files(spark, {"/z.odd": b"x"}), parsers={".odd": parser}).collect()}
    assert (new["/z.odd"].content, new["/z.odd"].status) == ("pages of /z.odd", "added")


def test_file_parsers_take_one_pass(spark, tmp_path):
    for name, body in {"a.pdf": b"one", "b.pdf": b"bad", "c.odd": b"\xff", "d.txt": b"plain text", "e.zip": b"x"}.items():
        (tmp_path / name).write_bytes(body)

    def pdf(path, body):
        if body == b"bad":
            raise ValueError(path)
        return body.decode() + " page", {"pages": "1"}

    found = dispatch(scan_files(spark, str(tmp_path)), extra={".odd": [".odd"]})
    loaded = load_with_file_parsers(found, {".pdf": pdf, ".odd": lambda path, body: None})
    rows = {r.path.rsplit("/", 1)[1]: (r.status, r.error, r.content, r.facts) for r in loaded.collect()}
    assert rows == {
        "a.pdf": ("loaded", None, "one page", {"pages": "1"}), "b.pdf": ("failed", "parser failed: ValueError", None, None),
        "c.odd": ("failed", "parser returned nothing", None, None), "d.txt": ("loaded", None, "plain text", None),
        "e.zip": ("unsupported", "no loader takes this extension", None, None),
    }
    nothing = files(spark, {"/x.pdf": b""}).withColumn("content", F.lit(None).cast("binary"))
    row = load_with_file_parsers(dispatch(nothing), {".pdf": pdf}).first()
    assert (row.status, row.error) == ("failed", "no bytes to parse")


def test_parsed_files_scan_once(spark):
    plan = parsed_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_index_from_disk_to_store(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\n# note\nprint(os.name)\n")
    (tmp_path / "src" / "b.txt").write_text("some words here, and more. " * 3)
    (tmp_path / "src" / "short.txt").write_text("tiny")
    (tmp_path / "src" / "bad.md").write_bytes(b"\xff\xfe\xfd")
    (tmp_path / "src" / "x.bin").write_bytes(b"\0")
    processed = process_files(scan_files(spark, str(tmp_path / "src")))
    by_name = {row.filename: row for row in processed.collect()}
    assert {name: row.status for name, row in by_name.items()} == {
        "a.py": "added", "b.txt": "added", "short.txt": "empty", "bad.md": "failed", "x.bin": "unsupported",
    }
    assert by_name["bad.md"].is_binary and by_name["a.py"].is_code_file and by_name["a.py"].lines_comments == 1
    store = str(tmp_path / "store")
    append_documents(added_documents(processed, hashed_embedding), store)
    stored = open_documents(spark, store)
    assert stored.columns != [] and {name for name, _ in columns_of(DOCUMENT_SCHEMA)} == set(stored.columns)
    assert count_documents(stored).first()[0] == 2
    assert all(len(row.embedding) == 256 and row.file_hash_sha256 for row in stored.collect())
    append_documents(added_documents(processed, hashed_embedding), store)
    assert count_documents(open_documents(spark, store)).first()[0] == 4
    clear_documents(spark, store)
    assert open_documents(spark, store).count() == 0
    append_documents(added_documents(processed), store)
    assert open_documents(spark, store).count() == 2


SMALL = "doc_id string, type string, content string"


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([("a", "text", "old a"), ("b", "text", "old b")], SMALL)
    new = spark.createDataFrame([("b", "code", "new b"), ("c", "text", "new c")], SMALL)
    upsert_documents(old, new, str(tmp_path / "u"))
    rows = {r.doc_id: r.content for r in open_documents(spark, str(tmp_path / "u"), SMALL).collect()}
    assert rows == {"a": "old a", "b": "new b", "c": "new c"}


def test_versions_are_cut_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id % 1 as doc_id", "id as loaded")
    newest = newest_documents(df, "loaded")
    assert newest.first().loaded == 9
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_embedder_routing(spark):
    df = spark.createDataFrame([("text", "one two"), ("code", "x = 1"), (None, "z")], "type string, content string")

    def failing(text):
        return F.lit(None).cast("array<float>")

    both = embed_by_type(df, lambda t: hashed_embedding(t, 8), lambda t: hashed_embedding(t, 4)).collect()
    assert {row.type: len(row.embedding) for row in both} == {"text": 8, "code": 4, None: 4}
    fallback = embed_by_type(df, failing, lambda t: hashed_embedding(t, 4)).collect()
    assert all(len(row.embedding) == 4 for row in fallback)


@pytest.mark.parametrize("text", ["", "one", "one one two", "Ünï cödé_1 x", None])
def test_embedding_is_unit_length_or_zero(spark, text):
    row = spark.createDataFrame([(text,)], "c string").select(hashed_embedding(F.col("c"), 16).alias("v")).first()
    if text is None:
        assert row.v is None
    else:
        assert len(row.v) == 16 and sum(x * x for x in row.v) == pytest.approx(1.0 if text else 0.0, abs=1e-6)


def test_whole_text_is_encoded(spark):
    df = spark.createDataFrame([("a " * 50_000 + "zzz",), ("a " * 50_000,)], "c string")
    first, second = df.select(hashed_embedding(F.col("c")).alias("v")).collect()
    assert first.v != second.v


def test_store_queries_process_files_and_leave_out_empty_ones(spark, tmp_path):
    # they only loaded the files before, and stored those without meaningful content too
    texts = ["a text that is long enough", "short", None, "<p>markup of some length</p>", "Image file: x.png, nothing more", "   \n\t  "]
    rows = [(n, "s", "en", text, len(text or "")) for n, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert append_count(spark, str(tmp_path)).head()[0] == 4
    assert sorted(map(tuple, upsert_count(spark, str(tmp_path)).collect())) == [("markup", 1, 1), ("text", 1, 1)]
