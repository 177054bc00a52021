import random
from collections import defaultdict

from docsift.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, row string, lines int, at string"


def brute(docs, min_words):
    """Delete what any run of min_words words or more covers that has an earlier copy."""
    docs = sorted({d[:2] for d in docs if d[1]}, key=lambda d: d[0])
    runs, out = defaultdict(list), {d: set() for d in docs}
    for doc in docs:
        lines = [line for line in doc[1].split("\n") if line.split()]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(len(line.split()) for line in lines[i:j]) >= min_words:
                    runs[tuple(lines[i:j])].append((doc, i, j))
    for places in runs.values():
        for doc, i, j in places[1:]:
            out[doc].update(range(i, j))
    return {doc: kept(doc[1], gone) for doc, gone in out.items()}


def kept(text, gone):
    lines, at, keep = text.split("\n"), -1, []
    marks = []
    for line in lines:
        at += bool(line.split())
        marks.append((line, at if line.split() else None, at))
    for line, own, before in marks:
        if own is None:
            inside = before in gone and before + 1 in gone
            keep.append((line, None if inside else line))
        else:
            keep.append((line, None if own in gone else line))
    return "\n".join(line for _, line in keep if line is not None)


def result(spark, rows, min_words):
    df = spark.createDataFrame([(*row, "x", 1, "y") for row in rows], SCHEMA)
    return dedup_lines(df, "doc_id", "text", min_words)


def test_random_texts_match_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(9)]
    rows = [(n, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for n in range(60)]
    rows += [(100 + n, rows[n][1] + "\n" + rows[n + 1][1]) for n in range(10)]
    for min_words in (1, 5, 9):
        want = brute(rows, min_words)
        got = result(spark, rows, min_words).collect()
        assert {(r.doc_id, w): r.text for r, w in ((r, dict(rows)[r.doc_id]) for r in got) if w} == want


def test_nulls_blank_lines_ties_and_clashing_names(spark):
    run = "one two three\n\nfour five six"
    rows = [(None, run), (1, None), (2, ""), (3, f"a\n{run}\nb"), (3, f"a\n{run}\nb"), (4, f"\n{run}\n\n"), (5, " \n\t")]
    got = result(spark, rows, 6).orderBy("doc_id", "text").collect()
    assert [(r.doc_id, r.text, r.lines, r.deleted_lines) for r in got] == [
        (None, run, 2, 0), (1, None, 0, 0), (2, "", 0, 0), (3, "a\nb", 4, 2), (3, "a\nb", 4, 2), (4, "\n\n", 2, 2), (5, " \n\t", 0, 0),
    ]
    assert (got[0].row, got[0].at) == ("x", "y")


def test_empty_table(spark):
    assert result(spark, [], 5).count() == 0


def test_long_run_of_one_line_keeps_the_first_copy(spark):
    got = result(spark, [(1, "\n".join(["w " * 10] * 500))], 50).collect()
    assert got[0].text.count("\n") < 10 and got[0].lines == 500
