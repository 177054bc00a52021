import sys

import pyarrow as pa
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from docsift.functions import text as tx
from docsift.operators import snippets
from docsift.operators.snippets import occurrences, ranked_snippets, with_snippets

C = F.col("c")
SAMPLES = [
    "",
    "   ",
    "one",
    "a  b\tc\nd\r\ne",
    "wide\u3000blank\u2003and\x85next\xa0line\u2028end\x1cfile\x1fdone",
    "Ünïcode wörds\n\nsecond paragraph. Done! Really? yes...",
    " leading and trailing \n",
    "zero\u200bwidth stays",
]


def test_whitespace_is_that_of_python(column):
    chars = [chr(code) for code in range(sys.maxunicode + 1) if chr(code).isspace() or code < 0x3100]
    chars = [char for char in chars if char != "\0"]
    blank = column(chars, tx.is_blank(C))
    assert [char for char, is_blank in zip(chars, blank) if is_blank] == [char for char in chars if char.isspace()]
    assert sorted(tx.WHITESPACE) == sorted(char for char in chars if char.isspace())


def test_words_and_strip(column):
    assert column(SAMPLES, tx.py_words(C)) == [text.split() for text in SAMPLES]
    assert column(SAMPLES, tx.py_strip(C)) == [text.strip() for text in SAMPLES]


def test_content_counts(column):
    got = column(SAMPLES, F.struct(*tx.content_counts(C).values()))
    for text, row in zip(SAMPLES, got):
        words = text.split()
        assert tuple(row) == (len(words), len(text), text.count("\n") + 1, text.count("\n\n") + 1, len(words) > 0)
    known = "This is a test document about Python programming and machine learning."
    assert tuple(column([known], F.struct(*tx.content_counts(C).values()))[0])[:3] == (11, 70, 1)


def test_lexical_counts(column):
    for text, row in zip(SAMPLES, column(SAMPLES, F.struct(*tx.lexical_counts(C).values()))):
        words = text.lower().split()
        assert tuple(row) == (len(words), len(set(words)), sum(map(len, words)), sum(map(text.count, ".!?")))


def test_count_literal_does_not_overlap(column):
    assert column(["aaaa", "aa", "", "baab"], tx.count_literal(C, "aa")) == [2, 1, 0, 1]


def test_code_lines(column):
    code = "#!/usr/bin/env python3\n# comment\nimport os\n\ndef f():\n    // odd\n    return 1\n\n  x = 2\ny = 3\nz"
    row = column([code], F.struct(*tx.code_line_counts(C).values()))[0]
    assert tuple(row) == (11, 6, 3)


def test_keywords(column):
    queries = ["what is the", "the quick quick fox", "UTF-9", "", "python programming", "été abc chéabc x_1"]
    expected = [["what", "is", "the"], ["quick", "quick", "fox"], ["utf"], [], ["python", "programming"], ["abc", "x_1"]]
    assert column(queries, tx.extract_keywords(C)) == expected


def test_positions(column):
    rows = [("aaaa", ["aa", "a"]), ("x.y.z", ["."]), ("\\Q\\E", ["\\E"]), ("none", ["q"]), ("äbä", ["ä"])]
    got = column(rows, tx.literal_positions("c", "d"), "c string, d array<string>")
    assert got == [[[0, 2], [0, 1, 2, 3]], [[1, 3]], [[2]], [[]], [[0, 2]]]


def test_snippet_window(column):
    text = "x" * 150 + "needle" + "y" * 150
    window = tx.snippet_window(C, F.lit(150), F.lit(6))
    assert column([text], window) == ["x" * 100 + "needle" + "y" * 100]
    assert column(["needle"], tx.snippet_window(C, F.lit(0), F.lit(6))) == ["needle"]


def test_highlight(column):
    def marked(text, query):
        return column([text], tx.highlight(C, F.lit(query), "<", "[", ">"))[0]

    # Keywords are marked inside the phrase and inside marks, too.
    assert marked("A Big Dog ran", "big dog") == "A <[Big> [Dog>> ran"
    assert marked("doghouse Dog", "dog") == "<[dog>>house <[Dog>>"
    assert marked("doghouse", "house") == "dog<[house>>"
    assert marked("nothing here", "dog") == "nothing here"
    assert marked("a.b axb", "a.b") == "<[a>.[b>> axb"
    assert marked("", "dog") == ""


def test_is_empty(column):
    texts = ["", "   \n", "123456789", "  123456789  ", "1234567890", "see exif data: here, long enough", None]
    assert column(texts, tx.is_empty(C)) == [True, True, True, True, False, True, True]


def _snippets(spark, text, query):
    hits = spark.createDataFrame([(1, text, query)], "id int, text string, query string")
    found = ranked_snippets(occurrences(hits, ["id"], F.col("text"), F.col("query")), ["id"])
    return found.orderBy("snippet_rank").collect()


def test_phrase_snippet_hides_keyword_snippets_of_the_same_start(spark):
    text = "This is a test document about Python programming and machine learning."
    (row,) = _snippets(spark, text, "python programming")
    assert (row.snippet, row.score, row.matched_terms, row.match_type) == (text, 1.0, ["python programming"], "exact_phrase")


def test_golden_query(spark):
    (row,) = _snippets(spark, '<?xml version="1.0" encoding="UTF-8"?> <!DOCTYPE typemap>', "UTF-9")
    assert (row.score, row.matched_terms, row.match_type) == (0.95, ["utf"], "keywords")


def test_without_keywords_no_snippets(spark):
    assert _snippets(spark, "some text ... here", "...") == []


def _brute_force_snippets(text, query, words):
    """Straight from the definition: windows by start, best three."""
    low, rows = text.lower(), []

    def places(needle):
        at = low.find(needle)
        while at >= 0:
            yield at
            at = low.find(needle, at + len(needle))

    for at in places(query.lower()):
        rows.append((1.0, text[max(0, at - 100) : at + len(query) + 100], [query]))
    groups = {}
    for word in words:
        for at in places(word):
            window = text[max(0, at - 100) : at + len(word) + 100]
            first, terms, count = groups.get(window[:50], (window, set(), 0))
            groups[window[:50]] = (first, terms | {word}, count + 1)
    for window, terms, count in groups.values():
        rows.append((min(0.95, 0.5 + count / len(words) * 0.45), window, sorted(terms)))
    best, seen = [], set()
    for score, window, terms in sorted(rows, key=lambda row: -row[0]):
        if window[:50] not in seen:
            seen.add(window[:50])
            best.append((window, round(score, 9), terms))
    return best[:3]


WORDS = st.lists(st.sampled_from(["alpha", "beta", "Gamma", "alphabet", "delta. ", "\n", "et"]), min_size=1, max_size=120)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(WORDS, st.sampled_from(["alpha beta", "gamma", "beta beta alpha"]))
def test_snippets_match_brute_force(spark, words, query):
    text = " ".join(words)
    got = [(row.snippet, round(row.score, 9), row.matched_terms) for row in _snippets(spark, text, query)]
    assert got == _brute_force_snippets(text, query, query.split())


def test_with_snippets_keeps_hits_without_a_match(spark):
    hits = spark.createDataFrame([(1, "has alpha in it"), (2, "nothing")], "id int, text string")
    rows = with_snippets(hits, ["id"], F.col("text"), F.lit("alpha")).orderBy("id").collect()
    assert [len(row.snippets) for row in rows] == [1, 0]


def test_position_follows_the_lower_cased_text(spark):
    # "İ" is two characters in lower case, so the window is shifted by one.
    (row,) = _snippets(spark, "İ" + "x" * 120 + "needle" + "y" * 120, "needle")
    assert row.snippet == "x" * 99 + "needle" + "y" * 101


def test_windows_leave_a_task_in_small_batches(monkeypatch):
    # all windows of a batch of texts were one nested value before
    monkeypatch.setattr(snippets, "BATCH_CHARS", 10_000)
    text = "In the end, in the beginning. " * 500
    columns = [pa.array([7, None]), pa.array([text, None]), pa.array([text.lower(), None]), pa.array(["in the"] * 2), pa.array([["in the", "in", "the"]] * 2)]
    batches = list(snippets._found(iter([pa.RecordBatch.from_arrays(columns, names=["id", "a", "b", "c", "d"])])))
    assert sum(batch.num_rows for batch in batches) == 1000 + 2000 + 1000
    assert max(sum(map(len, batch["snippet"].to_pylist())) for batch in batches) < 10_000 + 300
    assert all(set(batch["id"].to_pylist()) == {7} for batch in batches)


def _best_and_all(spark, rows):
    """Occurrences that can rank and all of them, each with the snippets ranked from them."""
    hits = spark.createDataFrame(rows, "id double, text string, query string").repartition(3)
    made = []
    for best in (snippets.MAX_SNIPPETS, None):
        found = occurrences(hits, ["id"], F.col("text"), F.col("query"), best=best)
        ranked = ranked_snippets(found, ["id"]).collect()
        made.append((found.collect(), sorted(map(str, ranked))))
    return made


def test_phrase_query_hands_on_only_what_can_rank(spark, tmp_path, monkeypatch):
    # every window was shuffled before, ten times the texts and more
    from docsift.queries import texts as queries

    numbers = range(400)
    long = " ".join(f"In the {n} we sing the {n * n} in {n * 7} rings." for n in numbers)
    other = " ".join(f"Sinn {n * n} breathe {n * 3}." for n in numbers)
    rows = [(n, text) for n, text in enumerate([long, other] * 5)] + [(10, "in the"), (11, "no match"), (12, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    monkeypatch.setattr(queries, "ranked_snippets", lambda found, keys: seen.append(found) or ranked_snippets(found, keys))
    got = queries.snippets_phrase(spark, str(tmp_path)).collect()
    per_text = {row.doc_id: row["count"] for row in seen[0].groupBy("doc_id").count().collect()}
    assert set(per_text) == set(range(11)) and max(per_text.values()) < 30
    everything = occurrences(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"], F.col("text"), F.lit("in the"))
    assert everything.count() > 5 * 1600
    want = ranked_snippets(everything, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.snippet_rank, r.snippet, r.score, r.match_type) for r in got) == sorted(
        (r.doc_id, r.snippet_rank, r.snippet, round(r.score, 6), r.match_type) for r in want
    )


def test_best_occurrences_of_hits_with_several_rows(spark):
    # what a row leaves out may rank once the other rows of its hit are known
    words = [f"{n * n * 7919 % 10007}" for n in range(120)]
    single = " ".join(f"alpha {a} {a}{b} padding of some length here, more of it" for a, b in zip(words, words[1:]))
    late = " ".join(f"x{a} {b}y nothing but padding of some length" for a, b in zip(words, words[1:])) + " " + single[3000:3600]
    phrase = single[:900] + " beta alpha " + single[900:1500]
    query = "beta alpha"
    rows = [(1.0, single, query), (1.0, late, query), (2.0, single, query), (2.0, phrase, query), (None, single, query), (None, late, query)]
    rows += [(float("nan"), single, query), (float("nan"), late, query), (3.0, single, query), (3.0, single, "beta alpha gamma"), (4.0, None, query), (4.0, late, query)]
    (some, got), (all_of_them, want) = _best_and_all(spark, rows)
    assert got == want and len(want) == 6 * 3
    assert len(some) < len(all_of_them) / 10


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([0.0, -0.0, 1.0]), WORDS), min_size=2, max_size=4), st.sampled_from(["alpha beta", "gamma", "beta beta alpha"]))
def test_best_occurrences_rank_as_all_do(spark, texts, query):
    # the first word numbers the rows, as snippets that tie are in no order
    rows = [(key, " " * n * 11 + f"{n} " + " ".join(words), query) for n, (key, words) in enumerate(texts)]
    (_, got), (_, want) = _best_and_all(spark, rows)
    assert got == want


def test_hits_too_large_to_decide_keep_all_occurrences(monkeypatch):
    text = " ".join(f"in {n * n}" for n in range(1000))
    needles = ["in the", "in", "the"]

    def counts(rows):
        ids, texts, numbers = zip(*rows)
        columns = [pa.array(ids), pa.array(texts), pa.array(texts), pa.array(["in the"] * len(ids)), pa.array([needles] * len(ids)), pa.array(numbers)]
        whole = pa.RecordBatch.from_arrays(columns, names=["id", "a", "b", "c", "d", "e"])
        found = [row for n in (1, 2, len(rows)) for batch in snippets._found((whole.slice(at, n) for at in range(0, len(rows), n)), 3) for row in batch["id"].to_pylist()]
        return {id: found.count(id) for id in set(ids)}

    rows = [(1, text, 1), (2, text, 3), (2, text, 3), (2, text, 3), (3, text, 1)]
    few = counts(rows)
    assert few[1] == few[3] < 100 and few[2] == 3 * few[1]
    monkeypatch.setattr(snippets, "HELD_CHARS", len(text) * 3 // 2)
    assert counts(rows) == {1: few[1], 2: 3 * 3000, 3: few[3]}
    monkeypatch.setattr(snippets, "HELD_STARTS", 500)
    assert counts(rows) == {1: 3 * 1000, 2: 3 * 3000, 3: 3 * 1000}
