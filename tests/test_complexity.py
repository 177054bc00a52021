import pytest
from pyspark.sql import functions as F

from docsift.functions import complexity as cx

C = F.col("c")


def test_bracket_depth_never_goes_below_zero(column):
    texts = [")\n((\n)\n(((", "", "no brackets", "(((\n)))\n{[", "(()", "}}}\n{"]
    assert column(texts, cx.max_bracket_depth(C)) == [4, 0, 0, 3, 1, 1]


def test_indent(column):
    texts = ["a\n    b\n\t\tc", "    \n  x", "\n\n   y", "", "none\n", "  first\n\n     last"]
    assert column(texts, cx.max_indent(C)) == [4, 2, 3, 0, 0, 5]


def test_operator_symbols_overlap_on_purpose(spark):
    # "==" is also two "=", "a<=b" has "<", "<=" and "=".
    df = spark.createDataFrame([("a == b", 3), ("a<=b", 3), ("x += 1", 3), ("plain", 0), ("p != q", 2)], "c string, want int")
    counted = df.withColumn("s", cx.operator_symbols(C)).withColumn("got", cx.code_counts("c", "s")["operators"])
    assert counted.filter("got <> want").count() == 0


def test_code_score_by_hand(spark):
    code = "def f(x):\n    if x:\n        return {1: [x]}\n# done"
    # 4 lines, 9 + 9 + 23 + 6 = 47 chars; depth 0 on every line end, indent 8 // 4 = 2;
    # operators ':' x3; functions 1; branches 'if ' 1; comments 1 of 4.
    expected = 20 * 0.35 + 47 / 4 / 80 * 60 * 0.15 + 3 / 4 / 5 * 100 * 0.15 + 50 * 0.10 + 1 / 4 * 50 * 0.25 - 30 / 4
    df = spark.createDataFrame([(code,)], "content string")
    assert cx.with_code_complexity(df).first().complexity_score == pytest.approx(expected)


def test_text_score_by_hand(spark):
    text = "One two. Three four five!"
    # '. ' splits into 2 parts, '!' is not followed by a blank: 2 sentences, 5 words, 21 characters.
    sentence, word = 2.5 / 12 * 40, 21 / 5 / 6 * 50
    vowel_groups = 2 + 1 + 1 + 1 + 2
    ease = 206.835 - 1.015 * 2.5 - 84.6 * (5 + vowel_groups) / 5
    level = max(0, min(100, (100 - ease) / 2))
    expected = sentence * 0.25 + word * 0.20 + 100 * 0.20 + 0 + 5 / 75 * 50 * 0.10 + level * 0.15
    df = spark.createDataFrame([(text,)], "content string")
    assert cx.with_text_complexity(df).first().complexity_score == pytest.approx(expected)


def test_bounds_and_blank(spark):
    texts = ["", "   ", "{" * 500, "a", "if (x) { y ? z : w } else { for (;;) while (1) }" * 50, "word " * 5000, "!?.;:" * 99]
    df = spark.createDataFrame([(t, code) for t in texts for code in (True, False)], "content string, is_code_file boolean")
    rows = cx.with_complexity(df).collect()
    assert all(0 <= row.complexity_score <= 100 for row in rows)
    assert all(row.complexity_score == 0 for row in rows if not row.content.strip())
    assert set(rows[0].asDict()) == {"content", "is_code_file", "complexity_score"}
