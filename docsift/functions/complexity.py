"""Complexity scores from 0 to 100 for source code and for prose.

Each score is split in two steps: cheap integer counts taken from the text, and
arithmetic on those counts. :func:`with_complexity` keeps the steps in separate
projections, so that every count is evaluated once per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docsift.functions.text import (
    NON_WS, UNICODE, WS, count_chars, count_literal, count_literals, is_blank, py_words,
)

# The symbols, words and marks that are counted.
OPERATORS = (
    "+", "-", "*", "/", "%", "=", "==", "!=", "<", ">", "<=", ">=",
    "&&", "||", "&", "|", "^", "<<", ">>", "++", "--", "+=", "-=",
    "*=", "/=", "?", ":",
)
FUNCTION_MARKS = ("def ", "function ", "=>", "lambda", "class ")
BRANCH_MARKS = ("if ", "else", "elif ", "switch", "case", "for ", "while ", "catch", "?")
SENTENCE_ENDS = (". ", "! ", "? ", ".\n", "!\n", "?\n")
WORD_EDGE = ".,!?;:()[]{}\"'"
FINE_PUNCTUATION = ";:()\"'—–"


def _total(columns) -> Column:
    return reduce(lambda left, right: left + right, columns)


def max_bracket_depth(text: Column) -> Column:
    """Deepest running bracket balance over lines; it never drops below zero."""
    brackets = F.regexp_replace(text, r"[^{}()\[\]\n]+", "")
    lines = F.array_remove(F.split(brackets, "\n"), "")
    nets = F.transform(lines, lambda line: F.length(F.translate(line, "})]", "")) * 2 - F.length(line))

    def step(state: Column, net: Column) -> Column:
        now = F.greatest(F.lit(0), state["now"] + net)
        return F.struct(now.alias("now"), F.greatest(state["top"], now).alias("top"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))
    return F.aggregate(nets, start, step, lambda state: state["top"].cast("bigint"))


def max_indent(text: Column) -> Column:
    """Most leading whitespace characters on any non-blank line."""
    gap = WS.replace("]", "&&[^\\n]]")
    leads = F.regexp_extract_all(text, F.lit(f"{UNICODE}(?:\\A|\\n)({gap}++)(?={NON_WS})"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(leads, F.length)), F.lit(0)).cast("bigint")


def operator_symbols(text: Column) -> Column:
    """Only the characters operators are made of; no symbol holds a blank, so each count stays."""
    return F.regexp_replace(text, r"[^+\-*/%=!<>&|^?:]+", " ")


def code_counts(text: str, symbols: str) -> dict[str, Column]:
    """Counts of a text column and of the :func:`operator_symbols` of it."""
    lines = F.split(text, "\n")
    solid = F.filter(lines, lambda line: line.rlike(UNICODE + NON_WS))
    comment = f"{UNICODE}\\A{WS}*(?:#|//|/\\*)"
    single = "".join(symbol for symbol in OPERATORS if len(symbol) == 1)
    return {
        "lines": F.size(lines),
        "solid_lines": F.size(solid),
        "solid_chars": F.length(F.array_join(solid, "")),
        "depth": max_bracket_depth(F.col(text)),
        "indent": max_indent(F.col(text)),
        "operators": count_chars(F.col(symbols), single) + count_literals(symbols, [s for s in OPERATORS if len(s) > 1]),
        "functions": count_literals(text, FUNCTION_MARKS),
        "branches": count_literals(text, BRANCH_MARKS),
        "comments": F.size(F.filter(lines, lambda line: line.rlike(comment))),
    }


def code_score(c: dict[str, Column]) -> Column:
    """Weighted mix of nesting, line length, operators, functions and branches."""
    hundred = F.lit(100.0)
    solid = c["solid_lines"]
    nesting = F.least(hundred, F.greatest(c["depth"], F.floor(c["indent"] / 4)) / 10 * 100)
    mean_line = c["solid_chars"] / solid
    line_length = (
        F.when(mean_line > 120, hundred).when(mean_line > 80, 60 + (mean_line - 80) / 40 * 40).otherwise(mean_line / 80 * 60)
    )
    operators = F.least(hundred, c["operators"] / solid / 5 * 100)
    functions = F.least(hundred, c["functions"] / solid * 200)
    branches = F.least(hundred, c["branches"] / solid * 50)
    bonus = c["comments"] / c["lines"] * 30
    raw = nesting * 0.35 + line_length * 0.15 + operators * 0.15 + functions * 0.10 + branches * 0.25
    return F.when(solid == 0, 0.0).otherwise(F.least(hundred, F.greatest(F.lit(0.0), raw - bonus)))


def text_counts(content: str, words: str) -> dict[str, Column]:
    """Counts of a text column and of the column of its words."""
    text, words = F.col(content), F.col(words)
    bare = F.transform(words, lambda word: F.btrim(F.lower(word), F.lit(WORD_EDGE)))

    def parts(end: str) -> Column:
        pieces = F.array_remove(F.split(text, f"\\Q{end}\\E"), "")
        return F.when(F.contains(text, F.lit(end)), F.size(pieces)).otherwise(0)

    return {
        "words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "distinct_words": F.size(F.array_distinct(bare)),
        "sentences": F.greatest(F.lit(1), _total(parts(end) for end in SENTENCE_ENDS)),
        "punctuation": count_literals(content, FINE_PUNCTUATION),
        "paragraphs": count_literal(text, "\n\n") + 1,
        "vowel_groups": F.regexp_count(F.lower(text), F.lit("[aeiou]+")),
    }


def text_score(c: dict[str, Column]) -> Column:
    """Weighted mix of sentence, word and paragraph length, variety and reading ease."""
    hundred = F.lit(100.0)
    words = c["words"]
    sentence = words / c["sentences"]
    sentence_score = (
        F.when(sentence > 30, hundred)
        .when(sentence > 20, 70 + (sentence - 20) / 10 * 30)
        .when(sentence > 12, 40 + (sentence - 12) / 8 * 30)
        .otherwise(sentence / 12 * 40)
    )
    word = c["word_chars"] / words
    word_score = F.when(word > 8, hundred).when(word > 6, 50 + (word - 6) / 2 * 50).otherwise(word / 6 * 50)
    variety = c["distinct_words"] / words * 100
    punctuation = F.least(hundred, c["punctuation"] / words * 200)
    paragraph = words / c["paragraphs"]
    paragraph_score = (
        F.when(paragraph > 150, hundred)
        .when(paragraph > 75, 50 + (paragraph - 75) / 75 * 50)
        .otherwise(paragraph / 75 * 50)
    )
    syllables = (words + c["vowel_groups"]) / words
    ease = F.lit(206.835) - sentence * 1.015 - syllables * 84.6
    level = F.greatest(F.lit(0.0), F.least(hundred, (100 - ease) / 2))
    mixed = (
        sentence_score * 0.25
        + word_score * 0.20
        + variety * 0.20
        + punctuation * 0.10
        + paragraph_score * 0.10
        + level * 0.15
    )
    return F.when(words == 0, 0.0).otherwise(F.least(hundred, mixed))


def _scored(df: DataFrame, counts: dict[str, Column], out: str, score) -> DataFrame:
    """Counts in one projection, the score of them in the next."""
    taken = {name: f"__{out}_count_{name}" for name in counts}
    staged = df.withColumns({taken[name]: column for name, column in counts.items()})
    return staged.withColumn(out, score({name: F.col(column) for name, column in taken.items()})).drop(*taken.values())


def with_code_complexity(df: DataFrame, content: str = "content", out: str = "complexity_score") -> DataFrame:
    symbols = f"__{out}_symbols"
    staged = df.withColumn(symbols, operator_symbols(F.col(content)))
    return _scored(staged, code_counts(content, symbols), out, code_score).drop(symbols)


def with_text_complexity(
    df: DataFrame, content: str = "content", out: str = "complexity_score", words: str | None = None
) -> DataFrame:
    """``words`` may name a column that already holds the words of the content."""
    if words is None:
        split = df.withColumn(f"__{out}_words", py_words(F.col(content)))
        return with_text_complexity(split, content, out, f"__{out}_words").drop(f"__{out}_words")
    return _scored(df, text_counts(content, words), out, text_score)


def with_complexity(df: DataFrame, content: str = "content", is_code: str = "is_code_file", words: str | None = None) -> DataFrame:
    """Score code rows as code and all others as prose; blank text scores 0.

    Each count sees null where its score does not apply, so a row pays for one
    of the two scores only.
    """
    text, code = F.col(content), F.coalesce(F.col(is_code), F.lit(False))
    solid = ~is_blank(text)
    prose_words = F.col(words) if words else py_words(text)
    df = df.withColumns({"__is_code": code & solid, "__is_prose": ~code & solid}).withColumns(
        {
            "__code": F.when(F.col("__is_code"), text),
            "__prose": F.when(F.col("__is_prose"), text),
            "__prose_words": F.when(F.col("__is_prose"), prose_words),
        }
    )
    df = with_code_complexity(df, "__code", "__code_score")
    df = with_text_complexity(df, "__prose", "__prose_score", "__prose_words")
    score = F.when(F.col("__is_code"), F.col("__code_score")).when(F.col("__is_prose"), F.col("__prose_score")).otherwise(0.0)
    internal = ("__is_code", "__is_prose", "__code", "__prose", "__prose_words", "__code_score", "__prose_score")
    return df.withColumn("complexity_score", score).drop(*internal)
