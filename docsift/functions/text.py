"""String columns: whitespace, counts, keywords, literal matches, highlighting.

Everything except :func:`literal_positions` is a plain Column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType

# The characters Python counts as whitespace in str.split/strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same as a Java regex class, for patterns that start with UNICODE; the
# engine tests this one much faster than a list of ranges.
UNICODE = "(?U)"
WS = r"[\s\x1c-\x1f]"
NON_WS = r"[^\s\x1c-\x1f]"

# Words ignored in a query.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for",
    "in", "is", "it", "of", "on", "or", "the", "to", "with", "what",
    "when", "where", "who", "why", "how", "this", "that",
)

# Terminal colours around a phrase hit and a keyword hit.
# Fixed value: characters shown on both sides of a match.
WINDOW = 100
PHRASE_MARK = "\x1b[92m"
KEYWORD_MARK = "\x1b[93m"
END_MARK = "\x1b[0m"


def py_strip(text: Column) -> Column:
    """Trim every Unicode whitespace character from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(UNICODE + NON_WS), F.lit(True))


def py_words(text: Column) -> Column:
    """Whitespace-separated words as ``array<string>``."""
    return F.array_remove(F.split(text, f"{UNICODE}{WS}+"), "")


def count_literal(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of ``literal``, scanning left to right."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return (removed / len(literal)).cast("bigint")


def count_literals(column: str, literals: Iterable[str]) -> Column:
    """:func:`count_literal` of a named column summed over many literals, as one SQL expression."""

    def one(literal: str) -> str:
        quoted = literal.replace("\\", "\\\\").replace("'", "\\'")
        return f"(length(`{column}`) - length(replace(`{column}`, '{quoted}', ''))) div {len(literal)}"

    return F.expr(" + ".join(one(literal) for literal in literals))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are one of ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def quote_regex(text: Column) -> Column:
    r"""Quote a column for literal use in a Java regex, surviving an embedded ``\E``."""
    inner = F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), inner, F.lit("\\E"))


def content_counts(text: Column, words: Column | None = None) -> dict[str, Column]:
    """Words, characters, lines, paragraphs and whether any word exists.

    ``words`` may name a column that already holds :func:`py_words` of the text.
    """
    count = F.size(py_words(text) if words is None else words).cast("bigint")
    return {
        "word_count": count,
        "char_count": F.length(text).cast("bigint"),
        "line_count": count_literal(text, "\n") + 1,
        "paragraph_count": count_literal(text, "\n\n") + 1,
        "has_content": count > 0,
    }


def lexical_counts(text: Column, terms: Column | None = None) -> dict[str, Column]:
    """Raw counts behind the lexical averages; see :func:`lexical_ratios`.

    ``terms`` may name a column that already holds the lower-cased words.
    """
    terms = py_words(F.lower(text)) if terms is None else terms
    return {
        "term_count": F.size(terms).cast("bigint"),
        "unique_terms": F.size(F.array_distinct(terms)).cast("bigint"),
        "term_chars": F.length(F.array_join(terms, "")).cast("bigint"),
        "sentence_count": count_literal(text, ".") + count_literal(text, "!") + count_literal(text, "?"),
    }


def lexical_ratios(terms: Column, unique: Column, chars: Column, sentences: Column) -> dict[str, Column]:
    at_least_one = F.greatest(F.lit(1), terms)
    return {
        "lexical_diversity": unique / at_least_one,
        "avg_word_length": chars / at_least_one,
        "avg_sentence_length": terms / F.greatest(F.lit(1), sentences),
    }


def content_density(words: Column, size_bytes: Column) -> Column:
    """Words per KiB of file."""
    return words / F.greatest(F.lit(1), size_bytes) * 1024


def code_line_counts(text: Column) -> dict[str, Column]:
    """Total, code and comment lines of a source file."""
    lines = F.split(text, "\n")
    comment = f"{UNICODE}\\A{WS}*(?:#|//)"
    comments = F.filter(lines, lambda line: line.rlike(comment))
    code = F.filter(lines, lambda line: line.rlike(UNICODE + NON_WS) & ~line.rlike(comment))
    return {
        "lines_total": F.size(lines).cast("bigint"),
        "lines_code": F.size(code).cast("bigint"),
        "lines_comments": F.size(comments).cast("bigint"),
    }


def extract_keywords(query: Column) -> Column:
    """Lower-cased ASCII words of 3+ characters that are no stop words.

    If nothing is left, all ASCII words. Order and repeats are kept. A run
    glued to a non-ASCII letter is no word.
    """
    runs = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    ascii_words = F.filter(runs, lambda run: run.rlike(r"\A[a-z0-9_]+\z"))
    strong = F.filter(ascii_words, lambda word: (F.length(word) >= 3) & ~word.isin(*STOP_WORDS))
    return F.when(F.size(strong) > 0, strong).otherwise(ascii_words)


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def literal_positions(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """0-based, non-overlapping positions of every needle of an array in a text.

    A running position is the one thing array expressions can only rebuild in
    quadratic time, so this small scan is Arrow-batched Python.
    """

    def scan(text: str, needle: str) -> list[int]:
        return [hit.start() for hit in re.finditer(re.escape(needle), text)]

    for texts, needles in batches:
        pairs = zip(texts.to_pylist(), needles.to_pylist())
        found = [None if None in pair else [scan(pair[0], needle) for needle in pair[1]] for pair in pairs]
        yield pa.array(found, pa.list_(pa.list_(pa.int32())))


# So marked, a later filter is not pushed below it, which would run it twice.
literal_positions.asNondeterministic()


def snippet_window(text: Column, position: Column, width: Column, context: int = WINDOW) -> Column:
    """The match and ``context`` characters on both sides, in original case."""
    start = F.greatest(F.lit(0), position - context)
    end = F.least(F.length(text), position + width + context)
    return F.substring(text, start + 1, F.greatest(F.lit(0), end - start))


def highlight(
    text: Column,
    query: Column,
    phrase_mark: str = PHRASE_MARK,
    keyword_mark: str = KEYWORD_MARK,
    end_mark: str = END_MARK,
) -> Column:
    """Wrap the whole query, then each of its keywords as a whole word."""
    lowered = F.lower(text)

    def wrap(subject: Column, pattern: Column, mark: str) -> Column:
        return F.regexp_replace(subject, pattern, F.lit(f"{mark}$0{end_mark}"))

    phrase = wrap(text, F.concat(F.lit("(?iu)"), quote_regex(query)), phrase_mark)
    marked = F.when(F.contains(lowered, F.lower(query)), phrase).otherwise(text)

    def one_keyword(subject: Column, keyword: Column) -> Column:
        whole_word = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), keyword, F.lit(r"(?![\p{L}\p{N}_])"))
        return F.when(F.contains(lowered, keyword), wrap(subject, whole_word, keyword_mark)).otherwise(subject)

    full = F.aggregate(extract_keywords(query), marked, one_keyword)
    return F.when((text == "") | (query == "") | query.isNull(), text).otherwise(full)


def preview(text: Column, verbose: bool = False) -> Column:
    """First 150 (verbose: 200) characters on one line."""
    return F.translate(F.substring(text, 1, 200 if verbose else 150), "\n", " ")


# Marks of documents that hold file facts instead of text.
EMPTY_MARKERS = ("no extractable text content", "image file:", "exif data:")
MIN_TEXT_LENGTH = 10


def is_empty(text: Column) -> Column:
    """Blank, very short, or mentioning a placeholder marker anywhere."""
    lowered = F.lower(text)
    empty = F.length(py_strip(text)) < MIN_TEXT_LENGTH
    for marker in EMPTY_MARKERS:
        empty = empty | F.contains(lowered, F.lit(marker))
    return F.coalesce(empty, F.lit(True))
