"""Queries over texts: counts, complexity, keywords, positions, snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift.functions.complexity import (
    BRANCH_MARKS, FINE_PUNCTUATION, FUNCTION_MARKS, OPERATORS, SENTENCE_ENDS,
    max_bracket_depth, with_code_complexity, with_complexity, with_text_complexity,
)
from docsift.functions.text import (
    STOP_WORDS, code_line_counts, content_counts, content_density, extract_keywords,
    highlight, is_empty, lexical_counts, lexical_ratios, preview, py_words,
)
from docsift.operators.snippets import MAX_SNIPPETS, occurrences, ranked_snippets
from docsift.plans.search import long_enough
from docsift.queries.common import (
    SQL_NON_WS, SQL_WS, documents, rounded, sql_count, sql_empty, sql_strip, sql_words, table,
)
from docsift.sources.tables import dealt_out

# A query whose words are frequent in the texts and also occur side by side.
QUERY = "que le in the Tion"
PHRASE_QUERY = "in the"


def _named(columns: dict) -> list:
    return [column.alias(name) for name, column in columns.items()]


def _pages(spark, folder):
    return dealt_out(table(spark, folder, "pages"))


def text_content_counts(spark, folder):
    split = documents(spark, folder).withColumn("words", py_words(F.col("text")))
    return split.select("doc_id", *_named(content_counts(F.col("text"), F.col("words"))))


def lexical_stats(spark, folder):
    split = documents(spark, folder).withColumn("terms", py_words(F.lower("text")))
    counts = split.select("doc_id", *_named(lexical_counts(F.col("text"), F.col("terms"))))
    ratios = lexical_ratios(*[F.col(name) for name in ("term_count", "unique_terms", "term_chars", "sentence_count")])
    return counts.select("doc_id", "unique_terms", "sentence_count", *[rounded(c).alias(n) for n, c in ratios.items()])


def text_content_density(spark, folder):
    words = content_counts(F.col("text"))["word_count"]
    density = content_density(words, F.octet_length("text"))
    return documents(spark, folder).select("doc_id", rounded(density).alias("content_density"))


def distinct_terms(spark, folder):
    return documents(spark, folder).select("doc_id", lexical_counts(F.col("text"))["unique_terms"].alias("distinct_terms"))


def text_complexity(spark, folder):
    scored = with_text_complexity(documents(spark, folder), "text", "score")
    return scored.select("doc_id", rounded("score").alias("score"))


def code_complexity(spark, folder):
    scored = with_code_complexity(documents(spark, folder), "text", "score")
    return scored.select("doc_id", rounded("score").alias("score"))


def code_complexity_html(spark, folder):
    scored = with_code_complexity(_pages(spark, folder), "html", "score")
    return scored.select("page_id", rounded("score").alias("score"))


def complexity_by_kind(spark, folder):
    """Every third text scored as code, the others as prose."""
    docs = documents(spark, folder).withColumn("is_code_file", F.col("doc_id") % 3 == 0)
    return with_complexity(docs, "text").select("doc_id", rounded("complexity_score").alias("score"))


def running_nesting(spark, folder):
    return documents(spark, folder).select("doc_id", max_bracket_depth(F.col("text")).alias("depth"))


def running_nesting_html(spark, folder):
    return _pages(spark, folder).select("page_id", max_bracket_depth(F.col("html")).alias("depth"))


def code_lines(spark, folder):
    return documents(spark, folder).select("doc_id", *_named(code_line_counts(F.col("text"))))


def keywords(spark, folder):
    found = F.array_join(extract_keywords(F.col("text")), " ")
    return table(spark, folder, "benchmark").select("item_id", found.alias("keywords"))


def document_keywords(spark, folder):
    found = extract_keywords(F.col("text"))
    return documents(spark, folder).select(
        "doc_id", F.size(found).cast("bigint").alias("keyword_count"), F.md5(F.array_join(found, " ")).alias("keywords_md5")
    )


def positions(spark, folder):
    found = occurrences(documents(spark, folder), ["doc_id"], F.col("text"), F.lit(QUERY)).filter("needle_no > 0")
    return found.groupBy("doc_id", "term").agg(
        F.count("*").alias("hits"),
        F.min("position").cast("bigint").alias("first_position"),
        F.max("position").cast("bigint").alias("last_position"),
        F.sum("position").cast("bigint").alias("position_sum"),
    )


def _snippets(spark, folder, query):
    found = occurrences(documents(spark, folder), ["doc_id"], F.col("text"), F.lit(query), best=MAX_SNIPPETS)
    return ranked_snippets(found, ["doc_id"]).select(
        "doc_id",
        "snippet_rank",
        "snippet",
        rounded("score").alias("score"),
        F.array_join("matched_terms", " ").alias("terms"),
        "match_type",
    )


def snippets_ranked(spark, folder):
    return _snippets(spark, folder, QUERY)


def snippets_phrase(spark, folder):
    return _snippets(spark, folder, PHRASE_QUERY)


def highlighted(spark, folder):
    return documents(spark, folder).select("doc_id", F.md5(highlight(F.col("text"), F.lit(PHRASE_QUERY))).alias("highlighted_md5"))


def empty_filter(spark, folder):
    return documents(spark, folder).select("doc_id", is_empty(F.col("text")).alias("is_empty"))


def min_length_filter(spark, folder):
    return documents(spark, folder).filter(long_enough(F.col("text"), 200)).select("doc_id")


def content_preview(spark, folder):
    return documents(spark, folder).select(
        "doc_id", preview(F.col("text")).alias("short"), preview(F.col("text"), verbose=True).alias("verbose")
    )


QUERIES = {
    "content_counts": text_content_counts,
    "content_density": text_content_density,
    "highlight": highlighted,
    "code_line_counts": code_lines,
    **{
        f.__name__: f
        for f in (
            lexical_stats, distinct_terms, text_complexity, code_complexity, code_complexity_html, complexity_by_kind,
            running_nesting, running_nesting_html, keywords, document_keywords, positions, snippets_ranked,
            snippets_phrase, empty_filter, min_length_filter, content_preview,
        )
    },
}


def _sum(parts) -> str:
    return "(" + " + ".join(parts) + ")"


_EDGE = ".,!?;:()[]{}\"''"


def _sql_text_score(relation: str, key: str, text: str) -> str:
    """A SELECT of (key, score) for prose."""

    def pieces(end: str) -> str:
        quoted = "' || chr(10) || '".join(end.split("\n"))
        split = f"list_filter(string_split({text}, '{quoted}'), lambda s: s <> '')"
        return f"CASE WHEN contains({text}, '{quoted}') THEN len({split}) ELSE 0 END"

    return f"""
SELECT {key}, CASE WHEN words = 0 THEN 0.0 ELSE least(100.0,
  (CASE WHEN s > 30 THEN 100 WHEN s > 20 THEN 70 + (s - 20) / 10 * 30 WHEN s > 12 THEN 40 + (s - 12) / 8 * 30 ELSE s / 12 * 40 END) * 0.25
  + (CASE WHEN w > 8 THEN 100 WHEN w > 6 THEN 50 + (w - 6) / 2 * 50 ELSE w / 6 * 50 END) * 0.20
  + variety * 100 * 0.20 + least(100, punct * 200) * 0.10
  + (CASE WHEN p > 150 THEN 100 WHEN p > 75 THEN 50 + (p - 75) / 75 * 50 ELSE p / 75 * 50 END) * 0.10
  + greatest(0, least(100, (100 - (206.835 - 1.015 * s - 84.6 * syllables)) / 2)) * 0.15) END AS score
FROM (SELECT {key}, words,
    words::DOUBLE / sentences AS s, word_chars::DOUBLE / nullif(words, 0) AS w, distinct_words::DOUBLE / nullif(words, 0) AS variety,
    punct::DOUBLE / nullif(words, 0) AS punct, words::DOUBLE / paragraphs AS p, (words + vowels)::DOUBLE / nullif(words, 0) AS syllables
  FROM (SELECT {key}, len(list) AS words, length(array_to_string(list, '')) AS word_chars,
      len(list_distinct(list_transform(list, lambda x: trim(lower(x), '{_EDGE}')))) AS distinct_words,
      greatest(1, {_sum(pieces(end) for end in SENTENCE_ENDS)}) AS sentences,
      {_sum(sql_count(text, mark) for mark in FINE_PUNCTUATION)} AS punct,
      len(string_split({text}, chr(10) || chr(10))) AS paragraphs,
      len(regexp_extract_all(lower({text}), '[aeiou]+')) AS vowels
    FROM (SELECT *, {sql_words(text)} AS list FROM {relation})))"""


def _sql_depth(relation: str, key: str, text: str) -> str:
    """A SELECT of (key, depth): running balance, never below zero, in closed form."""
    opens = _sum(sql_count("line", mark) for mark in "{([")
    closes = _sum(sql_count("line", mark) for mark in "})]")
    return f"""
SELECT {key}, greatest(0, max(balance - least(0, lowest)))::BIGINT AS depth FROM (
  SELECT {key}, balance, min(balance) OVER (PARTITION BY {key} ORDER BY n) AS lowest FROM (
    SELECT {key}, n, sum({opens} - {closes}) OVER (PARTITION BY {key} ORDER BY n) AS balance FROM (
      SELECT {key}, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n
      FROM (SELECT {key}, string_split({text}, chr(10)) AS lines FROM {relation}))))
GROUP BY {key}"""


def _sql_code_score(relation: str, key: str, text: str) -> str:
    lead = f"length(line) - length(regexp_replace(line, '^{SQL_WS}+', ''))"
    return f"""
SELECT {key}, CASE WHEN solid = 0 THEN 0.0 ELSE least(100.0, greatest(0.0,
  least(100, greatest(depth, indent // 4)::DOUBLE / 10 * 100) * 0.35
  + (CASE WHEN mean > 120 THEN 100 WHEN mean > 80 THEN 60 + (mean - 80) / 40 * 40 ELSE mean / 80 * 60 END) * 0.15
  + least(100, operators::DOUBLE / solid / 5 * 100) * 0.15 + least(100, functions::DOUBLE / solid * 200) * 0.10
  + least(100, branches::DOUBLE / solid * 50) * 0.25 - comments::DOUBLE / total * 30)) END AS score
FROM (SELECT b.{key}, b.depth, l.*, l.chars::DOUBLE / nullif(l.solid, 0) AS mean, t.operators, t.functions, t.branches
  FROM ({_sql_depth(relation, key, text)}) b
  JOIN (SELECT {key} AS line_key, count(*) AS total, count_if(regexp_matches(line, '{SQL_NON_WS}')) AS solid,
      sum(CASE WHEN regexp_matches(line, '{SQL_NON_WS}') THEN length(line) ELSE 0 END) AS chars,
      coalesce(max(CASE WHEN regexp_matches(line, '{SQL_NON_WS}') THEN {lead} END), 0) AS indent,
      count_if(regexp_matches(line, '^{SQL_WS}*(#|//|/\\*)')) AS comments
    FROM (SELECT {key}, unnest(string_split({text}, chr(10))) AS line FROM {relation}) GROUP BY {key}) l ON b.{key} = l.line_key
  JOIN (SELECT {key} AS text_key, {_sum(sql_count(text, mark) for mark in OPERATORS)} AS operators,
      {_sum(sql_count(text, mark) for mark in FUNCTION_MARKS)} AS functions,
      {_sum(sql_count(text, mark) for mark in BRANCH_MARKS)} AS branches FROM {relation}) t ON b.{key} = t.text_key)"""


_STOP = ", ".join(f"'{word}'" for word in STOP_WORDS)


def sql_keywords(text: str) -> str:
    words = f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda r: regexp_full_match(r, '[a-z0-9_]+'))"
    strong = f"list_filter({words}, lambda r: length(r) >= 3 AND r NOT IN ({_STOP}))"
    return f"CASE WHEN len({strong}) > 0 THEN {strong} ELSE {words} END"


def sql_occurrences(hits: str) -> str:
    """CTEs up to ``o(key, needle_no, term, position, keyword_count)`` for a relation ``hits(key, text, query)``."""
    return f"""
h AS ({hits}),
w AS (SELECT *, {sql_keywords("query")} AS words FROM h),
n AS (SELECT key, text, len(words) AS keyword_count, unnest(list_concat([lower(query)], words)) AS needle,
        unnest(list_concat([query], words)) AS term, unnest(range(0, len(words) + 1)) AS needle_no FROM w WHERE len(words) > 0),
parts AS (SELECT key, text, keyword_count, needle, term, needle_no, string_split(lower(text), needle) AS pieces FROM n),
x AS (SELECT key, text, keyword_count, needle, term, needle_no, unnest(pieces) AS piece,
        unnest(range(1, len(pieces) + 1)) AS piece_no, len(pieces) AS piece_count FROM parts),
o AS (SELECT key, text, keyword_count, needle_no, term, piece_no, piece_count,
        (sum(length(piece)) OVER (PARTITION BY key, needle_no ORDER BY piece_no) + (piece_no - 1) * length(needle))::BIGINT AS position FROM x),
occ AS (SELECT key, text, keyword_count, needle_no, term, position FROM o WHERE piece_no < piece_count)"""


def sql_snippets() -> str:
    """CTEs from ``occ`` to ``top(key, snippet_rank, snippet, score, terms, match_type)``."""
    return """
win AS (SELECT *, substring(text, greatest(0, position - 100) + 1,
          least(length(text), position + length(term) + 100) - greatest(0, position - 100)) AS snippet FROM occ),
grp AS (SELECT key, substring(snippet, 1, 50) AS snippet_key, max(keyword_count) AS keyword_count, bool_or(needle_no = 0) AS phrase,
          min(needle_no * 1000000000 + position) AS first_order,
          arg_min(snippet, needle_no * 1000000000 + position) AS snippet,
          arg_min(term, needle_no * 1000000000 + position) AS first_term,
          count(*) FILTER (needle_no > 0) AS hits,
          list_sort(list_distinct(list(term) FILTER (needle_no > 0))) AS terms FROM win GROUP BY key, substring(snippet, 1, 50)),
sc AS (SELECT key, snippet, CASE WHEN phrase THEN 1.0 ELSE least(0.95, 0.5 + hits::DOUBLE / keyword_count * 0.45) END AS score,
          CASE WHEN phrase THEN first_term ELSE array_to_string(terms, ' ') END AS terms,
          CASE WHEN phrase THEN 'exact_phrase' ELSE 'keywords' END AS match_type, first_order FROM grp),
top AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY score DESC, first_order) AS snippet_rank,
          snippet, score, terms, match_type FROM sc QUALIFY snippet_rank <= 3)"""


def _sql_query_hits(query: str) -> str:
    return f"SELECT doc_id AS key, text, '{query}' AS query FROM documents"


def _sql_snippet_query(query: str) -> str:
    return f"""WITH {sql_occurrences(_sql_query_hits(query))}, {sql_snippets()}
SELECT key AS doc_id, snippet_rank, snippet, round(score, 6) AS score, terms, match_type FROM top"""


def _sql_highlight(text: str, query: str, words: tuple[str, ...]) -> str:
    """RE2 has no look-around: neighbours are matched too, so each word needs two passes."""
    marked = f"regexp_replace({text}, '(?i)({query})', chr(27) || '[92m\\1' || chr(27) || '[0m', 'g')"
    for word in words:
        for _ in range(2):
            marked = (
                f"regexp_replace({marked}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({word})($|[^\\p{{L}}\\p{{N}}_])',"
                f" '\\1' || chr(27) || '[93m\\2' || chr(27) || '[0m\\3', 'g')"
            )
    return marked


_LINES = "string_split(text, chr(10))"
_COMMENT = f"regexp_matches(x, '^{SQL_WS}*(#|//)')"

ORACLES = {
    "content_counts": f"""
SELECT doc_id, len({sql_words("text")}) AS word_count, length(text) AS char_count, len({_LINES}) AS line_count,
  len(string_split(text, chr(10) || chr(10))) AS paragraph_count, len({sql_words("text")}) > 0 AS has_content FROM documents""",
    "lexical_stats": f"""
SELECT doc_id, len(list_distinct(words)) AS unique_terms, sentences AS sentence_count,
  round(len(list_distinct(words))::DOUBLE / greatest(1, len(words)), 6) AS lexical_diversity,
  round(length(array_to_string(words, ''))::DOUBLE / greatest(1, len(words)), 6) AS avg_word_length,
  round(len(words)::DOUBLE / greatest(1, sentences), 6) AS avg_sentence_length
FROM (SELECT doc_id, {sql_words("lower(text)")} AS words,
        {_sum(sql_count("text", mark) for mark in ".!?")} AS sentences FROM documents)""",
    "content_density": f"""
SELECT doc_id, round(len({sql_words("text")})::DOUBLE / greatest(1, strlen(text)) * 1024, 6) AS content_density FROM documents""",
    "distinct_terms": f"""SELECT doc_id, len(list_distinct({sql_words("lower(text)")})) AS distinct_terms FROM documents""",
    "text_complexity": f"""SELECT doc_id, round(score, 6) AS score FROM ({_sql_text_score("documents", "doc_id", "text")})""",
    "code_complexity": f"""SELECT doc_id, round(score, 6) AS score FROM ({_sql_code_score("documents", "doc_id", "text")})""",
    "code_complexity_html": f"""SELECT page_id, round(score, 6) AS score FROM ({_sql_code_score("pages", "page_id", "html")})""",
    "complexity_by_kind": f"""
SELECT d.doc_id, round(CASE WHEN NOT regexp_matches(d.text, '{SQL_NON_WS}') THEN 0.0 WHEN d.doc_id % 3 = 0 THEN c.score ELSE t.score END, 6) AS score
FROM documents d JOIN ({_sql_code_score("documents", "doc_id", "text")}) c ON d.doc_id = c.doc_id
JOIN ({_sql_text_score("documents", "doc_id", "text")}) t ON d.doc_id = t.doc_id""",
    "running_nesting": _sql_depth("documents", "doc_id", "text"),
    "running_nesting_html": _sql_depth("pages", "page_id", "html"),
    "code_line_counts": f"""
SELECT doc_id, len({_LINES}) AS lines_total,
  len(list_filter({_LINES}, lambda x: regexp_matches(x, '{SQL_NON_WS}') AND NOT {_COMMENT})) AS lines_code,
  len(list_filter({_LINES}, lambda x: {_COMMENT})) AS lines_comments FROM documents""",
    "keywords": f"""SELECT item_id, array_to_string({sql_keywords("text")}, ' ') AS keywords FROM benchmark""",
    "document_keywords": f"""
SELECT doc_id, len({sql_keywords("text")}) AS keyword_count, md5(array_to_string({sql_keywords("text")}, ' ')) AS keywords_md5 FROM documents""",
    "positions": f"""WITH {sql_occurrences(_sql_query_hits(QUERY))}
SELECT key AS doc_id, term, count(*) AS hits, min(position) AS first_position, max(position) AS last_position,
  sum(position)::BIGINT AS position_sum FROM occ WHERE needle_no > 0 GROUP BY key, term""",
    "snippets_ranked": _sql_snippet_query(QUERY),
    "snippets_phrase": _sql_snippet_query(PHRASE_QUERY),
    "highlight": f"""SELECT doc_id, md5({_sql_highlight("text", "in the", ("in", "the"))}) AS highlighted_md5 FROM documents""",
    "empty_filter": f"""SELECT doc_id, {sql_empty("text")} AS is_empty FROM documents""",
    "min_length_filter": f"""SELECT doc_id FROM documents WHERE length({sql_strip("text")}) >= 200""",
    "content_preview": """
SELECT doc_id, replace(substring(text, 1, 150), chr(10), ' ') AS short, replace(substring(text, 1, 200), chr(10), ' ') AS verbose FROM documents""",
}
