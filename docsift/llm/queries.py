"""One query per operator over its whole table, and the pipeline; DuckDB statements where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from docsift.llm import (
    chat, collocations, exact_dedup, line_dedup, packing, pieces, quality_classifier, quality_rules, ranked_search, simhash, spotsigs,
    token_counts, url_filter,
)
from docsift.llm.common import stored


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, folder, "documents"), "doc_id", "text").select(
        "doc_id", "lines", "deleted_lines", "text"
    )


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.digests(_table(spark, folder, "documents"), "doc_id", "text", path).withColumnRenamed("doc", "doc_id")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    trees = quality_rules.fit_rules(docs, "doc_id", "text", _table(spark, folder, "labels"))
    return quality_rules.judged(docs, "doc_id", "text", trees).select(
        F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality_classifier.fit_labelled(docs, "doc_id", "text", _table(spark, folder, "labels"))
    return quality_classifier.graded(docs, "doc_id", "text", model).withColumnRenamed("doc", "doc_id")


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(_table(spark, folder, "documents"), "doc_id", "text", path).withColumnRenamed("doc", "doc_id")


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{tricky}'), (-1L, 1L, 'assistant', '{tricky}') AS t(conv_id, turn, role, text)")
    chats = chat.formatted(turns.unionByName(extra), "conv_id", "turn", "role", "text")
    return chat.digests(chats).withColumnRenamed("conversation", "conv_id")


def op7_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.compared_with_edits(_table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lengths = token_counts.token_lengths(_table(spark, folder, "documents"), "doc_id", "text", path, public_tokenizers.PATTERN)
    return token_counts.length_histogram(lengths)


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"), "doc_id", "text")
    hexes = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("doc").alias("doc_id"), hexes.alias("fingerprint"), F.col("component").alias("component_id"))


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    words = url_filter.word_table(pages, "html", extra=tuple(url_filter.BLOCK_WORDS))
    split = stored(url_filter.split_urls(pages, "page_id", "url", words), "split")
    return url_filter.judged_split(split, url_filter.fit_split(split)).withColumnRenamed("page", "page_id")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"), "text", "lang")


def op12_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    found = ranked_search.ranked_search(docs, "doc_id", "text", items, "item_id", "text")
    return found.withColumnsRenamed({"item": "item_id", "doc": "doc_id"})


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    query.__name__: query
    for query in (
        op1_line_dedup, op2_sentencepiece, op3_quality_rules, op4_quality_classifier, op5_packing, op6_chat, op7_spotsigs,
        op8_token_counts, op9_simhash, op10_url_filter, op11_collocations, op12_exact_dedup, op13_ranked_search, pipeline,
    )
}

_WORDS = r"regexp_extract_all({}, '[^ \t\n\x0B\f\r]+')"

# Runs of min_words words, from both ends of every possible run, as the lines that they have.
_LINE_DEDUP = rf"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr
  FROM documents WHERE text <> ''),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS place, len({_WORDS.format("line")}) AS words
  FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
sums AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY place) AS ends FROM worded),
packed AS (
  SELECT doc_id, list(line ORDER BY place) AS lines, list(nr ORDER BY place) AS nrs, list(ends ORDER BY place) AS ends
  FROM sums GROUP BY doc_id),
forward AS (
  SELECT s.doc_id, s.place AS first, min(e.place) AS last FROM sums s JOIN sums e
    ON s.doc_id = e.doc_id AND e.place BETWEEN s.place AND s.place + {line_dedup.MIN_WORDS - 1}
   AND e.ends - (s.ends - s.words) >= {line_dedup.MIN_WORDS} GROUP BY ALL),
backward AS (
  SELECT e.doc_id, max(s.place) AS first, e.place AS last FROM sums s JOIN sums e
    ON s.doc_id = e.doc_id AND e.place BETWEEN s.place AND s.place + {line_dedup.MIN_WORDS - 1}
   AND e.ends - (s.ends - s.words) >= {line_dedup.MIN_WORDS} GROUP BY e.doc_id, e.place),
runs AS (SELECT * FROM forward UNION SELECT doc_id, first, last FROM backward),
texts AS (
  SELECT r.*, array_to_string(p.lines[first:last], chr(10)) AS run FROM runs r JOIN packed p USING (doc_id)),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS copy FROM texts) WHERE copy > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS place FROM later),
marked AS (
  SELECT l.doc_id, l.nr, l.line, w.place, g.place IS NOT NULL AS gone,
         max(w.place) OVER (PARTITION BY l.doc_id ORDER BY l.nr) AS before
  FROM lines l LEFT JOIN worded w ON l.doc_id = w.doc_id AND l.nr = w.nr
  LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.place = w.place),
decided AS (
  SELECT m.*, m.gone OR (m.place IS NULL AND a.place IS NOT NULL AND b.place IS NOT NULL) AS drop
  FROM marked m LEFT JOIN gone a ON a.doc_id = m.doc_id AND a.place = m.before
  LEFT JOIN gone b ON b.doc_id = m.doc_id AND b.place = m.before + 1),
kept AS (
  SELECT doc_id, count(place) AS lines, count(*) FILTER (gone) AS deleted_lines,
         coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT drop), '') AS text
  FROM decided GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.lines, 0)::BIGINT AS lines, coalesce(k.deleted_lines, 0)::BIGINT AS deleted_lines,
       CASE WHEN k.doc_id IS NULL THEN d.text ELSE k.text END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES
    (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))),
ordered AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM turns),
chats AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))
             + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
         bool_and((before = '' AND role IN ('system', 'user')) OR (before IN ('system', 'assistant') AND role = 'user')
             OR (before = 'user' AND role = 'assistant'))
           AND arg_max(role, (turn, role, text)) = 'assistant' AS valid
  FROM ordered GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, valid
FROM chats
"""

_LOWERED = f"translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')"

_COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM worded, range(1, {collocations.MOST_WORDS} + 1) AS s(size)),
phrases AS (
  SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*)::HUGEINT AS f FROM grams
  GROUP BY lang, size, phrase HAVING count(*) >= {collocations.MIN_COUNT}),
cuts AS (
  SELECT lang, size, phrase, w, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM phrases, range(1, {collocations.MOST_WORDS}) AS s(k) WHERE k < size),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.w, c.a, c.k, b.f AS l, e.f AS r, t.n, (1000 * c.a * t.n) // (b.f * e.f) AS score
  FROM cuts c JOIN phrases b ON b.lang = c.lang AND b.phrase = c.head JOIN phrases e ON e.lang = c.lang AND e.phrase = c.tail
  JOIN totals t ON t.lang = c.lang),
worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, f
  FROM phrases, range(1, {collocations.MOST_WORDS}) AS s(i), range(2, {collocations.MOST_WORDS}) AS m(n) WHERE n < size AND i + n - 1 <= size),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM worst c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.a))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {collocations.FIRST}
"""

_EXACT_DEDUP = f"""
WITH digests AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM digests WINDOW same AS (PARTITION BY text_sha256)
"""

_TERM_LIST = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_LOWERED)

_RANKED_SEARCH = f"""
WITH docs AS (SELECT doc_id, {_TERM_LIST} AS terms FROM documents),
sums AS (SELECT count(*) AS documents, sum(len(terms))::BIGINT AS occurrences FROM docs WHERE len(terms) > 0),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERM_LIST}) AS term FROM benchmark) GROUP BY ALL),
postings AS (
  SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM postings, sums GROUP BY term, documents),
parts AS (
  SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * length * documents) // occurrences)) AS part FROM postings, sums),
scores AS (
  SELECT item_id, doc_id, sum(times * weight * part)::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN parts USING (term) GROUP BY ALL HAVING sum(times * weight * part) > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {ranked_search.TOP}
"""

ORACLES = {
    "op1_line_dedup": _LINE_DEDUP, "op6_chat": _CHAT, "op11_collocations": _COLLOCATIONS, "op12_exact_dedup": _EXACT_DEDUP,
    "op13_ranked_search": _RANKED_SEARCH,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
