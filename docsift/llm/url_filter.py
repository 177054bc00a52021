"""URL filters: path rules first, then segmented host and path words scored by multinomial naive Bayes.

The words of concatenated names come from a unigram Viterbi split over a lexicon with counts. The lexicon is a table of all
words: only the words that occur in a name are joined to that name, so neither the driver nor a task holds the lexicon. The
classifier is counted over all example URLs, on hashed words, so that its size is fixed; it is smoothed towards the
shares of the words in all examples, so that rare words say little and words that no example has say nothing. A host counts once, however many pages it has, and
the block words themselves are known before any host has them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F

from docsift.llm.common import batch_of, looked_up, stored

LONGEST = 20  # letters of a lexicon word
_PIECE = 100_000  # candidates of one Arrow batch
_WINDOW = 4096  # letters of a name that are looked through at once
BITS = 16
SMOOTHING = 10.0  # words that are added to the examples of each kind, dealt as the words of all examples are
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# Words in a host name that make a URL an example of what to block.
BLOCK_WORDS = (
    "adult bet bingo bonus casino cheap coupon crack deals farm free gambling hack jackpot keygen lottery "
    "meds nude payday pharma pills poker porn prize replica sex slots spam torrent viagra warez xxx"
).split()
_PART = re.compile(r"[^\W\d_]+|\d+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as a struct of its length, text and verdict; null if none does.

    A rule is a host and the beginning of a path. It fits the host and all its subdomains. Of rules of the same length
    the first in alphabetical order wins.
    """
    found = []
    for verdict, rule in sorted(rules, key=lambda r: r[1]):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not found:
        return F.lit(None).cast("struct<length: int, rule: string, verdict: string>")
    fitting = F.array_compact(F.array(*found))
    longest = F.array_max(F.transform(fitting, lambda r: r["length"]))
    return F.get(F.filter(fitting, lambda r: r["length"] == longest), F.lit(0))


def word_table(texts: DataFrame, text_column: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``word`` and ``n``: every word of 2 to LONGEST letters of all texts (markup taken out), with its exact count.

    ``extra`` words are always in, with the count 2 if no text has them.
    """
    plain = F.lower(F.regexp_replace(texts[f"`{text_column}`"], "(?s)<[^>]*>", " "))
    each = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word")).where(F.length("word").between(2, LONGEST))
    more = texts.sparkSession.createDataFrame([(word,) for word in sorted(set(extra))], "word string")
    both = each.select("word", F.lit(1).alias("one")).unionAll(more.select("word", F.lit(0).alias("one")))
    counts = both.groupBy("word").agg(F.sum("one").alias("n"))
    return stored(counts.select("word", F.when(F.col("n") == 0, 2).otherwise(F.col("n")).alias("n")), "words")


def _total(occurrences: int, words: int) -> float:
    return float(occurrences + words + 1)


class Segmenter:
    """Splits names into the most probable words; an unknown run of letters costs more the longer it is."""

    def __init__(self, counts: dict[str, int], total: float | None = None):
        """``total`` is that of the whole lexicon, if ``counts`` has only the words that can occur."""
        total = _total(sum(counts.values()), len(counts)) if total is None else total
        self.cost = {word: float(np.log(total / n)) for word, n in counts.items()}
        self.unknown = float(np.log(total))
        self.seen: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        if name not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[name] = self._viterbi(name)
        return self.seen[name]

    def _viterbi(self, name: str) -> list[str]:
        best, last = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST), end):
                known = self.cost.get(name[start:end])
                options.append((best[start] + (self.unknown + 2.3 * (end - start) if known is None else known), -start))
            cost, start = min(options)
            best.append(cost)
            last.append(-start)
        words, end = [], len(name)
        while end:
            words.append(name[last[end] : end])
            end = last[end]
        return words[::-1]


def url_names(host: str, path: str) -> list[str]:
    """Names of the host and the path after a letter for their kind: h, t for the last label of a host with a dot, p.

    A number is the name 0.
    """
    front, dot, last = host.rpartition(".")
    parts = (("h", front if dot else host), ("t", last if dot else ""), ("p", path))
    return [kind + ("0" if name[0].isdigit() else name) for kind, part in parts for name in _PART.findall(part.lower())]


def _candidates(names: DataFrame) -> DataFrame:
    """``id`` and ``word``: every part of 2 to LONGEST letters of every name."""
    schema = pa.schema([("id", pa.int64()), ("word", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        words: list[str] = []
        for batch in batches:
            for number, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for first in range(0, len(name) - 1, _WINDOW):
                    starts = range(first, min(first + _WINDOW, len(name) - 1))
                    seen = {name[start:end] for start in starts for end in range(start + 2, min(start + LONGEST, len(name)) + 1)}
                    ids += [number] * len(seen)
                    words += seen
                    if len(ids) >= _PIECE:
                        yield batch_of(schema, [ids, words])
                        ids, words = [], []
        if ids:
            yield batch_of(schema, [ids, words])

    return names.select("id", "name").mapInArrow(work, "id long, word string")


def _splits(names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``name`` and ``words`` of the names (each once, with an ``id``) that are not a single word."""
    sums = lexicon.agg(F.sum("n").alias("occurrences"), F.count("*").alias("words")).head()
    total = _total(sums["occurrences"] or 0, sums["words"])
    found = looked_up(stored(_candidates(names), "candidates"), ["word"], lexicon)
    known = found.groupBy("id").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    rows = names.join(known, "id", "left").select("name", "known")
    schema = pa.schema([("name", pa.string()), ("words", pa.list_(pa.string()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            counts = [{k["word"]: k["n"] for k in ks or ()} for ks in batch.column(1).to_pylist()]
            yield batch_of(schema, [own, [Segmenter(c, total).split(name) for name, c in zip(own, counts, strict=True)]])

    return stored(rows.mapInArrow(work, "name string, words array<string>").where(F.size("words") > 1), "splits")


def split_urls(urls: DataFrame, id_column: str, url_column: str, lexicon: DataFrame) -> DataFrame:
    """``page``, ``host``, ``path`` and ``tokens`` of every row: the words of its names, each after the letter of its kind.

    The lexicon is a ``word_table`` of any size. A name may be as long as a text.
    """
    host, path = host_and_path(urls[f"`{url_column}`"])
    rows = urls.select(urls[f"`{id_column}`"].alias("page"), host.alias("host"), path.alias("path"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [url_names(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            schema = pa.schema([batch.schema.field(n) for n in range(3)] + [("tokens", pa.list_(pa.string()))])
            yield batch_of(schema, [*batch.columns, names])

    named = rows.mapInArrow(work, f"page {dict(rows.dtypes)['page']}, host string, path string, tokens array<string>")
    named = stored(named.withColumn("row", F.monotonically_increasing_id()), "urls")
    each = named.select("row", F.posexplode("tokens").alias("at", "token")).select("row", "at", F.substr("token", F.lit(2)).alias("name"))
    names = each.where(F.length("name") > 1).select("name").distinct()
    splits = _splits(stored(names.withColumn("id", F.monotonically_increasing_id()), "names"), lexicon)
    cut = looked_up(each, ["name"], splits).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "words"))).alias("cut"))

    def words(token: Column, at: Column) -> Column:
        own = F.coalesce(F.try_element_at("cut", at), F.array(F.substr(token, F.lit(2))))
        return F.transform(own, lambda word: F.concat(F.substr(token, F.lit(1), F.lit(1)), word))

    tokens = F.flatten(F.transform("tokens", words))
    return named.join(cut, "row", "left").select("page", "host", "path", tokens.alias("tokens"))


def _hashed(tokens: list[str], bits: int) -> list[int]:
    mask = (1 << bits) - 1
    return [zlib.crc32(token.encode()) & mask for token in tokens]


def _host_words(tokens: list[str]) -> list[str]:
    return [token[1:] for token in tokens if token[0] != "p"]


@dataclass
class UrlModel:
    """The log odds of block against allow: of a URL before its words, and of each hashed word."""

    prior: float
    odds: np.ndarray
    bits: int


def word_odds(counts: np.ndarray, listed: list[int]) -> np.ndarray:
    """Log odds of words from their counts in the examples to block and to allow, smoothed; 0 for words that have none.

    ``listed`` words count once more among those to block; that does not make the other words there any rarer.
    """
    totals = counts.sum(axis=1) + SMOOTHING
    counts = counts.copy()
    counts[0, sorted(set(listed))] += 1
    both = counts.sum(axis=0)
    used = both > 0
    smooth = np.log((counts[:, used] + SMOOTHING * both[used] / max(both.sum(), 1)) / totals[:, None])
    odds = np.zeros(counts.shape[1])
    odds[used] = smooth[0] - smooth[1]
    return odds


def fit_split(split: DataFrame, block_words: tuple[str, ...] = tuple(BLOCK_WORDS), bits: int = BITS) -> UrlModel:
    """Multinomial naive Bayes over the hosts of ``split_urls``: an example is a host with all different words of its URLs.

    It is one to block if one of the words of the host is a block word, else one to allow. The table of counts has
    2^bits rows at most.
    """
    own = F.transform(F.filter("tokens", lambda token: ~token.startswith("p")), lambda token: F.substr(token, F.lit(2)))
    blocked = F.arrays_overlap(own, F.array(*[F.lit(word) for word in block_words])).cast("int")
    hosts = split.where("host <> ''").select("host", blocked.alias("blocked"), "tokens")
    hashed = F.crc32("token").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    words = hosts.select("host", "blocked", F.explode("tokens").alias("token")).select("host", "blocked", hashed.alias("word")).distinct()
    sums = F.sum("blocked").alias("blocked"), F.sum(1 - F.col("blocked")).alias("allowed")
    counts = np.zeros((2, 1 << bits))
    for row in words.groupBy("word").agg(*sums).collect():
        counts[:, row["word"]] = row["blocked"], row["allowed"]
    seen = hosts.select("host", "blocked").distinct().agg(*sums).head()
    prior = float(np.log(((seen["blocked"] or 0) + 1) / ((seen["allowed"] or 0) + 1)))
    listed = _hashed([kind + word for kind in "ht" for word in block_words], bits)
    return UrlModel(prior, word_odds(counts, listed), bits)


def judged_split(split: DataFrame, model: UrlModel, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``page``, ``host``, ``path``, ``rule``, ``verdict``, ``host_words`` and ``odds`` of every row of ``split_urls``.

    The verdict is that of the longest rule that fits, else ``block`` if the log odds of the URL's words are above 0,
    else ``allow``. URLs that are null or without ``://`` have an empty host and path; without words only the prior
    decides. Rows are judged each on their own.
    """
    shared = split.sparkSession.sparkContext.broadcast((model.prior, model.odds, model.bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, known, bits = shared.value
        for batch in batches:
            found = batch.column(3).to_pylist()
            odds = [prior + float(known[_hashed(tokens, bits)].sum()) for tokens in found]
            schema = pa.schema([batch.schema.field(n) for n in range(3)] + [("host_words", pa.string()), ("odds", pa.float64())])
            yield batch_of(schema, [*batch.columns[:3], [" ".join(_host_words(tokens)) for tokens in found], odds])

    scored = split.mapInArrow(work, f"page {dict(split.dtypes)['page']}, host string, path string, host_words string, odds double")
    fitting = scored.withColumn("r", best_rule(F.col("host"), F.col("path"), rules))
    by_words = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return fitting.select(
        "page", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_words).alias("verdict"), "host_words", "odds"
    )
