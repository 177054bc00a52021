"""Phrase collocations: phrases whose words occur together more often than by chance.

Words are counted first, by block of texts and then by shard of the words. A phrase can only be frequent if all its parts are, so phrases of n words are counted among
the places where two frequent phrases of n - 1 words overlap. Every block of texts counts its own phrases: the number
of the first n - 1 words and that of the last word, packed into 64 bits, go into counting quotient filters, one per
shard of the permuted keys. The filters of a shard are merged from all blocks, frequent phrases get numbers, and every
block gets back the numbers of the phrases that it has. So a phrase, however common, is one row per block at most, and
no table of phrases has to fit a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docsift.llm.common import looked_up, shuffle_partitions, stored
from docsift.llm.quotient_filter import counted, decoded, encoded, merged, shards, unpermuted

MOST_WORDS, MIN_COUNT, FIRST = 5, 100, 2000
WORD_BITS = 24  # of a packed key, for the last word; the others are for the phrase before it
BLOCK_WORDS = 1_200_000  # a block ends with the document or piece that reaches it
SHARD_BYTES = 16_000_000  # of text for each shard, so that a merge has at most a few million keys
_CUT = b"\xff"  # no byte of UTF-8: the end of a piece
# Lower-cases A-Z; ends of pieces become \n, tabs spaces.
_PIECE_BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8, with ``_CUT`` between and behind its pieces."""
    return [*text.translate(_PIECE_BYTES).replace(b"\n", b" \xff ").split(), _CUT] if text else []


class _Codes(dict):
    """Numbers the words of one language among the ``names`` of a block: language, tab, word."""

    def __init__(self, lang: str, names: list[bytes]):
        super().__init__({_CUT: -1})
        self.begin, self.names, self.words = lang.encode() + b"\t", names, 0

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self.names)
        self.names.append(self.begin + word)
        return self[word]


_BLOCKS = pa.schema([
    ("block", pa.int64()), ("shard", pa.int32()), ("codes", pa.list_(pa.int32())), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())),
    ("names", pa.list_(pa.string())), ("named", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
])


class _Open:
    """A block that is being filled."""

    def __init__(self):
        self.codes, self.names, self.by_lang, self.size = [], [], {}, 0

    def add(self, lang: str, words: list[bytes]) -> None:
        known = self.by_lang.get(lang)
        if known is None:
            known = self.by_lang[lang] = _Codes(lang, self.names)
        codes = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        known.words += int((codes >= 0).sum())
        self.codes.append(codes)
        self.size += len(words)

    def rows(self, block: int, shard_bits: int) -> pa.RecordBatch:
        codes = np.concatenate(self.codes)
        counts = np.bincount(codes[codes >= 0], minlength=len(self.names))
        of = np.fromiter(map(zlib.crc32, self.names), np.uint32, len(self.names)).astype(np.int64) >> (32 - shard_bits)
        order = np.argsort(of, kind="stable")
        used, sizes = np.unique(of, return_counts=True)
        ends = pa.array(np.concatenate([[0, 0], np.cumsum(sizes)]), pa.int32())
        more = [None] * len(used)
        names = pa.array(self.names, pa.string()).take(pa.array(order))
        columns = [
            pa.array([block] * (len(used) + 1), pa.int64()), pa.array([None, *used.tolist()], pa.int32()),
            *[pa.array([own, *more], _BLOCKS.field(n + 2).type) for n, own in enumerate((codes, list(self.by_lang), [c.words for c in self.by_lang.values()]))],
            *[pa.ListArray.from_arrays(ends, values) for values in (names, pa.array(order, pa.int32()), pa.array(counts[order], pa.int64()))],
        ]
        return pa.RecordBatch.from_arrays(columns, schema=_BLOCKS)


def _parts(words: list[bytes], most: int) -> Iterator[list[bytes]]:
    """The words in parts of about ``most``, cut where a piece ends."""
    at = 0
    while len(words) - at > most:
        try:
            end = words.index(_CUT, at + most) + 1
        except ValueError:
            break
        yield words[at:end]
        at = end
    yield words[at:]


def _blocks(docs: DataFrame, text_column: str, lang_column: str, block_words: int, shard_bits: int) -> DataFrame:
    """Two kinds of rows. Without a shard, one per block: the ``codes`` of its words in order, -1 at the end of a piece, and
    the number of words of each language. One per block and shard: the ``names`` of its words, their codes and counts."""
    lang = F.coalesce(docs[f"`{lang_column}`"].cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), docs[f"`{text_column}`"].cast("binary").alias("text"), F.spark_partition_id().alias("part"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, done, part = _Open(), 0, 0
        for batch in batches:
            langs = batch.column(0).to_pylist()
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for lang, text in zip(langs, batch.column(1), strict=True):
                for words in _parts(words_of(text.as_py()), block_words):
                    if words:
                        block.add(lang, words)
                    if block.size >= block_words:
                        yield block.rows(part << 33 | done, shard_bits)
                        block, done = _Open(), done + 1
        if block.size:
            yield block.rows(part << 33 | done, shard_bits)

    ddl = (
        "block bigint, shard int, codes array<int>, langs array<string>, totals array<bigint>, "
        "names array<string>, named array<int>, counts array<bigint>"
    )
    return rows.mapInArrow(work, ddl)


def _lists(values: np.ndarray, owner: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """One list per row of the values that it owns; owners ascend."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _frequent_words(blocks: DataFrame, min_count: int, shard_bits: int) -> DataFrame:
    """Adds up the words of each shard. ``block``, ``named`` and ``ids``: the codes of the frequent words that the block has, with
    their numbers; a row with a null block has the ``ids``, ``names`` and ``counts`` of all those of a shard."""
    schema = pa.schema([
        ("block", pa.int64()), ("named", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("names", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
    ])

    def work(rows: pa.Table) -> pa.Table:
        shard, n = rows["shard"][0].as_py(), rows.num_rows
        lists = {name: rows[name].combine_chunks() for name in ("names", "named", "counts")}
        words = lists["names"].flatten().dictionary_encode()
        at, own = words.indices.to_numpy(), lists["counts"].flatten().to_numpy()
        sums = np.zeros(len(words.dictionary), np.int64)
        np.add.at(sums, at, own)
        frequent = sums >= min_count
        ids = (np.cumsum(frequent) - 1) << shard_bits | shard
        kept = frequent[at]
        owner = np.repeat(np.arange(n), lists["names"].value_lengths().to_numpy())[kept]
        theirs = [_lists(lists["named"].flatten().to_numpy()[kept], owner, n, pa.int32()), _lists(ids[at[kept]], owner, n, pa.int64())]
        nothing = [pa.nulls(n, schema.types[3]), pa.nulls(n, schema.types[4])]
        all_of = [words.dictionary.filter(pa.array(frequent)), pa.array(sums[frequent])]
        one = [pa.nulls(1, pa.int64()), pa.nulls(1, schema.types[1]), *[
            pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (pa.array(ids[frequent]), *all_of)
        ]]
        parts = [pa.Table.from_arrays(columns, schema=schema) for columns in ([rows["block"].combine_chunks(), *theirs, *nothing], one)]
        return pa.concat_tables(parts)

    ddl = "block bigint, named array<int>, ids array<bigint>, names array<string>, counts array<bigint>"
    dealt = blocks.where("shard IS NOT NULL").select("block", "shard", "names", "named", "counts")
    return stored(dealt.groupBy("shard").applyInArrow(work, ddl), "words")


def _word_phrases(found: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``f`` and ``id`` of the frequent words."""
    each = found.where("block IS NULL").select(F.explode(F.arrays_zip("names", "counts", "ids")).alias("w"))
    lang, word = F.regexp_extract("w.names", r"(?s)^(.*)\t", 1), F.substring_index("w.names", "\t", -1)
    return each.select(lang.alias("lang"), word.alias("phrase"), F.col("w.counts").alias("f"), F.col("w.ids").alias("id"))


def _first_sequences(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """``block`` and ``words``: the numbers of the frequent words at each place of a block, -1 elsewhere."""
    schema = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.int32()))])

    def work(own: pa.Table, theirs: pa.Table) -> pa.Table:
        if not own.num_rows or not theirs.num_rows:
            return schema.empty_table()
        codes = own["codes"].combine_chunks()[0].values.to_numpy()
        ids = np.full(max(codes.max(initial=-1), 0) + 2, -1, np.int32)  # the last place is that of the code -1
        ids[_flat(theirs["named"])] = _flat(theirs["ids"])
        return pa.Table.from_arrays([own["block"], pa.array([ids[codes]], schema.types[1])], schema=schema)

    sent = found.where("block IS NOT NULL AND size(ids) > 0").select(F.col("block").alias("to"), "named", "ids")
    pairs = blocks.where("shard IS NULL").select("block", "codes").groupBy("block").cogroup(sent.groupBy("to"))
    return stored(pairs.applyInArrow(work, "block bigint, words array<int>"), "sequences1")


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([chunk.flatten().to_numpy() for chunk in lists.chunks])


_SEQUENCES = pa.schema([("block", pa.int64()), ("places", pa.list_(pa.int32())), ("grams", pa.list_(pa.int64())), ("lasts", pa.list_(pa.int32()))])
_SEQUENCES_DDL = "block bigint, places array<int>, grams array<bigint>, lasts array<int>"


def _overlaps(row: dict[str, pa.Scalar]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where two frequent phrases overlap in all but a word, the packed keys of the phrases that they make, and their last words.

    A row of ``_first_sequences`` has words at all places, later ones have the places, numbers and last words of phrases.
    """
    if "words" in row:
        words = row["words"].values.to_numpy()
        places = np.flatnonzero(words >= 0)
        grams = lasts = words[places]
    else:
        places, grams, lasts = (row[n].values.to_numpy() for n in ("places", "grams", "lasts"))
    both = np.flatnonzero(places[1:] == places[:-1] + 1)
    return places[both], grams[both].astype(np.int64) << WORD_BITS | lasts[both + 1], lasts[both + 1]


def _filters(sequences: DataFrame, shard_bits: int) -> DataFrame:
    """``block``, ``shard`` and ``filter``: a counting quotient filter per block and shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *rest in zip(*batch.columns, strict=True):
                keys, counts = counted(_overlaps(dict(zip(batch.schema.names[1:], rest, strict=True)))[1])
                begins = shards(keys, shard_bits)
                used = np.flatnonzero(np.diff(begins))
                data = [encoded(keys[begins[s] : begins[s + 1]], counts[begins[s] : begins[s + 1]], shard_bits) for s in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()] * len(used), pa.int64()), pa.array(used, pa.int32()), pa.array(data, pa.binary())],
                    names=["block", "shard", "filter"],
                )

    return sequences.mapInArrow(work, "block bigint, shard int, filter binary")


def _frequent(filters: DataFrame, size: int, min_count: int, shard_bits: int) -> DataFrame:
    """Merges the filters of each shard. ``block``, ``keys``, ``ids`` and ``counts``: the frequent keys that the block has, with
    their numbers; a row with a null block has all those of a shard, with their counts."""
    schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def work(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        parts = [decoded(data.as_py(), shard, shard_bits) for data in rows["filter"]]
        keys, counts = merged(parts)
        keys, counts = keys[counts >= min_count], counts[counts >= min_count]
        ids, plain = np.arange(len(keys)) << shard_bits | shard, unpermuted(keys).astype(np.int64)
        blocks, own_keys, own_ids = [None], [plain], [ids]
        for block, (own, _) in zip(rows["block"].to_pylist(), parts, strict=True) if len(keys) else ():
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            at = at[keys[at] == own]
            blocks.append(block)
            own_keys.append(plain[at])
            own_ids.append(ids[at])
        empty = np.zeros(0, np.int64)
        columns = [blocks, own_keys, own_ids, [counts] + [empty] * (len(blocks) - 1)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ddl = "block bigint, keys array<bigint>, ids array<bigint>, counts array<bigint>"
    return stored(filters.groupBy("shard").applyInArrow(work, ddl), f"frequent{size}")


def _next_sequences(sequences: DataFrame, frequent: DataFrame, size: int) -> DataFrame:
    """The places, numbers and last words of the frequent phrases of ``size`` words in each block."""

    def work(own: pa.Table, found: pa.Table) -> pa.Table:
        if not own.num_rows or not found.num_rows:
            return _SEQUENCES.empty_table()
        places, keys, lasts = _overlaps({name: own[name].combine_chunks()[0] for name in own.column_names[1:]})
        known, ids = _flat(found["keys"]), _flat(found["ids"])
        order = np.argsort(known)
        known, ids = known[order], ids[order]
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        columns = [pa.array([v], f.type) for v, f in zip((places[hit], ids[at[hit]], lasts[hit]), list(_SEQUENCES)[1:], strict=True)]
        return pa.Table.from_arrays([own["block"], *columns], schema=_SEQUENCES)

    own = frequent.where("block IS NOT NULL AND size(keys) > 0").select(F.col("block").alias("to"), "keys", "ids")
    pairs = sequences.groupBy("block").cogroup(own.groupBy("to"))
    return stored(pairs.applyInArrow(work, _SEQUENCES_DDL), f"sequences{size}")


def _phrases(frequent: DataFrame, before: DataFrame, words: DataFrame, size: int) -> DataFrame:
    """``lang``, ``phrase``, ``f`` and ``id`` of the frequent phrases of ``size`` words, from their first words and their last."""
    each = frequent.where("block IS NULL").select(F.explode(F.arrays_zip("keys", "ids", "counts")).alias("g"))
    grams = each.select(
        F.shiftrightunsigned("g.keys", WORD_BITS).alias("first"), F.col("g.keys").bitwiseAND(F.lit((1 << WORD_BITS) - 1)).alias("last"),
        F.col("g.ids").alias("id"), F.col("g.counts").alias("f"),
    )
    # stored, because the next lookup reads them four times, each with a plan of all that is before
    begun = stored(looked_up(stored(grams, f"grams{size}"), ["first"], before.select(F.col("id").alias("first"), "lang", F.col("phrase").alias("begin"))), f"begun{size}")
    ended = looked_up(begun, ["last"], words.select(F.col("id").alias("last"), F.col("phrase").alias("end")))
    return stored(ended.select("lang", F.concat_ws(" ", "begin", "end").alias("phrase"), "f", "id"), f"phrases{size}")


def frequent_phrases(
    docs: DataFrame, text_column: str, lang_column: str, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS,
    block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``most_words`` words that occur ``min_count`` times or more in their language, and the languages.

    The phrases have ``lang``, ``size``, ``phrase`` and ``f`` (exact); the languages ``lang`` and ``n`` (all occurrences of words).
    Raises ValueError if there are more than 2^WORD_BITS frequent words, or 2^(63 - WORD_BITS) frequent phrases.
    """
    total = docs.agg(F.sum(F.octet_length(docs[f"`{text_column}`"]).cast("long"))).head()[0] or 0
    shard_bits = max(0, (-(-total // shard_bytes) - 1).bit_length())
    blocks = stored(_blocks(docs, text_column, lang_column, block_words, shard_bits), "blocks")
    totals = blocks.where("shard IS NULL").select(F.explode(F.arrays_zip("langs", "totals")).alias("t"))
    langs = stored(totals.groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n")), "langs")
    found = _frequent_words(blocks, min_count, shard_bits)
    words = stored(_word_phrases(found), "phrases1")
    _check_ids(words, WORD_BITS)
    sequences, before = _first_sequences(blocks, found), words
    every = words.select("lang", F.lit(1).alias("size"), "phrase", "f")
    for size in range(2, most_words + 1):
        frequent = _frequent(_filters(sequences, shard_bits), size, min_count, shard_bits)
        before = _phrases(frequent, before, words, size)
        _check_ids(before, 63 - WORD_BITS)
        every = every.unionAll(before.select("lang", F.lit(size).alias("size"), "phrase", "f"))
        if size < most_words:
            sequences = _next_sequences(sequences, frequent, size)
    return every, langs


def _check_ids(phrases: DataFrame, bits: int) -> None:
    if (phrases.agg(F.max("id")).head()[0] or 0) >= 1 << bits:
        raise ValueError("too many frequent phrases for a packed key; raise min_count")


def _scored(phrases: DataFrame) -> DataFrame:
    """``lang``, ``phrase``, ``size``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the phrases of two words or more, at their worst cut.

    ``phrases`` have ``lang``, ``size``, ``phrase``, ``f`` and the ``n`` of the language.
    """
    cuts = phrases.where("size > 1").select(
        "lang", F.col("phrase").alias("whole"), "size", F.col("f").alias("a"), "n", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    )
    words = F.split("whole", " ", -1)
    sides = F.array(
        F.struct(F.lit(True).alias("head"), F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("phrase")),
        F.struct(F.lit(False).alias("head"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("phrase")),
    )
    parts = cuts.withColumn("part", F.explode(sides)).select(*cuts.columns, "part.*")
    known = looked_up(parts, ["lang", "phrase"], phrases.select("lang", "phrase", "f"))
    both = known.groupBy(*cuts.columns).agg(F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    score = F.expr(
        "(1000 * CAST(a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"
    )
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w")
    found = both.groupBy("lang", "whole", "size", "a", "n").agg(worst)
    return found.select("lang", F.col("whole").alias("phrase"), "size", "a", "w.l", "w.r", "n", "w.score")


def collocations(
    docs: DataFrame, text_column: str, lang_column: str, min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, first: int = FIRST,
    block_words: int = BLOCK_WORDS, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the ``first`` collocations of every language.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends; words are what spaces and tabs part.
    Phrases of 2 to ``most_words`` words count with all occurrences in pieces. The score of a cut is
    1000 * a * n / (l * r), rounded down, that of a phrase the least of its cuts, the first of equal ones. A phrase
    inside of a longer one that occurs as often is left out. Null languages are ``und``, null texts are empty; every
    row counts, also if ids or texts repeat. Other columns are not read.
    """
    phrases, langs = frequent_phrases(docs, text_column, lang_column, min_count, most_words, block_words, shard_bytes)
    phrases = stored(looked_up(phrases, ["lang"], langs), "phrases")
    # a phrase as frequent as one two words longer is as frequent as one between them
    inside = F.array(F.regexp_extract("phrase", r"(?s)^(.*) ", 1), F.regexp_extract("phrase", r"(?s)^[^ ]* (.*)$", 1))
    inner = phrases.where("size > 2").select("lang", F.explode(inside).alias("phrase"), F.col("f").alias("a")).distinct()
    left = _scored(phrases).join(inner, ["lang", "phrase", "a"], "left_anti")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    some = Window.partitionBy("lang", "part").orderBy(*order)
    parts = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    few = left.withColumn("part", parts).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
