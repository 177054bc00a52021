"""SpotSigs fingerprints: chains of content words behind common-word anchors.

A signature is an anchor (a very common word) and the next content words behind it. The set of all signatures of a
text is its fingerprint. Sets are partitioned by their size, as sets of very different size can't be alike, and
compared by their Jaccard similarity, which is given up as soon as the sizes rule out the wanted value.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docsift.llm.common import CHUNK_CHARS, batch_of, chunks, shuffle_partitions
from docsift.llm.merges import WordCodes

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine er im in ist mit nicht sich und von zu "
    "au dans de des du elle en est et la le les ne par pas pour que qui sur un une "
    "al con del el en es la las lo los no para por que se su un una y"
).split()
CHAIN = 2
_STRIP = b".,;:!?\"'()[]{}#*$%&|<>-_"
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_KEEP = 300_000


class SpotSigs:
    """Signature sets of lists of texts; remembers words between calls."""

    def __init__(self, anchors: tuple[str, ...] = tuple(ANCHORS), chain: int = CHAIN):
        self.anchors, self.chain = {a.encode() for a in anchors}, chain
        self._reset()

    def _reset(self) -> None:
        self.codes = WordCodes()
        self.hashes, self.kinds = np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def _learn(self) -> None:
        fresh, self.codes.fresh = self.codes.fresh, []
        plain = [word.decode().lower().encode().strip(_STRIP) for word in fresh]
        kinds = np.array([2 if w in self.anchors else 1 if w else 0 for w in plain], np.int8)
        self.hashes = np.concatenate([self.hashes, np.array([zlib.crc32(w) for w in plain], np.uint64)])
        self.kinds = np.concatenate([self.kinds, kinds])

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All signatures (32-bit hashes), sorted and distinct within each text, and where each text's begin and end.

        A text with words but without any full chain has one signature of all its words; one without words has none.
        """
        if len(self.codes) > _KEEP:
            self._reset()
        words, counts = [], []
        for text in texts:
            own = text.encode().split() if text else []
            words += own
            counts.append(len(own))
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if self.codes.fresh:
            self._learn()
        owner = np.repeat(np.arange(len(texts)), counts)
        kinds, hashes = self.kinds[codes], self.hashes[codes]
        kept = kinds > 0
        owner, kinds, hashes = owner[kept], kinds[kept], hashes[kept]
        content = np.flatnonzero(kinds == 1)
        before = np.cumsum(kinds == 1)  # content words up to a place
        anchor = np.flatnonzero(kinds == 2)
        first = before[anchor]
        full = first + self.chain <= len(content)
        anchor, first = anchor[full], first[full]
        full = owner[content[first + self.chain - 1]] == owner[anchor]
        anchor, first = anchor[full], first[full]
        mixed = hashes[anchor] * _MIX[0]
        for step in range(self.chain):
            mixed = (mixed ^ hashes[content[first + step]]) * _MIX[1 + step % 3]
            mixed ^= mixed >> np.uint64(29)
        of = owner[anchor]
        bare = np.setdiff1d(np.unique(owner), of)
        if len(bare):
            mixed = np.concatenate([mixed, self._whole(owner, hashes, bare)])
            of = np.concatenate([of, bare])
        keys = np.unique(of.astype(np.uint64) << np.uint64(32) | mixed >> np.uint64(32))
        bounds = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
        return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), bounds

    @staticmethod
    def _whole(owner: np.ndarray, hashes: np.ndarray, bare: np.ndarray) -> np.ndarray:
        starts, ends = np.searchsorted(owner, bare), np.searchsorted(owner, bare, "right")
        return np.array([
            int.from_bytes(hashlib.blake2b(hashes[a:b].astype("<u8").tobytes(), digest_size=8).digest()) for a, b in zip(starts, ends, strict=True)
        ], np.uint64)


def as_text(signatures: np.ndarray) -> str:
    """The fingerprint as a string: eight hex digits per signature, in order."""
    return signatures.astype(">u4").tobytes().hex()


def jaccard(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Similarity of two sorted sets; 0 without looking at them if their sizes rule out ``at_least``. Two empty sets: 1."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not large:
        return 1.0
    if not small or small < at_least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc``, ``fingerprint`` and ``signatures`` (how many) of every row; null and empty texts have none ("")."""
    rows = docs.select(docs[f"`{id_column}`"].alias("doc"), docs[f"`{text_column}`"].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = SpotSigs()
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("fingerprint", pa.string()), ("signatures", pa.int64())])
            texts = batch.column(1).to_pylist()
            for begin, end in chunks(texts):
                found, bounds = maker.sets(texts[begin:end])
                prints = [as_text(found[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
                yield batch_of(schema, [batch.column(0)[begin:end], prints, np.diff(bounds)])

    return rows.mapInArrow(work, f"doc {dict(rows.dtypes)['doc']}, fingerprint string, signatures long")


def near_pairs(prints: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Pairs of different fingerprints with a Jaccard similarity of ``at_least`` or more: (a, b, similarity), a < b.

    Fingerprints fall into partitions by size, each ``1 / at_least`` times as wide as the one before, so that only the
    same and the next partition are compared. There, two sets that are alike share one of the first
    ``size - ceil(at_least * size) + 1`` of their signatures (sorted by a hash); pairs with that and with sizes that
    allow the similarity are compared in full. Equal fingerprints are one and are not expanded into pairs. Empty
    ones have no pair.
    """
    sets = prints.select("fingerprint").where("fingerprint <> ''").distinct()
    hexes = F.transform(F.sequence(F.lit(0), (F.length("fingerprint") / 8).cast("int") - 1), lambda n: F.substr("fingerprint", n * 8 + 1, F.lit(8)))
    sets = sets.select("fingerprint", hexes.alias("s")).withColumn("n", F.size("s"))
    step = -np.log(at_least) if at_least < 1 else 1e-9
    part = F.floor(F.log("n") / step)
    prefix = (F.col("n") - F.ceil(F.col("n") * at_least - 1e-9) + 1).cast("int")
    keyed = sets.withColumn("part", part).select("fingerprint", "n", "part", F.explode(F.slice(F.sort_array("s"), F.lit(1), prefix)).alias("sig"))
    small = keyed.select(F.col("fingerprint").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "sig")
    large = keyed.withColumnRenamed("fingerprint", "b").withColumnRenamed("n", "nb")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    possible = F.col("na") >= F.col("nb") * at_least - 1e-9
    found = small.join(large, ["part", "sig"]).where(ordered & possible).select("a", "b").distinct()

    def split(name: str):
        return F.transform(F.sequence(F.lit(0), (F.length(name) / 8).cast("int") - 1), lambda n: F.substr(name, n * 8 + 1, F.lit(8)))

    both = found.withColumn("sa", split("a")).withColumn("sb", split("b"))
    common = F.size(F.array_intersect("sa", "sb"))
    scored = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (common / (F.size("sa") + F.size("sb") - common)).alias("similarity"))
    return scored.where(F.col("similarity") >= at_least)


def edited_text(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by as many first characters of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def compared_with_edits(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text takes the beginning of the next document in ascending order of the (integer) id; after the last
    comes the first. Returns ``doc``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next`` (Jaccard with the edited text's and the next document's fingerprint) and ``signatures``.

    Null texts are empty. Null ids come first; rows with equal ids follow each other in the order of their texts. A
    single row is followed by itself.

    Ids are cut into ranges at their approximate quantiles and every range is sorted in one task; the first document of
    a range is also sent to the range before it. A task reads its rows as a stream.
    """
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    rows = docs.select(
        docs[f"`{id_column}`"].cast("long").alias("doc"), F.coalesce(docs[f"`{text_column}`"], F.lit("")).alias("text"),
        F.coalesce(docs[f"`{id_column}`"].cast("long"), F.lit(-(2**63))).alias("place"),
    )
    shares = [n / parts for n in range(1, parts)]
    cuts = np.unique(rows.select(F.col("doc").cast("double")).approxQuantile("doc", shares, 0.25 / parts)) if shares else np.zeros(0)
    bounds = spark.sparkContext.broadcast(np.ceil(cuts).astype(np.int64))

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, place.to_numpy(), "right").astype(np.int32))

    firsts = rows.groupBy(range_of("place").alias("r")).agg(F.min("place").alias("first")).orderBy("r").collect()  # a row per range
    before = {row["first"]: firsts[n - 1]["r"] for n, row in enumerate(firsts)}
    heads = spark.sparkContext.broadcast((np.array(sorted(before), np.int64), np.array([before[k] for k in sorted(before)], np.int32)))

    @F.pandas_udf("int")
    def also_to(place: pd.Series) -> pd.Series:
        keys, targets = heads.value
        at = np.minimum(np.searchsorted(keys, place.to_numpy()), len(keys) - 1)
        return pd.Series(np.where(keys[at] == place.to_numpy(), targets[at], -1).astype(np.int32))

    own = F.struct(F.col("own").alias("range"), F.lit(0).alias("ahead"))
    ahead = F.struct(F.col("more").alias("range"), F.lit(1).alias("ahead"))
    sent = rows.withColumn("own", range_of("place")).withColumn("more", also_to("place"))
    sent = sent.select("doc", "place", "text", F.explode(F.filter(F.array(own, ahead), lambda s: s["range"] >= 0)).alias("to"))
    dealt = sent.select("to.range", "to.ahead", "place", "doc", "text").repartitionById(parts, F.col("range"))
    ordered = dealt.sortWithinPartitions("range", "ahead", "place", "text").select("range", "ahead", "doc", "text")
    schema = (
        "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, signatures long"
    )
    return ordered.mapInArrow(_compare, schema)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """(doc, text, next text) of the sorted rows of a partition."""
    last = None
    for batch in batches:
        columns = [column.to_pylist() for column in batch.columns]
        for part, ahead, doc, text in zip(*columns, strict=True):
            if last is not None and last[0] == part:
                yield last[1], last[2], text
            last = None if ahead else (part, doc, text)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maker = SpotSigs()
    schema = pa.schema([
        ("doc", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("signatures", pa.int64()),
    ])

    def done(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        texts = [text for _, text, _ in rows]
        edits = [edited_text(text, following) for _, text, following in rows]
        # the next text is mostly the text of the next row
        known = [n + 1 < len(rows) and rows[n + 1][1] is rows[n][2] for n in range(len(rows))]
        extra = [row[2] for row, there in zip(rows, known, strict=True) if not there]
        found, bounds = maker.sets(texts + edits + extra)
        sets = [found[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        n, others = len(rows), iter(sets[2 * len(rows) :])
        following = [sets[k + 1] if known[k] else next(others) for k in range(n)]
        return batch_of(schema, [
            [doc for doc, _, _ in rows], list(map(len, texts)), [hashlib.sha256(e.encode()).hexdigest() for e in edits],
            list(map(as_text, sets[:n])), list(map(as_text, sets[n : 2 * n])),
            [jaccard(sets[k], sets[n + k]) for k in range(n)], [jaccard(sets[k], following[k]) for k in range(n)],
            [len(s) for s in sets[:n]],
        ])

    waiting, size = [], 0
    for row in _followed(batches):
        waiting.append(row)
        size += len(row[1])
        if size >= CHUNK_CHARS // 2:
            yield done(waiting)
            waiting, size = [], 0
    if waiting:
        yield done(waiting)
