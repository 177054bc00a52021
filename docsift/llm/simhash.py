"""SimHash fingerprints and their near-duplicate groups by pigeonring filtering.

A fingerprint of 64 bits is a ring of 8 segments of 8 bits. Two fingerprints that differ in at most 2 bits have a
segment from which on every chain of l segments has at most 2 * l / 8 differing bits: none in the first three, at most
one in the first seven. So three segments are equal, and of the next four the first two or the last two. Each
fingerprint has 8 * 2 keys of 40 bits; only fingerprints with a common key are compared, first by the budgets of the
chain and then in full.

Different fingerprints that share a key are compared in pairs while they are few. Where many share one, as the
fingerprints around a large group of near copies do, another exact way is taken: two fingerprints differ in at
most 2 bits if and only if some 64-bit value differs from each in at most one. Every fingerprint gives its 65
such values, and all that give one value are linked to the smallest of them (65 at most). That is linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docsift.llm.common import batch_of, chunks, stored
from docsift.llm.components import connected
from docsift.llm.line_dedup import text_key

SEGMENTS, WIDTH, MOST = 8, 8, 2
WORDS = 3  # in a shingle
FEW = 16  # fingerprints of a key that are compared in pairs; more are linked through neighbouring values
_BLOCK = 1 << 18


def fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc`` and ``fp`` (64 bits as a long) of every row.

    Lower-cases A-Z, takes words between ASCII white space and shingles of three words with repeats; a text of fewer
    words is one shingle. A bit is set if it is set in over half the XXH64 hashes (seed 42). Null texts and texts
    without words have the fingerprint 0. Whole texts are read.
    """
    rows = docs.select(docs[f"`{id_column}`"].alias("doc"), docs[f"`{text_column}`"].alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("fp", pa.int64())])
            texts = batch.column(1).to_pylist()
            for begin, end in chunks(texts):
                yield batch_of(schema, [batch.column(0)[begin:end], _fingerprints(texts[begin:end])])

    return rows.mapInArrow(work, f"doc {dict(rows.dtypes)['doc']}, fp long")


def _hashes(text: str | None) -> list[int]:
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return []
    shingles = zip(*(words[n:] for n in range(WORDS)), strict=False) if len(words) >= WORDS else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(shingle), 42) for shingle in shingles]


def _fingerprints(texts: list[str | None]) -> np.ndarray:
    counts = np.zeros((len(texts), 64), np.int64)
    sizes = np.zeros(len(texts), np.int64)
    waiting, rows = [], 0

    def count() -> None:
        hashes = np.concatenate([np.array(h, np.uint64) for _, h in waiting])
        owners = np.repeat([n for n, _ in waiting], [len(h) for _, h in waiting])
        for at in range(0, len(hashes), _BLOCK):
            bits = np.unpackbits(hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = owners[at : at + _BLOCK]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        waiting.clear()

    for n, text in enumerate(texts):
        hashes = _hashes(text)
        sizes[n] = len(hashes)
        if hashes:
            waiting.append((n, hashes))
            rows += len(hashes)
        if rows >= _BLOCK:
            count()
            rows = 0
    if waiting:
        count()
    bits = (2 * counts > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().view(np.int64)


def _rotated(fp: Column, bits: int) -> Column:
    return fp if not bits else F.shiftrightunsigned(fp, bits).bitwiseOR(F.shiftleft(fp, 64 - bits))


def _keys(fp: Column) -> Column:
    """The 16 keys of a fingerprint: number of the chain and of the equal half, then 40 bits."""
    keys = []
    for start in range(SEGMENTS):
        ring = _rotated(fp, WIDTH * start)
        equal = ring.bitwiseAND(F.lit((1 << 3 * WIDTH) - 1))
        for half in range(2):
            rest = F.shiftrightunsigned(ring, (3 + 2 * half) * WIDTH).bitwiseAND(F.lit((1 << 2 * WIDTH) - 1))
            tag = F.lit((2 * start + half) << 5 * WIDTH).cast("long")
            keys.append(equal.bitwiseOR(F.shiftleft(rest, 3 * WIDTH)).bitwiseOR(tag))
    return F.array(*keys)


def _within_budgets(a: Column, b: Column, key: Column) -> Column:
    """Whether every chain from the key's segment on keeps its share of the allowed differences."""
    start = F.shiftrightunsigned(key, 5 * WIDTH + 1).cast("int")
    differing = a.bitwiseXOR(b)
    ring = F.element_at(F.array(*[_rotated(differing, WIDTH * n) for n in range(SEGMENTS)]), start + 1)
    fits = F.lit(True)
    for chain in range(1, SEGMENTS + 1):
        mask = F.lit((1 << WIDTH * chain) - 1 if chain < SEGMENTS else -1).cast("long")
        fits = fits & (F.bit_count(ring.bitwiseAND(mask)) <= MOST * chain // SEGMENTS)
    return fits


def links(prints: DataFrame, few: int = FEW) -> DataFrame:
    """Edges (a, b) that connect all different values of ``fp`` at 2 or fewer differing bits.

    Two such fingerprints have an edge, or a common neighbour among the edges of one value; others have none.
    """
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, "key"), "shared")
    bounded = shared.where(F.col("n") <= few).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    firsts = bounded.select("key", "fps", F.posexplode("fps").alias("at", "a"))
    pairs = firsts.select("key", "a", F.explode(F.expr("slice(fps, at + 2, size(fps))")).alias("b"))
    near = pairs.where(_within_budgets(F.col("a"), F.col("b"), F.col("key"))).select("a", "b")
    many = shared.where(F.col("n") > few).select("fp").distinct()
    return near.unionAll(_links_by_values(many))


def _links_by_values(prints: DataFrame) -> DataFrame:
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << n if n < 63 else -(1 << 63)).cast("long") for n in range(64)])
    values = prints.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    groups = values.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    return groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")


def _rooted(prints: DataFrame, first: Column) -> DataFrame:
    """``fp``, its smallest ``first`` and the ``root`` of its component, a row per different fingerprint."""
    nodes = stored(prints.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    roots = connected(links(nodes))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc``, ``fp`` and ``component``: the smallest id that is reachable over links of 2 or fewer differing bits.

    A row per input row. Rows with equal fingerprints are always linked; so texts without words (fingerprint 0) form
    one group. Null ids have a component, but are the smallest only if no other id is there (then null).
    """
    prints = stored(fingerprints(docs, id_column, text_column), "fingerprints")
    rooted = _rooted(prints, F.col("doc"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    components = rooted.join(smallest, "root").select("fp", "component")
    return prints.join(components, "fp").select("doc", "fp", "component")


def without_near_duplicates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row of every group, with all its columns: that with the smallest id, and of one id the first text by its hash.

    Null ids come last, so rows without an id stay only where their group has no other id. Rows with the same id and
    different texts are different documents, each in the group of its own text. Rows equal in id and text are one
    document, of which one row stays (the first by a hash of all columns).
    """
    key = text_key(docs[f"`{text_column}`"])
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs[f"`{text_column}`"].alias("text"),
        docs[f"`{id_column}`"].alias("doc"), key["a"].alias("a"), key["b"].alias("b"),
    )
    prints = stored(fingerprints(rows.select(F.struct("doc", "a", "b").alias("doc"), "text"), "doc", "text"), "fingerprints")
    rooted = _rooted(prints, F.struct(F.col("doc.doc").isNull().alias("last"), "doc.doc", "doc.a", "doc.b"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("k"))
    kept = firsts.select(F.col("k.doc").alias("kept_doc"), F.col("k.a").alias("kept_a"), F.col("k.b").alias("kept_b"))
    same = F.col("doc").eqNullSafe(F.col("kept_doc")) & (F.col("a") == F.col("kept_a")) & (F.col("b") == F.col("kept_b"))
    mine = rows.drop("text").join(kept, same, "left_semi")
    hashed = [F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    first = mine.groupBy("doc", "a", "b").agg(F.min_by("row", F.xxhash64(*hashed)).alias("row"))
    return first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
