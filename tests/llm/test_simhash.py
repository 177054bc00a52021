import random

import xxhash

from docsift.llm.components import connected
from docsift.llm.simhash import _links_by_values, fingerprints, links, near_duplicates, without_near_duplicates


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def brute_groups(values):
    near = [(a, b) for a in values for b in values if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2]
    return groups(near, values)


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "one TWO", "Ñandú É é", "a b\x1cc d", "a b c d e", "x " * 5000]
    texts += [" ".join(rng.choices("aA bB cC é\td e\n".split(" "), k=rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "fp long, text string")
    got = {r.doc: r.fp % (1 << 64) for r in fingerprints(df, "fp", "text").collect()}
    assert got == {n: brute_fingerprint(t) for n, t in enumerate(texts)}


def sample(rng, centres, around):
    values = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(around):
            value = centre
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randrange(64)
            values.add(signed(value))
    return sorted(values)


def roots(spark, edges, values):
    found = {r.node: r.root for r in connected(edges).collect()}
    return {v: found.get(v, v) for v in values}


def test_links_give_the_same_groups_in_pairs_and_by_values(spark):
    rng = random.Random(2)
    values = sample(rng, 40, 5) + sample(rng, 2, 60)
    prints = spark.createDataFrame([(v,) for v in values], "fp long")
    want = brute_groups(values)
    for few in (0, 3, 16, 10_000):
        assert roots(spark, links(prints, few), values) == want, few
    assert roots(spark, _links_by_values(prints), values) == want


def test_every_difference_of_two_bits_is_found(spark):
    values = [0] + [1 << a | 1 << b for a in range(64) for b in range(a + 1, 64)][:: 7]
    prints = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {tuple(sorted((r.a, r.b))) for r in links(prints, 10_000).collect()}
    assert {tuple(sorted((0, signed(v)))) for v in values[1:]} <= found


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([((n * 7919) % 101, ((n + 1) * 7919) % 101) for n in range(100)], "a long, b long")
    assert {r.root for r in connected(edges).collect()} == {0}
    assert connected(edges.limit(0)).count() == 0


def test_documents_nulls_copies_and_names(spark):
    long = " ".join(f"w{n}" for n in range(400))
    rows = [(5, long, "a"), (2, long, "b"), (2, long, "b"), (9, long + " end", "c"), (None, long, "d"), (7, None, "e"), (3, "", "f"), (8, "other", "g")]
    df = spark.createDataFrame(rows, "doc long, text string, kept_doc string")
    got = {(r.doc, r.component) for r in near_duplicates(df, "doc", "text").collect()}
    near = (brute_fingerprint(long) ^ brute_fingerprint(long + " end")).bit_count() <= 2
    assert got == {(5, 2), (2, 2), (9, 2 if near else 9), (None, 2), (7, 3), (3, 3), (8, 8)}
    kept = without_near_duplicates(df, "doc", "text").collect()
    assert sorted(r.doc for r in kept) == ([2, 3, 8] if near else [2, 3, 8, 9])
    assert set(kept[0].asDict()) == {"doc", "text", "kept_doc"}
    assert near_duplicates(df.limit(0), "doc", "text").count() == 0


def test_one_row_of_every_group_whatever_its_id(spark):
    x, y, z, v = (" ".join(f"{c}{n}" for n in range(300)) for c in "xyzv")
    rows = [(5, x, "a"), (5, y, "b"), (3, y, "c"), (None, z, "d"), (None, v, "e"), (None, z, "d"), (None, x, "f"), (7, None, "g"), (7, "lone text", "h")]
    df = spark.createDataFrame(rows, "doc long, text string, more string").repartition(4)
    kept = sorted(map(tuple, without_near_duplicates(df, "doc", "text").collect()), key=repr)
    assert kept == sorted([(5, x, "a"), (3, y, "c"), (None, z, "d"), (None, v, "e"), (7, None, "g"), (7, "lone text", "h")], key=repr)
