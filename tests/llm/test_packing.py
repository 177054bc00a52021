import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docsift.llm.packing import pack_counts, packed, reduced
from docsift.llm.word_bpe import WordCodec, WordModel

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
MODEL = WordModel(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_equal_the_library():
    rng = random.Random(1)
    texts = [
        "", " ", "Hello World", "don't we'll I'S it'd x'y", "naïve ÉCOLE Straße ÑANDÚ ŒUVRE", "a1b22 3.14 #tag $$$ ***", "İstanbul ΣΑΣ ſ ŉ ĸ",
        "日本語 テキスト", "é ́a", "<|endoftext|> x<|startoftext|>y <|", "a b c\x1cd", "½ ² ª º ×÷", "_a_b_ 'S ''s", "x" * 500, "thth" * 300,
        "\U0001f600 ok", "a\x00b",
    ]
    texts += ["".join(rng.choices("abthe' n\n1.É日_*", k=rng.randint(0, 80))) for _ in range(400)]
    ids, lengths = WordCodec(MODEL, 0).encode(texts)
    ends = np.cumsum(lengths)
    for text, end, length in zip(texts, ends, lengths, strict=True):
        assert ids[end - length : end].tolist() == ids_of(text), repr(text)


def fewest(items, capacity):
    """The optimum by search over all assignments."""
    best = [len(items)]

    def place(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(items):
            best[0] = len(rooms)
            return
        for n in range(len(rooms)):
            if rooms[n] >= items[at]:
                place(at + 1, [*rooms[:n], rooms[n] - items[at], *rooms[n + 1 :]])
        place(at + 1, [*rooms, capacity - items[at]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.randint(6, 20)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        left = np.bincount(items, minlength=capacity + 1)
        fixed = reduced(left)
        rest = list(np.repeat(np.arange(capacity + 1), left))
        assert sum(n for _, n in fixed) + fewest(rest[::-1], capacity) == fewest(items, capacity), items


def test_patterns_hold_every_piece():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.randint(3, 60)
        histogram = np.array([0] + [rng.choice([0, 0, 1, 5, 1000]) for _ in range(capacity)])
        patterns = pack_counts(histogram)
        got = np.zeros_like(histogram)
        for lengths, count in patterns:
            assert sum(lengths) <= capacity and count > 0
            np.add.at(got, list(lengths), count)
        assert (got == histogram).all()
        total = (histogram * np.arange(capacity + 1)).sum()
        least = max(total / capacity, histogram[capacity // 2 + 1 :].sum())  # no two of the larger ones fit together
        assert sum(n for _, n in patterns) <= 1.25 * least + 2


def test_packed_documents(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(200)]
    rows = [(n, " ".join(rng.choices(words, k=rng.randint(0, 30))), "s") for n in range(80)]
    rows += [(None, None, "s"), (90, "", None), (91, "x y", "s"), (91, "x y", "s"), (92, "long word " * 3000, "s")]
    df = spark.createDataFrame(rows, "length long, text string, part string")
    got = packed(df, "length", "text", PATH, capacity=64, with_ids=True).collect()
    want = sorted(
        (str(n), at, at * 64, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        for n, text, _ in rows
        for at, part in enumerate(list(itertools.batched(ids_of(text), 64)))
    )
    assert sorted((str(r.doc), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.05 * sum(w[3] for w in want) / 64 + 1
    assert packed(df.limit(0), "length", "text", PATH).count() == 0
