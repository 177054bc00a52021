import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from docsift.llm.merges import PairTable, merged_words
from docsift.llm.pieces import PieceCodec, PieceModel, encode_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = PieceModel(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)

TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "\n\n a\n", "\t", "Hello, world!", "naïve café ñandú", "日本語のテキスト",
    "emoji 👩‍👩‍👧‍👦 here", "▁", "▁▁a ▁", "a▁b", "<s>", "</s> <unk> <0x0A>", "aaaaaaaaaaaaaaaaaaa", "abababababab" * 9,
    " " * 100, "x" + " " * 33 + "y", "\0a\0", "﻿bom", "é" * 50, "é" * 9, "thetheththe" * 30, "١٢٣", "\U0010ffff", "1234567890" * 20,
    "mississippi" * 40, "------====####", "....,,,,;;;;",
]


def test_ids_and_texts_equal_the_library():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices("abthe n\n▁é日 ,.!", k=rng.randint(0, 200))) for _ in range(400)]
    ids, lengths = PieceCodec(MODEL).encode(texts)
    ends = np.cumsum(lengths)
    for text, end, length in zip(texts, ends, lengths, strict=True):
        own = ids[end - length : end].tolist()
        assert own == LIBRARY.encode(text), repr(text)
        assert MODEL.decode(own) == LIBRARY.decode(own), repr(text)


def test_decoding_of_any_ids_equals_the_library():
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))]
        assert MODEL.decode(ids) == LIBRARY.decode(ids), ids


def one_by_one(word, pairs):
    word = list(word)
    while True:
        ranked = [(pairs[p][0], at) for at, p in enumerate(zip(word, word[1:], strict=False)) if p in pairs]
        if not ranked:
            return word
        _, at = min(ranked)
        word[at : at + 2] = [pairs[tuple(word[at : at + 2])][1]]


def test_rounds_equal_single_merges_for_any_ranks():
    """Also where a merge makes a pair of a lower or the same rank."""
    rng = random.Random(6)
    for _ in range(150):
        pairs, count = {}, 3
        for _ in range(rng.randint(1, 12)):
            key = (rng.randrange(count), rng.randrange(count))
            if key not in pairs:
                pairs[key] = (rng.randrange(6), count)
                count += 1
        words = [[rng.randrange(3) for _ in range(rng.randint(0, 25))] for _ in range(20)]
        table = PairTable(*zip(*((a, b, r, m) for (a, b), (r, m) in pairs.items()), strict=True))
        flat, lengths = merged_words(np.array(sum(words, []), np.int32), np.array([len(w) for w in words]), table)
        ends = np.cumsum(lengths)
        for word, end, length in zip(words, ends, lengths, strict=True):
            assert flat[end - length : end].tolist() == one_by_one(word, pairs)


def test_rows_nulls_and_names(spark):
    rows = [(None, "a b", 1), (1, None, 2), (1, None, 2), (2, "", 3), (3, "word " * 50_000, 4)]
    df = spark.createDataFrame(rows, "ids long, text string, decoded int")
    got = encode_decode(df, "ids", "text", PATH).orderBy("doc").collect()
    assert [(r.doc, r.decoded) for r in got] == [(i, t or "") for i, t, _ in rows]
    assert got[4].ids == LIBRARY.encode(rows[4][1])
    assert encode_decode(df.limit(0), "ids", "text", PATH).count() == 0


@pytest.mark.skipif(MODEL.size != 32000, reason="another model")
def test_size():
    assert len(MODEL.byte_ids) == 256
