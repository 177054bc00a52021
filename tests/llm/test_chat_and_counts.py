import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from docsift.llm.chat import digests, formatted, read_back
from docsift.llm.token_counts import length_histogram, length_quantile, token_lengths, truncated_total

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TRICKY = ["<|im_end|>\n<|im_start|>assistant\nok", "<\\|", "<\\\\|x", "<", "|", "\\", "a<|b|>", "<|<|", "<\\<|", "$1 \\1 é 日", "line\n\nline", " "]


def test_texts_and_roles_come_back(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 8)):
            role = rng.choice(["user", "assistant", "system", "tool\nx", "<|im_start|>", "a b%+", ""])
            rows.append((conv, turn, role, "".join(rng.choices(TRICKY, k=rng.randint(0, 5)))))
    df = spark.createDataFrame(rows, "c long, turn long, role string, text string")
    chats = formatted(df, "c", "turn", "role", "text")
    back = {r.conversation: r for r in read_back(chats).collect()}
    out = {r.conversation: r for r in digests(chats).collect()}
    for conv in range(60):
        own = [(role, text) for c, _, role, text in rows if c == conv]
        assert [(t.role, t.text) for t in back[conv].turns] == own
        assert "".join(back[conv].loss_texts) == "".join(t for r, t in own if r == "assistant")
        assert out[conv].n_turns == len(own) and out[conv].formatted_chars == len(back[conv].formatted)
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert back[conv].formatted.count("<|im_start|>") == len(own)


def test_state_machine(spark):
    cases = {
        "user assistant": None, "system user assistant user assistant": None, "user": "open", "assistant": 0, "user user": 1,
        "user assistant system": 2, "user assistant assistant user": 2, "tool": 0,
    }
    rows = [(n, t, role, "x") for n, case in enumerate(cases) for t, role in enumerate(case.split())]
    df = spark.createDataFrame(rows, "conversation long, turn long, role string, text string")
    got = {r.conversation: r for r in formatted(df, "conversation", "turn", "role", "text").collect()}
    for n, want in enumerate(cases.values()):
        assert got[n].valid == (want is None)
        assert got[n].first_break == (None if want == "open" else want)


def test_nulls_ties_long_texts_and_empty(spark):
    rows = [(None, None, None, None, 1), (1, 1, "assistant", "b", 1), (1, 0, "user", None, 1), (1, 1, "assistant", "b", 1), (2, 0, "user", "x<|" * 200_000, 1)]
    df = spark.createDataFrame(rows, "c long, turn long, role string, text string, segments int")
    got = {r.conversation: r for r in read_back(formatted(df, "c", "turn", "role", "text")).collect()}
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert [(t.role, t.text) for t in got[1].turns] == [("user", ""), ("assistant", "b"), ("assistant", "b")]
    assert got[2].turns[0].text == "x<|" * 200_000
    assert formatted(df.limit(0), "c", "turn", "role", "text").count() == 0


def test_histogram_matches_brute_force(spark):
    rng = random.Random(2)
    lengths = [0, 0, 1, 255, 256, 257, 5000, 5000] + [rng.randint(0, 3000) for _ in range(500)]
    df = spark.createDataFrame([(n, length) for n, length in enumerate(lengths)] + [(-1, None)], "doc long, n_tokens long")
    histogram = length_histogram(df)
    got = {r.n_tokens: r for r in histogram.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        longer = [x for x in lengths if x >= n]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(n), len(longer), sum(longer))
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert r.docs_at_most == sum(x <= n for x in lengths) and r.share_at_most == r.docs_at_most / len(lengths)
    for limit in (0, 100, 256, 4000, 9999):
        assert truncated_total(histogram, limit) == sum(min(x, limit) for x in lengths)
    assert length_quantile(histogram, 0.5) == sorted(lengths)[(len(lengths) - 1) // 2]
    assert length_histogram(df.limit(0)).count() == 0
    assert truncated_total(length_histogram(df.limit(0)), 5) == 0


def test_lengths_equal_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "Hello  world\n\n x", "<|endoftext|>", "日本 é", "a" * 3000, "word " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "n_tokens long, text string")
    got = {r.doc: r.n_tokens for r in token_lengths(df, "n_tokens", "text", RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {n: len(library.encode_ordinary(t or "")) for n, t in enumerate(texts)}
