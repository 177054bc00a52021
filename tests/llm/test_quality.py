import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm import quality_classifier as qc, quality_rules as qr


def brute_counts(text):
    spaces = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in (text or "") + " ":
        if c in spaces:
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if any(c not in spaces for c in line)]
    dup = sum(line in lines[:at] for at, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_counts_match_brute_force():
    rng = random.Random(1)
    texts = [None, "", " ", "a", "a b c", "a a a a", "a b c a b c", "x\x1cy z w", "# * $\n#\n\n#", "a b\x0bc\x0cd\re"]
    texts += ["".join(rng.choices("abé #\n\t|", k=rng.randint(0, 60))) for _ in range(300)]
    for text in texts:
        assert qr.text_counts(text)[:5] == brute_counts(text), repr(text)


def walk(trees, x, root):
    node = root
    while trees.left[node] != node:
        node = trees.left[node] if x[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
    return trees.value[node]


def test_trees_learn_stay_monotonic_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * np.sin(9 * x[:, 2]) + 0.2 * rng.standard_normal(3000) > 0).astype(float)
    trees = qr.fit_trees(x[:2000], y[:2000], [1, -1, 0])
    assert ((trees.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.85
    slow = [trees.base + sum(walk(trees, row, r) for r in trees.roots) for row in x[:50]]
    assert np.allclose(slow, trees.margin(x[:50]))
    grid = np.linspace(0, 1, 200)
    for row in x[:20]:
        for feature, sign in ((0, 1), (1, -1)):
            moved = np.tile(row, (200, 1))
            moved[:, feature] = grid
            assert (sign * np.diff(trees.margin(moved)) >= -1e-9).all()


CLEAN = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def corpus(rng, n):
    rows = []
    for doc in range(n):
        words = rng.choices(CLEAN, k=rng.randint(60, 200))
        kind = doc % 4
        if kind == 1:
            words = [w + rng.choice(["***", "$$$", "###"]) for w in words]
        if kind == 2:
            words[rng.randrange(len(words))] = rng.choice(["idiot,", "scum", "Scum."])
        rows.append((doc, " ".join(words), int(kind != 1), int(kind == 2)))
    return rows


def test_rules_on_held_out_documents(spark):
    rows = corpus(random.Random(2), 400) + [(400, None, 1, 0), (401, "few words", 1, 0), (402, "a b c " * 100, 1, 0), (None, "x", None, None)]
    df = spark.createDataFrame(rows, "doc long, text string, quality int, kept int")
    trees = qr.fit_rules(df.where("doc < 200"), "doc", "text", df.where("doc < 200"))
    got = {r.doc: r for r in qr.judged(df, "doc", "text", trees).collect()}
    assert len(got) == 404
    right = [got[doc].kept == (quality == 1) for doc, _, quality, _ in rows[200:400]]
    assert np.mean(right) > 0.98
    for doc, text, _, _ in rows:
        want = brute_counts(text)
        assert (got[doc].n_words, got[doc].word_chars, got[doc].n_symbols, got[doc].n_dup_lines, got[doc].n_repeat_words) == want
        assert got[doc].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert not any(got[d].kept for d in (400, 401, 402, None))


def test_rules_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc long, text string, quality int")
    trees = qr.fit_rules(empty, "doc", "text", empty)
    assert qr.judged(empty, "doc", "text", trees).count() == 0
    one = spark.createDataFrame([(1, " ".join(CLEAN))], "doc long, text string")
    assert qr.judged(one, "doc", "text", trees).collect()[0].score == 0.5


def test_classifier_on_held_out_documents(spark):
    rows = corpus(random.Random(3), 1600) + [(None, None, None, None), (1601, "", 1, 0), (1602, " \n", None, 0)]
    df = spark.createDataFrame(rows, "doc long, text string, quality int, toxic int")
    grades = df.select("doc", qc.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    model = qc.fit_classifier(df.where("doc < 800"), "doc", "text", grades)
    got = {r.doc: r for r in qc.graded(df, "doc", "text", model).collect()}
    assert len(got) == 1603
    right = [got[doc].kept == (q == 1 and t == 0) for doc, _, q, t in rows[800:1600]]
    assert np.mean(right) > 0.97
    means = [np.mean([got[d].expected_grade for d, _, q, t in rows[800:1600] if (q == 0, t) == k]) for k in ((True, 0), (False, 1), (False, 0))]
    assert means == sorted(means)
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got.values())


def test_classifier_sample_bound_and_empty(spark):
    df = spark.createDataFrame(corpus(random.Random(4), 400), "doc long, text string, quality int, toxic int")
    grades = df.select("doc", qc.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    assert qc.bounded_sample(grades, ["doc"], 100).count() < 150
    empty = df.limit(0)
    model = qc.fit_classifier(empty, "doc", "text", grades.limit(0))
    assert qc.graded(empty, "doc", "text", model).count() == 0
    assert 0 < qc.graded(df.limit(1), "doc", "text", model).collect()[0].tail_probability < 1


@pytest.mark.parametrize("count", [2, 4])
def test_thresholds_are_ordered(count):
    rng = np.random.default_rng(1)
    grades = rng.integers(0, count, 300)
    rows = [np.array([g, 10 + rng.integers(5)], np.int32) for g in grades]
    model = qc.fit_ordinal(rows, grades, count, bits=6, l1=0.1)
    assert (np.diff(model.thresholds) > 0).all()
    best = model.at_most(model.scores(np.arange(count), np.ones(count, int)))
    assert (np.diff((1 - best).sum(axis=1)) > 0).all()


def test_gradient_is_that_of_the_likelihood():
    theta, s, step = np.array([-1.0, 0.5, 2.0]), 0.7, 1e-6

    def loss(s, y):
        below = np.concatenate([[0.0], 1 / (1 + np.exp(s - theta)), [1.0]])
        return -np.log(below[y + 1] - below[y])

    for y in range(4):
        below = np.concatenate([[0.0], 1 / (1 + np.exp(s - theta)), [1.0]])
        assert abs((loss(s + step, y) - loss(s - step, y)) / (2 * step) - (1 - below[y] - below[y + 1])) < 1e-6
