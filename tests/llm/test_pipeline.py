"""Every stage of the pipeline on its own input, against brute force."""

import itertools
import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_quality import brute_counts
from tests.llm.test_simhash import brute_fingerprint, brute_groups, signed

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1][1], FOLDER).write.parquet(path)
        out.append((name, spark.read.parquet(path)))
    return {name: (df.columns, [tuple(r) for r in df.collect()]) for name, df in out}


def test_columns_and_order(results):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "quality_rules", "line_dedup", "simhash_near_dedup", "best_fit_packing",
    ]
    for name in list(results)[:-1]:
        assert results[name][0] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_filters_keep_clean_documents(spark, results):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for before, after in itertools.pairwise(["documents", "quality_classifier", "quality_rules"]):
        old, new = results[before][1], results[after][1]
        assert set(new) <= set(old)
        kept = {r[0] for r in new}
        clean = [r[0] for r in old if labels.get(r[0]) == (1, 0) and brute_counts(r[1])[0] >= 50]
        assert sum(d in kept for d in clean) >= 0.95 * len(clean)
        assert not any(brute_counts(r[1])[0] < 50 for r in results["quality_rules"][1])


def test_line_dedup(results):
    old, new = results["quality_rules"][1], results["line_dedup"][1]
    want = brute_lines([(r[0], r[1]) for r in old], 50)
    assert {r[0]: r[1] for r in new} == {doc[0]: text for doc, text in want.items()}
    assert all(r[4] == len(r[1]) for r in new)


def test_near_dedup(results):
    old, new = results["line_dedup"][1], results["simhash_near_dedup"][1]
    prints = {r[0]: signed(brute_fingerprint(r[1])) for r in old}
    groups = brute_groups(sorted(set(prints.values())))
    first = {}
    for doc in sorted(prints):
        first.setdefault(groups[prints[doc]], doc)
    assert sorted(r[0] for r in new) == sorted(first.values())
    assert set(new) <= set(old)


def test_packing(results):
    columns, pieces = results["best_fit_packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r[0]: len(library.encode(r[1], add_special_tokens=False).ids) + 1 for r in results["simhash_near_dedup"][1]}
    got, used = dict.fromkeys(want, 0), {}
    for piece in (dict(zip(columns, p, strict=True)) for p in pieces):
        got[piece["doc_id"]] += piece["length"]
        used.setdefault(piece["sequence_id"], []).append((piece["offset"], piece["length"]))
    assert got == want
    for spans in used.values():
        ends = list(itertools.accumulate(length for _, length in sorted(spans)))
        assert [offset for offset, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_stages_take_nulls_repeated_rows_and_empty_tables(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    text = " ".join(f"word{n}" for n in range(80))
    rows = [(None, None, None, None, None), (1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, "", None, "s", 0), (None, text, "en", None, 1)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), FOLDER).count() == 0
        assert stage(spark, spark.createDataFrame(rows, schema), FOLDER).count() >= 0


def test_filters_judge_rows_and_not_ids(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    by_both = corpus_pipeline.ruled(spark, corpus_pipeline.classified(spark, docs, FOLDER), FOLDER)
    clean = [r.text for r in by_both.orderBy("doc_id").limit(2).collect()]
    good = [(None, clean[0], "en", "s", 1), (1, clean[0], "en", "s", 9), (1, clean[0], "en", "s", 9), (1, clean[1], None, None, None)]
    rejected = [(None, None, None, None, None), (None, "", "en", "s", 0), (1, "", "en", "s", 0)]
    rows = spark.createDataFrame(good + rejected, docs.schema)
    order = lambda found: sorted(map(tuple, found), key=repr)
    assert order(corpus_pipeline.ruled(spark, rows, FOLDER).collect()) == order(good)
    assert order(corpus_pipeline.classified(spark, rows, FOLDER).where("text <> ''").collect()) == order(good)
    toxic = spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 1 OR quality = 0").join(docs, "doc_id")
    out = toxic.join(corpus_pipeline.classified(spark, docs, FOLDER), "doc_id", "left_anti").select("text").first().text
    rows = spark.createDataFrame([*good, (None, out, "en", "s", 1), (1, out, "en", "s", 1)], docs.schema)
    assert order(corpus_pipeline.classified(spark, rows, FOLDER).collect()) == order(good)
