"""What the fits bring to the driver, and workers without the package."""

import os
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F

from docsift.llm import quality_classifier, quality_rules
from docsift.llm.common import one_text_each

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_a_hot_id_is_one_row_of_the_sample(spark):
    docs = spark.range(10_000).select(
        F.when(F.col("id") < 9_000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")
    )
    labels = spark.createDataFrame([(7, 1), (7, 1), (7, 0), (9_500, 0), (None, 1), (3, None)], "doc_id long, quality long")
    sample = labels.dropna().distinct().withColumnsRenamed({"doc_id": "key", "quality": "label"})
    assert one_text_each(docs, "doc_id", "text", sample).count() == 3
    trees = quality_rules.fit_rules(docs, "doc_id", "text", labels, sample_rows=10)
    assert quality_rules.judged(docs, "doc_id", "text", trees).count() == 10_000


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "good words here", "x", 5), (1, "good words here", "x", 5), (1, None, None, 5), (2, "", "y", 5), (None, "bad", "z", 5)]
    docs = spark.createDataFrame(rows, "grade long, text string, doc string, kept int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (None, 1, 1)], "grade long, quality int, toxic int")
    graded = labels.select(F.col("grade").alias("id"), quality_classifier.grade_of(F.col("quality"), F.col("toxic")).alias("g"))
    model = quality_classifier.fit_classifier(docs.withColumnRenamed("grade", "id"), "id", "text", graded, "g")
    found = quality_classifier.graded(docs, "grade", "text", model)
    assert found.count() == 5 and found.columns == ["doc", "expected_grade", "tail_probability", "kept"]
    assert len({r.expected_grade for r in found.where("doc = 1").collect()}) == 2


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import public_tokenizers
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert not spark.range(1).mapInPandas(lambda ts: (t.assign(id=int(__import__("importlib.util").util.find_spec("docsift") is not None)) for t in ts), "id long").head()[0]
import __spark_entry__ as entry
for name in ("op2_sentencepiece", "op3_quality_rules", "op4_quality_classifier", "op5_packing", "op10_url_filter", "op11_collocations", "op13_ranked_search"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all done")
"""


def test_workers_need_no_package():
    with tempfile.TemporaryDirectory() as folder:
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run(
            [sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=folder, env=env, capture_output=True, text=True, timeout=600, check=False
        )
    assert "all done" in done.stdout, done.stderr[-3000:]
