"""Very many equal rows, repeated doc_ids, extreme vectors; executors that lack the package."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from driftloom.llm import line_dedup, substring_dedup, vector_dedup

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_marks_of_equal_rows_are_bounded(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, 1).alias("doc_id"), F.lit(text).alias("text")).union(spark.createDataFrame([(2, "clean " * 3)], "doc_id int, text string"))
    got = substring_dedup.substring_dedup(rows).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == [("1", 200, 200, 5000), ("2", 3, 0, 1), ("None", 200, 200, 5000)]


@pytest.mark.parametrize("docs,gone", [([1] * 5 + [2], 0), ([1, 1, 2, 3, 4, 5], 5), ([None] * 9 + [1, 2, 3], 0), ([None] * 2 + [1, 2, 3, 4], 5)])
def test_lines_count_documents_not_rows(spark, docs, gone):
    line = "the very same line of more than forty characters"
    df = spark.createDataFrame([(d, f"{line}\nown {i}") for i, d in enumerate(docs)], "doc_id long, text string")
    for index_bytes in (line_dedup.INDEX_BYTES, -1):
        assert sum(r["n_dropped"] for r in line_dedup.dedup_lines(df, index_bytes=index_bytes).collect()) == gone


def test_vectors_of_any_size(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 1e-210]), (3, [1e200, 0.0]), (4, [3e200, 1e190]), (5, [5e-324, 0.0]), (6, [1.0, 1e-300]), (7, [0.0, 1e300]), (8, [1e-320, 1e-310]), (9, [0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (5, 1) for i in range(1, 7)}, 7: (1, 7), 8: (1, 7), 9: (0, 9)}


#: Runs every query from a folder without the package, which the driver alone can import.
AWAY = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__
found = __spark_entry__.queries()
missing = spark.range(1).rdd.map(lambda _: __import__("importlib.util").util.find_spec("driftloom") is None).first()
assert missing, "the workers have the package"
for name in sys.argv[4:] or found:
    try:
        found[name](spark, sys.argv[3]).write.format("noop").mode("overwrite").save()
    except Exception as e:
        print("FAILED", name, next((x for x in str(e).splitlines() if "Error" in x), str(e)[:200]))
print("DONE")
"""


@pytest.mark.parametrize("names", [["op2_ngram_jaccard_join", "op8_substring_dedup", "op11_exact_top_k", "op12_conversation_repair", "op13_embedding_whitening", "pipeline", "rewrite_html"]])
def test_executors_without_the_package(tmp_path, names):
    (tmp_path / "shared").mkdir()
    (tmp_path / "away").mkdir()
    (tmp_path / "run.py").write_text(AWAY)
    paths = ":".join(p for p in os.environ.get("PYTHONPATH", "").split(":") if p and os.path.abspath(p) != ROOT)
    env = {**os.environ, "PYTHONPATH": paths, "PYSPARK_PYTHON": sys.executable, "PYTHONSAFEPATH": "1"}
    done = subprocess.run([sys.executable, str(tmp_path / "run.py"), ROOT, str(tmp_path / "shared"), "/root/testdata/sf0.001", *names], cwd=tmp_path / "away", env=env, capture_output=True, text=True, timeout=900)
    said = [x for x in done.stdout.splitlines() if x.startswith(("FAILED", "DONE"))]
    assert said == ["DONE"], (said, done.stderr[-2000:])
