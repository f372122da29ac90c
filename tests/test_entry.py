"""The driver contract where the session was not made by plain Python: spark-submit, workers elsewhere."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark
from pyspark.ml.feature import StopWordsRemover

import corpus_pipeline
from sparkfeat import queries_more

REPO = Path(__file__).resolve().parent.parent
LIB = Path(pyspark.__file__).resolve().parent / "python" / "lib"


def run(code: str, cwd: Path, **env: str) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | env
    done = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(REPO)!r})\n{code}"], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert not done.returncode, done.stderr[-3000:]
    return done.stdout


def test_queries_are_found_with_spark_submits_zipped_library(tmp_path):
    path = os.pathsep.join(map(str, [LIB / "pyspark.zip", next(LIB.glob("py4j-*.zip"))]))
    said = run("import pyspark, __spark_entry__ as e\nprint('pyspark.zip' in pyspark.__file__, 'pipeline' in e.queries(), 'txt_tfidf' in e.oracle_sql())", tmp_path, PYTHONPATH=path)
    assert said.split() == ["True"] * 3


def test_stop_words_of_the_sql_are_the_librarys(spark):
    assert queries_more._STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_workers_need_not_have_the_package_on_their_path(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = corpus_pipeline.STAGES[0][1](spark, docs, "/root/testdata/sf0.001").count()
    said = run(
        f"""from pyspark.sql import SparkSession
import corpus_pipeline
conf = {{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {str(tmp_path / "shared")!r}}}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
name, stage = corpus_pipeline.STAGES[0]
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
print(name, docs.count(), stage(spark, docs, "/root/testdata/sf0.001").count())""",
        tmp_path,
    )
    assert said.split() == ["toxicity", str(docs.count()), str(want)]
