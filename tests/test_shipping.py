"""Python functions on workers that have no package: the driver knows where it is, the workers don't."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider").getOrCreate()
from marlstone.functions import scalar, text, vector
from marlstone.operators import jobs, pacing
from marlstone.sources import polling
from marlstone.streaming import delivery, index

def absent(x):
    import importlib.util
    import pandas as pd
    return pd.Series([importlib.util.find_spec("marlstone") is None] * len(x))

one = spark.range(1)
assert one.select(F.pandas_udf(absent, "boolean")("id")).first()[0], "the workers have the package"
docs = spark.createDataFrame([(1, "The roof leaked. Dr. Smith was great! They fixed it fast.", None, False)], "id bigint, text string, rating int, hidden boolean")
assert docs.select(text.lexemes("text").alias("v")).first().v["roof"] == [2]
assert text.chunked(docs).count() > 2
assert docs.select(text.lexicon_sentiment("text").alias("s")).first().s is not None
assert len(docs.select(vector.hashed_embedding(8)("text").alias("v")).first().v) == 8
rows = docs.select(F.lit(1).alias("query_id"), text.lexemes("text").alias("lexemes"))
assert text.match_columns(rows, "lexemes", {{1: ("roof", ["team"])}}).first().full_match
parts, judged = jobs.index_step(docs, spark.createDataFrame([(1,)], "review_id bigint"), 16)
assert all(len(r.embedding) == 16 for r in parts.collect()) and judged.count() == 1
events = spark.createDataFrame([(i, 1, 1000 + i) for i in range(9)], "event_id bigint, k bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
assert jobs.rate_limited(events, "k", 3).filter("allowed").count() == 3
polling.store_reviews(spark.createDataFrame([("a", "r", 1, 1, "FIVE", "x")], "location string, name string, update_ms bigint, create_ms bigint, stars string, comment string"), {folder!r} + "/store")
assert polling.pages(spark, {folder!r} + "/store").count() == 1
events.write.parquet({folder!r} + "/in")
def run(frame, n):
    q = frame.writeStream.format("memory").queryName(f"q{{n}}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(f"q{{n}}").count()
source = spark.readStream.schema(events.schema).parquet({folder!r} + "/in")
assert run(index.limited_stream(source, "k", 3), 1) == 9
assert run(pacing.penalty_stream(source.select("k", F.col("event_id").alias("ident"), "ts", F.lit(True).alias("failed")), 3), 2) == 9
sent = source.select(F.lit("r").alias("review_id"), F.col("event_id").cast("string").alias("message_id"), F.lit("sent").alias("kind"), F.lit(0).alias("attempt"), F.col("ts").alias("at"))
assert run(delivery.deliveries(sent), 3) == 9
print("all travelled")
"""


def test_functions_travel(tmp_path):
    repo = str(Path(__file__).parent.parent)
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=repo, folder=str(tmp_path / "shared")))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert "all travelled" in done.stdout, done.stderr[-3000:]
