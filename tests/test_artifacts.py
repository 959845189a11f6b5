import pytest
from pyspark.sql import functions as F

from marlstone.sources.artifacts import ArtifactStore


def objects(spark, n, version=1):
    return spark.range(n).select(F.concat((F.col("id") % 10).cast("string"), F.lit("/run"), (F.col("id") % 100).cast("string"), F.lit("/errors"), F.col("id").cast("string"), F.lit(".csv")).alias("key"), F.encode(F.concat(F.lit(f"v{version}-"), F.col("id").cast("string")), "UTF-8").alias("content"))


def test_ten_thousand_objects(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path / "store"))
    assert store.listed().count() == 0 and store.delete("x") == {"objects": 0, "bytes": 0, "missing": 0}
    assert store.put(objects(spark, 10_000))["objects"] == 10_000
    assert store.listed("3/").count() == 1000 and store.listed("3/run13/").count() == 100
    done = store.delete("3/run1")
    assert done["objects"] == 100 and done["missing"] == 0
    assert not list((tmp_path / "store/objects/3/run13").glob("*.csv")) and len(list((tmp_path / "store/objects/3/run23").glob("*.csv"))) == 100
    assert store.listed("3/").count() == 900 and store.listed().count() == 9900
    store.put(objects(spark, 10, 2))
    again = {r.key: bytes(r.content) for r in store.read("7/run7/errors7.").collect()}
    assert again == {"7/run7/errors7.csv": b"v2-7"} and store.listed().count() == 9900 + 0


def test_a_deletion_that_breaks_off_is_repeated(spark, tmp_path, monkeypatch):
    store = ArtifactStore(spark, str(tmp_path / "store"))
    store.put(objects(spark, 200))
    monkeypatch.setattr(store.table, "_publish", lambda m: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.delete("4/")
    store = ArtifactStore(spark, str(tmp_path / "store"))
    assert store.listed("4/").count() == 20
    assert store.delete("4/") == {"objects": 20, "bytes": store_bytes(4), "missing": 20}
    assert store.listed().count() == 180 and store.delete("4/")["objects"] == 0


def store_bytes(digit):
    return sum(len(f"v1-{i}") for i in range(200) if i % 10 == digit)
