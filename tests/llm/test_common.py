import time
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinlog.llm import common


def test_no_shared_folder_on_a_cluster():
    """Without spark.checkpoint.dir a cluster is an error: a folder of the driver's machine is not shared."""
    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    spark = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(spark)


def test_pieces():
    texts = ["x" * n for n in (3, 3, 50, 1, 1, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts, pa.string())], names=["i", "t"])
    got = [b.column(0).to_pylist() for b in common.pieces(iter([batch, batch.slice(0, 0)]), rows=4, size=10)]
    assert got == [[0, 1], [2], [3, 4, 5, 6], [7, 8]]


def test_stored_tables(spark):
    df = common.store(spark.range(10))
    files = df.inputFiles()
    assert files and df.count() == 10
    common.drop_stored(df)
    with pytest.raises(Exception):
        spark.read.parquet(files[0]).count()


@pytest.mark.parametrize("bits", [6, 10, 24])
def test_mask_misses_no_key(spark, bits):
    rows, keys = spark.range(1000).withColumn("flag", F.lit("x")), spark.range(0, 1000, 50)
    got = common.flag_likely(rows, F.xxhash64("id"), keys, F.xxhash64("id"), "likely", bits).collect()
    assert len(got) == 1000 and all(r["likely"] for r in got if r["id"] % 50 == 0)
    assert bits < 24 or sum(r["likely"] for r in got) == 20
    none = common.flag_likely(rows, F.xxhash64("id"), keys.limit(0), F.xxhash64("id"), "likely", bits)
    assert none.filter("likely").count() == 0


def test_shuffles_of_a_stored_table_go_at_once(spark):
    def shuffled():
        return sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))

    before, setting = shuffled(), spark.conf.get(common.CLEANUP)
    out = common.store(spark.range(10_000).repartition(4, "id"))
    deadline = time.time() + 20
    while shuffled() > before and time.time() < deadline:
        time.sleep(0.1)
    assert shuffled() <= before and out.count() == 10_000 and spark.conf.get(common.CLEANUP) == setting
