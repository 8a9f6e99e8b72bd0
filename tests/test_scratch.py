from pathlib import Path

from veriscope import scratch


def place(df):
    return Path(df.inputFiles()[0].split("file://")[-1].replace("//", "/")).parent


def test_tables_live_until_released(spark):
    a, b, c = (scratch.table(spark.range(i + 3), "x") for i in range(3))
    assert a.count() == 3 and all(place(t).exists() for t in (a, b, c))
    scratch.drop(b)
    assert not place(b).exists()
    scratch.release(keep=c)
    assert not place(a).exists() and c.count() == 5
    start = scratch.mark()
    d = scratch.table(spark.range(2))
    scratch.release(since=start)
    assert not place(d).exists() and place(c).exists()
    scratch.release()
    assert not place(c).exists()


def test_schema_and_rows_stay(spark):
    df = spark.sql("select 1 as a, array(struct('x' as b, cast(null as double) as c)) as d, cast(null as string) as e")
    back = scratch.table(df)
    assert back.dtypes == df.dtypes and back.collect() == df.collect()
    assert scratch.table(df.limit(0)).count() == 0


def test_a_cluster_has_to_name_its_folder():
    import pytest

    class Cluster:
        master = "spark://head:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        scratch.folder(Session)
    Cluster.master = "local[2, 4]"
    assert scratch.folder(Session).startswith("file://")


def test_no_shuffle_files_stay(spark):
    """What a table shuffled is deleted once it is written, not when the driver collects its garbage."""
    import time

    from pyspark.sql import functions as F

    own = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    jvm = spark.sparkContext._jvm

    def files() -> set[str]:
        found = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    before, conf = files(), spark.conf.get(own, None)
    table = scratch.table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    wait = time.time() + 10
    while files() - before and time.time() < wait:
        time.sleep(0.2)
    assert not files() - before
    assert table.count() == 7 and spark.conf.get(own, None) == conf
    scratch.drop(table)
