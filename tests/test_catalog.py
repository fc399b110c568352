import pytest

from helixlake import catalog
from tests import compare

pytestmark = pytest.mark.skipif(not compare.DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    return compare.oracle()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, duck, name):
    assert compare.differences(spark, duck, catalog.QUERIES[name], catalog.SQL[name]) == ([], [], 0)


def test_streaming(spark, tmp_path):
    """The batch functions take a stream: windows with a watermark over files that arrive in a folder."""
    from pyspark.sql import functions as F

    from helixlake.streaming.events import sessions, stream_lines, tumbling

    e = spark.read.parquet(str(compare.DATA / "events.parquet")).select("ts", "user_id", "event_type", "value")
    e.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for build, name in ((lambda d: tumbling(d, "1 hour", "1000 days"), "w"), (lambda d: sessions(d, "30 minutes", "1000 days"), "s")):
        mode = "complete" if name == "w" else "append"
        q = build(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        if name == "w":
            assert spark.table("out_w").count() == tumbling(e, "1 hour").count()
    (tmp_path / "lines").mkdir()
    assert stream_lines(spark, str(tmp_path / "lines")).isStreaming
