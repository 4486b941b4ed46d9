"""Due times from a table and from a stream: the same rows, with late readings in their places."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skein.streaming import polling

SCHEMA = "source string, ts timestamp, hours int"
T0 = datetime(2024, 1, 1)


def plain(rows, until):
    out = []
    for s in {r[0] for r in rows if r[0]}:
        own = sorted((t, h) for x, t, h in rows if x == s and t is not None and h and t <= until)
        for i, (t, h) in enumerate(own):
            due = t + timedelta(hours=h)
            if due <= until and (i + 1 == len(own) or own[i + 1][0] > due):
                out.append((s, t, due))
    return sorted(out)


def readings(n, seed=1):
    rng = random.Random(seed)
    return [(f"s{rng.randint(0, 5)}", T0 + timedelta(minutes=30 * rng.randint(0, 400)), rng.choice([1, 5, 24])) for _ in range(n)]


def test_a_table_equals_a_plain_version(spark):
    rows = readings(300) + [(None, T0, 1), ("s0", None, 1), ("s0", T0, None), ("s9", T0, 0), ("t", T0, 2), ("t", T0 + timedelta(hours=2), 2), ("t", T0, 2), ("t", T0, 1)]
    until = T0 + timedelta(hours=150)
    got = sorted(map(tuple, polling.due_times(spark.createDataFrame(rows, SCHEMA), F.lit(until)).collect()))
    assert got == plain(rows, until) and ("t", T0, T0 + timedelta(hours=2)) not in got
    assert polling.due_times(spark.createDataFrame([], SCHEMA), F.lit(until)).count() == 0


def test_a_stream_gives_the_same_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted(readings(200, seed=3), key=lambda r: r[1] + timedelta(hours=rng.uniform(0, 9)))  # up to nine hours late
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for i in range(0, 200, 40):
        spark.createDataFrame(rows[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("flush", T0 + timedelta(hours=400), 1)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        q = polling.due_stream(stream, "10 hours").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = sorted(map(tuple, spark.read.schema(polling.ROWS).parquet(out).collect()))
    assert got == plain(rows, T0 + timedelta(hours=390)) and len(got) > 20
