"""The transitions of a stream over several micro-batches against those of the whole table."""

import time
from collections import Counter

from netspark.operators import sequences
from netspark.streaming.transitions import stream_transitions


def test_stream_equals_the_table(spark, tmp_path):
    rows = [(c, t, "abc"[(c * t + t // 2) % 3]) for c in range(5) for t in range(1, 9)]
    schema = "case int, t int, state string"
    for part in range(2):  # the first half of every case, then the other, in no order
        some = [r for r in rows if (r[1] > 4) == bool(part)][::-1]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream_transitions(events).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    until = time.time() + 60
    while time.time() < until and spark.table("moves").count() < 35:  # a timeout by the clock keeps such a query going
        time.sleep(0.5)
    run.stop()
    found = Counter((r.src, r.dst) for r in spark.table("moves").collect())
    wanted = Counter((r.src, r.dst) for r in sequences.steps(spark.createDataFrame(rows, schema)).collect())
    assert found == wanted and sum(found.values()) == 35
