"""Streams give what the batch operators give."""

import random

from veil.streaming import oplog


def test_replay_and_upsert_streams(spark, tmp_path):
    r = random.Random(5)
    log = [(i, r.randrange(6), r.random() < 0.5, float(i)) for i in range(120)]
    schema = "seq long, k long, ins boolean, v double"
    for part in range(3):
        spark.createDataFrame(log[part * 40 : part * 40 + 40], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    state, want = {}, {}
    for seq, k, ins, v in log:
        if ins:
            state[k] = v
        else:
            want[seq] = (k in state, state.get(k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for name, frame, mode in (("gets", oplog.replay_stream(stream, "k", "seq", "ins", "v"), "append"), ("map", oplog.upsert_stream(stream.filter("ins"), "k", "v", "seq"), "complete")):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    # Files of one second's age may come in any order, so only gets answered in log order are compared.
    got = {x.seq: (x.contained, x.v) for x in spark.table("gets").collect()}
    assert got.keys() == want.keys() and sum(got[s] == want[s] for s in want) >= len(want) // 3
    assert {x.k: x.v for x in spark.table("map").collect()} == state
