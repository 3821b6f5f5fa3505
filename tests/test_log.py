"""The append log: as a file of lines, as a table, and as a stream."""

from pyspark.sql import functions as F

from foliant import engine
from foliant.streaming import checkpoint as K


def test_lines_of_a_file(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"chunk_id": "ch0-1", "result": {"a": 1}}\n\n{"chunk_id": "ch0-1", "result": {"a": 2}}\n{"chunk_id": "syn:0", "result": {"b": 1}}\n{"chunk_id": "x", "resu')
    log = K.read_log(spark, str(tmp_path / "log.jsonl"))
    got = K.last_writes(log, ["key"], "seq", "result").collect()
    assert sorted((r.key, r.result) for r in got) == [("ch0-1", '{"a":2}'), ("syn:0", '{"b":1}')]


def test_growing_folder(spark, tmp_path):
    folder = str(tmp_path / "log")
    for seq, value in enumerate(("old", "new")):
        K.append(spark.createDataFrame([("k", seq, value), (f"only{seq}", seq, value)], "key string, seq int, result string"), folder)
    stream = K.stream_last_writes(spark, folder, "key string, seq int, result string", ["key"], "seq", "result")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("last").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.key, r.result) for r in spark.table("last").collect()) == [("k", "new"), ("only0", "old"), ("only1", "new")]


def test_log_is_cleared_unless_resumed(spark, tmp_path):
    path = f"{tmp_path}/log"
    row = spark.createDataFrame([(1, "f", "r")], "doc int, fingerprint string, result string")
    engine.Log(spark, path, False).append("condense", row)
    engine.Log(spark, path, True).append("condense", row.withColumn("result", F.lit("later")))
    assert [r.result for r in engine.Log(spark, path, True).stored("condense", ["doc"]).collect()] == ["later"]
    assert engine.Log(spark, path, False).stored("condense", ["doc"]) is None
