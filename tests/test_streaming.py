"""Streams give what a batch over the same rows gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import audit
from tagloom.streaming import jobs


def _stream(spark, df, folder, mode, build, keys):
    for i, part in enumerate(df.randomSplit([1.0, 1.0], 3) if keys is None else [df.where(F.col("id") < 40), df.where(F.col("id") >= 40)]):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    name = f"out_{abs(hash(folder)) % 10**8}"
    q = build(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_number_import(spark, tmp_path):
    df = spark.createDataFrame([("EP1A1",), ("ep 1 a1",), ("US2B1",), ("junk",)], "input_raw string")
    out = _stream(spark, df, str(tmp_path), "append", jobs.number_import, None)
    assert sorted(r.pub_key for r in out.collect()) == ["EP1", "US2"]


def test_audit_monitor(spark, tmp_path):
    rows = []
    for n in range(30):
        rows += [(2 * n, n, n % 2, "auto", "pos" if n % 3 else "neg"), (2 * n + 1, n, n % 2, "human", "pos" if n % 4 else "neg")]
    df = spark.createDataFrame(rows, "id bigint, doc_id bigint, tag_id int, source string, state string")
    out = _stream(spark, df, str(tmp_path), "update", jobs.audit_monitor, "id")
    last = {r.tag_id: r for r in out.orderBy("n").collect()}
    for r in audit.auto_completion_audit(df).collect():
        assert abs(last[r.tag_id].precision - r.precision) < 1e-9 and abs(last[r.tag_id].recall - r.recall) < 1e-9 and last[r.tag_id].n == r.n
