"""The stream of audits against the batch form, and expiry of open decisions."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tagloom.operators import audit
from tagloom.operators.automation import EngineConfig
from tagloom.sources.tables import spark_table
from tagloom.streaming import suspensions

CONFIG = EngineConfig(target_precision=0.6, target_recall=0.6)


def replay(spark, batches, folder, expiry=timedelta(days=10_000), late="0 seconds"):
    """The rows of the stream, batch by batch."""
    suspensions.use_rocksdb(spark)
    for i, b in enumerate(batches):
        b.coalesce(1).write.parquet(f"{folder}/tmp{i}")
        os.makedirs(f"{folder}/in", exist_ok=True)
        name = next(n for n in os.listdir(f"{folder}/tmp{i}") if n.startswith("part"))
        os.utime(f"{folder}/tmp{i}/{name}", (1_000_000 + i, 1_000_000 + i))
        os.rename(f"{folder}/tmp{i}/{name}", f"{folder}/in/{i:03d}.parquet")
    source = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out: list = []
    query = (
        suspensions.audit_stream(source, "at", CONFIG, expiry, late)
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{folder}/state")
        .foreachBatch(lambda df, n: out.append(df.collect()))
        .start()
    )
    query.processAllAvailable()
    query.stop()
    return out


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_replay_equals_batch(spark, tmp_path):
    history = spark_table(spark, "/root/testdata/sf0.001", "a_history").withColumn("at", F.timestamp_seconds(F.col("id") * 60))
    ids = [r.id for r in history.select("id").orderBy("id").collect()]
    cuts = [ids[len(ids) * k // 3] for k in range(3)] + [ids[-1] + 1]
    batches = [history.where((F.col("id") >= a) & (F.col("id") < b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = replay(spark, batches, str(tmp_path))
    last, ever = {}, set()
    for k, rows in enumerate(r for r in out if r):
        last |= {r.tag_id: r for r in rows}
        seen = history.where(F.col("id") < cuts[min(k, 2) + 1])
        tags = history.select("tag_id").distinct().withColumns({"auto_enabled": F.lit(True), "archived": F.lit(False)})
        want = {r.tag_id for r in audit.tags_to_suspend(tags, seen, 0.6, 0.6).collect()}
        assert {t for t, r in last.items() if r.below} == want
        ever |= want
        assert {t for t, r in last.items() if r.suspended} == ever
        full = {r.tag_id: (r.precision, r.recall, r.n) for r in audit.auto_completion_audit(seen).collect()}
        single = {r.tag_id: (r.precision, r.n) for r in audit.audited_precision(seen).collect()}
        for t, r in last.items():
            assert (r.precision, r.recall, r.n) == pytest.approx(full[t]) if t in full else r.n == 0
            assert (r.pos_precision, r.n_pos) == pytest.approx(single[t]) if t in single else r.n_pos == 0
    assert ever


def test_open_decisions_expire(spark, tmp_path):
    def at(day):
        return datetime(2024, 1, 1) + timedelta(days=day)

    schema = "id bigint, doc_id bigint, tag_id int, source string, state string, at timestamp"
    batches = [
        [(1, 1, 7, "auto", "pos", at(0)), (2, 2, 7, "auto", "neg", at(0)), (3, 2, 7, "human", "pos", at(1))],
        [(4, 9, 8, "auto", "pos", at(40))],  # time goes on, for another tag
        [(5, 9, 8, "human", "pos", at(41))],
        [(6, 1, 7, "human", "pos", at(42)), (7, 3, 7, "auto", "pos", at(42))],  # the first decision is gone by now
    ]
    out = replay(spark, [spark.createDataFrame(b, schema) for b in batches], str(tmp_path), timedelta(days=30))
    rows = [r for b in out for r in b if r.tag_id == 7]
    assert (rows[0].n, rows[0].n_open) == (1, 1)
    assert any(r.n_open == 0 for r in rows[1:-1]) or rows[-1].n_open == 1
    assert (rows[-1].n, rows[-1].n_open) == (1, 1)
    assert [(r.n, r.precision) for b in out for r in b if r.tag_id == 8][-1] == (1, 1.0)
