"""Audits of automatic decisions as a stream, with expiry of what nobody answers and suspension of tags.

State of a tag: its open decisions by document (a map in the state store, so their number is not bounded by memory), its last
fifty audits of either kind and of positives, and whether it was suspended. A human label audits all open decisions on
its document. An event-time timer drops decisions that are older than ``expiry``. The state store must be the RocksDB one
(``use_rocksdb``), as for all processors of this kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import MIN_AUDITS, WINDOW
from ..operators.automation import EngineConfig

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUTPUT = (
    "tag_id bigint, precision double, recall double, n bigint, pos_precision double, n_pos bigint, n_open bigint, below boolean, suspended boolean"
)
_COLUMNS = [c.split()[0] for c in _OUTPUT.split(", ")]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _share(hits: int, of: int) -> float | None:
    return hits / of if of else None


class Audits(StatefulProcessor):
    """Decisions and labels of one tag, in the order of their ids, to its audits."""

    def __init__(self, config: EngineConfig, expiry: timedelta):
        self.config, self.expiry = config, int(expiry.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "doc_id bigint", "ids array<bigint>, states array<string>, at bigint")
        # the last audits, newest at the end: id of the decision, whether it was positive, whether the human label is
        self.both = handle.getValueState("both", "ids array<bigint>, auto array<boolean>, human array<boolean>")
        self.positive = handle.getValueState("positive", "ids array<bigint>, auto array<boolean>, human array<boolean>")
        self.marks = handle.getValueState("marks", "n_open bigint, suspended boolean")

    def _last(self, state) -> list[tuple[int, bool, bool]]:
        return list(zip(*state.get(), strict=True)) if state.exists() else []

    def _told(self, tag: int, both: list, positive: list, n_open: int) -> pd.DataFrame:
        hits = sum(a and h for _, a, h in both)
        precision, recall = _share(hits, sum(a for _, a, _ in both)), _share(hits, sum(h for _, _, h in both))
        single = _share(sum(h for _, _, h in positive), len(positive))
        target = self.config.target_precision
        below = (len(positive) >= MIN_AUDITS and single < target) or (
            len(both) >= MIN_AUDITS and ((precision is not None and precision < target) or (recall is not None and recall < self.config.target_recall))
        )
        suspended = below or (self.marks.exists() and self.marks.get()[1])
        self.marks.update((n_open, suspended))
        row = (tag, precision, recall, len(both), single, len(positive), n_open, below, suspended)
        return pd.DataFrame([row], columns=_COLUMNS).astype({"precision": float, "recall": float, "pos_precision": float})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        both, positive = self._last(self.both), self._last(self.positive)
        n_open = self.marks.get()[0] if self.marks.exists() else 0
        dated = set()
        for r in pd.concat(list(rows)).sort_values("id").itertuples(index=False):
            doc = (int(r.doc_id),)
            held = self.open.getValue(doc)
            if r.source == "auto":
                at = int(pd.Timestamp(r.at).value // 1_000_000)
                ids, states = (list(held[0]), list(held[1])) if held else ([], [])
                self.open.updateValue(doc, ([*ids, int(r.id)], [*states, r.state], at))
                dated.add(at + self.expiry)
                n_open += 1
            elif held:
                audits = [(int(i), s == "pos", r.state == "pos") for i, s in zip(held[0], held[1], strict=True)]
                both = sorted(both + audits)[-WINDOW:]
                positive = sorted(positive + [a for a in audits if a[1]])[-WINDOW:]
                self.open.removeKey(doc)
                n_open -= len(audits)
        for state, last in ((self.both, both), (self.positive, positive)):
            if last:
                state.update(tuple(list(c) for c in zip(*last, strict=True)))
        # one timer a batch and tag, at the time by which all that came with it is too old
        if dated:
            self.handle.registerTimer(max(dated))
        yield self._told(int(key[0]), both, positive, n_open)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        limit = expiredTimerInfo.getExpiryTimeInMs() - self.expiry
        n_open = self.marks.get()[0] if self.marks.exists() else 0
        for doc, (ids, _, at) in list(self.open.iterator()):
            if at <= limit:
                self.open.removeKey(doc)
                n_open -= len(ids)
        yield self._told(int(key[0]), self._last(self.both), self._last(self.positive), n_open)

    def close(self) -> None:
        pass


def audit_stream(
    history: DataFrame, time_col: str, config: EngineConfig = EngineConfig(), expiry: timedelta = timedelta(days=90), late: str = "1 day"
) -> DataFrame:
    """An updated row for each tag that a batch has labels of, or whose open decisions expire.

    tag_id, precision, recall, n (last 50 audits), pos_precision, n_pos (last 50 of positives), n_open, below (a target is missed
    now, with ten audits or more) and suspended (it was at any time). ``history`` has id, doc_id, tag_id, source, state and the time.
    """
    rows = history.withColumn("at", F.col(time_col).cast("timestamp")).withWatermark("at", late)
    rows = rows.select("id", "doc_id", F.col("tag_id").cast("bigint").alias("tag_id"), "source", "state", "at")
    return rows.groupBy("tag_id").transformWithStateInPandas(
        statefulProcessor=Audits(config, expiry), outputStructType=_OUTPUT, outputMode="Update", timeMode="EventTime"
    )


def suspensions(audits: DataFrame) -> DataFrame:
    """tag_id of tags to suspend, as a stream beside the audits: a batch's tags that miss a target."""
    return audits.where("suspended").select("tag_id")
