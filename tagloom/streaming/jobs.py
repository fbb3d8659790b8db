"""Structured Streaming forms: number import, audit monitor, evaluation window, scoring, label activity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numbers import normalise_numbers
from ..operators.audit import WINDOW as AUDITS
from ..operators.automation import EngineConfig, with_decision
from ..operators.evaluation import WINDOW as EVALUATED
from ..operators.scoring import score_rows


def number_import(lines: DataFrame, col: str = "input_raw") -> DataFrame:
    """Parsed numbers of a stream of lines, each key once."""
    return normalise_numbers(lines, col).where("outcome = 'parsed'").dropDuplicates(["pub_key"])


def score_batches(vectors: DataFrame, state: Callable[[], dict[str, DataFrame]], sink: Callable[[DataFrame, int], None], model_id: str = "m1", k: int = 10):
    """Writer that scores each micro-batch of vectors for all active tags and decides on the scores.

    ``state`` gives the tables as they are at the batch: pool, tags, labels, classifiers, tag_vectors. ``sink`` gets the
    rows of ``score_rows`` with decision, and the batch's number.
    """

    def score(batch: DataFrame, number: int) -> None:
        now = state()
        rows = score_rows(batch, now["pool"], now["tags"], now["labels"], now["classifiers"], now["tag_vectors"], model_id, k)
        sink(with_decision(rows, now["tags"]), number)

    return vectors.writeStream.foreachBatch(score)


def _audit(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pending, window = ([], []) if not state.exists else ([tuple(x) for x in zip(*state.get[:3], strict=True)], list(zip(*state.get[3:], strict=True)))
    rows = sorted((int(r.id), int(r.doc_id), r.source, r.state) for f in frames for r in f.itertuples(index=False))
    for id_, doc, source, label in rows:
        if source == "auto":
            pending.append((id_, doc, label))
        else:
            window += [(p, a, label) for p, d, a in pending if d == doc]
            pending = [x for x in pending if x[1] != doc]
    window = sorted(window)[-AUDITS:]
    state.update(tuple([list(c) for c in zip(*pending, strict=True)] or [[], [], []]) + tuple([list(c) for c in zip(*window, strict=True)] or [[], [], []]))
    tp = sum(a == "pos" == h for _, a, h in window)
    auto, human = sum(a == "pos" for _, a, _ in window), sum(h == "pos" for _, _, h in window)
    yield pd.DataFrame(
        {"tag_id": [key[0]], "precision": [tp / auto if auto else None], "recall": [tp / human if human else None], "n": [len(window)]}
    ).astype({"precision": float, "recall": float})


def audit_monitor(history: DataFrame) -> DataFrame:
    """tag_id, precision, recall, n of the last audited decisions, updated per micro-batch.

    State per tag: its open automatic decisions (id, document, state) and the last 50 audits.
    """
    return history.select("id", "doc_id", "tag_id", "source", "state").groupBy("tag_id").applyInPandasWithState(
        _audit,
        "tag_id int, precision double, recall double, n bigint",
        "p_id array<bigint>, p_doc array<bigint>, p_state array<string>, w_id array<bigint>, w_auto array<string>, w_human array<string>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def _thresholds(scores: np.ndarray, pos: np.ndarray, config: EngineConfig) -> tuple[float | None, float | None]:
    """The lowest hundredth with the wanted precision and the highest that keeps the wanted recall."""
    steps = np.arange(101, dtype=np.float32) * np.float32(0.01)
    hit = scores[None, :].astype(np.float32) >= steps[:, None]
    right, found = (hit & pos).sum(axis=1), hit.sum(axis=1)
    precise = np.flatnonzero((found > 0) & (right >= config.target_precision * found))
    recalled = np.flatnonzero(right >= config.target_recall * pos.sum()) if pos.any() else precise[:0]
    return float(steps[precise[0]]) if len(precise) else None, float(steps[recalled[-1]]) if len(recalled) else None


def evaluation_monitor(scored: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """tag_id, precision, recall, n, threshold, neg_threshold over the last 300 scored labels of each tag."""

    def evaluate(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = list(zip(*state.get, strict=True)) if state.exists else []
        rows += [(int(r.id), float(r.score), bool(r.is_pos)) for f in frames for r in f.itertuples(index=False)]
        rows = sorted(rows)[-EVALUATED:]
        state.update(tuple(list(c) for c in zip(*rows, strict=True)))
        at = [p for _, s, p in rows if s >= 0.5]
        pos = sum(p for _, _, p in rows)
        high, low = _thresholds(np.array([s for _, s, _ in rows]), np.array([p for _, _, p in rows]), config)
        yield pd.DataFrame(
            {
                "tag_id": [key[0]], "precision": [sum(at) / len(at) if at else None], "recall": [sum(at) / pos if pos else None], "n": [len(rows)],
                "threshold": [high], "neg_threshold": [low],
            }
        ).astype({"precision": float, "recall": float, "threshold": float, "neg_threshold": float})

    return scored.select("id", "tag_id", "score", "is_pos").groupBy("tag_id").applyInPandasWithState(
        evaluate, "tag_id bigint, precision double, recall double, n bigint, threshold double, neg_threshold double",
        "ids array<bigint>, scores array<double>, pos array<boolean>", "update", GroupStateTimeout.NoTimeout,
    )


def label_activity(log: DataFrame, time_col: str = "created_at", size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Labels per tag and window; rows later than the watermark are dropped."""
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    return log.withWatermark(time_col, late).groupBy(w.alias("w"), "tag_id").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "tag_id", "n")


def label_sessions(log: DataFrame, time_col: str = "created_at", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = F.session_window(time_col, gap)
    return log.withWatermark(time_col, late).groupBy(s.alias("w"), "tag_id").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "tag_id", "n")
