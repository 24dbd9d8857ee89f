"""Toxicity: cumulative-link ordinal regression on sparse text features, with expected severity.

P(grade > k) = logistic(w x - threshold_k): the weights are shared by the ordered thresholds. Features are words
(letters, A-Z lower-cased) and their first 4 to 6 bytes, hashed into slots; a slot's value is 1 if the text has it. Rows are
fitted by FTRL-proximal steps on the ordinal likelihood, thresholds by scaled gradient steps that keep their
order; shards of a bounded sample run side by side and their models are averaged.

The labels mark toxic rows by 0 and 1 only, so ``fit_toxic`` makes severity grades 0 to 3 of them: slots much more
frequent in toxic training rows are markers, and a toxic row's grade follows the number of its markers
(``STEPS``). It fits on the markers alone: a long clean text has thousands of other slots, in whose noise one
toxic word is lost. A grade is given from a chance of ``CUT`` on, as a missed toxic row costs more than a false one. The
general fit takes any slots and any integer grades.

Defined cases: a null or empty text has no features and scores by the thresholds alone; rows with a null label are
left out of fitting; without labels every row has severity 0 and grade 0; repeated rows and ties score
alike; very long texts are whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm import flat
from panelwright.llm.quality import KIND

SLOTS = 1 << 18
PREFIXES = (4, 5, 6)
STEPS = (2, 4)
MARKER_ODDS, MARKER_ROWS = 12.0, 4
CUT = 0.3
SHARD_ROWS = 4_000


@dataclass(frozen=True)
class OrdinalSettings:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.1
    threshold_step: float = 0.2
    least_gap: float = 0.05
    passes: int = 10


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of the slots and the ascending thresholds; no thresholds: never fitted."""

    weights: np.ndarray
    thresholds: np.ndarray


def word_slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot, document and word number of each feature of a block."""
    starts, ends, doc = flat.runs(np.where(KIND[data] == 1, np.uint8(1), np.uint8(0)), offsets)
    lower = flat.LOWER[data]
    found = [(flat.run_hashes(lower, starts, ends), np.arange(len(starts)))]
    for n, width in enumerate(PREFIXES):
        long = np.flatnonzero(ends - starts > width)
        found.append((flat.mixed(flat.run_hashes(lower, starts[long], starts[long] + width) + np.uint64(n + 1)), long))
    slot = np.concatenate([h & np.uint64(SLOTS - 1) for h, _ in found]).astype(np.int64)
    word = np.concatenate([w for _, w in found])
    return slot, doc[word], word


def sparse_rows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text, in order."""
    for _, data, offsets in flat.blocks(texts):
        slot, doc, _ = word_slots(data, offsets)
        order = np.argsort(doc, kind="stable")
        slot, edges = slot[order], np.searchsorted(doc[order], np.arange(len(offsets)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            index = np.unique(slot[a:b]).astype(np.int32)
            yield index, np.ones(len(index), np.float32)


def marker_slots(labelled: DataFrame) -> np.ndarray:
    """True for slots that toxic rows of (text, label) have far more often; at most SLOTS rows come to the driver."""

    def tally(batches):
        toxic, clean = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for label, (slot, _) in zip(batch.column("label").to_pylist(), sparse_rows(batch.column("text")), strict=True):
                (toxic if label else clean)[slot] += 1
        used = np.flatnonzero(toxic)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(toxic[used]), pa.array(clean[used])], names=["slot", "toxic", "clean"])

    rows = labelled.groupBy().agg(F.sum("label").alias("t"), F.count("label").alias("n")).first()
    toxic_rows, all_rows = int(rows.t or 0), int(rows.n or 0)
    marks = np.zeros(SLOTS, bool)
    if not toxic_rows or toxic_rows == all_rows:
        return marks
    even = (all_rows - toxic_rows + 1) / (toxic_rows + 1)
    sums = labelled.select("label", "text").mapInArrow(tally, "slot int, toxic long, clean long").groupBy("slot").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    found = sums.where((F.col("t") >= MARKER_ROWS) & ((F.col("t") + 1) * even >= MARKER_ODDS * (F.col("c") + 1)))
    marks[[r.slot for r in found.select("slot").collect()]] = True
    return marks


def fit(labelled: DataFrame, grade_of=None, grades: int = 4, settings: OrdinalSettings = OrdinalSettings(), only=None) -> OrdinalModel:
    """Fit on (doc_id, text, label); grade_of(labels, texts) may turn labels into grades 0..grades-1.

    ``only`` (a broadcast mask of slots) limits the features."""
    draw = F.xxhash64(F.col("doc_id"), F.lit(6))
    shards = max(1, -(-labelled.count() // SHARD_ROWS))

    def features(batches):
        for batch in batches:
            pairs = list(sparse_rows(batch.column("text")))
            if only is not None:
                pairs = [(i[only.value[i]], v[only.value[i]]) for i, v in pairs]
            label = batch.column("label").to_numpy(zero_copy_only=False)
            grade = grade_of(label, batch.column("text")) if grade_of else label
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("shard"), batch.column("turn"), pa.array(np.asarray(grade, np.int32)),
                    pa.array([i for i, _ in pairs], pa.list_(pa.int32())), pa.array([v for _, v in pairs], pa.list_(pa.float32())),
                ],
                names=["shard", "turn", "grade", "slot", "value"],
            )

    def shard_model(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("turn")
        rows = [(np.asarray(s), np.asarray(v, float), int(g)) for s, v, g in zip(group.slot, group.value, group.grade, strict=True)]
        weights, thresholds = ordinal(rows, grades, settings)
        used = np.flatnonzero(weights)
        return pd.DataFrame({"thresholds": [thresholds], "slot": [used.astype(np.int32)], "weight": [weights[used].astype(np.float32)]})

    dealt = labelled.select(F.pmod(draw, F.lit(shards)).cast("int").alias("shard"), draw.alias("turn"), F.col("label").cast("int").alias("label"), "text")
    found = (
        dealt.mapInArrow(features, "shard int, turn long, grade int, slot array<int>, value array<float>")
        .groupBy("shard").applyInPandas(shard_model, "thresholds array<double>, slot array<int>, weight array<float>").collect()
    )
    weights = np.zeros(SLOTS)
    for row in found:
        weights[np.asarray(row.slot, int)] += np.asarray(row.weight)
    if not found:
        return OrdinalModel(weights.astype(np.float32), np.zeros(0))
    return OrdinalModel((weights / len(found)).astype(np.float32), np.mean([r.thresholds for r in found], axis=0))


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ordinal(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, settings: OrdinalSettings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds after several passes over rows of (slots, values, grade)."""
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    thresholds = np.arange(1, grades, dtype=float)
    seen = np.ones(grades - 1)
    for _ in range(settings.passes):
        for index, value, grade in rows:
            zi, ni = z[index], n[index]
            w = -(zi - np.clip(zi, -settings.l1, settings.l1)) / ((settings.beta + np.sqrt(ni)) / settings.alpha + settings.l2)
            below = _logistic(thresholds - w @ value)
            upper = below[grade] if grade < grades - 1 else 1.0
            lower = below[grade - 1] if grade else 0.0
            step = (1.0 - upper - lower) * value
            sigma = (np.sqrt(ni + step * step) - np.sqrt(ni)) / settings.alpha
            z[index] += step - sigma * w
            n[index] += step * step
            chance = max(upper - lower, 1e-6)
            slope = np.zeros(grades - 1)
            if grade < grades - 1:
                slope[grade] = -upper * (1 - upper) / chance
            if grade:
                slope[grade - 1] = lower * (1 - lower) / chance
            seen += slope * slope
            thresholds = thresholds - settings.threshold_step * slope / np.sqrt(seen)
            gaps = np.arange(grades - 1) * settings.least_gap
            thresholds = np.maximum.accumulate(thresholds - gaps) + gaps
    return -(z - np.clip(z, -settings.l1, settings.l1)) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2), thresholds


def fit_toxic(labelled: DataFrame, settings: OrdinalSettings = OrdinalSettings()) -> OrdinalModel:
    """Fit on (doc_id, text, label 0/1), with grades from the number of markers."""
    held = labelled.sparkSession.sparkContext.broadcast(marker_slots(labelled))

    def grade(labels: np.ndarray, texts: pa.Array) -> np.ndarray:
        markers = np.array([held.value[slot].sum() for slot, _ in sparse_rows(texts)], int)
        return np.where(labels > 0, 1 + np.searchsorted(STEPS, markers, "right"), 0)

    return fit(labelled, grade, len(STEPS) + 2, settings, only=held)


def severities(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, severity, grade, toxic): expected grade, largest grade of a chance of CUT or more, and whether that is above 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            weights, thresholds = held.value.weights, held.value.thresholds
            line = np.array([weights[i] @ v for i, v in sparse_rows(batch.column("text"))], float)
            over = _logistic(line[:, None] - thresholds[None, :])
            grade = (over >= CUT).sum(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(over.sum(1)), pa.array(grade), pa.array(grade > 0)], names=["doc_id", "severity", "grade", "toxic"]
            )

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, severity double, grade int, toxic boolean")
