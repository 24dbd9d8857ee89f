"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL-proximal steps.

Features of a text are its words, pairs of neighbouring words and triples of word shapes (case,
digits, marks), hashed into a fixed number of slots; a value is the share of the n-grams that fall
into the slot, times a constant. A score is one sparse dot product and the logistic function.

Fitting reads at most about ``rows`` labelled documents (documented bound, chosen by a hash of
doc_id). They are dealt to ``shards`` groups; each group runs follow-the-regularised-leader over its
own rows, and the weights of the groups are averaged. Only these sparse weights reach the driver,
whose number the slots bound.

Defined cases: a null or empty text has no feature and scores the bias alone; rows with a null label
are left out of fitting; without both labels the score is 0.5 for every text; repeated rows and
ties are scored alike; other columns are ignored or passed through by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm import flat

SLOTS = 1 << 18
SCALE = 30.0
ROWS = 16_000
SHARDS = 8

# Kinds of bytes: 0 space, 1 letter, 2 digit, 3 mark. Bytes above 127 are parts of letters.
KIND = np.full(256, 3, np.uint8)
KIND[flat.SPACE] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
UPPER = np.zeros(256, np.int64)
UPPER[65:91] = 1
PLAIN, CAPITAL, SHOUT, DIGITS = (np.uint64(n) for n in (11, 13, 17, 19))


@dataclass(frozen=True)
class FtrlSettings:
    """Step size, its offset and the penalties of the FTRL-proximal update; passes over a shard."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    passes: int = 4


@dataclass(frozen=True)
class LinearModel:
    """Weights of the slots (float32) and the bias."""

    weights: np.ndarray
    bias: float


def slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and document of every n-gram of a block."""
    starts, ends, doc = flat.runs(KIND[data], offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    count = len(offsets) - 1
    token = flat.run_hashes(flat.LOWER[data], starts, ends)
    upper = np.concatenate([[0], np.cumsum(UPPER[data])])
    caps, kind = upper[ends] - upper[starts], KIND[data[starts]]
    shape = np.where(kind == 1, PLAIN, np.where(kind == 2, DIGITS, token))
    shape = np.where((kind == 1) & (caps > 0), np.where((caps > 1) & (2 * caps > ends - starts), SHOUT, CAPITAL), shape)
    pairs, pair_doc = flat.grams(token, doc, 2, count)
    same = np.flatnonzero((doc[1:] == doc[:-1]) & (token[1:] == token[:-1]))
    shapes, shape_doc = flat.grams(shape, doc, 3, count)
    repeat = np.full(len(same), 23, np.uint64)
    kinds = ((token, doc), (pairs, pair_doc), (flat.mixed(shapes + np.uint64(1)), shape_doc), (flat.mixed(repeat), doc[same]))
    slot = np.concatenate([flat.mixed(h + np.uint64(n)) & np.uint64(SLOTS - 1) for n, (h, _) in enumerate(kinds)])
    return slot.astype(np.int64), np.concatenate([d for _, d in kinds])


def sparse_rows(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text, in order."""
    for _, data, offsets in flat.blocks(texts):
        slot, doc = slots(data, offsets)
        order = np.argsort(doc, kind="stable")
        slot, edges = slot[order], np.searchsorted(doc[order], np.arange(len(offsets)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            index, tally = np.unique(slot[a:b], return_counts=True)
            yield index.astype(np.int32), (tally * (SCALE / max(1, b - a))).astype(np.float32)


def dots(texts: pa.Array, model: LinearModel) -> np.ndarray:
    """The linear score of each text."""
    out = np.full(len(texts), model.bias)
    for row, data, offsets in flat.blocks(texts):
        slot, doc = slots(data, offsets)
        count = len(offsets) - 1
        total = np.bincount(doc, model.weights[slot], minlength=count)
        out[row : row + count] += total * SCALE / np.maximum(1, np.bincount(doc, minlength=count))
    return out


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], settings: FtrlSettings) -> tuple[np.ndarray, float]:
    """Weights and bias after following the regularised leader over the rows, several times."""
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)
    bias_z = bias_n = 0.0

    def leader(z, n, l1):
        return -(z - np.clip(z, -l1, l1)) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2)

    for _ in range(settings.passes):
        for index, value, label in rows:
            w, bias = leader(z[index], n[index], settings.l1), leader(bias_z, bias_n, 0.0)
            error = 1.0 / (1.0 + np.exp(-np.clip(w @ value + bias, -35, 35))) - label
            step = error * value
            sigma = (np.sqrt(n[index] + step * step) - np.sqrt(n[index])) / settings.alpha
            z[index] += step - sigma * w
            n[index] += step * step
            sigma = (np.sqrt(bias_n + error * error) - np.sqrt(bias_n)) / settings.alpha
            bias_z += error - sigma * bias
            bias_n += error * error
    return leader(z, n, settings.l1), float(leader(bias_z, bias_n, 0.0))


def fit(labelled: DataFrame, settings: FtrlSettings = FtrlSettings(), rows: int = ROWS, shards: int = SHARDS) -> LinearModel:
    """Fit on (doc_id, text, label 0/1); a share of the rows is taken by hash when there are more than ``rows``."""
    labelled = labelled.where(F.col("label").isNotNull()).select("doc_id", "text", "label")
    draw = F.xxhash64(F.col("doc_id"), F.lit(9))

    def features(batches):
        for batch in batches:
            pairs = list(sparse_rows(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("shard"), batch.column("turn"), batch.column("label"),
                    pa.array([i for i, _ in pairs], pa.list_(pa.int32())), pa.array([v for _, v in pairs], pa.list_(pa.float32())),
                ],
                names=["shard", "turn", "label", "slot", "value"],
            )

    def shard_weights(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("turn")
        examples = [(np.asarray(s), np.asarray(v, float), float(y)) for s, v, y in zip(group.slot, group.value, group.label, strict=True)]
        weights, bias = ftrl(examples, settings)
        used = np.flatnonzero(weights)
        return pd.DataFrame({"bias": [bias], "slot": [used.astype(np.int32)], "weight": [weights[used].astype(np.float32)]})

    dealt = labelled.select(
        F.pmod(draw, F.lit(shards)).cast("int").alias("shard"), draw.alias("turn"), F.col("label").cast("double").alias("label"), "text"
    )
    found = (
        dealt.mapInArrow(features, "shard int, turn long, label double, slot array<int>, value array<float>")
        .groupBy("shard").applyInPandas(shard_weights, "bias double, slot array<int>, weight array<float>").collect()
    )
    weights = np.zeros(SLOTS)
    for row in found:
        weights[np.asarray(row.slot, int)] += np.asarray(row.weight)
    share = max(1, len(found))
    return LinearModel((weights / share).astype(np.float32), sum(row.bias for row in found) / share)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled documents at most, none of them held out.

    A document labelled twice takes the larger label. The chosen ids are at most about ``rows``,
    so they are broadcast.
    """
    marks = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    have = marks.count()
    if have > rows:
        limit = int(rows / have * (1 << 30))
        marks = marks.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(1 << 30)) < limit)
    return docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, model: LinearModel) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on); clashing columns of docs are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def score(batches):
        for batch in batches:
            value = 1.0 / (1.0 + np.exp(-np.clip(dots(batch.column("text"), held.value), -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
                names=[*names, "score", "predicted"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names).mapInArrow(score, f"{schema}, score double, predicted int")
