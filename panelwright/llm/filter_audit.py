"""Filter interaction audit: what each of several filters removes, first, after others, and over all orders.

Rows go into sorted posting lists: for each part and range of doc_ids, one ascending list of failing places per
filter. Unions of the lists of every set of filters are grown by galloping each list into the union of a smaller set;
their sizes are added over the ranges. Every figure of the audit is a difference of such sizes.

Ranges are cut from rows sorted by part and doc_id, so no part, however large, is held by one task.

Defined cases: a null text is empty, a null lang is the part ""; every row counts as one document, also those that
repeat a doc_id or have none (these are the first of their part; without an id a row is never a later copy). A
document with several labels is good or toxic if any of them says so. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.shared import stored

# The five conditions under which a document fails, as bits 0 to 4, and their limits.
LETTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"[\x20\x09-\x0D]+"

LISTS = "part string, first_id long, last_id long, size int, doc_ids array<long>, fails array<array<int>>, good array<int>, toxic array<int>"


def outcomes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, fails, good, toxic) of every row; bit i of fails stands for letter i."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split("_text", SPACES), "")
    capitals = F.char_length("_text") - F.char_length(F.translate("_text", CAPITALS, ""))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("_text")).withColumn("_words", words)
    own = (
        F.size("_words") < MIN_WORDS,
        100 * F.size(F.array_distinct("_words")) < DISTINCT_PERCENT * F.size("_words"),
        100 * capitals > CAPITAL_PERCENT * F.char_length("_text"),
        F.col("_text").rlike(SYMBOLS),
    )
    bits = sum(((F.when(c, F.lit(1 << i)).otherwise(F.lit(0))) for i, c in enumerate(own)), F.lit(0))
    digest = F.unhex(F.sha2(F.col("_text").cast("binary"), 256))
    rows = stored(read.select("doc_id", "part", bits.alias("bits"), digest.alias("digest")))
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    later = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(own))).otherwise(F.lit(0))
    copied = rows.join(firsts.where("copies > 1").select("digest", "first"), "digest", "left")
    known = copied.join(marks, "doc_id", "left")
    return stored(known.select(
        "doc_id", "part", F.col("bits").bitwiseOR(later).alias("fails"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    ))


def posting_lists(rows: DataFrame, filters: int) -> DataFrame:
    """One row for each part and range of doc_ids: the doc_ids, and the places in them that each filter fails."""

    def lists(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part").to_numpy(zero_copy_only=False)
            fails = batch.column("fails").to_numpy(zero_copy_only=False)
            classes = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic")]
            edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            found = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                ids = batch.column("doc_id").slice(a, b - a)
                found.append((
                    part[a], ids[0].as_py(), ids[-1].as_py(), b - a, ids.to_pylist(),
                    [np.flatnonzero(fails[a:b] >> i & 1).astype(np.int32) for i in range(filters)],
                    *(np.flatnonzero(c[a:b]).astype(np.int32) for c in classes),
                ))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = [pa.array([row[i] for row in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "first_id", "last_id", "size", "doc_ids", "fails", "good", "toxic"])

    # Rows of one doc_id, if very many, are spread by where they were read.
    ranged = rows.withColumn("_read", F.spark_partition_id()).repartitionByRange("part", "doc_id", "_read")
    return ranged.sortWithinPartitions("part", "doc_id").drop("_read").mapInArrow(lists, LISTS)


def absent(some: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The ids of some that held lacks; both ascend, so each search goes on from where the one before ended."""
    if not len(held):
        return some
    at = np.minimum(np.searchsorted(held, some), len(held) - 1)
    return some[held[at] != some]


def united(lists: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The union of the lists of every subset, by the subset's bits."""
    unions = [np.zeros(0, np.int32)]
    for own in lists:
        grown = []
        for held in unions:
            long, short = (held, own) if len(held) >= len(own) else (own, held)
            new = absent(short, long)
            grown.append(np.insert(long, np.searchsorted(long, new), new) if len(new) else long)
        unions += grown
    return unions


def subset_sizes(lists: DataFrame, filters: int) -> DataFrame:
    """(part, subset, size, good, toxic, documents): rows that fail any filter of the subset, and all rows of the part."""

    def counted(batches):
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                fails = batch.column("fails")[row].values
                good, toxic = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("good", "toxic"))
                size = batch.column("size")[row].as_py()
                for subset, union in enumerate(united([fails[i].values.to_numpy(zero_copy_only=False) for i in range(filters)])):
                    of_class = [len(c) - len(absent(c, union)) for c in (good, toxic)]
                    found.append((batch.column("part")[row].as_py(), subset, len(union), *of_class, size))
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "subset", "size", "good", "toxic", "documents"])

    kept = lists.select("part", "size", "fails", "good", "toxic")
    each = kept.mapInArrow(counted, "part string, subset int, size long, good long, toxic long, documents long")
    return each.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("size", "good", "toxic", "documents")])


def audit(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Per part, order of the filters and step: what stays, what goes and what that says of the step's filter.

    rows has doc_id, part, fails (bits in the order of letters), good and toxic. Filters are few: the result has a row
    for each of their orders.
    """
    count, every = len(letters), (1 << len(letters)) - 1
    spark = rows.sparkSession
    sizes = stored(subset_sizes(stored(posting_lists(rows, count)), count))
    plan = []
    for order in permutations(range(count)):
        before = 0
        for step, f in enumerate(order, 1):
            plan.append(("".join(letters[i] for i in order), step, f, before, before | 1 << f, 1 << f, every & ~(1 << f)))
            before |= 1 << f
    steps = spark.createDataFrame(plan, "filter_order string, step int, filter int, subset int, after int, alone int, others int")
    # At most 2 ** filters structs for each part, in the order of subsets.
    held = F.array_sort(F.collect_list(F.struct("subset", "size", "good", "toxic")))
    parts = sizes.groupBy("part").agg(held.alias("u"))
    at = lambda subset: F.element_at("u", subset + F.lit(1))
    gained = lambda s, f: F.element_at("u", (s | 1 << f) + 1)["size"] - F.element_at("u", s + 1)["size"]
    shapley = F.array(*[
        sum(
            (F.lit(math.factorial(s.bit_count()) * math.factorial(count - 1 - s.bit_count())) * gained(s, f) for s in range(every + 1) if not s >> f & 1),
            F.lit(0).cast("long"),
        )
        for f in range(count)
    ])
    parts = parts.select("part", "u", shapley.alias("shapley"))
    removed = at(F.col("after"))["size"] - F.col("size")
    return (
        sizes.join(F.broadcast(steps), "subset").join(parts, "part")
        .select(
            "part", "filter_order", "step",
            (F.col("documents") - at(F.col("after"))["size"]).alias("kept"), removed.alias("removed"), (at(F.col("alone"))["size"] - removed).alias("redundant"),
            (at(F.lit(every))["size"] - at(F.col("others"))["size"]).alias("unique_fails"),
            (at(F.col("after"))["good"] - F.col("good")).alias("good_lost"), (at(F.col("after"))["toxic"] - F.col("toxic")).alias("toxic_lost"),
            F.element_at("shapley", F.col("filter") + F.lit(1)).alias("shapley"),
        )
    )
