"""Mixing sources to target weights: blocks of words, multinomial counts per shard, permuted indexes.

The words of a source are packed into blocks of ``block_words``. Packing runs in chunks of some 4000
documents, dealt by a hash of doc_id, so a source that holds most rows is still many tasks; only the last
block of a chunk can be short. A source is owed a number of slots by its target. The slots are dealt
over the output shards by a multinomial draw for each source, seeded by its rank. A slot number, taken modulo
the number of blocks, goes through a pseudorandom permutation of the block indexes (another one for each
pass), so each block is used once before any is used again, and the slots are joined with the blocks
by index. The last slot of a source can take a part of its block, which brings it to its target.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share 150 % of all words; a
target is at most twice the words of its source, and the excess goes to the others by weight until none is above.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own; rows
that repeat a doc_id are packed and counted row by row; without words all targets are 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm.flat import mixed
from panelwright.llm.shared import stored

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
TASK_SHARDS = 32
CHUNK_ROWS = 4_000
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET, MOST = 1.5, 2.0
SEED = 1


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with rank (sid) and target; only two sums a round come to the driver."""
    spark = sources.sparkSession
    ranked = sources.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[0].source, x[0].source_size, x[1]))
    rows = spark.createDataFrame(ranked, f"source {sources.schema['source'].dataType.simpleString()}, source_size long, sid long")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    rows = stored(rows.withColumn("weight", F.get(cycle, F.pmod("sid", F.lit(len(weights))))))
    words = (rows.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, free = 0.0, None
    while True:
        above = F.col("weight") * level > F.col("source_size") * most
        held, left, count = rows.agg(
            F.sum(F.when(above, F.col("source_size") * most)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(~above, 1))
        ).first()
        if not count or count == free:
            break
        level, free = (words - (held or 0.0)) / left, count
    return rows.withColumn("target", F.least(F.col("weight") * level, F.col("source_size") * most))


def packed(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, sid, size, chunk, turn, start): each row with its place and its first word in its chunk."""
    sizes = docs.select("doc_id", "source", word_count("text").alias("size"))
    chunks = max(1, -(-docs.count() // CHUNK_ROWS))
    ranks = sources.select(F.col("source").alias("named"), "sid")
    inside = Window.partitionBy("sid", "chunk").orderBy("doc_id", "size")
    return (
        sizes.join(ranks, F.col("source").eqNullSafe(F.col("named")))
        .withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(chunks)))
        .select("doc_id", "sid", "size", "chunk", F.row_number().over(inside).alias("turn"), (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"))
    )


def permuted(index: np.ndarray, count: int, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..count-1 for each key: Feistel rounds, walked until inside."""
    half = np.uint64(max(1, (int(count - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mixed(right + mixed(key[todo] + np.uint64(r))) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= count]
    return out.astype(np.int64)


def slots(sources: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(sid, shard, slot, block, room) for sources with n_blocks: which block each slot of the mix takes, and how many words of it."""
    exact = F.col("target") * F.col("n_blocks") / F.col("source_size")
    full = F.least(F.floor(exact + 1e-9), F.col("n_blocks") * F.lit(2))
    owed = (
        sources.where("n_blocks > 0 AND source_size > 0").withColumn("full", full.cast("long"))
        .withColumn("rest", F.least(F.round(F.col("target") - F.col("full") * F.col("source_size") / F.col("n_blocks")).cast("long"), F.lit(block_words)))
        .withColumn("rest", F.when(F.col("full") < 2 * F.col("n_blocks"), F.greatest("rest", F.lit(0))).otherwise(F.lit(0)))
        .withColumn("n_slots", F.col("full") + F.when(F.col("rest") > 0, 1).otherwise(0)).where("n_slots > 0")
    )
    shards = max(1, -(-(owed.agg(F.sum("n_slots")).first()[0] or 0) // SHARD_SLOTS))
    # A number of tasks of its own: by the bytes of the draws one task would make the slots of all shards.
    tasks = max(1, -(-shards // TASK_SHARDS))

    def draw(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                counts = np.random.default_rng([seed, int(row.sid)]).multinomial(row.n_slots, np.full(shards, 1.0 / shards))
                first = np.cumsum(counts) - counts
                used = np.flatnonzero(counts)
                for a in range(0, len(used), 10_000):
                    at = used[a : a + 10_000]
                    yield pd.DataFrame({"sid": row.sid, "shard": at, "count": counts[at], "first": first[at], "n_blocks": row.n_blocks, "full": row.full, "rest": row.rest})

    def spread(batches):
        for pdf in batches:
            for sid, own in pdf.groupby("sid"):
                count = own["count"].to_numpy()
                slot = np.repeat(own["first"].to_numpy() - (np.cumsum(count) - count), count) + np.arange(count.sum())
                blocks, full, rest = (int(own[c].iloc[0]) for c in ("n_blocks", "full", "rest"))
                key = mixed(np.uint64(seed) + mixed(np.uint64(sid) + mixed((slot // blocks).astype(np.uint64) + np.uint64(9))))
                yield pd.DataFrame(
                    {"sid": sid, "shard": np.repeat(own["shard"].to_numpy(), count), "slot": slot, "block": permuted(slot % blocks, blocks, key), "room": np.where(slot < full, block_words, rest)}
                )

    draws = owed.select("sid", "n_slots", "n_blocks", "full", "rest").mapInPandas(draw, "sid long, shard long, count long, first long, n_blocks long, full long, rest long")
    return draws.repartition(tasks, "shard").mapInPandas(spread, "sid long, shard long, slot long, block long, room long")


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: documents (with sid, chunk, turn), sources, and the pieces of documents in the mix.

    A piece is (shard, slot, sid, chunk, turn, words): so many words of that document in that slot.
    """
    sized = docs.select("source", word_count("text").alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored(targets(stored(sized)))
    rows = stored(packed(docs, sources))
    per_chunk = rows.groupBy("sid", "chunk").agg(F.ceil(F.sum("size") / block_words).alias("blocks"))
    order = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    per_chunk = stored(per_chunk.withColumn("base", F.sum("blocks").over(order) - F.col("blocks")))
    counts = per_chunk.groupBy("sid").agg(F.sum("blocks").alias("n_blocks"))
    taken = slots(sources.join(counts, "sid"), block_words, seed)
    spans = rows.where("size > 0").join(per_chunk, ["sid", "chunk"]).withColumn(
        "local", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))
    )
    begin = F.greatest("start", F.col("local") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("local") + 1) * block_words)
    blocks = spans.select("sid", "chunk", "turn", (F.col("base") + F.col("local")).alias("block"), (begin - F.col("local") * block_words).alias("skip"), (end - begin).alias("words"))
    # The slots come out of few rows of sources, which would pass for a small table: never broadcast them.
    pieces = taken.hint("merge").join(blocks, ["sid", "block"]).select(
        "shard", "slot", "sid", "chunk", "turn", F.least("words", F.greatest(F.col("room") - F.col("skip"), F.lit(0))).alias("words")
    )
    return rows, sources, pieces.where("words > 0")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source): how many words of each document the mix takes."""
    rows, sources, pieces = mixture(docs)
    taken = pieces.groupBy("sid", "chunk", "turn").agg(F.sum("words").alias("taken"))
    return (
        rows.join(taken, ["sid", "chunk", "turn"], "left").join(sources.select("sid", "source", "source_size", "target"), "sid")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
    )
