"""Line deduplication with exact reference counts and sharded cuckoo filters, reversible per document.

The state holds three tables. ``postings`` has each (key, doc_id) once and is the exact record;
``refs`` counts the documents of each key and names the largest doc_id; ``filters`` has, for each
shard of the key space, a cuckoo filter of the keys whose count has reached ``min_docs``. Inserting or
deleting documents changes the counts, and the keys that cross the threshold enter or leave the
filters, so any insertion can be undone. A key is the MD5 of the line without white space
``[\\x20\\x09-\\x0D]`` at its ends and with A-Z lower-cased; shorter lines than ``min_chars`` code points
have none.

Dropping lines: a filter hit only proposes a line; the join with ``refs`` decides, so false hits do
no harm. Filters of at most ``FILTER_BYTES`` in all are broadcast, and documents without a hit never move. Beyond
that keys travel to the shard of their filter, each shard split as the most frequent line needs, and only hits go on to the join.

Defined cases: a null or empty text is one empty line; rows that repeat a doc_id count as one document
for the references and are each cleaned; rows with a null doc_id count together as one document and never hold
a line back; lines repeated inside the kept document stay; an empty table gives an empty state and result;
other columns pass through, those named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.flat import mixed
from panelwright.llm.shared import stored

BLANKS = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 200_000
FILTER_BYTES = 64 << 20
PROBES = 500_000
WAYS = 4
KICKS = 500


class CuckooFilter:
    """16-bit fingerprints in buckets of four; holds 64-bit key hashes, supports deletion."""

    def __init__(self, table: np.ndarray):
        self.table = table.reshape(-1, WAYS)
        self.mask = np.uint64(len(self.table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (WAYS * 0.8)))))
        return cls(np.zeros(buckets * WAYS, np.uint16))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each hash."""
        mark = np.maximum(hashes >> np.uint64(48), np.uint64(1))
        first = hashes & self.mask
        return mark.astype(np.uint16), first.astype(np.int64), self.other(first, mark).astype(np.int64)

    def other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return np.uint64(bucket) ^ (mixed(np.atleast_1d(np.uint64(mark))) & self.mask)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(hashes)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> np.ndarray:
        """Adds the hashes one by one; returns the fingerprints' hashes that found no room."""
        left = []
        chance = np.random.default_rng(4)
        for h, mark, one, two in zip(hashes, *self.places(hashes), strict=True):
            for bucket in (one, two):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
            else:
                undo = []
                for _ in range(KICKS):
                    way = int(chance.integers(WAYS))
                    undo.append((bucket, way, self.table[bucket, way]))
                    mark, self.table[bucket, way] = self.table[bucket, way], mark
                    bucket = int(self.other(bucket, mark)[0])
                    free = np.flatnonzero(self.table[bucket] == 0)
                    if len(free):
                        self.table[bucket, free[0]] = mark
                        break
                else:
                    for bucket, way, old in reversed(undo):
                        self.table[bucket, way] = old
                    left.append(h)
        return np.array(left, np.uint64)

    def delete(self, hashes: np.ndarray) -> np.ndarray:
        """Removes one copy of each hash's fingerprint; returns the hashes that were not there."""
        left = []
        for h, mark, one, two in zip(hashes, *self.places(hashes), strict=True):
            for bucket in (one, two):
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break
            else:
                left.append(h)
        return np.array(left, np.uint64)


@dataclass(frozen=True)
class LineState:
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line, None for lines too short to have one."""
    out = []
    for line in text.split(b"\n"):
        line = line.strip(BLANKS).lower()
        long = len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars)
        out.append(hashlib.md5(line).digest() if long else None)
    return out


def raw_texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Filter hash and shard number (before the remainder) of each key."""
    parts = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return parts[:, 0], parts[:, 1] >> np.uint64(1)


def postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each (key, doc_id) once."""

    def keys(batches):
        for batch in batches:
            owner, found = [], []
            for n, text in enumerate(raw_texts(batch.column("text"))):
                own = {k for k in line_keys(text, min_chars) if k is not None}
                owner.extend([n] * len(own))
                found.extend(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), batch.column("doc_id").take(pa.array(owner, pa.int64()))], names=["key", "doc_id"]
            )

    return docs.select("doc_id", "text").mapInArrow(keys, "key binary, doc_id long").distinct()


def counted(posts: DataFrame) -> DataFrame:
    return posts.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def with_shards(keys: DataFrame, shards: int) -> DataFrame:
    """Adds hash and shard to a table with a key column."""

    def place(batches):
        for batch in batches:
            hashes, shard = key_hashes(batch.column("key").to_pylist()) if batch.num_rows else (np.zeros(0, np.uint64),) * 2
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hashes.view(np.int64)), pa.array((shard % np.uint64(shards)).astype(np.int32))],
                names=[*batch.schema.names, "hash", "shard"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema)
    return keys.mapInArrow(place, f"{schema}, hash long, shard int")


def grown(tables: list[np.ndarray], hashes: np.ndarray) -> list[np.ndarray]:
    """The shard's filters after inserting the hashes; what finds no room opens a further filter."""
    for table in tables:
        hashes = CuckooFilter(table).insert(hashes)
    while len(hashes):
        fresh = CuckooFilter.sized(2 * len(hashes))
        hashes = fresh.insert(hashes)
        tables.append(fresh.table.reshape(-1))
    return tables


def built(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> LineState:
    """The state after inserting all documents."""
    posts = stored(postings(docs, min_chars))
    refs = stored(counted(posts))
    repeated = refs.where(F.col("n_docs") >= min_docs).select("key")
    shards = max(1, -(-repeated.count() // SHARD_KEYS))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        tables = grown([], group.hash.to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": group.shard.iloc[:1], "tables": [[t.tobytes() for t in tables]]})

    filters = stored(with_shards(repeated, shards).groupBy("shard").applyInPandas(fill, "shard int, tables array<binary>"))
    return LineState(posts, refs, filters, shards, min_docs, min_chars)


def _changed(state: LineState, posts: DataFrame, refs: DataFrame) -> LineState:
    """The state with new postings and counts; keys that cross the threshold enter or leave the filters."""
    before = state.refs.where(F.col("n_docs") >= state.min_docs).select("key")
    after = refs.where(F.col("n_docs") >= state.min_docs).select("key")
    moved = after.join(before, "key", "left_anti").withColumn("enters", F.lit(True)).union(
        before.join(after, "key", "left_anti").withColumn("enters", F.lit(False))
    )

    def update(held: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        tables = [np.frombuffer(t, np.uint16).copy() for t in (held.tables.iloc[0] if len(held) else ())]
        hashes, enters = change.hash.to_numpy().view(np.uint64), change.enters.to_numpy(bool)
        gone = hashes[~enters]
        for table in tables:
            gone = CuckooFilter(table).delete(gone)
        tables = grown(tables, hashes[enters])
        shard = (held if len(held) else change).shard.iloc[:1].to_numpy()
        return pd.DataFrame({"shard": shard, "tables": [[t.tobytes() for t in tables]]})

    filters = (
        state.filters.groupBy("shard").cogroup(with_shards(moved, state.shards).groupBy("shard"))
        .applyInPandas(update, "shard int, tables array<binary>")
    )
    return replace(state, postings=posts, refs=refs, filters=stored(filters))


def inserted(state: LineState, docs: DataFrame) -> LineState:
    """The state after adding documents; pairs of key and document already held do not count again."""
    fresh = stored(postings(docs, state.min_chars).join(
        state.postings.withColumnsRenamed({"key": "k", "doc_id": "d"}), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_anti"
    ))
    refs = state.refs.union(counted(fresh)).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
    return _changed(state, stored(state.postings.union(fresh)), stored(refs))


def deleted(state: LineState, ids: DataFrame) -> LineState:
    """The state without the documents named by the doc_id column of ids: insertion undone."""
    gone = ids.select(F.col("doc_id").alias("d")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d"))
    posts = stored(state.postings.join(gone, same, "left_anti"))
    touched = stored(state.postings.join(gone, same, "left_semi").select("key").distinct())
    recount = counted(posts.join(touched, "key", "left_semi"))
    refs = state.refs.join(touched, "key", "left_anti").union(recount)
    return _changed(state, posts, stored(refs))


def probed(keys: DataFrame, state: LineState) -> DataFrame:
    """The (key, doc) rows whose key the filter of its shard does not rule out.

    A group holds one part of a shard: about ``PROBES`` rows, also of a line that most documents have.
    """
    most, total = state.refs.agg(F.max("n_docs"), F.sum("n_docs")).first()
    salts = max(1, -(-((most or 0) + (total or 0) // state.shards) // PROBES))
    spread = with_shards(keys, state.shards).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    filters = state.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = np.zeros(asked.num_rows, bool)
        hashes = asked.column("hash").to_numpy().view(np.uint64)
        for table in held.column("tables")[0].as_py() if held.num_rows else ():
            found |= CuckooFilter(np.frombuffer(table, np.uint16)).contains(hashes)
        return asked.select(["key", "doc"]).filter(pa.array(found))

    by = ("shard", "salt")
    return spread.groupBy(*by).cogroup(filters.groupBy(*by)).applyInArrow(probe, "key binary, doc long")


def unused(stem: str, names: list[str]) -> str:
    """A column name that no given one equals in any case."""
    while stem.lower() in {n.lower() for n in names}:
        stem += "_"
    return stem


def cleaned(docs: DataFrame, state: LineState) -> DataFrame:
    """docs with the dropped lines taken out of text, and n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    size = state.filters.select(F.sum(F.aggregate("tables", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t)))).first()[0] or 0
    small = size <= FILTER_BYTES
    held = None
    if small:  # the size has just been checked
        tables = {r.shard: [np.frombuffer(t, np.uint16) for t in r.tables] for r in state.filters.collect()}
        held = spark.sparkContext.broadcast(tables)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*[F.col(f"`{n}`") for n in names])
    owner_name, drop_name = unused("_owner", names), unused("_drop", names)
    shards, min_chars = state.shards, state.min_chars

    def hits(texts: list[bytes]) -> list[list[bytes]]:
        """For each text, its keys that the filters do not rule out."""
        keys = [sorted({k for k in line_keys(t, min_chars) if k is not None}) for t in texts]
        if not small:
            return keys
        flat = [k for own in keys for k in own]
        if not flat:
            return keys
        hashes, shard = key_hashes(flat)
        shard = (shard % np.uint64(shards)).astype(int)
        found = np.zeros(len(flat), bool)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            for table in held.value.get(int(s), ()):
                found[at] |= CuckooFilter(table).contains(hashes[at])
        flags = iter(found.tolist())
        return [[k for k in own if next(flags)] for own in keys]

    def untouched(batches):
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            at = [n for n, own in enumerate(hits(texts)) if not own]
            rows = batch.take(pa.array(at, pa.int64()))
            counts = pa.array([texts[n].count(b"\n") + 1 for n in at], pa.int64())
            yield pa.RecordBatch.from_arrays([*rows.columns, counts, pa.array([0] * len(at), pa.int64())], names=[*names, "n_lines", "n_dropped"])

    def proposed(batches):
        for batch in batches:
            found = hits(raw_texts(batch.column("text")))
            owner = pa.array([n for n, own in enumerate(found) for _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for own in found for k in own], pa.binary()), batch.column("doc_id").take(owner)], names=["key", "doc"])

    def touched(batches):
        for batch in batches:
            at = [n for n, own in enumerate(hits(raw_texts(batch.column("text")))) if own]
            yield batch.take(pa.array(at, pa.int64()))

    def dropped(batches):
        for batch in batches:
            kept, total, gone = [], [], []
            for text, drop in zip(raw_texts(batch.column("text")), batch.column(drop_name).to_pylist(), strict=True):
                drop = set(drop or ())
                lines = text.split(b"\n")
                stay = [line for line, k in zip(lines, line_keys(text, min_chars), strict=True) if k is None or k not in drop]
                kept.append(b"\n".join(stay))
                total.append(len(lines))
                gone.append(len(lines) - len(stay))
            columns = [pa.array(kept, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    counts = f"{plain}, n_lines long, n_dropped long"
    repeated = state.refs.where(F.col("n_docs") >= state.min_docs).select("key", "keeper")
    proposals = docs.select("doc_id", "text").mapInArrow(proposed, "key binary, doc long")
    drops = (
        (proposals if small else probed(proposals, state)).join(repeated, "key")
        .where(F.col("keeper").isNotNull() & ~F.col("doc").eqNullSafe(F.col("keeper"))).groupBy(F.col("doc").alias(owner_name)).agg(F.collect_set("key").alias(drop_name))
    )
    moved = docs.mapInArrow(touched, plain).join(drops, F.col("doc_id").eqNullSafe(F.col(owner_name)), "left").drop(owner_name)
    return docs.mapInArrow(untouched, counts).union(moved.mapInArrow(dropped, counts))
