"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), and the groups that its links form.

A document is the set of its distinct word n-grams, A-Z lower-cased; one with fewer words is a single
gram, one without words is empty and linked with nothing. Two documents link when
``percent`` / 100 of the union of their sets is shared. The result is exact up to collisions of 64-bit hashes.

1. Equal sets are one class; its smallest doc_id stands for it.
2. Where could links be? A linked document misses at most floor((100 - percent) n / 100) of the grams of
   its partner, so of its grams ordered by (number of documents, hash) one of the first that many plus one is
   in the partner's first ones too. Inverted lists are made of such grams: documents of 128 grams and more
   use the half of the grams whose hash has a leading zero, those that a smaller one could link with use all. Grams travel packed by
   block of documents. Each list proposes only a star to its smallest document, not its pairs.
3. Components of these stars hold every link. Within one, the full inverted index is searched for each
   document: lists are ordered by length, the L longest are set aside (DivideSkip), the short ones are merged,
   and documents found T - L times are probed in the long ones, by binary search or, in the longest, in a bitmap. A document already
   connected with the searching one is passed over, so a group of n near copies costs n links, not n squared.
   Components of more than ``TILE`` grams are cut into tiles, and each pair of tiles is one task.

Defined cases: null or empty text: n_shingles 0 and its own component; rows that repeat a doc_id are one
document with several texts, each row with its own n_shingles; a null doc_id is linked with nothing and has a null component; very
long texts are whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm import flat
from panelwright.llm.components import components
from panelwright.llm.shared import stored

BUCKET_GRAMS = 1_000_000
PACK_GRAMS = 1_000_000
TILE = 2_000_000
HALVED = 128
TOP = np.uint64(1 << 63)
LONG_FACTOR = 0.0085
PROBES = 32
DENSE = 16


def sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct gram hashes end to end, number per document) of each block of texts."""
    for row, data, offsets in flat.blocks(texts):
        count = len(offsets) - 1
        hashes, doc = flat.words(data, offsets, lower=True)
        yield row, *flat.distinct(*flat.grams(hashes, doc, width, count, short=True), count)


def _per_document(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the values of each document, modulo 2**64."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(sizes)
    return sums[ends] - sums[ends - sizes]


def set_digests(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _per_document(flat.mixed(values + np.uint64(5)), sizes), _per_document(flat.mixed(values ^ np.uint64(flat.BASE)), sizes)


def measured(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, one, two): set size and 128-bit digest of each row's set."""

    def measure(batches):
        for batch in batches:
            parts = [(sizes, *set_digests(values, sizes)) for _, values, sizes in sets(batch.column("text"), width)]
            n, one, two = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                names=["doc_id", "n", "one", "two"],
            )

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, n long, one long, two long")


def whole_up_to(percent: int) -> int:
    """The largest set that can link with one of fewer than HALVED grams."""
    return -(-100 * HALVED // percent)


def missing(n: np.ndarray, percent: int) -> np.ndarray:
    """The most grams of a set of n that a linked set can lack."""
    return (100 - percent) * n // 100


def star_links(docs: DataFrame, width: int, percent: int, grams: int) -> DataFrame:
    """(a, b): each document with the smallest document of every list that its first grams are in."""
    buckets = max(16, -(-grams // BUCKET_GRAMS))

    def lists(batches):
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            seen: set[tuple[int, int]] = set()
            found = []
            for row, values, sizes in sets(batch.column("text"), width):
                one, two = set_digests(values, sizes)
                fresh = np.zeros(len(sizes), bool)
                for d in np.flatnonzero(sizes):
                    key = (int(one[d]), int(two[d]))
                    fresh[d] = key not in seen
                    seen.add(key)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                n = sizes[owner]
                for keep, token in (
                    (fresh[owner] & (n >= HALVED) & (values < TOP), values),
                    (fresh[owner] & (n <= whole_up_to(percent)), (flat.mixed(values) >> np.uint64(1)) | TOP),
                ):
                    own = owner[keep]
                    used = np.bincount(own, minlength=len(sizes))
                    found.append((row + own, token[keep], n[keep], used[own]))
            if not found:
                continue
            at, token, n, used = (np.concatenate(p) for p in zip(*found, strict=True))
            doc = ids[at]
            if not len(doc):
                continue
            bucket = (flat.mixed(token) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at, doc, token, n, used, bucket = at[order], doc[order], token[order], n[order], used[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = []
            for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
                starts = np.flatnonzero((np.diff(at[a:b], prepend=-1) != 0) | (np.diff((token[a:b] >> np.uint64(63)).astype(np.int8), prepend=-1) != 0))
                heads = np.stack([doc[a:b][starts], np.diff([*starts, b - a]), n[a:b][starts], used[a:b][starts]])
                rows.append((int(bucket[a]), heads.astype(np.int64).tobytes(), token[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))],
                names=["bucket", "heads", "tokens"],
            )

    def shared(group: pd.DataFrame) -> pd.DataFrame:
        """Per document the grams that others have too, with list length and smallest document."""
        heads = np.concatenate([np.frombuffer(h, np.int64).reshape(4, -1) for h in group.heads], axis=1)
        token = np.concatenate([np.frombuffer(t, np.uint64) for t in group.tokens])
        which = np.repeat(np.arange(heads.shape[1]), heads[1])
        order = np.argsort(token, kind="stable")
        token, which = token[order], which[order]
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff([*edges, len(token)])
        hub = np.minimum.reduceat(heads[0][which], edges)
        keep = np.repeat(length > 1, length)
        rows = np.zeros(int(keep.sum()), SHARED)
        for name, value in (("doc", heads[0][which]), ("n", heads[2][which]), ("used", heads[3][which]), ("token", token), ("df", np.repeat(length, length)), ("hub", np.repeat(hub, length))):
            rows[name] = value[keep]
        part = (flat.mixed(rows["doc"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((rows["doc"], part))
        rows, part = rows[order], part[order]
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        return pd.DataFrame({"part": part[edges].astype(np.int32), "rows": [rows[a:b].tobytes() for a, b in zip(edges, np.append(edges[1:], len(part))[: len(edges)], strict=True)]})

    def stars(group: pd.DataFrame) -> pd.DataFrame:
        """The first grams of each document, rarest first, and the stars that their lists propose."""
        rows = np.concatenate([np.frombuffer(r, SHARED) for r in group.rows])
        level = (rows["token"] >> np.uint64(63)).astype(np.int8)
        rows = rows[np.lexsort((rows["token"], rows["df"], rows["n"], level, rows["doc"]))]
        level = (rows["token"] >> np.uint64(63)).astype(np.int8)
        new = np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (level[1:] != level[:-1]) | (rows["n"][1:] != rows["n"][:-1])])
        edges = np.flatnonzero(new)
        held = np.diff([*edges, len(rows)])
        place = np.arange(len(rows)) - np.repeat(edges, held)
        alone = rows["used"] - np.repeat(held, held)
        first = rows[(place + alone <= missing(rows["n"].astype(np.int64), percent)) & (rows["doc"] != rows["hub"])]
        pairs = np.unique(np.stack([first["doc"], first["hub"]], axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return (
        docs.select("doc_id", "text").mapInArrow(lists, "bucket int, heads binary, tokens binary")
        .groupBy("bucket").applyInPandas(shared, "part int, rows binary")
        .groupBy("part").applyInPandas(stars, "a long, b long").distinct()
    )


SHARED = np.dtype([("doc", np.int64), ("hub", np.int64), ("token", np.uint64), ("n", np.int32), ("used", np.int32), ("df", np.int32)])


def search(ids: np.ndarray, sizes: np.ndarray, values: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect all linked documents among those given, by T-occurrence search.

    values has each document's distinct grams end to end; the links found form a forest.
    """
    count = len(sizes)
    owner = np.repeat(np.arange(count), sizes)
    order = np.lexsort((owner, values))
    ranked = values[order]
    list_of = np.empty(len(values), np.int64)
    list_of[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])) if len(values) else 0
    posted = owner[order]
    lists = list_of[order]
    lengths = np.bincount(lists)
    heads = np.cumsum(lengths) - lengths
    keys = lists * count + posted
    ends = np.cumsum(sizes)
    # Very long lists are bitmaps as well, where a probe is one look: at most DENSE bytes for each posting.
    dense = np.flatnonzero(lengths * DENSE >= max(count, 16 * DENSE))
    bitmap_of = np.full(len(lengths), -1, np.int64)
    bitmap_of[dense] = np.arange(len(dense))
    bitmap = np.zeros((len(dense), count), bool)
    inside = bitmap_of[lists] >= 0
    bitmap[bitmap_of[lists[inside]], posted[inside]] = True
    root = np.arange(count)
    members: dict[int, list[int]] = {}
    links = []

    def join(x: int, y: int) -> None:
        one, two = root[x], root[y]
        small, large = sorted((one, two), key=lambda r: len(members.get(r, (r,))))
        moved = members.pop(small, [small])
        members.setdefault(large, [large]).extend(moved)
        root[moved] = large
        links.append((int(ids[x]), int(ids[y])))

    for x in range(count):
        own = list_of[ends[x] - sizes[x] : ends[x]]
        own = own[lengths[own] > 1]
        need = -(-percent * int(sizes[x]) // 100)
        if len(own) < need or need == 0:
            continue
        own = own[np.argsort(lengths[own], kind="stable")]
        aside = min(need - 1, int(need / (LONG_FACTOR * np.log2(lengths[own[-1]]) + 1)))
        short, long = own[: len(own) - aside], own[len(own) - aside :]
        spans = lengths[short]
        at = np.repeat(heads[short] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        near, hits = np.unique(posted[at], return_counts=True)
        least = -(-percent * (sizes[near] + sizes[x]) // (100 + percent))  # the overlap that a link with each takes
        keep = (near < x) & (hits >= least - len(long)) & (root[near] != root[x])
        near, hits = near[keep], hits[keep]
        order = np.argsort(-hits, kind="stable")
        near, hits = near[order], hits[order]
        mapped, listed = bitmap_of[long], long[bitmap_of[long] < 0]
        mapped = mapped[mapped >= 0]
        while len(near):
            now, got = near[:PROBES], hits[:PROBES].copy()
            if len(mapped):
                got += bitmap[mapped[:, None], now[None, :]].sum(0)
            if len(listed):
                probe = (listed[None, :] * count + now[:, None]).ravel()
                place = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                got += (keys[place] == probe).reshape(len(now), -1).sum(1)
            for y in now[100 * got >= percent * (sizes[x] + sizes[now] - got)]:
                if root[y] != root[x]:
                    join(x, int(y))
            near, hits = near[PROBES:], hits[PROBES:]
            apart = root[near] != root[x]
            near, hits = near[apart], hits[apart]
    return links


def verified_links(docs: DataFrame, members: DataFrame, width: int, percent: int, packs: int) -> DataFrame:
    """(a, b) forest of true links among members (node, tiles, block): documents that could link."""
    wanted = docs.select("doc_id", "text").join(members, F.col("doc_id") == F.col("node")).select("doc_id", "text", "block", "tiles")

    def packed(batches):
        for batch in batches:
            groups, ids, blobs = [], [], []
            block, tiles = batch.column("block").to_pylist(), batch.column("tiles").to_pylist()
            doc_id = batch.column("doc_id").to_pylist()
            for row, values, sizes in sets(batch.column("text"), width):
                ends = np.cumsum(sizes)
                for d in np.flatnonzero(sizes):
                    r = row + int(d)
                    blob = values[ends[d] - sizes[d] : ends[d]].tobytes()
                    seed = flat.mixed(np.array([block[r], doc_id[r]], np.int64).view(np.uint64))
                    if tiles[r] == 1:
                        places = [f"p{int(seed[0] % np.uint64(packs))}"]
                    else:
                        own = int(seed[1] % np.uint64(tiles[r]))
                        places = [f"{block[r]}:{min(own, t)}:{max(own, t)}" for t in range(tiles[r])]
                    groups += places
                    ids += [doc_id[r]] * len(places)
                    blobs += [blob] * len(places)
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.string()), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["pack", "doc_id", "grams"]
            )

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")
        parts = [np.frombuffer(g, np.uint64) for g in group.grams]
        links = search(group.doc_id.to_numpy(), np.array([len(p) for p in parts]), np.concatenate(parts), percent)
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return wanted.mapInArrow(packed, "pack string, doc_id long, grams binary").groupBy("pack").applyInPandas(joined, "a long, b long")


def linked(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    sizes = stored(measured(docs, width))
    full = sizes.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(full.groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep")))
    grams = classes.select(F.sum(F.when(F.col("n") > whole_up_to(percent), F.col("n") / 2).otherwise(F.col("n")))).first()[0] or 0
    proposed = star_links(docs, width, percent, int(grams))
    copies = full.select("n", "one", "two", "doc_id").join(classes, ["n", "one", "two"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    copies = stored(copies)
    blocks = components(proposed.union(copies))
    nodes = stored(
        classes.select(F.col("rep").alias("node"), "n").join(blocks, "node", "left").select("node", "n", F.coalesce("root", "node").alias("block"))
    )
    weights = nodes.groupBy("block").agg(F.sum("n").alias("grams"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    weights = stored(weights.select("block", "grams", F.ceil(F.col("grams") / TILE).cast("int").alias("tiles")))
    members = stored(nodes.join(weights, "block").select("node", "block", "tiles").distinct())
    total = weights.where("tiles = 1").agg(F.sum("grams")).first()[0] or 0
    links = stored(verified_links(docs, members, width, percent, max(12, -(-int(total) // PACK_GRAMS))))
    found = components(links.union(copies))
    return (
        sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    )
