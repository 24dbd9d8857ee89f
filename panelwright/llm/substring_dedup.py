"""Exact removal of repeated byte strings by a hash-compared suffix sort.

Every byte covered by a ``WIDTH``-byte string that also starts somewhere else goes, in whichever documents the two lie.
No list of all positions is shuffled:

1. Anchors. Each window of WIDTH bytes picks the byte position in it whose ``GRAM`` following bytes hash lowest (the last
   of equals), so equal windows pick the same place. An anchor, the range of windows that picked it and the hash of
   the region they cover are one row; there is about one for every 85 bytes.
2. Anchors meet by the hash of their gram. Regions that are equal as a whole are repeated as a whole.
   Anchors whose gram occurs again, but whose region does not, ask their document for the bytes around them.
3. Suffix sort. The bytes to the right of the anchors of one gram are sorted by a bottom-up merge sort, and so are the
   bytes to their left, backwards. Prefix sums of a polynomial give the hash of any stretch, and a binary search over
   its length gives the common extension of two suffixes, so a comparison takes a logarithmic number of steps. Common
   extensions of neighbours are then compared byte by byte; a false one raises, it is never used.
   A window with d bytes left of its anchor is repeated if another anchor lies in the same interval of
   the right order at depth WIDTH - d and of the left order at depth d.
4. Grams with more than ``HOT`` unresolved anchors don't go to one task: each of their windows becomes a row with its own
   digest, and digests are counted with partial sums.

Defined cases: null or empty text has no bytes; texts shorter than WIDTH stay; rows that repeat a doc_id are told apart by
their text, and equal rows repeat each other; very long texts are whole (cut into overlapping segments); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm import flat
from panelwright.llm.line_dedup import raw_texts
from panelwright.llm.shared import stored

WIDTH = 200
GRAM = 32
SEGMENT = 1 << 19
BUCKET_ROWS = 400_000
HOT = 20_000
PLACE = np.uint64((1 << 22) - 1)

ROW = np.dtype([("doc", np.int64), ("mark", np.int64), ("gram", np.uint64), ("region", np.uint64), ("first", np.int32), ("span", np.uint8), ("lead", np.uint8)])


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width keys, by doubling."""
    out, size = keys, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == width else np.minimum(out[: len(keys) - width + 1], out[width - size :])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on, by doubling."""
    out, size = flat.mixed(data.astype(np.uint64) + np.uint64(1)), 1
    while size < GRAM:
        out = out[:-size] * np.uint64(pow(flat.BASE, size, 1 << 64)) + out[size:]
        size *= 2
    return flat.mixed(out)


def anchors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ROWs of the anchors of a block; doc is the number of the document in it, first counts from its start."""
    import xxhash

    found = []
    choices = WIDTH - GRAM + 1
    lasts = np.maximum(offsets[1:] - WIDTH + 1, offsets[:-1])  # one behind each document's last window
    raw = memoryview(np.ascontiguousarray(data))
    for start in range(0, len(data) - WIDTH + 1, SEGMENT):
        end = min(start + SEGMENT, len(data) - WIDTH + 1)
        grams = gram_hashes(data[start : end + WIDTH - 1])
        places = PLACE - np.arange(len(grams), dtype=np.uint64)
        least = sliding_least((grams & ~PLACE) | places, choices)
        change = np.zeros(end - start + 1, np.int32)
        np.add.at(change, np.clip(offsets[:-1] - start, 0, end - start), 1)
        np.add.at(change, np.clip(lasts - start, 0, end - start), -1)
        windows = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        if not len(windows):
            continue
        at = (PLACE - (least[windows] & PLACE)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)]))
        tails = np.concatenate([heads[1:], [len(windows)]]) - 1
        rows = np.zeros(len(heads), ROW)
        first, last = windows[heads] + start, windows[tails] + start
        rows["doc"] = np.searchsorted(offsets, first, "right") - 1
        rows["gram"] = grams[at[heads]]
        rows["first"] = first - offsets[rows["doc"]]
        rows["span"] = last - first
        rows["lead"] = at[heads] + start - first
        rows["region"] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (last + WIDTH).tolist(), strict=True)]
        found.append(rows)
    return np.concatenate(found) if found else np.zeros(0, ROW)


def packed(rows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Rows by key: the keys and the bytes of their rows, column by column."""
    order = np.argsort(key, kind="stable")
    rows, key = rows[order], key[order]
    edges = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(edges[1:], len(key))[: len(edges)]
    return key[edges], [b"".join(rows[n][a:b].tobytes() for n in rows.dtype.names) for a, b in zip(edges, ends, strict=True)]


def unpacked(blobs, kind: np.dtype) -> np.ndarray:
    parts = []
    for blob in blobs:
        count = len(blob) // kind.itemsize
        rows, at = np.zeros(count, kind), 0
        for name in kind.names:
            size = kind[name].itemsize * count
            rows[name] = np.frombuffer(blob, kind[name], count, at)
            at += size
        parts.append(rows)
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), F.xxhash64(text).alias("mark"))


def met_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc, mark, gram, first, span, lead, full, open) of anchors whose gram occurs again.

    full: the region occurs again as a whole. open: its bytes are needed, for its own windows or for those of others.
    """

    def dealt(batches):
        for batch in batches:
            doc, mark = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "mark"))
            found = []
            for row, data, offsets in flat.blocks(batch.column("text")):
                rows = anchors(data, offsets)
                own = rows["doc"] + row
                rows["doc"], rows["mark"] = doc[own], mark[own]
                found.append(rows)
            rows = np.concatenate(found) if found else np.zeros(0, ROW)
            bucket, blobs = packed(rows, (rows["gram"] % np.uint64(buckets)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        rows = unpacked(group.rows, ROW)
        rows = rows[np.argsort(rows["gram"], kind="stable")]
        heads = np.flatnonzero(np.concatenate([[True], rows["gram"][1:] != rows["gram"][:-1]])[: len(rows)])
        length = np.diff([*heads, len(rows)])[: len(heads)]
        rows = rows[np.repeat(length > 1, length)]
        rows = rows[np.lexsort((rows["lead"], rows["span"], rows["region"], rows["gram"]))]
        gram = np.concatenate([[True], rows["gram"][1:] != rows["gram"][:-1]])[: len(rows)]
        kind = gram.copy()
        for name in ("region", "span", "lead"):
            kind[1:] |= rows[name][1:] != rows[name][:-1]
        of_gram, of_kind = np.cumsum(gram) - 1, np.cumsum(kind) - 1
        full = np.bincount(of_kind, minlength=1)[of_kind] > 1
        kinds = np.bincount(of_gram[kind], minlength=1)[of_gram]
        out = pd.DataFrame({n: rows[n].astype(np.int64) if n != "gram" else rows[n].view(np.int64) for n in ("doc", "mark", "gram", "first", "span", "lead")})
        return out.assign(full=full, open=kind & (kinds > 1), fellows=kinds)

    return (
        keyed(docs).select("doc", "mark", "text").mapInArrow(dealt, "bucket long, rows binary").groupBy("bucket")
        .applyInPandas(meet, "doc long, mark long, gram long, first long, span long, lead long, full boolean, open boolean, fellows long")
    )


class Extensions:
    """Common extensions of byte rows (right-padded matrix) from column 0 on, by prefix hashes."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray):
        self.rows, self.sizes = rows, sizes
        self.sums = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
        np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * flat.powers(flat.BASE, rows.shape[1]), axis=1, out=self.sums[:, 1:])

    def common(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the rows, by binary search over prefix hashes."""
        low, high = np.zeros(len(one), np.int64), np.minimum(self.sizes[one], self.sizes[two])
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                return low
            middle = (low[live] + high[live] + 1) // 2
            same = self.sums[one[live], middle] == self.sums[two[live], middle]
            low[live] = np.where(same, middle, low[live])
            high[live] = np.where(same, high[live], middle - 1)

    def before(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether row one sorts before row two; equal rows by their numbers."""
        length = self.common(one, two)
        ended_one, ended_two = length >= self.sizes[one], length >= self.sizes[two]
        at = np.minimum(length, self.rows.shape[1] - 1)
        less = self.rows[one, at] < self.rows[two, at]
        return np.where(ended_one & ended_two, one < two, np.where(ended_one, True, np.where(ended_two, False, less)))

    def merge_sorted(self, starts: np.ndarray) -> np.ndarray:
        """Row numbers with each group (rows from starts on) sorted: all groups' merges of a width run together."""
        count = len(self.rows)
        order = np.arange(count)
        group = np.zeros(count, np.int64)
        group[starts] = 1
        head = starts[np.cumsum(group) - 1]
        tail = np.concatenate([starts[1:], [count]])[np.cumsum(group) - 1]
        width = 1
        while width < (tail - head).max(initial=0):
            place = np.arange(count)
            block = (place - head) // (2 * width)
            left = head + block * 2 * width
            middle, right = np.minimum(left + width, tail), np.minimum(left + 2 * width, tail)
            own = np.flatnonzero(middle < right)
            first = place[own] < middle[own]
            # Rank in the other run: how many of its rows come before this one.
            low = np.where(first, middle[own], left[own])
            base, high = low.copy(), np.where(first, right[own], middle[own])
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                half = (low[live] + high[live]) // 2
                ahead = self.before(order[half], order[own[live]])
                low[live] = np.where(ahead, half + 1, low[live])
                high[live] = np.where(ahead, high[live], half)
            rank = own - np.where(first, left[own], middle[own]) + (low - base)
            moved = order.copy()
            moved[left[own] + rank] = order[own]
            order = moved
            width *= 2
        return order

    def verified_neighbours(self, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Common extension of each row in order with the one before, -1 at starts, compared byte by byte."""
        out = np.full(len(order), -1, np.int64)
        inner = np.ones(len(order), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        for part in np.array_split(at, len(at) // 20_000 + 1):
            one, two = order[part - 1], order[part]
            out[part] = self.common(one, two)
            equal = (self.rows[one] == self.rows[two]) | (np.arange(self.rows.shape[1]) >= out[part][:, None])
            if not equal.all():
                raise ArithmeticError("prefix hashes of different bytes collide")
        return out


def repeated_windows(gram: np.ndarray, span: np.ndarray, lead: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """(anchor, window) pairs: windows of anchors (sorted by gram) that another anchor repeats."""
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    count = len(gram)
    limit = 2 * WIDTH
    right, left = np.zeros((count, limit), np.uint8), np.zeros((count, limit), np.uint8)
    sizes = np.array([len(t) for t in texts]) - lead
    for n, text in enumerate(texts):
        row = np.frombuffer(text, np.uint8)
        right[n, : sizes[n]] = row[lead[n] :]
        left[n, : lead[n]] = row[: lead[n]][::-1]
    ranks = []
    for side, length in ((right, sizes), (left, lead)):
        suffixes = Extensions(side, length)
        order = suffixes.merge_sorted(starts)
        ranks.append((order, suffixes.verified_neighbours(order, starts)))
    found = []
    for d in range(WIDTH - GRAM + 1):
        own = np.flatnonzero((lead >= d) & (lead - span <= d))
        if len(own) < 2:
            continue
        interval = []
        for (order, common), depth in zip(ranks, (WIDTH - d, d), strict=True):
            of = np.empty(count, np.int64)
            of[order] = np.cumsum(common < depth)
            interval.append(of[own])
        key = interval[0] * (count + 1) + interval[1]
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        again = own[times[back] > 1]
        found.append(np.stack([again, lead[again] - d]))
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def stretches(doc: np.ndarray, mark: np.ndarray, anchor: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """(doc, mark, from, to) of runs of consecutive window starts of the same anchor."""
    order = np.lexsort((start, anchor))
    anchor, start = anchor[order], start[order]
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] > start[:-1] + 1)])[: len(anchor)])
    tail = np.concatenate([head[1:], [len(anchor)]]) - 1 if len(head) else head
    return pd.DataFrame({"doc": doc[anchor[head]], "mark": mark[anchor[head]], "from": start[head], "to": start[tail] + WIDTH})


SPANS = "doc long, mark long, `from` long, `to` long"


def spans(docs: DataFrame, total_bytes: int, hot: int = HOT) -> DataFrame:
    """(doc, mark, from, to) of stretches to remove; they may overlap."""
    met = stored(met_anchors(docs, max(12, -(-total_bytes // (85 * BUCKET_ROWS)))))
    whole = met.where("full").select("doc", "mark", F.col("first").alias("from"), (F.col("first") + F.col("span") + WIDTH).alias("to"))
    wanted = met.where("open")
    lists = stored(wanted.groupBy("doc", "mark").agg(F.collect_list(F.struct("gram", "first", "span", "lead", "fellows")).alias("asked")))
    tasks = max(12, -(-lists.select(F.sum(F.size("asked"))).first()[0] // 10_000)) if lists.take(1) else 12

    def cut(batches):
        for batch in batches:
            columns = {n: [] for n in ("gram", "doc", "mark", "first", "span", "lead", "fellows", "bytes")}
            doc, mark = (batch.column(c).to_pylist() for c in ("doc", "mark"))
            for n, (text, asked) in enumerate(zip(raw_texts(batch.column("text")), batch.column("asked").to_pylist(), strict=True)):
                for a in asked:
                    for name in ("gram", "first", "span", "lead", "fellows"):
                        columns[name].append(a[name])
                    columns["doc"].append(doc[n])
                    columns["mark"].append(mark[n])
                    columns["bytes"].append(text[a["first"] : a["first"] + a["span"] + WIDTH])
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary() if n == "bytes" else pa.int64()) for n, v in columns.items()], names=list(columns)
            )

    context = "gram long, doc long, mark long, first long, span long, lead long, fellows long, bytes binary"
    around = keyed(docs).select("doc", "mark", "text").join(lists, ["doc", "mark"]).mapInArrow(cut, context)

    def sort(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("gram", kind="stable")
        column = {n: group[n].to_numpy() for n in ("gram", "doc", "mark", "first", "span", "lead")}
        anchor, window = repeated_windows(column["gram"], column["span"], column["lead"], list(group.bytes))
        return stretches(column["doc"], column["mark"], anchor, column["first"][anchor] + window)

    grams = around.where(F.col("fellows") <= hot)
    sorted_out = grams.groupBy(F.pmod(F.xxhash64("gram"), F.lit(tasks)).alias("task")).applyInPandas(sort, SPANS)
    parts = [whole, sorted_out]
    if met.where((F.col("fellows") > hot) & F.col("open")).take(1):
        parts.append(_counted_windows(around.where(F.col("fellows") > hot)))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _counted_windows(around: DataFrame) -> DataFrame:
    """The same for anchors of very frequent grams: windows are counted by their digests."""

    def windows(batches):
        import xxhash

        for pdf in batches:
            for row in pdf.itertuples():
                text = row.bytes
                digests = [xxhash.xxh3_128_digest(text[j : j + WIDTH]) for j in range(row.span + 1)]
                yield pd.DataFrame({"digest": digests, "doc": row.doc, "mark": row.mark, "from": row.first + np.arange(row.span + 1)})

    rows = stored(around.select("doc", "mark", "first", "span", "bytes").mapInPandas(windows, "digest binary, doc long, mark long, `from` long"))
    again = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    return rows.join(again, "digest").select("doc", "mark", "from", (F.col("from") + WIDTH).alias("to"))


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): the remaining bytes of each row, and what was removed."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    found = stored(spans(docs, int(total), hot))
    lists = found.groupBy("doc", "mark").agg(F.collect_set(F.struct("from", "to")).alias("spans"))

    def remove(batches):
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            kept, removed, count = [], [], []
            for text, own in zip(texts, batch.column("spans").to_pylist(), strict=True):
                parts, at, gone, runs, end = [], 0, 0, 0, -1
                for start, stop in sorted((s["from"], s["to"]) for s in own or ()):
                    if start > end:
                        runs += 1
                        parts.append(text[at:start])
                        gone += stop - start
                        at = end = stop
                    elif stop > end:
                        gone += stop - end
                        at = end = stop
                kept.append(b"".join([*parts, text[at:]]))
                removed.append(gone)
                count.append(runs)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(v, pa.int64()) for v in ([len(t) for t in texts], removed, count))],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    rows = keyed(docs).join(stored(lists), ["doc", "mark"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(remove, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")

