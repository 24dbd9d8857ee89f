"""Spelling variants: words one edit apart, the form that each word varies, and the root of such chains.

Two words are near if they differ by one inserted, deleted or replaced code point: then their common prefix and suffix
together reach the longer length minus one, so one of them reaches half of it. Words are sorted by that half
(first or last code points, for each longer length M), cut into tiles of padded code-point matrices, and each
pair of tiles that share a half is compared densely: first difference from the front, first difference from the back.
A pair is taken from the prefix order if its prefix reaches the half, else from the suffix order, so once.

Halves shared by more than ``HALF_WORDS`` words are dealt out as pairs of parts, one task each.

Defined cases: a null text has no words; a null doc_id hashes as an empty string; rows that repeat a doc_id count
each. Ties between forms go to the word of smallest code points. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.shared import stored

# Fixed values of the damaged-word rule: letters, alphabet, and one run in so many loses a code point.
RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMAGED = 97

MIN_CHARS = 5
MIN_COUNT = 3
HALF_WORDS = 4096
GROUP_CHARS = 400_000
TILE_ROWS = 128
TILE_BYTES = 1 << 24


def damaged_words(docs: DataFrame, one_in: int = DAMAGED) -> DataFrame:
    """(word) of every run of letters; a run whose hash with the doc_id is divisible by one_in lacks a code point."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUNS), F.lit(0))).alias("_run"),
    )
    hashed = runs.withColumn("_h", F.crc32(F.encode(F.concat("_id", F.lit(":"), "_run"), "UTF-8")))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    return hashed.select(F.when(F.col("_h") % one_in == 0, cut).otherwise(F.col("_run")).alias("word"))


def counted(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of at least so many code points and occurrences; the sums are partly made before the shuffle."""
    return words.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points padded by zeros, the same from the back, and the lengths."""
    sizes = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    if len(points) and points.max() < 256:
        points = points.astype(np.uint8)
    row = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    front, back = (np.zeros((len(words), int(sizes.max(initial=0))), points.dtype) for _ in range(2))
    front[row, place] = points
    back[row, sizes[row] - 1 - place] = points
    return front, back, sizes


def single_edits(a: tuple, b: tuple, longer: int, by_suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of tile a and of tile b that are one edit apart, the longer word having ``longer`` code points.

    From the prefix order only pairs whose prefix reaches half of it are taken, from the suffix order the others.
    """
    prefix = (a[0][:, None, :] != b[0][None, :, :]).argmax(-1)
    suffix = (a[1][:, None, :] != b[1][None, :, :]).argmax(-1)
    fits = (np.maximum(a[2][:, None], b[2][None, :]) == longer) & (prefix + suffix >= longer - 1)
    return np.nonzero(fits & ((prefix < longer // 2) if by_suffix else (prefix >= longer // 2)))


def tile_pairs(halves: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """Ranges (a, b, c, d) of sorted rows to compare, so that any two rows of one half meet once.

    Small halves share a tile; a half of more rows than a tile is cut into several, each pair of which meets.
    """
    rows = max(8, min(TILE_ROWS, int((TILE_BYTES / max(1, width)) ** 0.5)))
    edges = [0, *(np.flatnonzero(halves[1:] != halves[:-1]) + 1).tolist(), len(halves)]
    found, start = [], 0
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - start <= rows:
            continue
        if a > start:
            found.append((start, a, start, a))
        start = a
        if b - a > rows:
            cuts = [*range(a, b, rows), b]
            tiles = list(zip(cuts[:-1], cuts[1:], strict=True))
            found += [(*one, *two) for i, one in enumerate(tiles) for two in tiles[i:]]
            start = b
    if len(halves) > start:
        found.append((start, len(halves), start, len(halves)))
    return found


def near_in_group(table: pa.Table) -> pa.Table:
    """(word, near, best_n, best) of the words of a group with any near one: how many, and the most frequent."""
    group = table.to_pandas().sort_values(["kind", "longer", "half", "word"], kind="stable", ignore_index=True)
    words, n, part = group.word.to_numpy(object), group.n.to_numpy(), group.part.to_numpy()
    ones, twos = [], []
    runs = np.flatnonzero((group.kind.diff() != 0) | (group.longer.diff() != 0)).tolist()
    for a, b in zip(runs, [*runs[1:], len(group)], strict=True):
        longer, kind = int(group.longer[a]), int(group.kind[a])
        halves = pd.factorize(group.half[a:b])[0]
        front, back, sizes = matrices(words[a:b].tolist())
        for p, q, r, s in tile_pairs(halves, front.shape[1]):
            if q - p < 2 and p == r:
                continue
            x, y = single_edits((front[p:q], back[p:q], sizes[p:q]), (front[r:s], back[r:s], sizes[r:s]), longer, kind == 1)
            x, y = x + p + a, y + r + a
            # Two parts of one half meet in their own group; there only pairs across them count.
            keep = (x < y) & ((part[x] != part[y]) | (group.i.iat[0] == group.j.iat[0]))
            ones.append(x[keep])
            twos.append(y[keep])
    x, y = (np.concatenate([np.zeros(0, np.int64), *found]) for found in (ones, twos))
    own, other = np.concatenate([x, y]), np.concatenate([y, x])
    spelled, held = np.unique(words, return_inverse=True)
    own, other_word, other_n = held[own], held[other], n[other]
    order = np.lexsort((other_word, -other_n, own))
    own, other_word, other_n = own[order], other_word[order], other_n[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    near = np.diff(first, append=len(own))
    columns = (spelled[own[first]], near, other_n[first], spelled[other_word[first]])
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("word", "near", "best_n", "best"), columns, kinds, strict=True)})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words with a near one, from distinct (word, n)."""
    size = F.char_length("word")
    ways = F.array(*[
        F.struct(F.lit(kind).alias("kind"), m.alias("longer"), half.alias("half"))
        for m in (size, size + 1)
        for kind, half in ((0, F.left("word", F.floor(m / 2).cast("int"))), (1, F.right("word", F.floor(m / 2).cast("int"))))
    ])
    halves = words.select("word", "n", F.explode(ways).alias("w")).select("word", "n", "w.kind", "w.longer", "w.half")
    key = ["kind", "longer", "half"]
    # Few halves are so common; their number is below that of the words over HALF_WORDS, times four.
    common = halves.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > HALF_WORDS)
    common = common.select(*key, F.ceil(F.col("held") / HALF_WORDS).cast("int").alias("parts"))
    chars = words.agg(F.sum(4 * size)).first()[0] or 0
    groups = max(12, -(-int(chars) // GROUP_CHARS))
    dealt = halves.join(common, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    seed = F.xxhash64(*key)
    spread = dealt.select(
        "word", "n", *key, "part",
        F.when(F.col("parts") > 1, seed).otherwise(F.pmod(seed, F.lit(groups))).alias("g"), (F.col("parts") > 1).alias("split"),
        F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))).alias("with"),
    ).withColumns({"i": F.least("part", "with"), "j": F.greatest("part", "with")})
    made = spread.groupBy("split", "g", "i", "j").applyInArrow(near_in_group, "word string, near long, best_n long, best string")
    return made.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best")
    )


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) pairs: the last word that the forms lead to, by pointer doubling.

    A form has twice the count of its word at least, so chains have 63 words at most and six rounds end them.
    """
    links = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while links.where("moved").limit(1).count():
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(
            links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        )
    return links.select("word", "root")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n).

    The form is the most frequent near word, if it is at least ``times`` as frequent (2 or more).
    """
    words = stored(words.select("word", "n"))
    near = stored(near_words(words))
    known = F.col("best_n") >= times * F.col("n")
    forms = stored(words.join(near, "word").where(known).select("word", F.col("best").alias("form"), F.col("best_n").alias("form_n")))
    counts = words.join(near.select("word", "n_near"), "word", "left")
    return counts.join(forms, "word", "left").join(rooted(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
