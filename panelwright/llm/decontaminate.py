"""Benchmark decontamination by templates: re-parameterised questions are caught with the plain ones.

A text is cut into words and marks are dropped. Numbers (digits or number words), names (words with a
capital first letter) and units of measure become typed placeholders; every other word stays, without case.
Since a capital tells names apart only where others are lower case, a second template keeps names as words without
case; so copies in upper, lower or title case are found, with numbers and units changed too, but not with
names changed. Windows of ``WINDOW`` words with at least ``PLAIN`` plain words in either template are
hash-joined by it between benchmark and documents; all others are joined by their exact words without case, so items
made of numbers, names and units are found as verbatim copies. A bitmap of fixed size, made from all benchmark windows,
sits in front of the join, so that only windows likely to match are shuffled; false bits cost rows, never results.

Matches of one document and item at one shift are one alignment. Its slots have to be consistent: one
benchmark value always stands for one document value, while two may stand for the same one, as drawn values can be alike.
A window with a benchmark value that has several document values counts only if all its slots are unchanged. A window counts once, by whichever key it met. An item leaks into a document
if at least ``COVER`` of its windows count: of those with enough plain words in the typed template, of those with enough
in either, or of all; the largest share is reported.
Windows are hashed by 64 bits; the words of matching windows are compared again by their own hashes.

Defined cases: null or empty texts match nothing; an item with fewer words than a window is one shorter window, searched
at every place of the documents, or, with fewer than ``PLAIN`` words, among documents of these words alone; a null id is an ordinary value; repeated
documents or items are reported alike; very long texts are whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm import flat
from panelwright.llm.shared import stored

WINDOW = 8
PLAIN = 4
COVER = 0.5
BITS = 1 << 22

# Words that are numbers, and units of measure, lower case.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen"
).split()
UNIT_WORDS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds lb lbs ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur "
    "mph kph degree degrees percent watt watts volt volts joule joules newton newtons"
).split()

# Kinds of window keys, and levels of windows.
TYPED, FOLDED, EXACT = 0, 1, 2
LEVELS = 3
NUMBER, NAME, UNIT = (np.uint64(n) for n in (101, 103, 107))
# Word bytes: letters, digits, and all bytes above 127; the rest separates.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, np.int64)
DIGIT[48:58] = 1
# A numeral may hold a point or comma between its digits.
INNER = np.zeros(256, bool)
INNER[[44, 46]] = True


def _hashes(words: list[str]) -> np.ndarray:
    data = "\n".join(words).encode()
    return np.sort(flat.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0])


NUMBERS, UNITS = _hashes(NUMBER_WORDS), _hashes(UNIT_WORDS)


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Words(NamedTuple):
    """Every word of a block: its hash without case, both templates, which words are slots of either, its document."""

    word: np.ndarray
    typed: np.ndarray
    folded: np.ndarray
    slot: np.ndarray
    hard: np.ndarray
    doc: np.ndarray


def _inside(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes belong to words; a numeral may hold points and commas."""
    inside = WORD[data]
    if len(data) > 2:
        digits = DIGIT[data] > 0
        inside[1:-1] |= INNER[data[1:-1]] & digits[:-2] & digits[2:]
        at = offsets[(offsets > 0) & (offsets < len(data))]
        inside[at] &= WORD[data[at]]
        inside[at - 1] &= WORD[data[at - 1]]
    return inside


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block without case. Letters become letters, so that the words stay the same in number and order."""
    if not len(data) or data.max() < 128:
        return flat.LOWER[data], offsets
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    texts = pc.utf8_lower(pc.utf8_upper(pc.replace_substring(pc.replace_substring(texts, "\u1e9e", "ss"), "\u00df", "ss")))
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def templates(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of a block. Numbers and units are slots of both templates, names of the typed one alone."""
    starts, ends, doc = flat.runs(_inside(data, offsets), offsets)
    if not len(starts):
        none, flags = np.zeros(0, np.uint64), np.zeros(0, bool)
        return Words(none, none, none, flags, flags, doc)
    small, bounds = _folded(data, offsets)
    small_starts, small_ends, _ = flat.runs(_inside(small, bounds), bounds)
    lower = flat.run_hashes(small, small_starts, small_ends)
    digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
    number = (digits[ends] > digits[starts]) | _among(lower, NUMBERS)
    unit = ~number & _among(lower, UNITS)
    hard = number | unit
    folded = np.where(number, NUMBER, np.where(unit, UNIT, lower))
    return Words(lower, np.where(~hard & capital, NAME, folded), folded, hard | capital, hard, doc)


class Windows(NamedTuple):
    """First word, length, level, kind and hash of each window and kind of key."""

    first: np.ndarray
    length: np.ndarray
    level: np.ndarray
    kind: np.ndarray
    hash: np.ndarray


def windows(text: Words, documents: int, lengths: Sequence[int] | None = None) -> Windows:
    """The keys of each window. Without lengths, a text shorter than a window is one window; else windows of these lengths are cut.

    Level 0 has enough plain words beside names, numbers and units, level 1 beside numbers and units, level 2 has not.
    The typed key is left out where there is no name, because the folded one is the same there; level 2 has the key of
    its exact words. A window of less than PLAIN words has to be the whole text.
    """
    counts = np.bincount(text.doc, minlength=documents)
    left = np.cumsum(counts)[text.doc] - np.arange(len(text.doc))
    inside = [np.concatenate([[0], np.cumsum(flags)]) for flags in (text.slot, text.hard)]
    out = []
    for size in range(1, WINDOW + 1) if lengths is None else lengths:
        whole = left >= size
        if size < (WINDOW if lengths is None else PLAIN):
            whole &= counts[text.doc] == size
        first = np.flatnonzero(whole)
        slots, hard = (total[first + size] - total[first] for total in inside)
        level = np.where(size - slots >= PLAIN, 0, np.where(size - hard >= PLAIN, 1, 2))
        keys = {TYPED: (text.typed, (level == 0) & (slots > hard)), FOLDED: (text.folded, level < 2), EXACT: (text.word, level == 2)}
        for kind, (template, some) in keys.items():
            at = first[some]
            value = np.full(len(at), size + (WINDOW + 1) * kind, np.uint64)
            for j in range(size):
                value = flat.mixed(value * np.uint64(flat.BASE) + template[at + j])
            out.append(Windows(at, np.full(len(at), size), level[some], np.full(len(at), kind), value))
    return Windows(*(np.concatenate(part) for part in zip(*out, strict=True)))


FIELDS = "window long, place int, level int, words array<long>, slots array<long>"


def _once(found: Windows, doc: np.ndarray) -> np.ndarray:
    """Which windows stay when exact ones, which need no alignment, are listed once a document."""
    exact = np.flatnonzero(found.kind == EXACT)
    order = exact[np.lexsort((found.hash[exact], doc[found.first[exact]]))]
    stay = np.ones(len(found.first), bool)
    stay[order[1:]] = (found.hash[order[1:]] != found.hash[order[:-1]]) | (doc[found.first[order[1:]]] != doc[found.first[order[:-1]]])
    return stay


def _window_rows(texts: pa.Array, keep, lengths: Sequence[int] | None) -> tuple[list, ...]:
    """Row, hash, word position, level, template words and slot values of the windows that keep(hashes) lets pass."""
    owner, hashes, places, levels, words, slots = [], [], [], [], [], []
    for row, data, offsets in flat.blocks(texts):
        count = len(offsets) - 1
        text = templates(data, offsets)
        if not len(text.word):
            continue
        found = windows(text, count, lengths)
        at = keep(found.hash)
        found = Windows(*(part[at] for part in found))
        if lengths is not None:
            at = _once(found, text.doc)
            found = Windows(*(part[at] for part in found))
        counts = np.bincount(text.doc, minlength=count)
        heads = np.cumsum(counts) - counts
        template = (text.typed, text.folded, text.word)
        value = [np.where(flags, text.word, np.uint64(0)).view(np.int64) for flags in (text.slot, text.hard, False)]
        for f, size, level, kind, w in zip(*(part.tolist() for part in found._replace(hash=found.hash.view(np.int64))), strict=True):
            d = text.doc[f]
            owner.append(row + int(d))
            hashes.append(w)
            places.append(f - int(heads[d]))
            levels.append(level)
            words.append(template[kind][f : f + size].view(np.int64))
            slots.append(value[kind][f : f + size])
    return owner, hashes, places, levels, words, slots


def window_table(rows: DataFrame, key: str, bitmap: np.ndarray | None = None, lengths: Sequence[int] | None = None) -> DataFrame:
    """(key, window, place, level, words, slots) of each window of the text column, those outside the bitmap left out."""
    held = None if bitmap is None else rows.sparkSession.sparkContext.broadcast(bitmap)

    def keep(window: np.ndarray) -> np.ndarray:
        if held is None:
            return np.arange(len(window))
        return np.flatnonzero(held.value[(window & np.uint64(BITS - 1)).astype(np.int64)])

    def cut(batches):
        for batch in batches:
            ids = batch.column(key)
            owner, hashes, places, levels, words, slots = _window_rows(batch.column("text"), keep, lengths)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(owner, pa.int64())), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), pa.array(levels, pa.int32()),
                    pa.array(words, pa.list_(pa.int64())), pa.array(slots, pa.list_(pa.int64())),
                ],
                names=[key, "window", "place", "level", "words", "slots"],
            )

    return rows.select(key, "text").mapInArrow(cut, f"{key} long, {FIELDS}")


def _up_to(level: int) -> Column:
    """How many different windows of a level or a lower one there are."""
    return F.count_distinct(F.when(F.col("level") <= level, F.struct("place", "level")))


def leaks(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """(doc_id, item_id, hits, windows, share): items that leak into documents, and how many of their windows.

    Only the bitmap, whose size is fixed, comes to the driver; windows meet by a shuffled hash join unless
    Spark finds the benchmark's side small.
    """
    items = stored(window_table(benchmark, "item_id"))
    bits = items.select(F.col("window").bitwiseAND(F.lit(BITS - 1)).alias("bit")).distinct()
    bitmap = np.zeros(BITS, bool)
    bitmap[[row.bit for row in bits.toLocalIterator()]] = True
    lengths = sorted({WINDOW} | {row[0] for row in items.select(F.size("words")).distinct().collect()})  # WINDOW rows at most
    reach = items.groupBy("item_id").agg(*[_up_to(n).alias(f"windows_{n}") for n in range(LEVELS)])
    found = window_table(docs, "doc_id", bitmap, lengths).drop("level").withColumnsRenamed({"place": "at", "words": "doc_words", "slots": "doc_slots"})
    met = found.join(items, "window").where("words = doc_words").drop("words", "doc_words")
    pairs = F.filter(F.arrays_zip("slots", "doc_slots"), lambda p: p["slots"] != 0)
    window = F.struct("place", "level", "slots", (F.col("slots") == F.col("doc_slots")).alias("same"))
    aligned = met.groupBy("doc_id", "item_id", (F.col("at") - F.col("place")).alias("shift")).agg(
        F.collect_set(window).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(pairs)))).alias("pairs")
    )
    # Different pairs of one benchmark value are neighbours in the sorted pairs.
    clashes = F.aggregate(
        "pairs",
        F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<long>").alias("values")),
        lambda a, p: F.struct(
            p["slots"].alias("last"), F.when(p["slots"] == a["last"], F.array_append(a["values"], p["slots"])).otherwise(a["values"]).alias("values")
        ),
        lambda a: a["values"],
    )
    kept = aligned.select("doc_id", "item_id", clashes.alias("clashes"), F.explode("found").alias("met")).select(
        "doc_id", "item_id", "clashes", "met.*"
    ).where(F.col("same") | ~F.arrays_overlap("slots", "clashes"))
    best = kept.groupBy("doc_id", "item_id").agg(*[_up_to(n).alias(f"hits_{n}") for n in range(LEVELS)])
    reach = reach.withColumnRenamed("item_id", "item")
    shares = F.array_max(F.array(*[
        F.struct(F.coalesce(F.try_divide(f"hits_{n}", f"windows_{n}"), F.lit(0.0)).alias("share"), F.col(f"windows_{n}").alias("windows"), F.col(f"hits_{n}").alias("hits"))
        for n in range(LEVELS)
    ]))
    scored = best.join(reach, F.col("item_id").eqNullSafe(F.col("item"))).select("doc_id", "item_id", shares.alias("best"))
    return scored.select("doc_id", "item_id", "best.hits", "best.windows", "best.share").where(F.col("share") >= cover)
