"""Document fingerprints by SpotSigs, from DataFrame functions alone.

A spot is a common word (an anchor) together with the next ``CHAIN`` content words among the ``REACH`` words
behind it; content words are all words that are not common. Texts of tables, lists and junk have few common words, so one
word in ``SAMPLED``, chosen by its hash, is an anchor as well. Words are runs of letters and digits in lower case. A
fingerprint is the sorted set of the 32-bit hashes of a text's spots, written as decimal numbers. A text without
spots takes its words in their place, one without words its whole text, an empty text nothing.

Likeness is the Jaccard similarity of two such sets. ``searched`` and ``matches`` search a stated set of queries in all
documents: equal sets are one class, classes are partitioned by length, so that a pair can reach the threshold only inside a
partition or between neighbours, and share one of the first spots of their sets, rare ones first. Alike sets are gathered in blocks, so a
query meets a group of near copies by its few blocks; the sets of the blocks it may be near are then compared, each once. Two different spots may share a 32-bit hash; likeness can then be too high by that spot.
Equal sets are told by 128 bits.

Defined cases: null text is empty; two empty fingerprints have likeness 1; equal texts have equal fingerprints; rows that
repeat a doc_id are followed by one another in the order of their texts; null ids come first; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm.shared import stored

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he his in is it its not of on or that the their they this to was were which with you "
    "aber als am auch auf aus bei das dass dem den der des die du ein eine einem einen einer er es hat ich im ist man mit nach nicht noch sich sie sind so und vom von war wie wir zu zum zur für "
    "au aux avec ce cette dans de elle est et il je la le les leur lui ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous du des en "
    "al como con del el ella ellos era esta este fue ha hay las lo los mas muy no o para pero por se sin sobre su sus una uno y ya que"
).split()
CHAIN = 2
SAMPLED = 6
REACH = 10
BUCKET_ROWS = 500
MOST_BUCKETS = 50_000
SAMPLE = 20_000
TILE = 256
RARE, SLOTS = 4, 1 << 16
FIRST_ID = -(1 << 63)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def spots(text: Column) -> Column:
    """Sorted distinct spot hashes of a text without nulls."""
    anchors = sorted(set(ANCHORS))

    def of(all_words: Column) -> Column:
        found = F.transform(
            all_words,
            lambda w, i: F.when(
                w.isin(anchors) | (F.pmod(F.hash(w), F.lit(SAMPLED)) == 0),
                F.hash(w, F.slice(F.filter(F.slice(all_words, i + 2, REACH), lambda x: ~x.isin(anchors)), 1, CHAIN)),
            ),
        )
        return F.filter(found, lambda h: h.isNotNull())

    def or_else(found: Column, other: Column) -> Column:
        return F.when(F.size(found) > 0, found).otherwise(other)

    # A one-element transform binds the words, so they are split once.
    bound = F.transform(F.array(words(text)), lambda ws: or_else(of(ws), F.transform(ws, lambda w: F.hash(w))))[0]
    plain = F.when(text == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(text)))
    chosen = F.transform(F.array(bound), lambda b: or_else(b, plain))[0]
    return F.array_sort(F.array_distinct(chosen))


def written(fingerprint: Column) -> Column:
    return F.concat_ws(",", fingerprint.cast("array<string>"))


def likeness(one: Column, two: Column) -> Column:
    """Jaccard similarity of two sets; 1 if both are empty."""
    both = F.size(F.array_intersect(one, two))
    return F.when((F.size(one) == 0) & (F.size(two) == 0), F.lit(1.0)).otherwise(both / (F.size(one) + F.size(two) - both))


def id_buckets(docs: DataFrame) -> DataFrame:
    """docs (with key) and its bucket: consecutive ranges of the key, of about BUCKET_ROWS rows."""
    count = docs.count()
    buckets = max(1, min(MOST_BUCKETS, count // BUCKET_ROWS))
    if buckets == 1:
        return docs.withColumn("bucket", F.lit(0))
    shares = [n / buckets for n in range(1, buckets)]
    bounds = sorted(set(docs.agg(F.percentile_approx("key", shares, max(10_000, 10 * buckets))).first()[0]))
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = F.lit(bounds[step - 1 :: step]), F.lit(bounds)
    passed = F.size(F.filter(coarse, lambda b: b <= F.col("key")))
    rest = F.size(F.filter(F.slice(fine, passed * step + 1, F.lit(step)), lambda b: b <= F.col("key")))
    return docs.withColumn("bucket", passed * step + rest)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, spots, and next_text and next_spots of the next document by ascending doc_id; the first follows the last.

    Rows are dealt by ranges of doc_id. The first rows of a range are also sent to the range before it, so a
    window inside a range sees its follower. Ranges are at most MOST_BUCKETS, so their heads may be broadcast.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(FIRST_ID)).alias("key"))
    rows = id_buckets(rows)
    heads = rows.groupBy("bucket").agg(F.min("key").alias("head"))
    order = Window.orderBy("bucket")
    heads = heads.select("bucket", "head", F.lag("bucket").over(order).alias("before"), F.max("bucket").over(Window.partitionBy()).alias("last"))
    heads = heads.select("bucket", F.col("head").alias("key"), F.coalesce("before", "last").alias("before"))
    guests = rows.join(F.broadcast(heads), ["bucket", "key"]).select("doc_id", "text", "key", F.col("before").alias("bucket"), F.lit(1).alias("guest"))
    # Spots are taken behind the shuffle, so only texts travel.
    held = rows.select("doc_id", "text", "key", "bucket", F.lit(0).alias("guest")).union(guests).repartition("bucket").withColumn("spots", spots(F.col("text")))
    turn = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    seen = held.select("doc_id", "text", "spots", "guest", F.lead("text").over(turn).alias("next_text"), F.lead("spots").over(turn).alias("next_spots"))
    return seen.where("guest = 0").drop("guest")


def edits(docs: DataFrame) -> DataFrame:
    """Spots of each text and of its edit, whose last quarter the start of the next document replaces, and their likeness."""
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut)
    )
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
    rows = rows.withColumn("edited_spots", spots(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "spots", "edited_spots",
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def shown(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of ``edits`` with their spots written as fingerprints."""
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("spots")).alias("fingerprint"),
        written(F.col("edited_spots")).alias("edited_fingerprint"), "near_edited", "near_next", *more,
    )


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, and their likeness."""
    return shown(edits(docs))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with spots, written with a number of their own in ``row``."""
    return stored(rows.withColumn("row", F.monotonically_increasing_id()))


def marked(rows: DataFrame) -> DataFrame:
    """Rows with their set's 128-bit mark, by which equal sets are found without moving them."""
    return rows.withColumn("mark", F.struct(F.xxhash64("spots").alias("a"), F.xxhash64(F.lit(1), "spots").alias("b"), F.size("spots").alias("size")))


def spot_classes(rows: DataFrame, asked: Column) -> DataFrame:
    """(mark, class, rows, least, asked) of numbered rows: equal sets are one class, named by its first row, asked if one of its rows is."""
    return stored(
        marked(rows).groupBy("mark").agg(
            F.min("row").alias("class"), F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"),
            F.coalesce(F.max(asked), F.lit(False)).alias("asked"),
        )
    )


def spot_counts(rows: DataFrame, classes: DataFrame) -> Column:
    """SLOTS numbers: how many sets of a sample of the classes hold the commonest spot of each slot, 0 below RARE sets.

    Each spot has one slot. The numbers only order sets, so no result depends on them.
    """
    step = max(1, classes.count() // SAMPLE)
    some = classes.where(F.pmod(F.xxhash64("class"), F.lit(step)) == 0).select("class")
    spread = rows.join(some, rows["row"] == some["class"], "left_semi").select(F.explode("spots").alias("spot"))
    found = spread.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RARE)
    counts = [0] * SLOTS
    for slot, n in found.groupBy(F.pmod("spot", F.lit(SLOTS)).alias("slot")).agg(F.max("n")).collect():
        counts[slot] = n
    # One string, which the optimizer makes an array once, in place of SLOTS literals.
    return F.split(F.lit(",".join(map(str, counts))), ",").cast("array<int>")


def heads_of(rows: DataFrame, classes: DataFrame, at_least: float) -> DataFrame:
    """(class, size, head, part, block, asked) of every class with spots: the beginning of its set, in which two sets of at_least
    share a spot, in the common order, rare spots first, the partition by length, and the block.

    A spot of a head stands behind its number of ``spot_counts`` in one long, by which heads are in order. A block is what sets of one
    partition with the same least spot and the same least hash of a spot have in common, so near copies mostly share one. Blocks only
    gather sets: no result depends on them.
    """
    width = -math.log(at_least) if at_least < 1 else 1.0
    counts = spot_counts(rows, classes)
    size = F.size("spots")
    first = size - F.ceil(size * at_least - 1e-9).cast("int") + 1
    ordered = F.array_sort(F.transform("spots", lambda s: F.get(counts, F.pmod(s, F.lit(SLOTS))).cast("long") * (1 << 32) + s))
    heads = rows.where(size > 0).select(
        F.col("row").alias("class"), size.alias("size"), F.slice(ordered, 1, first).alias("head"),
        F.floor(F.log(size) / width + 1e-9).cast("int").alias("part"),
        F.hash(F.element_at("spots", 1), F.array_min(F.transform("spots", lambda s: F.hash(s)))).alias("block"),
    )
    return heads.join(classes.select("class", "asked"), "class")


def near_blocks(heads: DataFrame, at_least: float) -> DataFrame:
    """(one, part, block) of every asked class and every block that may hold another class of at_least or more.

    A block is met once for each spot in its beginnings, however many sets hold it. Two sets that must share n spots share one
    that has at least n - 1 spots behind it in both, so the first spot that an asked set shares with a near set of the block is met at
    a place that leaves room for the rest. Where a spot leaves no room, by the lengths and the foremost place of the spot
    in the block, it is not met: most spots that sets share by chance.
    """
    near_parts = F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1))
    one = heads.where("asked").withColumn("part", near_parts).select(
        F.col("class").alias("one"), F.col("size").alias("one_size"), "part", F.posexplode("head").alias("one_place", "spot")
    )
    blocks = heads.select("class", "size", "part", "block", F.posexplode("head").alias("place", "spot")).repartition("spot", "part")
    blocks = blocks.groupBy("spot", "part", "block").agg(
        F.min("size").alias("least_size"), F.max("size").alias("most_size"), F.min("place").alias("least_place"),
        F.min("class").alias("least_class"), F.max("class").alias("most_class"),
    )
    only_itself = (F.col("least_class") == F.col("one")) & (F.col("most_class") == F.col("one"))
    # The lengths that a near set of the block may have.
    least = F.greatest(F.col("least_size"), F.ceil(F.col("one_size") * at_least - 1e-9))
    most = F.least(F.col("most_size"), F.floor(F.col("one_size") / at_least + 1e-9))

    def needed(size: Column) -> Column:
        return F.ceil((F.col("one_size") + size) * (at_least / (1 + at_least)) - 1e-9)

    # The room in the asked set is largest for the least length, that in the other set for the largest.
    met = one.join(blocks, ["spot", "part"]).where(
        ~only_itself & (least <= most) & (F.col("one_place") <= F.col("one_size") - needed(least)) & (F.col("least_place") <= most - needed(most))
    )
    return met.select("one", "part", "block").distinct()


def class_pairs(rows: DataFrame, classes: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(one, two, likeness) of every asked class and every other class of at_least or more.

    In any order of spots two such sets share one of their first size - ceil(size * at_least) + 1, here with rare
    spots first, and lie in the same or in neighbouring partitions by length. Asked classes meet blocks of sets by spot and partition;
    then the sets of the blocks that are left are compared, each pair once. Blocks of more than TILE sets are dealt in tiles.
    """
    heads = heads_of(rows, classes, at_least)
    places = stored(heads.select("class", "part", "block"))
    large = places.groupBy("part", "block").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).where("tiles > 1")
    large = F.broadcast(stored(large))
    tiles = F.coalesce("tiles", F.lit(1))
    hits = near_blocks(heads, at_least).join(large, ["part", "block"], "left")
    hits = stored(hits.select("one", "part", "block", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile")))
    held = places.join(large, ["part", "block"], "left").select(F.col("class").alias("two"), "part", "block", F.pmod(F.hash("class"), tiles).alias("tile"))
    held = stored(held.join(hits.select("part", "block", "tile").distinct(), ["part", "block", "tile"], "left_semi"))
    sets = rows.select("row", "spots")
    asked = sets.toDF("one", "one_spots").join(hits, "one")
    given = sets.toDF("two", "two_spots").join(held, "two")
    alike = likeness(F.col("one_spots"), F.col("two_spots"))
    sizes = F.size("one_spots"), F.size("two_spots")
    found = asked.join(given, ["part", "block", "tile"]).where(
        (F.col("one") != F.col("two")) & (F.least(*sizes) >= F.greatest(*sizes) * at_least - 1e-9) & (alike >= at_least - 1e-12)
    )
    return found.select("one", "two", alike.alias("likeness"))


def near_counts(rows: DataFrame, asked: Column, at_least: float = 0.8) -> DataFrame:
    """(mark, n_near, near_first) of the sets of asked numbered rows: how many other rows are at_least alike, the least doc_id of them all.

    Copies are counted by class, never paired. near_first counts the row itself in; rows without a doc_id count, but are never the least.
    """
    classes = spot_classes(rows, asked)
    of = classes.select(F.col("class").alias("two"), "rows", "least")
    others = class_pairs(rows, classes, at_least).join(of, "two").groupBy(F.col("one").alias("class")).agg(
        F.sum("rows").alias("more"), F.min("least").alias("other")
    )
    return classes.where("asked").join(others, "class", "left").select(
        "mark", (F.col("rows") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"), F.least("least", "other").alias("near_first")
    )


def searched(docs: DataFrame, every: int = 20, at_least: float = 0.8) -> DataFrame:
    """``compared``, and what the search by length partitions finds in all rows for those whose doc_id is
    divisible by ``every``: n_near and near_first (null for the others).
    """
    rows = numbered(edits(docs))
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    own = marked(rows.where(asked)).join(near_counts(rows.select("doc_id", "spots", "row"), asked, at_least), "mark", "left")
    rest = rows.where(~asked).withColumns({"n_near": F.lit(None).cast("long"), "near_first": F.lit(None).cast("long")})
    return shown(own.drop("mark").unionByName(rest), "n_near", "near_first")


def matches(docs: DataFrame, queries: DataFrame, at_least: float = 0.8) -> DataFrame:
    """(query_id, doc_id, likeness) of a stated set of queries (doc_id, text) against all docs, from at_least on.

    Texts without words match nothing."""

    def sets(rows: DataFrame, asked: bool) -> DataFrame:
        own = rows.select("doc_id", spots(F.coalesce("text", F.lit(""))).alias("spots"), F.lit(asked).alias("query"))
        return own.where(F.size("spots") > 0)

    rows = numbered(sets(docs, False).union(sets(queries, True)))
    classes = spot_classes(rows, F.col("query"))
    held = marked(rows.select("doc_id", "query", "spots")).join(classes.select("mark", "class"), "mark").select("doc_id", "query", "class")
    pairs = class_pairs(rows, classes, at_least).union(classes.where("asked").select("class", "class", F.lit(1.0)))
    asked = held.where("query").select(F.col("doc_id").alias("query_id"), F.col("class").alias("one"))
    given = held.where(~F.col("query")).select("doc_id", F.col("class").alias("two"))
    return asked.join(pairs, "one").join(given, "two").select("query_id", "doc_id", "likeness")
