import random
import re
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import components, ngram_join, spotsigs
from text_rows import sentence


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def groups(rows, width, percent):
    """(doc_id, set size, smallest linked doc_id) by comparing all pairs."""
    sets = [(r[0], shingles(r[1], width)) for r in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            one, two = sorted((find(a), find(b)))
            root[two] = one
    return sorted((d, len(s), find(d)) for d, s in sets)


def found(docs, width, percent):
    return sorted(map(tuple, ngram_join.linked(docs, width, percent).collect()))


@pytest.fixture(scope="module")
def families():
    """A group of near copies of every likeness around the thresholds, in long and short texts."""
    rng = random.Random(9)
    rows = []
    for words, copies in ((300, 25), (150, 20), (40, 20), (12, 20), (5, 10)):
        base = sentence(rng, words).split(" ")
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, words // 30))):
                own[rng.randrange(len(own))] = f"w{rng.randrange(9)}"
            if rng.random() < 0.3:
                own = own[: -rng.randint(1, 3)]
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.2 else " ".join(own)))
    return rows


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_groups_match_all_pairs(spark, docs, corpus, families, width, percent):
    rows = families + [(10_000 + r[0], r[1]) for r in corpus]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = groups(rows, width, percent)
    assert len({r[2] for r in want}) < len({r[0] for r in want}) - 20
    assert found(table, width, percent) == want


def test_tiles_and_shuffles_give_the_same(spark, families, monkeypatch):
    table = spark.createDataFrame(families, "doc_id long, text string").repartition(4)
    want = groups(families, 4, 85)
    monkeypatch.setattr(ngram_join, "TILE", 1000)
    monkeypatch.setattr(ngram_join, "BUCKET_GRAMS", 500)
    assert found(table, 4, 85) == want


def test_null_ids_and_empty_tables(spark, no_docs):
    assert ngram_join.linked(no_docs).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, None), (10, "")]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(None, 3, None), (4, 3, 2), (2, 3, 2), (9, 0, 9), (10, 0, 10)}


def test_repeated_ids_in_every_row_order(spark):
    """A doc_id with two texts of unlike length keeps the links of both."""
    rng = random.Random(21)
    words = sentence(rng, 103).split(" ")
    other = [f"u{n}" for n in range(103)]
    rows = [(2, " ".join(other)), (2, " ".join(words[:23])), (1, " ".join([*words[:22], "changed"]))]
    assert {(d, r) for d, _, r in groups(rows, 4, 85)} >= {(1, 1), (2, 1)}
    for order in permutations(rows):
        table = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        assert {(r.a, r.b) for r in ngram_join.star_links(table, 4, 85, 300).collect()} == {(2, 1)}
    table = spark.createDataFrame([rows[0], rows[1], rows[2]], "doc_id long, text string").coalesce(1)
    assert {(r.doc_id, r.component_id) for r in ngram_join.linked(table).collect()} == {(1, 1), (2, 1)}


def test_components_of_a_chain(spark):
    chain = list(range(200))
    random.Random(2).shuffle(chain)
    edges = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)) + [(500, 500), (600, 601)], "a long, b long")
    out = {r.node: r.root for r in components.components(edges).collect()}
    assert out == {n: 0 for n in range(1, 200)} | {601: 600}
    assert components.components(edges.limit(0)).count() == 0


def test_search_finds_no_false_link():
    ids, sizes = np.arange(3), np.array([3, 3, 3])
    values = np.array([1, 2, 3, 1, 2, 4, 7, 8, 9], np.uint64)
    assert ngram_join.search(ids, sizes, values, 50) == [(1, 0)]
    assert ngram_join.search(ids, sizes, values, 51) == []


def likeness(one, two):
    a, b = ({x for x in f.split(",") if x} for f in (one, two))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, corpus):
    out = spotsigs.compared(docs).collect()
    assert len(out) == len(corpus)
    ordered = sorted(corpus, key=lambda r: (r[0], r[1] or ""))
    by_id = {r.doc_id: r for r in out}
    for n, row in enumerate(ordered):
        text, follower = row[1] or "", ordered[(n + 1) % len(ordered)]
        got = by_id[row[0]]
        assert got.n_chars == len(text)
        assert abs(got.near_edited - likeness(got.fingerprint, got.edited_fingerprint)) < 1e-12
        if row[0] != follower[0] and row[0] != ordered[n - 1][0]:
            assert abs(got.near_next - likeness(got.fingerprint, by_id[follower[0]].fingerprint)) < 1e-12
            import hashlib

            cut = len(text) // 4
            edited = text[: len(text) - cut] + (follower[1] or "")[:cut]
            assert got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    prints = {}
    for row in corpus:
        prints.setdefault(row[1] or "", set()).add(by_id[row[0]].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_next_across_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 2)
    rows = [(n * n if n else None, f"text {n}") for n in range(40)]
    out = {r.doc_id: r.next_text for r in spotsigs.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert out == {rows[n][0]: rows[(n + 1) % 40][1] for n in range(40)}


def test_spots_follow_common_words(spark):
    rows = [(1, "The stone of winter"), (2, "the STONE, of: winter!"), (3, "!!"), (4, ""), (5, None)]
    out = {r.doc_id: r for r in spotsigs.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].fingerprint == out[2].fingerprint and out[1].near_next == 1.0
    assert out[3].fingerprint and out[4].fingerprint == out[5].fingerprint == ""
    assert spotsigs.compared(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_matches_of_stated_queries(spark, docs):
    queries = docs.where("doc_id % 20 = 0")
    got = {(r.query_id, r.doc_id): r.likeness for r in spotsigs.matches(docs, queries, 0.6).collect()}
    prints = {r.doc_id: r.fingerprint for r in spotsigs.compared(docs).collect()}
    want = {
        (q, d): likeness(prints[q], prints[d]) for q in prints if q % 20 == 0 for d in prints if prints[q] and prints[d] and likeness(prints[q], prints[d]) >= 0.6
    }
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def plain_spots(text):
    """The spots of a text by a plain walk over its words, as (anchor, following content words)."""
    anchors = set(spotsigs.ANCHORS)
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    return {
        (w, *[x for x in words[n + 1 : n + 1 + spotsigs.REACH] if x not in anchors][: spotsigs.CHAIN]) for n, w in enumerate(words) if w in anchors
    }


def test_spots_by_a_plain_walk(spark, monkeypatch):
    """Without hash-chosen anchors, the likeness of neighbours is that of plainly walked spots."""
    monkeypatch.setattr(spotsigs, "SAMPLED", 1 << 30)
    rng = random.Random(3)
    base = [sentence(rng, 60) + " the of and in " + sentence(rng, 30) + " with the a" for _ in range(6)]
    texts = [v for b in base for v in (b, b.replace("the", "The,", 1).upper(), " ".join(b.split()[:70]) + " of it all")]
    out = {r.doc_id: r for r in spotsigs.compared(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for n, text in enumerate(texts):
        one, two = plain_spots(text), plain_spots(texts[(n + 1) % len(texts)])
        assert one and len(out[n].fingerprint.split(",")) == len(one)
        assert abs(out[n].near_next - len(one & two) / len(one | two)) < 1e-12


def test_search_counts_near_rows(spark, docs, corpus):
    """Every query row's count of near rows, against all pairs; copies, empty texts and repeated rows count by row."""
    odd = [(20 * n, t) for n, t in enumerate([None, "", "!!", "!!", "the stone of winter"], 5000)] + [(None, "the stone of winter"), (-40, "")]
    rows = [(r[0], r[1]) for r in corpus] + odd + odd[:1] + [(r[0] + 100_000, r[1]) for r in corpus[:60]]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spots", F.lit("x")).withColumn("n", F.lit(1)).repartition(5)
    out = spotsigs.searched(table, at_least=0.7).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None or r.doc_id % 20:
            assert r.n_near is None and r.near_first is None
            continue
        near = [o.doc_id for o in out if likeness(r.fingerprint, o.fingerprint) >= 0.7]
        assert (r.n_near, r.near_first) == (len(near) - 1, min(d for d in near if d is not None))
    assert sum((r.n_near or 0) > 0 for r in out) > 5
    assert spotsigs.searched(table.limit(0)).count() == 0


def test_a_group_of_near_copies_is_met_by_blocks(spark, monkeypatch):
    """Far fewer rows than pairs are kept of a large group of differing near copies, and no pair is lost."""
    rng = random.Random(5)
    base = [f"w{n}" for n in range(160)]
    texts = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in base) for _ in range(240)]
    texts += [" ".join(base[: 100 + n]) for n in range(0, 60, 3)] + [texts[0], "alone of its kind", ""]
    rows = [(20 * n, text) for n, text in enumerate(texts)]
    counts, stored = [], spotsigs.stored

    def counting(df):
        out = stored(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(spotsigs, "stored", counting)
    monkeypatch.setattr(spotsigs, "TILE", 16)
    out = {r.doc_id: r for r in spotsigs.searched(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    sets = {i: set(r.fingerprint.split(",")) if r.fingerprint else set() for i, r in out.items()}
    pairs = 0
    for i, r in out.items():
        near = [j for j in sets if j != i and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
        pairs += len(near)
        assert (r.n_near, r.near_first) == (len(near), min([i, *near]))
    assert pairs > 20_000 and max(counts) < pairs / 3


def test_spots_shared_by_chance_are_seldom_met(spark, monkeypatch):
    """Sets that share fairly common spots, none in 2 % of them, meet in few rows, and every near pair is found."""
    rng = random.Random(8)
    sets = [{rng.randrange(-2400, 2400) for _ in range(rng.randint(90, 110))} | {rng.randrange(10**5, 10**9) for _ in range(50)} for _ in range(300)]
    for n in range(1, 61):
        one = sorted(sets[n])
        sets.append(set(one[: len(one) - n % 30]) | {2 * 10**9 + rng.randrange(10**8) for _ in range(n % 7)})
    table = spark.createDataFrame([(n, n, sorted(s)) for n, s in enumerate(sets)], "doc_id long, row long, spots array<int>").repartition(5)
    classes = spotsigs.spot_classes(table, F.lit(True))
    met, where = [], type(table).where

    def noting(df, condition):
        out = where(df, condition)
        if {"one", "spot"} <= set(out.columns):
            met.append(out)
        return out

    monkeypatch.setattr(type(table), "where", noting)
    got = {(r.one, r.two) for r in spotsigs.class_pairs(table, classes).collect()}
    near = {(a, b) for a, b in permutations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert got == near and len(near) > 80
    counts = [rows.count() for rows in met]
    assert len(counts) == 1 and counts[0] < 6000


@pytest.mark.parametrize("at_least", [0.35, 0.5, 0.8, 0.9, 1.0])
def test_pairs_at_the_threshold(spark, monkeypatch, at_least):
    """Sets of every length around the least likeness, by common and rare spots, against all pairs."""
    monkeypatch.setattr(spotsigs, "SLOTS", 16)
    rng = random.Random(int(100 * at_least))
    sets = {frozenset([n]) for n in range(3)}
    for size in (2, 3, 5, 9, 10, 20, 45, 100):
        base = rng.sample(range(-200, 200), size)
        for _ in range(12):
            kept = rng.sample(base, rng.randint(max(1, int(size * at_least) - 1), size))
            sets.add(frozenset(kept) | frozenset(rng.randrange(-10**6, 10**6) for _ in range(rng.randint(0, max(1, size // 8)))))
    sets = sorted(sets, key=sorted)
    table = spark.createDataFrame([(n, n, sorted(s)) for n, s in enumerate(sets)], "doc_id long, row long, spots array<int>").repartition(5)
    got = {(r.one, r.two): r.likeness for r in spotsigs.class_pairs(table, spotsigs.spot_classes(table, F.col("doc_id") % 2 == 0), at_least).collect()}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in permutations(range(len(sets)), 2) if a % 2 == 0}
    want = {pair: x for pair, x in alike.items() if x >= at_least}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
