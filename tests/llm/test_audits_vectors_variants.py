import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from panelwright.llm import filter_audit, spelling, vantage
from text_rows import sentence

VECTORS = "vec_id long, embedding array<float>"


def brute_nearest(rows, queries, k):
    """{query: [(score, vec_id)]} by comparing all rows; rows are (vec_id, list) with finite, non-zero lists."""
    width = max(len(v) for _, v in rows)
    matrix = np.array([list(np.float32(v).astype(float)) + [0.0] * (width - len(v)) for _, v in rows])
    ids = np.array([i for i, _ in rows])
    length = np.sqrt((matrix**2).sum(1))
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        score = (matrix * matrix[at]).sum(1) / (length * length[at])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(float(score[j]), int(ids[j])) for j in order]
    return out


def answers(table, queries, **options):
    out = {}
    for r in sorted(vantage.nearest(table, queries, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


@pytest.fixture(scope="module")
def clustered():
    """Vectors around 20 centres, a third of all rows being one vector, and scaled copies."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 12))
    rows = [(n, (centres[n % 20] + rng.normal(scale=0.2, size=12)).astype(np.float32).tolist()) for n in range(600)]
    rows += [(n, rows[7][1]) for n in range(600, 880)] + [(900 + n, [4.0 * x for x in rows[n][1]]) for n in range(10)]
    return rows


def test_exact_search_equals_all_pairs(spark, clustered):
    table = spark.createDataFrame(clustered, VECTORS).repartition(5)
    got = answers(table, table.where("vec_id % 20 = 0"), k=5, factor=1.0, shard_rows=50)
    want = brute_nearest(clustered, [n for n, _ in clustered if n % 20 == 0], 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert max(abs(a - b) for (a, _), (b, _) in zip(got[q], want[q], strict=True)) < 1e-12


@pytest.mark.parametrize("clusters", [True, False])
def test_relaxed_search_reaches_the_recall(spark, clustered, clusters):
    rng = np.random.default_rng(5)
    rows = clustered if clusters else [(n, rng.normal(size=64).tolist()) for n in range(900)]
    table = spark.createDataFrame(rows, VECTORS)
    got = answers(table, table.where("vec_id % 20 = 0"), k=5, shard_rows=100)
    want = brute_nearest(rows, [n for n, _ in rows if n % 20 == 0], 5)
    # By score: copies of one vector are as good as each other.
    hits = sum(any(abs(a - b) < 1e-9 for a, _ in got[q]) for q in want for b, _ in want[q])
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_a_larger_factor_visits_less():
    rng = np.random.default_rng(6)
    rows = (rng.normal(size=(30, 8))[rng.integers(30, size=3000)] + rng.normal(scale=0.1, size=(3000, 8)))
    order, nodes = vantage.grown(rows, vantage.LEAF)
    index = {"ids": order.astype(np.int64).tobytes(), "vectors": rows[order].tobytes(), "nodes": nodes.tobytes()}
    seen = {}
    for factor in (1.0, 2.0, 8.0):
        tree = vantage.Search(index, 8, 5, factor)
        scanned, scan = [], tree.scan
        tree.scan = lambda a, b, who, scan=scan, scanned=scanned: (scanned.append((b - a) * len(who)), scan(a, b, who))
        tree.run(np.arange(0, 3000, 100), rows[::100], np.full(30, np.inf))
        seen[factor] = sum(scanned)
    assert seen[8.0] < seen[2.0] < seen[1.0] < 30 * 3000


def test_vectors_that_take_no_part(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [math.nan, 1.0]),
        (8, [math.inf, 1.0]), (None, [1.0, 0.0]), (9, [5.0]), (2, [0.0, 3.0]), (20, [-1.0, 0.0]), (20, [-1.0, 0.0]), (40, None),
    ]
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS vector", "1 AS cell", "2 AS score")
    got = answers(table, table.where("vec_id % 20 = 0"), k=5)
    assert got == {0: [(1.0, 1), (1.0, 9), (0.0, 2), (-1.0, 20)], 20: [(0.0, 2), (-1.0, 0), (-1.0, 1), (-1.0, 9)]}
    assert vantage.nearest(table.limit(0), table.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1e-200, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, round(r.score, 9)) for r in vantage.nearest(huge, huge.where("vec_id = 0")).collect()] == [(1, 0.707106781)]
    with pytest.raises(ValueError):
        vantage.nearest(table, table, factor=0.5)


def brute_variants(rows, one_in, min_count=3):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            at = h % len(low)
            counts[low[:at] + low[at + 1 :] if h % one_in == 0 else low] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= min_count}
    shapes = {}
    for w in n:
        for i in range(len(w)):
            shapes.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for (_, cut), group in shapes.items():
        for w in group:
            near[w] |= {x for x in group if x != w}
            if cut in n:
                near[w].add(cut)
                near[cut].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def variants_of(docs, one_in):
    found = spelling.variants(spelling.counted(spelling.damaged_words(docs, one_in)))
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}


@pytest.mark.parametrize("tile_rows", [1, 8, 9, 128])
def test_tiles_meet_once(monkeypatch, tile_rows):
    monkeypatch.setattr(spelling, "TILE_ROWS", tile_rows)
    halves = np.repeat(np.arange(40), np.random.default_rng(3).integers(1, 30, size=40))
    met = {}
    for p, q, r, s in spelling.tile_pairs(halves, 12):
        for x in range(p, q):
            for y in range(r, s):
                if x < y and halves[x] == halves[y]:
                    met[x, y] = met.get((x, y), 0) + 1
    assert met == {(x, y): 1 for x in range(len(halves)) for y in range(x + 1, len(halves)) if halves[x] == halves[y]}
    assert spelling.tile_pairs(np.zeros(0, int), 5) == []


@pytest.mark.parametrize(("half_words", "group_chars"), [(4096, 400_000), (6, 300)])
def test_variants_match_all_pairs(spark, docs, corpus, monkeypatch, half_words, group_chars):
    monkeypatch.setattr(spelling, "HALF_WORDS", half_words)
    monkeypatch.setattr(spelling, "GROUP_CHARS", group_chars)
    rng = random.Random(12)
    made = []
    for n in range(300):  # one letter changed again and again, so that many words share a half
        word = list(rng.choice(["stonework", "lantern", "éclairée", "abcde"]))
        for _ in range(rng.randint(0, 2)):
            word[rng.randrange(len(word))] = rng.choice("abxyzé")
        made.append((5000 + n, " ".join(["".join(word)] * rng.randint(1, 40))))
    rows = [(r[0], r[1]) for r in corpus] + made + [(None, "Lanterns lanterns LANTERNS"), (8000, "y" * 3000 + " " + "y" * 3001 + " " + "y" * 3000), (8001, ("y" * 3000 + " " + "y" * 3001 + " ") * 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS half").repartition(3)
    got, want = variants_of(table, 7), brute_variants(rows, 7)
    assert got == want and any(r[1] for r in want) and any(r[2] != r[1] for r in want if r[1])


def test_chains_of_forms_end_in_one_root(spark):
    # Each word is one edit from the next and half as frequent.
    words = ["a" * n + "b" * (24 - n) for n in range(5, 20)]
    table = spark.createDataFrame([(w, 2**i) for i, w in enumerate(words)], "word string, n long")
    out = {r.word: r for r in spelling.variants(table).collect()}
    assert {r.root for r in out.values()} == {words[-1]} and out[words[-1]].form is None
    assert [out[w].form for w in words[:-1]] == words[1:]
    assert spelling.variants(table.limit(0)).count() == 0


def test_ties_of_forms_go_to_the_smaller_word(spark):
    table = spark.createDataFrame([("stone", 3), ("stona", 6), ("stonb", 6), ("ston", 5), ("stonec", 6), ("éston", 1)], "word string, n long")
    out = {r.word: (r.form, r.n_near, r.form_n) for r in spelling.variants(table).collect()}
    assert out["stone"] == ("stona", 4, 6) and out["éston"] == ("ston", 1, 5) and out["stona"] == (None, 3, None)


def brute_audit(rows, labels):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    parts = {}
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            l for l, bad in zip("ABCDE", (
                len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                bool(re.search("[#$%&*|]", text)), doc_id is not None and doc_id > first[text],
            ), strict=True) if bad
        }
        parts.setdefault(lang or "", []).append((fails, doc_id in good, doc_id in toxic))
    out = set()
    for part, docs in parts.items():
        removed = {}
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                removed[order, f] = (step, len(left), len(gone), sum(d[1] for d in gone), sum(d[2] for d in gone))
        shapley = {f: sum(v[2] for (_, g), v in removed.items() if g == f) for f in "ABCDE"}
        for (order, f), (step, kept, gone, g, t) in removed.items():
            failing = sum(f in d[0] for d in docs)
            out.add((part, "".join(order), step, kept, gone, failing - gone, sum(d[0] == {f} for d in docs), g, t, shapley[f]))
    return out


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_matches_every_order(spark):
    rng = random.Random(8)
    rows = []
    for n in range(400):
        text = " ".join(sentence(rng, 1) + str(rng.randrange(rng.choice([5, 900]))) for _ in range(rng.randint(60, 180)))
        text = text.upper() if n % 5 == 0 else text
        rows.append((n * 3, text + rng.choice(["", "", " #", "|"]), rng.choice(["en", "en", "de", None, ""])))
    rows += [(2000 + n, rows[n][1], "en") for n in range(0, 60, 2)] + [(7, None, "fr"), (8, "", "fr"), (9, "ÀÉ é", "fr"), (None, rows[0][1], "en"), (None, None, None)]
    rows += [rows[3], (rows[3][0], "another text", "de"), (rows[3][0], rows[3][1], "de")]
    labels = [(r[0], rng.randrange(2), rng.randrange(2)) for r in rows[::2]] + [(rows[4][0], None, 1), (None, 1, 1), (999_999, 1, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS part", "2 AS digest", "3 AS fails").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r[c] for c in COLUMNS) for r in filter_audit.audit(filter_audit.outcomes(table, marks)).collect()}
    assert got == brute_audit(rows, labels)


def test_audit_of_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.outcomes(no_docs, labels)).count() == 0
    one = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    out = filter_audit.audit(filter_audit.outcomes(one, labels)).collect()
    assert len(out) == 600 and {r.removed for r in out if r.filter_order[r.step - 1] == "A"} == {1} and sum(r.shapley for r in out) == 120 * 120


def test_posting_lists_hold_the_failing_ids(spark):
    rows = spark.createDataFrame([(n, "p" if n < 70 else "q", n % 8, n % 2 == 0, n % 3 == 0) for n in range(100)], "doc_id long, part string, fails int, good boolean, toxic boolean")
    lists = filter_audit.posting_lists(rows.repartition(3), 3).collect()
    for f in range(3):
        held = [r.doc_ids[i] for r in lists for i in r.fails[f]]
        assert sorted(held) == [n for n in range(100) if n % 8 >> f & 1]
    assert all(r.doc_ids == sorted(r.doc_ids) and (r.first_id, r.last_id) == (r.doc_ids[0], r.doc_ids[-1]) for r in lists)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(200, size=n)) for n in (0, 3, 50, 150)]
    for subset, union in enumerate(filter_audit.united(sets)):
        assert set(union) == {x for i, s in enumerate(sets) if subset >> i & 1 for x in s.tolist()} and (np.diff(union) > 0).all()
