import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from panelwright.llm import line_dedup, substring_dedup

BLANK = "[\x20\x09-\x0d]"


def line_key(line):
    key = re.sub(f"^{BLANK}+|{BLANK}+$", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)


def expected_lines(rows, min_docs=5, min_chars=40):
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(doc_id)
    keeper = {k: max(d) for k, d in holders.items() if len(d) >= min_docs}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(line_key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def found_lines(docs, state):
    rows = line_dedup.cleaned(docs, state).collect()
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in rows)


def test_lines_match_brute_force_on_both_ways(docs, corpus, monkeypatch):
    state = line_dedup.built(docs)
    want = expected_lines(corpus)
    assert any(r[2] for r in want)
    assert found_lines(docs, state) == want
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)  # no broadcast: keys go to the shards of their filters
    assert found_lines(docs, state) == want
    monkeypatch.setattr(line_dedup, "PROBES", 3)  # and each shard is split
    assert found_lines(docs, state) == want


def test_filters_are_on_the_way_at_any_size(spark, docs, monkeypatch):
    state = line_dedup.built(docs)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    split = line_dedup.built(docs, min_docs=2)
    for held in (state, split):
        keys = held.refs.select("key", F.lit(4).cast("long").alias("doc"))
        repeated = {bytes(r.key) for r in held.refs.where(F.col("n_docs") >= held.min_docs).collect()}
        hits = {bytes(r.key) for r in line_dedup.probed(keys, held).collect()}
        assert repeated <= hits and len(hits) < 0.2 * keys.count() + len(repeated)
    assert split.shards > 1
    assert line_dedup.probed(keys.limit(0), state).count() == 0


def test_insert_and_delete_are_reversible(docs, corpus):
    first, later = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    state = line_dedup.built(first, min_docs=3)
    grown = line_dedup.inserted(state, later)
    assert found_lines(docs, grown) == expected_lines(corpus, 3)
    assert line_dedup.inserted(grown, later).refs.exceptAll(grown.refs).count() == 0
    back = line_dedup.deleted(grown, later)
    assert sorted(map(tuple, back.refs.collect())) == sorted(map(tuple, state.refs.collect()))
    assert found_lines(first, back) == expected_lines([r for r in corpus if r[0] % 2 == 0], 3)


def test_empty_table_and_clashing_columns(no_docs, docs):
    assert line_dedup.cleaned(no_docs, line_dedup.built(no_docs)).count() == 0
    named = docs.withColumn("n_lines", F.lit("x")).withColumn("key", F.lit(1))
    out = line_dedup.cleaned(named, line_dedup.built(named))
    assert out.where("n_lines >= 1 AND key = 1").count() == docs.count()
    names = ["d", "drop", "k", "doc", "keeper", "_owner", "_DROP", "salt"]
    clash = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    state = line_dedup.built(clash)
    rows = line_dedup.cleaned(clash, state).select("doc_id", "text", *[F.col(f"`{n}`") for n in names]).collect()
    assert {tuple(r[2:]) for r in rows} == {tuple(range(len(names)))}
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in line_dedup.cleaned(docs, state).collect())


def test_cuckoo_filter_keeps_what_it_holds():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)
    tables = line_dedup.grown([], hashes)
    has = lambda h: np.any([line_dedup.CuckooFilter(t).contains(h) for t in tables], axis=0)
    assert has(hashes).all()
    assert has(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)).mean() < 0.01
    gone = hashes[:2500]
    for table in tables:
        gone = line_dedup.CuckooFilter(table).delete(gone)
    assert not len(gone) and has(hashes[2500:]).all() and has(hashes[:2500]).mean() < 0.01


def expected_strings(rows, width=200):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i : i + width] for _, t in texts for i in range(len(t) - width + 1))
    out = []
    for doc_id, text in texts:
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - width + 1):
            if seen[text[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(text, gone, strict=False) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found_strings(docs, **more):
    rows = substring_dedup.deduplicated(docs, **more).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows)


def test_strings_match_brute_force(docs, corpus, monkeypatch):
    want = expected_strings(corpus)
    assert sum(r[2] > 0 for r in want) > 10 and any(r[3] > 1 for r in want)
    assert found_strings(docs) == want
    assert found_strings(docs, hot=1) == want  # windows counted by digest
    monkeypatch.setattr(substring_dedup, "SEGMENT", 997)
    assert found_strings(docs) == want


def test_strings_of_short_texts(spark):
    rows = [(1, "a"), (2, None), (3, "b" * 199)]
    assert found_strings(spark.createDataFrame(rows, "doc_id long, text string")) == expected_strings(rows)


def test_strings_of_an_empty_table(no_docs):
    assert substring_dedup.deduplicated(no_docs).count() == 0


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 99, rng.integers(0, 30)).astype(np.uint8).tobytes() for _ in range(500)]
    starts = np.array([0, 1, 40, 300])
    rows = np.zeros((500, 32), np.uint8)
    for n, t in enumerate(texts):
        rows[n, : len(t)] = np.frombuffer(t, np.uint8)
    side = substring_dedup.Extensions(rows, np.array([len(t) for t in texts]))
    order = side.merge_sorted(starts)
    for a, b in zip(starts, [*starts[1:], 500], strict=True):
        assert sorted(order[a:b]) == list(range(a, b))
        assert [texts[i] for i in order[a:b]] == sorted(texts[a:b])
    common = side.verified_neighbours(order, starts)
    at = 450
    one, two = texts[order[at - 1]], texts[order[at]]
    assert common[at] == next((i for i, (x, y) in enumerate(zip(one, two, strict=False)) if x != y), min(len(one), len(two)))
