import base64
import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, mixing, quality, token_counts, toxicity, warc
from text_rows import sentence


def words(text):
    return (text or "").encode().split()


# --- mixing ------------------------------------------------------------------


def expected_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    capped, total = set(), budget * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        scale = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / scale for s in names}
        above = {s for s in names if target[s] > most * sizes[s] + 1e-9}
        if not above:
            return target
        capped |= above


def test_mix_meets_targets(docs, corpus):
    out = mixing.mixed_documents(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in corpus)
    sizes = Counter()
    for row in corpus:
        sizes[row[3]] += len(words(row[1]))
    want = expected_targets(sizes)
    taken = Counter()
    for row in out:
        assert row.source_size == sizes[row.source] and abs(row.target - want[row.source]) < 1e-6
        assert 0 <= row.taken <= 2 * row.size
        taken[row.source] += row.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= mixing.BLOCK_WORDS
    assert sorted(map(tuple, mixing.mixed_documents(docs).collect())) == sorted(map(tuple, out))


def test_mix_slots_are_shared_out(docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 10)
    rows, sources, pieces = mixing.mixture(docs, block_words=16)
    held = pieces.groupBy("sid", "slot").agg(F.count_distinct("shard").alias("shards"), F.sum("words").alias("n")).collect()
    assert all(r.shards == 1 and r.n <= 16 for r in held) and pieces.select("shard").distinct().count() > 10
    taken = {r.sid: r.n for r in pieces.groupBy("sid").agg(F.sum("words").alias("n")).collect()}
    for row in sources.collect():
        assert abs(taken.get(row.sid, 0) - row.target) <= max(64, 0.1 * row.target)


def test_mix_without_words(no_docs, spark):
    assert mixing.mixed_documents(no_docs).count() == 0
    rows = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.size, r.target, r.taken) for r in mixing.mixed_documents(rows).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


@pytest.mark.parametrize("count", [1, 2, 3, 17, 1000])
def test_permutations(count):
    out = mixing.permuted(np.arange(count), count, np.full(count, 7, np.uint64))
    assert sorted(out) == list(range(count))


# --- token counts --------------------------------------------------------------


def test_tokens_match_the_library(spark, docs, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.tokenizer_path(token_counts.TOKENIZER))
    odd = [
        (5001, "a<|endoftext|>b <|startoftext|>"), (5002, "It's  we'll THEY'D x\x1fy\x85z"), (5003, "é ́a Å Å"), (5004, "1234 ½ ٣ 中文字 ab\tc\r\n"),
        (5005, "<|endoftext|"), (5006, "İstanbul ΣΑΣ"), (5007, "y" * 5000),
    ]
    rows = [(r[0], r[1]) for r in corpus] + odd
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for d, t in rows)
    assert sorted(map(tuple, token_counts.counted(table, limit=100).collect())) == want
    assert token_counts.counted(table.limit(0)).count() == 0


def test_bounded_tallies_do_not_change_counts(docs, monkeypatch):
    want = sorted(map(tuple, token_counts.counted(docs).collect()))
    for name, value in (("TALLY", 10), ("REPORT", 3), ("CACHE", 5), ("TEXTS", 2)):
        monkeypatch.setattr(token_counts, name, value)
    assert sorted(map(tuple, token_counts.counted(docs).collect())) == want


# --- archives ----------------------------------------------------------------


def test_pages_come_back(spark):
    rng = random.Random(1)
    rows = [(n, f"http://host/{n}\n x", f"<p>{sentence(rng, 60)}</p>") for n in range(120)]
    rows += [(200 + n, None, rows[n % 3][2]) for n in range(30)] + [(300, "u", None), (301, "u", ""), (None, "v", "alone"), (302, "w", "Ünï\x00\r\n\r\n<b>")]
    rows.append(rows[7])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if page is None else page)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        keeper = last[html or ""]
        kind = ("response", None) if page is None or page == keeper else ("revisit", keeper)
        want.append((page, *kind, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), body if kind[0] == "response" else None))
    out = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload and bytes(r.payload)) for r in warc.round_trip(pages, payload=True).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(*r[:5], r[5] or (b"" if r[1] == "response" and not r[3] else r[5])) for r in out], key=key) == sorted(want, key=key)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_bounded(spark, tmp_path):
    """Many archives at a small limit, each near it although one payload fills a third of the table; all come back."""
    rng = random.Random(2)
    rows = [(n, f"u{n}", sentence(rng, 300)) for n in range(400)] + [(1000 + n, f"v{n}", "copied " * 400) for n in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    limit, total = 64 << 10, sum(len(h) for *_, h in rows)
    per_file = warc.marked(pages, limit).groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("html")).alias("b")).collect()
    assert len(per_file) > 0.6 * total / limit and max(r.b for r in per_file) < 4 * limit
    warc.written(pages, str(tmp_path / "w"), limit)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert len(sizes) >= len(per_file) and max(sizes) < 4 * limit
    out = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(out) == 600 and {r.refers_to for r in out if r.record_type == "revisit"} == {1199} and sum(r.record_type == "revisit" for r in out) == 199


def test_broken_archives_are_refused():
    items = [warc.record(n, f"http://h/{n}", b"page %d" % n, None, False) for n in range(20)]
    data = b"".join(f + warc.EMPTY_FRAME.encode() for f in warc.archive_frames(iter(items)))
    assert list(warc.archive_records(data)) == items
    size = int.from_bytes(data[4:8], "little")
    for bad in (data[8 + size :], data[:-9], data[: 8 + size - 2], data + b"garbage!"):
        with pytest.raises(ValueError):
            list(warc.archive_records(bad))
    good = items[3]
    assert warc.parsed(good)[0] == 3
    for old, new in ((b"page 3", b"page 33"), (b"page 3", b"pale 3"), (b"WARC/1.1", b"WARC/0.9"), (b"WARC-Date:", b"X-Date:"), (b"response\r", b"odd\r")):
        with pytest.raises(ValueError):
            warc.parsed(good.replace(old, new, 1))


# --- scores --------------------------------------------------------------------


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for n in range(600):
        bad = n % 5 == 0
        text = sentence(rng, rng.randint(10, 60))
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        nasty = n % 7 == 0
        if nasty:
            text += " dreadful" + rng.choice(["ly", "ness", ""]) + " " + rng.choice(["awful", "vilest"])
        rows.append((n, text))
        marks.append((n, int(not bad), int(nasty)))
    marks += [(3, None, None), (99_999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(marked):
    docs, labels = marked
    rows = quality.training_rows(docs, labels, "quality")
    assert rows.where(quality.held_out(F.col("doc_id"))).count() == 0
    model = quality.fit(rows)
    scored = quality.scored(docs.withColumn("score", F.lit("x")), model)
    out = scored.join(labels.where("quality IS NOT NULL"), "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert len(out) > 150 and np.mean([r.predicted == r.quality for r in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_quality_sample_is_bounded_and_odd_rows_score(spark, marked):
    docs, labels = marked
    assert 20 < quality.training_rows(docs, labels, "quality", rows=50).count() < 90
    model = quality.fit(quality.training_rows(docs, labels.limit(0), "quality"))
    odd = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "!?"), (3, "word " * 5000)], "doc_id long, text string")
    assert {r.score for r in quality.scored(odd, model).collect()} == {0.5}
    assert quality.scored(odd.limit(0), model).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.1/labels.parquet").exists(), reason="needs the given tables")
def test_toxicity_of_the_given_tables(spark):
    """Recall and precision on the held-out third of the labelled documents (131 of 144 found, 7 false)."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxic(quality.training_rows(docs, labels, "toxic"))
    asked = docs.select("doc_id", "text").join(labels.where("toxic IS NOT NULL"), "doc_id").where(quality.held_out(F.col("doc_id")))
    found = toxicity.severities(asked, model).select("doc_id", F.col("toxic").alias("said")).join(labels, "doc_id").toPandas()
    hits = (found.said & (found.toxic == 1)).sum()
    assert hits >= 0.9 * (found.toxic == 1).sum() > 100 and hits >= 0.94 * found.said.sum()


def test_toxicity_on_held_out_rows(spark, marked):
    docs, labels = marked
    model = toxicity.fit_toxic(quality.training_rows(docs, labels, "toxic"))
    assert (np.diff(model.thresholds) > 0).all()
    out = toxicity.severities(docs, model).join(labels.where("toxic IS NOT NULL"), "doc_id").where(quality.held_out(F.col("doc_id"))).select(
        "severity", "grade", labels["toxic"].alias("mark")
    ).collect()
    assert np.mean([(r.grade > 0) == bool(r.mark) for r in out]) > 0.97
    assert all(0 <= r.severity <= len(model.thresholds) for r in out)
    blank = toxicity.fit_toxic(quality.training_rows(docs, labels.limit(0), "toxic"))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert {(r.severity, r.grade, r.toxic) for r in toxicity.severities(odd, blank).collect()} == {(0.0, 0, False)}
    assert toxicity.severities(odd.limit(0), model).count() == 0


def test_ordinal_grades_rise():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(800):
        grade = int(rng.integers(0, 3))
        rows.append((np.array([grade, 10 + int(rng.integers(0, 50))]), np.ones(2), grade))
    weights, thresholds = toxicity.ordinal(rows, 3, toxicity.OrdinalSettings(l1=0.1))
    assert weights[0] < weights[1] < weights[2] and thresholds[0] < thresholds[1]
    assert ((weights[[0, 1, 2]][:, None] > thresholds).sum(1) == [0, 1, 2]).all()


def test_sparse_rows_agree_with_dot_products():
    texts = pa.array(["The stone, THE stone 12!", "", None, "x"])
    model = quality.LinearModel(np.random.default_rng(0).normal(size=quality.SLOTS).astype(np.float32), 0.3)
    want = [model.bias + float(model.weights[i] @ v) for i, v in quality.sparse_rows(texts)]
    assert np.allclose(quality.dots(texts, model), want, atol=1e-4)


# --- decontamination -----------------------------------------------------------


QUESTION = "Anna walks 12 miles from the old market to the river and then Anna buys 3 pounds of apples for 12 friends near the bridge"


def test_leaks_and_their_slots(spark):
    bench = spark.createDataFrame([(1, QUESTION), (2, "Too short to be found"), (3, None), (4, "a much longer plain sentence about nothing that anyone ever wrote down")], "item_id long, text string")
    again = QUESTION.replace("Anna", "Peter").replace("12", "77").replace("3 pounds", "9 kilograms").replace("miles", "km")
    mixed_up = QUESTION.replace("Anna", "Peter", 1).replace("12", "77", 1).replace("Anna", "Maria").replace("12", "78")
    rng = random.Random(6)
    texts = {
        10: QUESTION, 11: f"{sentence(rng, 30)}. {again}. {sentence(rng, 9)}", 12: mixed_up, 13: sentence(rng, 500), 14: None, 15: "",
        16: QUESTION.upper(), 17: " ".join(QUESTION.split()[:9]), 18: sentence(rng, 3000) + "\n" + QUESTION.replace(" ", "\n") + " " + sentence(rng, 3000),
        19: "A much longer plain sentence about nothing that anyone ever wrote down!",
    }
    rows = [(k, v) for k, v in texts.items()] + [(10, QUESTION)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("window", F.lit("clash")).repartition(3)
    out = {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(docs, bench).collect()}
    assert set(out) == {(10, 1), (11, 1), (16, 1), (18, 1), (19, 4)}
    assert out[10, 1] == 1.0 and out[11, 1] == 1.0
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_in_other_case(spark):
    accents = "Élodie mißt die Größe der Bäume über den großen Straßen und zählt danach alle Äpfel im Garten"
    bench = spark.createDataFrame([(1, QUESTION), (2, QUESTION.upper()), (3, accents)], "item_id long, text string")
    texts = {
        20: QUESTION.upper(), 21: QUESTION.lower(), 22: QUESTION.title(), 23: QUESTION.upper().replace("12", "77").replace("MILES", "KM"),
        24: "Before it. " + QUESTION.title() + " and after", 25: accents.upper(), 26: accents.lower(), 27: sentence(random.Random(7), 400).upper(),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(docs, bench).collect()}
    assert out == {(d, n): 1.0 for d in (20, 21, 22, 23, 24) for n in (1, 2)} | {(25, 3): 1.0, (26, 3): 1.0}


def test_leaks_of_items_dense_in_slots(spark):
    sums = "Compute 12 + 7 * 3 - 4"
    table = "Lisbon 1755 Messina 1908 Tokyo 1923 Agadir 1960 Skopje 1963 Managua 1972 Tangshan 1976 Kobe 1995"
    bench = spark.createDataFrame([(1, sums), (2, table), (3, "0 " * 60), (4, "Anna Yes"), (5, "add 2 km")], "item_id long, text string")
    rng = random.Random(8)
    around = [sentence(rng, 40) for _ in range(8)]
    texts = {
        30: sums, 31: f"{around[0]} {sums.upper()} = ? {around[1]}", 32: f"{around[2]} {table} {around[3]}", 33: table.lower(),
        34: f"{around[4]} {sums.replace('7', '8')}", 35: " ".join(table.split()[:5]) + around[5], 36: "0 " * 3000, 37: f"{around[6]} anna yes {around[7]}",
        38: "ANNA, yes!", 39: "Add 2 km", 40: "add 3 km", 41: sums + " " + sums,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {(r.doc_id, r.item_id): r.share for r in decontaminate.leaks(docs, bench).collect()}
    assert out == {k: 1.0 for k in [(30, 1), (31, 1), (32, 2), (33, 2), (36, 3), (38, 4), (39, 5), (41, 1)]}


def test_leaks_with_colliding_values(spark):
    fruit = "the farmer sells 3 apples and also keeps 4 pears in the old shed before walking 9 miles or 2 km down the road to his house"
    alike = fruit.replace("3", "5").replace("4", "5").replace("miles", "km").replace("9", "2")
    # One benchmark value at both ends stands for two document values: only the windows that hold it go.
    ends = "all 6 " + "of them went quietly along the narrow path and none of them ever looked back at the village below " + "with 6 others"
    apart = ends.replace("all 6", "all 7").replace("with 6", "with 8")
    every = "there were 6 of them and then 6 more and after that 6 again until the last 6 of them had left"
    digits = iter("1234")
    spread = "".join(next(digits) if c == "6" else c for c in every)
    bench = spark.createDataFrame([(1, fruit), (2, ends), (3, every)], "item_id long, text string")
    docs = spark.createDataFrame([(50, alike), (51, apart), (52, spread), (53, every.replace("6", "8"))], "doc_id long, text string")
    out = {(r.doc_id, r.item_id): (r.hits, r.windows) for r in decontaminate.leaks(docs, bench).collect()}
    size = {n: len(words(t)) - 7 for n, t in ((1, fruit), (2, ends), (3, every))}
    assert out == {(50, 1): (size[1], size[1]), (51, 2): (size[2] - 4, size[2]), (53, 3): (size[3], size[3])}
