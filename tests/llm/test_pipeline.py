import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from panelwright.llm.queries import LLM_QUERIES
from test_lines_and_strings import expected_lines
from test_near_copies import groups
from test_scores_counts_archives import QUESTION, expected_targets, words
from text_rows import sentence


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    """A folder of tables: the corpus, shouted junk that labels call bad, and documents with a question."""
    rng = random.Random(12)
    rows = [r for r in corpus if r[0] is not None]
    for n in range(60):
        rows.append((2000 + n, " ".join(w.upper() + "!!" for w in sentence(rng, 40).split()), "en", "src9", 0))
    for n in range(3):
        rows.append((3000 + n, f"{sentence(rng, 50)}\n{QUESTION}", "en", "src1", 0))
    labels = [(r[0], int(not 2000 <= r[0] < 3000), 0) for r in rows]
    place = tmp_path_factory.mktemp("tables")
    tables = {
        "documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, QUESTION)], "item_id long, text string"),
        "embeddings": ([(n, [1.0, float(n)]) for n in range(101)], "vec_id long, embedding array<float>"),
        "pages": ([(1, "u", "<p>"), (2, "u", "<p>")], "page_id long, url string, html string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).repartition(2).write.parquet(f"{place}/{name}.parquet")
    return str(place), rows


def test_pipeline_matches_brute_force(spark, folder):
    place, rows = folder
    good = [r for r in rows if not 2000 <= r[0] < 3000]
    lines = {(r[0], r[3]) for r in expected_lines(good)}
    texts = [(r[0], next(t for d, t in lines if d == r[0])) for r in good]
    kept = {d for d, _, root in groups(texts, 5, 80) if d == root and d < 3000}
    assert len(kept) < len({r[0] for r in good}) - 3
    out = corpus_pipeline.run(spark, place).collect()
    source = {r[0]: r[3] for r in rows}
    want = sorted((d, len(words(t))) for d, t in texts if d in kept)
    assert sorted((r.doc_id, r.size) for r in out) == want
    sizes, taken = Counter(), Counter()
    for row in out:
        sizes[source[row.doc_id]] += row.size
        taken[row.source] += row.taken
    target = expected_targets(sizes)
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.taken <= 2 * r.size for r in out)
    assert all(abs(taken[s] - target[s]) <= 64 for s in target)


def test_stages_keep_the_columns_of_documents(spark, folder):
    place, _ = folder
    docs = spark.read.parquet(f"{place}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources"
    ]
    wide = docs.selectExpr("*", "1 AS score", "'x' AS n_lines")
    for table in (wide, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, place).columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), place).count() == 0


def test_every_operator_is_registered_once(spark, folder):
    place, rows = folder
    numbers = sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES)
    assert numbers == list(range(1, 14))
    words = {w for _, t, *_ in rows for w in re.findall("[a-zÀ-ÿ]+", (t or "").lower())}
    counts = {"op7_warc": 2, "op10_decontaminate": 3, "op11_nearest_vectors": 15, "op13_filter_audit": 600 * len({r[2] or "" for r in rows})}
    for name, query in LLM_QUERIES.items():
        found = query(spark, place).count()
        assert 100 < found < len(words) if name == "op12_spelling_variants" else found == counts.get(name, len(rows)), name
