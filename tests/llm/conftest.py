import random

import pytest

from text_rows import sentence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
@pytest.fixture(scope="session")
def corpus():
    """Rows of documents with copies, near copies, shared lines and passages, odd texts and a long one."""
    rng = random.Random(3)
    texts = ["\n".join(sentence(rng, rng.randint(5, 40)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    line = "This line of words stands in many of the documents, again and again."
    for n in range(0, 30, 3):
        texts[n] += "\n" + line + ("\t " if n % 2 else "")
    for n in range(6):
        words = texts[40 + n].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [texts[5]] * 4 + ["", " ", "one", "two words", "Ünïcode línes wïth áccents thät are löng enough tö be a key of förty\n" * 2, "x" * 700, "ab " * 400]
    texts.append(sentence(rng, 20_000))
    rows = [(3 * n, t, "en", f"src{n % 4}" if n % 7 else None, len(t)) for n, t in enumerate(texts)]
    return [*rows, (1000, None, None, None, None), rows[2]]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
