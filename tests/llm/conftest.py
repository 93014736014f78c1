from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents of texts, ids from 0; extra columns have names that operators use themselves."""

    def make(texts, sources=None, ids=None):
        from pyspark.sql import functions as F

        rows = [(i if ids is None else ids[i], x, "en", (sources or ["a"] * len(texts))[i], len(x or "")) for i, x in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("size", "n", "gram", "bucket", "key", "words", "score")})

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, long texts, ties and empties."""
    import random

    r = random.Random(5)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(60)
    base = text(90)
    out = [text(r.randint(5, 200)) for _ in range(40)] + [None, "", " \n\t ", "one", "Two Words", "x" * 450, "ab" * 300]
    out += [base] * 4 + [text(20) + " " + passage + " " + text(30) for _ in range(8)]
    for _ in range(12):
        w = base.split()
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    out += [base.upper(), "\n".join([text(12)] * 9), text(3000)]
    return out
