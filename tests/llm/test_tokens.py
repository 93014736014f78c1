from __future__ import annotations

import itertools

import public_tokenizers
import pytest
import sentencepiece

from sparkloom.llm.tokens import PrefixCounter, count_tokens, longest_fit

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a  b ", "\n \n", "</s>[INST] <s>", "x▁ y▁", "🙂\t日本", "a\x00b", " lead", "tail \n"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_equal_the_library(docs_of, corpus, model):
    texts = [*corpus, *ODD]
    got = {r["doc_id"]: r for r in count_tokens(docs_of(texts), MODEL, limit=50).collect()}
    for i, x in enumerate(texts):
        n = len(model.encode(x or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((x or "").encode()), n > 50)
        assert len(model.encode((x or "")[: got[i]["fit_chars"]])) <= 50
    assert count_tokens(docs_of([]), MODEL).count() == 0


def test_every_prefix(corpus, model):
    counter = PrefixCounter(MODEL)
    for x in [*(x[:120] for x in corpus if x), *(x for x in ODD if x)]:
        want = [len(model.encode(x[:i])) for i in range(len(x) + 1)]
        assert list(counter.prefix_counts(x)) == want
        for budget in (0, 1, 5, 17):
            assert counter.fit(x, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_long_parts_cost_their_length(docs_of, model):
    import random

    r = random.Random(3)
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "的一是不了人我在有他这为之大来以个中上们龘。", "aab", "=-*_/", "if(var){return;}0x"]
    for letters in alphabets:
        x = "".join(r.choice(letters) for _ in range(400))
        assert list(PrefixCounter(MODEL).prefix_counts(x)) == [len(model.encode(x[:i])) for i in range(len(x) + 1)]
    #: one part; encoding each prefix of it would take minutes and gigabytes
    x = "".join(r.choice(alphabets[0]) for _ in range(40_000))
    counter, sizes = PrefixCounter(MODEL), []
    encode = counter._count
    counter._count = lambda parts: sizes.append(sum(map(len, parts))) or encode(parts)
    n = counter.fit(x, 4096)
    assert sum(sizes) <= 50_000
    assert len(model.encode(x[:n])) <= 4096 < min(len(model.encode(x[:i])) for i in range(n + 1, n + 40))
    assert [r["fit_chars"] for r in count_tokens(docs_of([x]), MODEL).collect()] == [n]


def test_very_long_texts_null_and_repeated_ids(docs_of, model):
    words = "the quick brown fox " * 60_000
    texts = [words, None, "a b", "a b", "x" * 300_000]
    got = count_tokens(docs_of(texts, ids=[None, None, 3, 3, 4]), MODEL).collect()
    want = sorted((i or 0, len(model.encode(x or ""))) for i, x in zip([None, None, 3, 3, 4], texts))
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == want


def test_counts_and_fit_come_from_the_table_of_prefixes(model):
    x = "the quick brown fox jumps\nover it " * 40
    counter = PrefixCounter(MODEL)
    counts = counter.prefix_counts(x)
    want = [len(model.encode(x[:i])) for i in range(len(x) + 1)]
    counter.model = None  # nothing is encoded again, neither for the whole text nor where it is cut
    assert list(counter.prefix_counts(x)) == list(counts) == want
    for budget in (0, 7, 100, 10_000):
        assert longest_fit(counts, budget) == counter.fit(x, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_a_table_that_the_library_contradicts_is_encoded_anew(model):
    counter = PrefixCounter(MODEL)
    counter._composed = lambda part, ids: None
    counter._chain = lambda part: __import__("numpy").zeros(len(part) + 1, int)
    assert list(counter.prefix_counts("brown fox")) == [len(model.encode("brown fox"[:i])) for i in range(10)]


def test_tables_of_many_texts_equal_the_library(model):
    import random

    r = random.Random(5)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for letters in ("ab \n", "entioning  s", "🙂日本語é \n", "▁x ▁", "Straße  über\tund\r\n", "the re in st\x00") for _ in range(25)]
    for x, counts in zip(texts, PrefixCounter(MODEL).all_prefix_counts(texts), strict=True):
        assert list(counts) == [len(model.encode(x[:i])) for i in range(len(x) + 1)]


def test_new_words_have_no_tables_of_their_own():
    """Tables of whole texts are put together from pairs and triples of pieces, whatever the words."""
    counter = PrefixCounter(MODEL)
    words = list(map("".join, itertools.product(["ent", "ion", "wor", "the", "ing", "sta"], repeat=4)))
    counter.prefix_counts(" ".join(words))
    assert len(counter.tables) < len(words) / 4, len(counter.tables)
