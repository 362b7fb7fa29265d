"""Texts beyond what a task handles at once."""

import random

import brute
import numpy as np
import pytest

from tessera.llm import counts, decontaminate, jaccard, lm, quality, scan, secrets, vocab


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    words = brute.prose(400, 30_000).split()
    long = " ".join(r.choices(words, k=420_000))
    assert len(long.encode()) > scan.STEP
    near = long.split(" ")
    for k in range(0, len(near), 3000):
        near[k] = "other"
    return [brute.prose(401, 300), long, " ".join(near) + " password=abcdef123456 0123456789abcdef0123", None, brute.prose(402, 50)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1).cache()


def test_quality(docs, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for r in quality.quality(docs).collect():
        assert tuple(r[n] for n in names) == brute.quality(texts[r.doc_id])


def test_secrets(docs, texts):
    for r in secrets.find_secrets(docs).collect():
        base = secrets.written(brute.secrets_base(texts[r.doc_id]))
        assert {*filter(None, base.split(","))} <= {*r.spans.split(",")} and [r.n_assign, r.n_hex] == [base.count("assign"), base.count("hex")]


def test_counts(docs, texts):
    whole = vocab.tokenizer(counts.VOCABULARY)
    for r in counts.count_tokens(docs).collect():
        assert r.n_tokens == len(whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)


def test_jaccard(docs, texts):
    want = brute.components(list(enumerate(texts)))
    assert want[2][1] == 1
    for r in jaccard.jaccard_components(docs).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_decontamination(spark, docs, texts):
    items = [(1, " ".join(texts[1].split()[-40:])), (2, texts[4])]
    for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute.contaminated(texts[r.doc_id], items)


def test_lm(docs, texts):
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    assert all(got[i].n_words == len(brute.BLANK_WORD.findall(t or "")) for i, t in enumerate(texts)) and np.isfinite(got[1].log_likelihood)
