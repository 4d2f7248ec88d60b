import random

import numpy as np
import pytest

import corpus_pipeline
from tidelog.llm import neardup, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)


def star(leaves, words=1000, edits=16):
    """Edited copies of one text, each at 0.85 to it and at about 0.72 to each other; the text itself comes last."""
    r = random.Random(11)
    centre = [f"w{r.randrange(10**6)}" for _ in range(words)]
    texts = []
    for k in range(leaves):
        w = list(centre)
        for at in range(edits):
            w[at * (words // edits) + r.randrange(5, words // edits - 5)] = f"edit{k}x{at}"
        texts.append(" ".join(w))
    return [*texts, " ".join(centre)]


def test_near_duplicates_of_a_star_whose_centre_has_the_largest_id(spark, monkeypatch):
    texts = star(150)
    other = [" ".join(f"z{k}x{i}" for i in range(50)) for k in range(3)]
    for block in (neardup.BLOCK, 20):
        monkeypatch.setattr(neardup, "BLOCK", block)
        rows = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(docs_of(spark, texts + other)).collect()}
        assert rows == {i: (0, 151) for i in range(151)} | {i: (i, 1) for i in range(151, 154)}


def test_near_pairs_give_up_no_pair():
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 12)):
            w[r.randrange(300)] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(w[: r.randrange(220, 301)]))
    runs = [tokens.shingles(t.hash, neardup.WORDS) for t in (tokens.tokenize([x], digits=True) for x in texts)]
    signs = np.stack([neardup.signature(x) for x in runs])
    ids = np.arange(60)
    n = np.array([len(x) for x in runs])
    true = {(a, b) for a in ids for b in ids if a < b and neardup.similarity(runs[a], runs[b])}
    found = neardup.near_pairs(ids, ids, n, signs, 60)
    assert true and true <= {(a, b) for a, b, _ in found} and not any(cut for _, _, cut in found)
    assert any(cut for _, _, cut in neardup.near_pairs(ids, ids, n, signs, 1))


def test_pipeline_dedup_of_a_group_whose_original_comes_last(spark):
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    docs = docs_of(spark, star(150))
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]


def test_components_never_return_links_that_are_no_stars(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        neardup.components(edges, "t", most_rounds=1)
