"""Parts of the models and the whole pipeline against plain versions that share no code with them."""

import collections
import math
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tidelog.llm import langid, tokens, toxicity

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def common_in_order(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def kept_of_copies(docs):
    """ids of the documents that are the least of their class."""
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in docs.items()}
    bags = {i: collections.Counter(w) for i, w in words.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            n = len(words[a]) + len(words[b])
            if a < b and words[a] and words[b] and sum((bags[a] & bags[b]).values()) * 1.8 >= 0.8 * n - 1e-9:
                m = common_in_order(words[a], words[b])
                if m >= 0.8 * (n - m) - 1e-9:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i for i in docs if find(i) == i}


def contaminated(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {tuple(w[i : i + 13]) for w in map(split, items) if w for i in range(max(1, len(w) - 12))}
    words, hit = split(text), set()
    for n in {len(x) for x in windows}:
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_pipeline_against_plain_stages(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    items = list(pd.read_parquet(f"{SF}/benchmark.parquet").text)
    texts = {i: t for i, t in zip(docs.doc_id, docs.text) if t and any(c.isalpha() for c in t)}
    left = {i for i in kept_of_copies(texts) if not contaminated(texts[i], items)}
    con = duckdb.connect()
    rest = docs[docs.doc_id.isin(left)]
    con.register("documents", rest)
    from tidelog.llm.mixing import mix_sql

    want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({mix_sql()})").fetchall()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == want and len(rows) == len(want) > 0
    of = {i: (s, x, n) for i, s, x, n in zip(docs.doc_id, docs.source, docs.lang, docs.n_chars)}
    assert all((r.source, r.lang, r.n_chars) == of[r.doc_id] and r.shard_bytes > 0 for r in rows)


def test_windows_and_network_by_loops():
    texts = ["Alpha beta, gamma delta " * 9 + "end", "one", "", "two words", "x " * 16, "x " * 17]
    p = {k: v.astype(np.float64) for k, v in toxicity._init(5).items()}
    p["bias"] += 0.3
    sig = lambda x: 1 / (1 + math.exp(-x))
    h, got = toxicity.HIDDEN, toxicity.logits({k: v.astype(np.float32) for k, v in p.items()}, texts)
    t = tokens.tokenize(texts)
    w = toxicity.distinct_words(t)
    x = toxicity.inputs(p, w)

    def states(seq, way):
        s, out = np.zeros(h), []
        for v in seq:
            g = v @ p[f"w{way}"] + p[f"c{way}"]
            u = s @ p[f"u{way}"]
            z, r = [np.array([sig(a) for a in g[k * h : k * h + h] + u[k * h : k * h + h]]) for k in (0, 1)]
            c = np.array([math.tanh(a) for a in g[2 * h :] + r * u[2 * h :]])
            s = (1 - z) * s + z * c
            out.append(s)
        return out

    for k, text in enumerate(texts):
        at = list(w.at[t.of(k)])
        best = -math.inf
        starts = range(0, max(1, len(at)), toxicity.STRIDE) if at else ()
        for a in starts:
            if a and a + toxicity.WIDTH - toxicity.STRIDE >= len(at):
                break  # the window before reached the end
            seq = [x[i] for i in at[a : a + toxicity.WIDTH]]
            both = [np.concatenate(s) for s in zip(states(seq, "f"), states(seq[::-1], "b")[::-1])]
            e = np.array([math.exp(s @ p["att"]) for s in both])
            best = max(best, float((e / e.sum()) @ np.array(both) @ p["out"] + p["bias"][0]))
        assert got[k] == pytest.approx(best, abs=1e-4)


def test_gradients_of_many_entries():
    r = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in toxicity._init(3).items()}
    t = tokens.tokenize(["alpha beta gamma delta", "beta beta epsilon zeta eta"])
    w = toxicity.distinct_words(t)
    start, text = toxicity.windows_of(t.bounds)
    index = toxicity._index(w, t.bounds, start, text)
    x, keep = toxicity.inputs(p, w).astype(np.float64), {}
    d = np.array([1.0, -0.5])[: len(toxicity.forward(p, x, index, keep))]
    g, dx = toxicity.backward(p, x, keep, d)
    for key in g:
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in p[key].shape)
            old, vals = p[key][at], []
            for e in (1e-4, -1e-4):
                p[key][at] = old + e
                vals.append(float(toxicity.forward(p, x, index) @ d))
            p[key][at] = old
            assert (vals[0] - vals[1]) / 2e-4 == pytest.approx(float(g[key][at]), abs=1e-3)


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def test_word_scores_and_scripts_by_loops():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    rows = [(t, x) for t, x in zip(docs.text[:80], docs.lang[:80])] + [("привет как дела друг " * 9, "ru")]
    model = langid.fit(rows)
    text = "Hello der été привет x"
    t = tokens.tokenize([text])
    scores, letters = langid.word_scores(model, t)
    words = re.findall(r"[^\W\d_]+", text.lower())
    assert list(letters) == [len(x) for x in words]
    shift = 64 - langid.TABLE_BITS
    for k, word in enumerate(words):
        total = np.zeros(len(model.languages))
        for i, c in enumerate(word):
            c1 = ord(word[i - 1]) if i > 0 else 32
            c2 = ord(word[i - 2]) if i > 1 else 32
            two = (ord(c) * tokens.BASE + c1) * 0xD6E8FEB86659FD93 & MASK
            three = (two + c2) * 0xCA5A826395121157 & MASK
            total += model.table[mixed(two + 1 & MASK) >> shift] + model.table[mixed(three) >> shift]
        total = np.maximum(total - total.max(), -langid.WORD_RANGE)
        cyrillic = word == "привет"
        for j, lang in enumerate(model.languages):
            assert scores[k, j] == (pytest.approx(total[j], abs=1e-3) if (lang == "ru") == cyrillic else -4 * langid.WORD_RANGE)
    # buckets of the fit: what each language counted, from texts by loops
    assert model.languages == sorted({x for _, x in rows})
