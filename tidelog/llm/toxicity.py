"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

Each word enters as the embedding of its hash beside the mean embedding of its character n-grams. A gated recurrent network
reads each window of words in both directions; attention pools the states to one score. All windows of a text, each
overlapping the next by half, are scored, and the text's score is that of its highest window.

The network learns from a bounded sample of labelled documents, half of them toxic. A toxic text doesn't say where it is
toxic: the first windows to learn from are those whose n-grams are the most telling, and later those that the network
itself scores highest (multiple-instance learning). Inputs are known per distinct word, so that the gates' input parts are
computed once a word and not once a position.

Defined results: null, empty and wordless texts get the score ``EMPTY_SCORE``; without labelled rows of both kinds every
score is that; of repeated labels for a document the highest counts; repeated rows are scored each for itself; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, ship, text_of, texts_in
from .tokens import BASE, U64, Tokens, chunks, mix, tokenize

#: The bound of the sample that the network learns from: documents of each label, taken by a hash of id and text, and their characters.
SAMPLE_PER_LABEL, SAMPLE_CHARS = 1500, 6_000_000
FOLDS, HELD_OUT = 5, 0
WIDTH, STRIDE = 16, 8
WORD_BITS, GRAM_BITS = 13, 15
WORD_DIM, GRAM_DIM, HIDDEN = 6, 14, 8
EPOCHS, BATCH, RATE = 4, 128, 0.01
EMPTY_SCORE = 0.0
#: Windows that are scored at once.
BLOCK = 16384


@dataclass
class Words:
    """Distinct words of some texts: hash, n-gram buckets (flat, with each word's first), and each position's word."""

    hash: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    at: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.grams)))


def distinct_words(t: Tokens) -> Words:
    """3- and 4-grams of each word with a mark at either end."""
    hashes, index, at = np.unique(t.hash, return_index=True, return_inverse=True)
    start, length = t.start[index], (t.end - t.start)[index]
    padded = length + 2
    first = np.cumsum(padded) - padded
    word = np.repeat(np.arange(len(length)), padded)
    inner = np.arange(len(word)) - first[word]
    c = np.where((inner == 0) | (inner == padded[word] - 1), 1, t.codes[np.minimum(start[word] + np.maximum(inner - 1, 0), len(t.codes) - 1)]).astype(U64)
    grams, owner = [], []
    with np.errstate(over="ignore"):
        for k in (3, 4):
            n = len(c) - k + 1
            if n <= 0:
                continue
            h = np.full(n, U64(k))
            for i in range(k):
                h = h * U64(BASE) + c[i : i + n]
            ok = word[:n] == word[k - 1 :]
            grams.append((mix(h)[ok] >> U64(64 - GRAM_BITS)).astype(np.int32))
            owner.append(word[:n][ok])
    g, o = (np.concatenate(grams), np.concatenate(owner)) if grams else (np.zeros(0, np.int32), np.zeros(0, int))
    order = np.argsort(o, kind="stable")
    return Words(hashes, g[order], np.searchsorted(o[order], np.arange(len(length))), at.astype(np.int32))


def _picked(w: Words, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of some distinct words, one word's after another's, and each word's number of them."""
    n = w.counts()[words]
    return w.grams[np.repeat(w.first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def vocabulary(texts: list[str]) -> tuple[Words, np.ndarray]:
    """The distinct words of many texts, taken up chunk by chunk, and the bounds of the texts in their positions."""
    parts, bounds = [], [np.zeros(1, int)]
    for a, b in chunks(texts):
        t = tokenize(texts[a:b])
        parts.append(distinct_words(t))
        bounds.append(bounds[-1][-1] + t.bounds[1:])
    together = Words(np.concatenate([w.hash for w in parts]), np.concatenate([w.grams for w in parts]), np.zeros(0, int), np.zeros(0, int))
    n = np.concatenate([w.counts() for w in parts])
    together.first = np.cumsum(n) - n
    hashes, index, inverse = np.unique(together.hash, return_index=True, return_inverse=True)
    grams, n = _picked(together, index)
    offset = np.cumsum([0, *(len(w.hash) for w in parts)])
    at = np.concatenate([inverse[offset[k] + w.at] for k, w in enumerate(parts)])
    return Words(hashes, grams, np.cumsum(n) - n, at.astype(np.int32)), np.concatenate(bounds)


def windows_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every window: each text's words in windows of WIDTH, one each STRIDE, the last reaching its end."""
    n = np.diff(bounds)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WIDTH) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return bounds[text] + k * STRIDE, text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def _init(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d, h = WORD_DIM + GRAM_DIM, HIDDEN
    p = {"word": r.normal(0, 0.1, (1 << WORD_BITS, WORD_DIM)), "gram": r.normal(0, 0.3, (1 << GRAM_BITS, GRAM_DIM)), "att": r.normal(0, 0.3, 2 * h), "out": r.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
    for way in "fb":
        p |= {f"w{way}": r.normal(0, d**-0.5, (d, 3 * h)), f"u{way}": r.normal(0, h**-0.5, (h, 3 * h)), f"c{way}": np.zeros(3 * h)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def inputs(p: dict, w: Words) -> np.ndarray:
    """The input vector of each distinct word."""
    n = w.counts()
    sums = np.zeros((len(n), GRAM_DIM), np.float32)
    for a in range(0, len(n), BLOCK):  # so many words at once
        own, low = n[a : a + BLOCK], w.first[a]
        some = own > 0
        if some.any():
            sums[a : a + BLOCK][some] = np.add.reduceat(p["gram"][w.grams[low : low + own.sum()]], (w.first[a : a + BLOCK] - low)[some], axis=0)
    return np.concatenate([p["word"][(w.hash >> U64(64 - WORD_BITS)).astype(np.int64)], sums / np.sqrt(np.maximum(n, 1))[:, None].astype(np.float32)], 1)


def _run(p: dict, gates: np.ndarray, way: str, live: np.ndarray, keep: list | None) -> np.ndarray:
    """gates (time, window, 3H): states (time, window, H). live (time, window): is there a word."""
    u, h = p[f"u{way}"], HIDDEN
    steps = range(len(gates)) if way == "f" else range(len(gates) - 1, -1, -1)
    s = np.zeros((gates.shape[1], h), np.float32)
    out = np.empty((*gates.shape[:2], h), np.float32)
    for t in steps:
        g = gates[t]
        zr = _sigmoid(g[:, : 2 * h] + s @ u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        a = s @ u[:, 2 * h :]
        c = np.tanh(g[:, 2 * h :] + r * a)
        m = live[t][:, None]
        new = s + m * (z * (c - s))
        if keep is not None:
            keep.append((t, s, z, r, a, c))
        s = out[t] = new
    return out


def forward(p: dict, x: np.ndarray, index: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """x: input vectors of distinct words; index (window, time): word or -1. Logits."""
    at = np.maximum(index.T, 0)
    live = (index.T >= 0).astype(np.float32)
    states = []
    for way in "fb":
        gates = (x @ p[f"w{way}"] + p[f"c{way}"])[at]
        states.append(_run(p, gates, way, live, None if keep is None else keep.setdefault(way, [])))
    s = np.concatenate(states, 2)
    e = s @ p["att"] + (live - 1) * np.float32(1e9)
    e = np.exp(e - e.max(0))
    e /= e.sum(0)
    pooled = np.einsum("tw,twh->wh", e, s)
    if keep is not None:
        keep |= {"s": s, "e": e, "pooled": pooled, "at": at, "live": live}
    return pooled @ p["out"] + p["bias"][0]


def backward(p: dict, x: np.ndarray, k: dict, d: np.ndarray) -> tuple[dict, np.ndarray]:
    """d: the loss's derivative by the logits. Gradients of the parameters but the embeddings, and of x."""
    g = {"out": k["pooled"].T @ d, "bias": np.array([d.sum()], np.float32)}
    dp = d[:, None] * p["out"]
    de = np.einsum("wh,twh->tw", dp, k["s"])
    de = k["e"] * (de - (k["e"] * de).sum(0))
    g["att"] = np.einsum("tw,twh->h", de, k["s"])
    ds = k["e"][:, :, None] * dp[None] + de[:, :, None] * p["att"]
    dx = np.zeros_like(x)
    h = HIDDEN
    for way, part in (("f", ds[:, :, :h]), ("b", ds[:, :, h:])):
        u, du = p[f"u{way}"], np.zeros_like(p[f"u{way}"])
        dgates = np.zeros((*part.shape[:2], 3 * h), np.float32)
        carry = np.zeros(part.shape[1:], np.float32)
        for t, s, z, r, a, c in reversed(k[way]):
            m = k["live"][t][:, None]
            dn = part[t] + carry
            dz, dc = m * dn * (c - s) * z * (1 - z), m * dn * z * (1 - c * c)
            dr, da = dc * a * r * (1 - r), dc * r
            dgates[t] = np.concatenate([dz, dr, dc], 1)
            rec = np.concatenate([dz, dr, da], 1)
            du += s.T @ rec
            carry = dn * (1 - m * z) + rec @ u.T
        flat = dgates.reshape(-1, 3 * h)
        by_word = np.stack([np.bincount(k["at"].ravel(), flat[:, j], len(x)) for j in range(3 * h)], 1).astype(np.float32)
        g[f"u{way}"], g[f"c{way}"], g[f"w{way}"] = du, flat.sum(0), x.T @ by_word
        dx += by_word @ p[f"w{way}"].T
    return g, dx


def _scatter(w: Words, dx: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Gradients of the embedding rows in use: (rows, gradient), from those of the input vectors."""
    out = {}
    rows, inverse = np.unique((w.hash >> U64(64 - WORD_BITS)).astype(np.int64), return_inverse=True)
    out["word"] = rows, np.stack([np.bincount(inverse, dx[:, j], len(rows)) for j in range(WORD_DIM)], 1)
    n = w.counts()
    rows, inverse = np.unique(w.grams, return_inverse=True)
    share = np.repeat(dx[:, WORD_DIM:] / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)
    out["gram"] = rows, np.stack([np.bincount(inverse, share[:, j], len(rows)) for j in range(GRAM_DIM)], 1)
    return out


def _index(w: Words, bounds: np.ndarray, start: np.ndarray, text: np.ndarray) -> np.ndarray:
    """(window, time): the distinct word at each place of each window; -1 beyond the text."""
    place = start[:, None] + np.arange(WIDTH)
    return np.where(place < bounds[text + 1][:, None], w.at[np.minimum(place, len(w.at) - 1)], -1)


def _score_windows(p: dict, x: np.ndarray, w: Words, bounds: np.ndarray, start: np.ndarray, text: np.ndarray) -> np.ndarray:
    gates = {way: x @ p[f"w{way}"] + p[f"c{way}"] for way in "fb"}
    out = np.empty(len(start), np.float32)
    for a in range(0, len(start), BLOCK):
        index = _index(w, bounds, start[a : a + BLOCK], text[a : a + BLOCK]).T
        at, live = np.maximum(index, 0), (index >= 0).astype(np.float32)
        s = np.concatenate([_run(p, gates[way][at], way, live, None) for way in "fb"], 2)
        e = s @ p["att"] + (live - 1) * np.float32(1e9)
        e = np.exp(e - e.max(0))
        out[a : a + BLOCK] = (np.einsum("tw,twh->wh", e, s) / e.sum(0)[:, None]) @ p["out"] + p["bias"][0]
    return out


def logits(p: dict, texts: list[str]) -> np.ndarray:
    """The highest window's logit of each text; -inf for texts without words."""
    out = np.full(len(texts), -np.inf, np.float32)
    for a, b in chunks(texts):
        t = tokenize(texts[a:b])
        if not len(t.start):
            continue
        w = distinct_words(t)
        start, text = windows_of(t.bounds)
        np.maximum.at(out, a + text, _score_windows(p, inputs(p, w), w, t.bounds, start, text))
    return out


def _telling(w: Words, bounds: np.ndarray, toxic: np.ndarray, texts: int = 100) -> np.ndarray:
    """For each distinct word: the log-odds of its most telling n-gram, by the toxic and other texts that have it."""
    seen = np.zeros((2, 1 << GRAM_BITS))
    for a in range(0, len(toxic), texts):
        b = min(a + texts, len(toxic))
        doc = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
        pairs = np.unique(np.stack([doc, w.at[bounds[a] : bounds[b]]], 1), axis=0)
        grams, n = _picked(w, pairs[:, 1])
        pairs = np.unique(np.repeat(pairs[:, 0], n).astype(np.int64) << GRAM_BITS | grams)
        y = toxic[a + (pairs >> GRAM_BITS)]
        for v in (0, 1):
            seen[v] += np.bincount(pairs[y == v] & ((1 << GRAM_BITS) - 1), minlength=1 << GRAM_BITS)
    odds = np.log((seen[1] + 0.3) / (toxic == 1).sum()) - np.log((seen[0] + 0.3) / (toxic == 0).sum())
    odds *= np.minimum(1, seen.sum(0) / 3)
    best = np.zeros(len(w.first))
    some = w.counts() > 0
    if some.any():
        best[some] = np.maximum.reduceat(odds[w.grams], w.first[some])
    return best


def fit(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the windows chosen each epoch: of a toxic text its highest one, of others the highest and two by chance."""
    r = np.random.default_rng(seed)
    p = _init(seed)
    w, bounds = vocabulary(texts)
    start, text = windows_of(bounds)
    telling = _telling(w, bounds, toxic)
    index = _index(w, bounds, start, text)
    score = np.where(index >= 0, telling[np.maximum(index, 0)], -np.inf).max(1)
    moments: dict[str, list] = {k: [np.zeros_like(v), np.zeros_like(v), 0] for k, v in p.items()}

    def step(key, rows, grad):
        m, v, n = moments[key]
        n += 1
        moments[key][2] = n
        grad = grad.astype(np.float32)
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        p[key][rows] -= RATE * (m[rows] / (1 - 0.9**n)) / (np.sqrt(v[rows] / (1 - 0.99**n)) + 1e-6)

    for epoch in range(epochs):
        order = np.lexsort((-score, text))
        first = np.flatnonzero(np.diff(text[order], prepend=-1))
        top = order[first]
        clean = np.flatnonzero(toxic[text] == 0)
        chosen = np.concatenate([top, r.choice(clean, min(len(clean), 2 * len(texts)), replace=False)])
        r.shuffle(chosen)
        for a in range(0, len(chosen), BATCH):
            own = chosen[a : a + BATCH]
            y = toxic[text[own]].astype(np.float32)
            words, local = np.unique(index[own], return_inverse=True)
            local = local.reshape(index[own].shape)
            if words[0] < 0:
                words, local = words[1:], local - 1
            grams, n = _picked(w, words)
            part = Words(w.hash[words], grams, np.cumsum(n) - n, local)
            x, keep = inputs(p, part), {}
            out = forward(p, x, local, keep)
            d = (_sigmoid(out) - y) / len(own)
            grads, dx = backward(p, x, keep, d.astype(np.float32))
            for key, g in grads.items():
                step(key, slice(None), g)
            for key, (rows, g) in _scatter(part, dx).items():
                step(key, rows, g)
        if epoch < epochs - 1:
            score = _score_windows(p, inputs(p, w), w, bounds, start, text)
    return p


def threshold_of(p: dict, texts: list[str], toxic: np.ndarray) -> float:
    """The logit between the labels with the fewest errors, in the middle of its gap."""
    z = logits(p, texts)
    z = np.where(np.isfinite(z), z, -30)
    order = np.argsort(z)
    z, y = z[order], toxic[order]
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    k = int(errors.argmin())
    return float((z[max(k - 1, 0)] + z[min(k, len(z) - 1)]) / 2)


def sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> list[tuple[str, int]]:
    """At most per_label documents of each label, none of the held-out fold."""
    known = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # labels that can hardly be in the sample go before the texts are met; enough stay for labels without a document
    counts = {r.toxic: r.c for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("c")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for y, c in counts.items() for x in (y, min(1.0, (4.0 * per_label + 200) / c))])[F.col("toxic")]
    near = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(near), "doc_id")
    return bounded_sample(rows, "toxic", per_label, SAMPLE_CHARS)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[dict, float] | None:
    rows = sample(docs, labels, per_label)
    texts, toxic = [t for t, _ in rows], np.array([y for _, y in rows])
    if not len(toxic) or toxic.min() == toxic.max() or not any(c.isalpha() for t in texts for c in t):
        return None
    p = fit(texts, toxic)
    return p, threshold_of(p, texts, toxic)


def score_documents(docs: DataFrame, model: tuple[dict, float] | None) -> DataFrame:
    """docs (doc_id, text): doc_id, score."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, EMPTY_SCORE)
            if known.value is not None:
                p, threshold = known.value
                z = logits(p, texts_in(batch))
                out = np.where(np.isfinite(z), 1 / (1 + np.exp(-np.clip(z.astype(float) - threshold, -30, 30))), EMPTY_SCORE)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score_documents(docs.select("doc_id", text_of().alias("text")), train(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
