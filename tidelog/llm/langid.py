"""Language ID of mixed texts: script ranges narrow the candidates, Viterbi over words labels spans.

A character n-gram model is fitted on a bounded sample of labelled documents. For each word, the scripts of its letters
leave only the languages that use them in the sample; each of these scores the word by its n-grams. Viterbi over the words
of a document, with a penalty for every switch, labels each word; runs of a label are the spans. The document's language is
that of most letters; its score is the share of letters so labelled.

Defined results: 'und' with score 0 for null texts and texts without letters; a word whose scripts no language uses is
open to all; unlabelled rows (null lang) are never learned from; with no labelled row at all everything is 'und'; rows that
repeat are predicted each for itself; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, ship, text_of, texts_in
from .tokens import BASE, U64, Tokens, char_tables, chunks, mix, tokenize

#: The bound of the sample that the model is fitted on: documents a language, taken by a hash of id and text, and their characters.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 500, 3_000_000
TABLE_BITS = 16
#: Log-odds that a switch of language costs, and the range a word's score may span.
SWITCH = 6.0
WORD_RANGE = 8.0
FOLDS, HELD_OUT = 3, 1
#: Code points that Viterbi takes up together: enough to spread its steps over many texts, few enough to bound memory.
GROUP = 3_000_000
#: First code points of script ranges, each up to the next.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"))
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
#: A language uses a script if at least this share of its letters in the sample is of it.
SCRIPT_SHARE = 0.001


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # n-gram bucket x language, log-probabilities
    scripts: np.ndarray  # language: bits of the scripts that it uses


def script_bits(codes: np.ndarray) -> np.ndarray:
    """The bit of each code point's script."""
    starts = np.array([s for s, _ in SCRIPTS])
    bit = np.array([1 << SCRIPT_NAMES.index(n) for _, n in SCRIPTS], np.int32)
    return bit[np.searchsorted(starts, codes, "right") - 1]


def gram_slots(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the 2- and the 3-gram that end at each letter, words being preceded by a blank; and each letter's word."""
    length = t.end - t.start
    word = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length) + t.start[word]
    first = at == t.start[word]
    c0 = t.codes[at].astype(U64)
    c1 = np.where(first, U64(32), t.codes[np.maximum(at - 1, 0)])
    c2 = np.where(first | (at - 1 == t.start[word]), U64(32), t.codes[np.maximum(at - 2, 0)])
    shift = U64(64 - TABLE_BITS)
    with np.errstate(over="ignore"):
        one = c0 * U64(BASE)
        two = (one + c1) * U64(0xD6E8FEB86659FD93)
        three = (two + c2) * U64(0xCA5A826395121157)
    return np.stack([mix(two + U64(1)) >> shift, mix(three) >> shift], 1).astype(np.int32), word


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows (text, language)."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0, np.int32))
    size = 1 << TABLE_BITS
    counts = np.zeros((size, len(languages)))
    scripts = np.zeros((len(languages), len(SCRIPT_NAMES)))
    by = {lang: [t for t, x in rows if x == lang] for lang in languages}
    for k, lang in enumerate(languages):
        for a, b in chunks(by[lang]):
            t = tokenize(by[lang][a:b])
            slots, _ = gram_slots(t)
            counts[:, k] += np.bincount(slots.ravel(), minlength=size)
            bits = script_bits(t.codes[char_tables()[0][t.codes]])
            scripts[k] += [np.count_nonzero(bits == 1 << s) for s in range(len(SCRIPT_NAMES))]
    p = (counts + 0.5) / (counts.sum(0) + 0.5 * size)
    used = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))
    return Model(languages, (np.log(p) - np.log(p).mean(1, keepdims=True)).astype(np.float32), (used * (1 << np.arange(len(SCRIPT_NAMES)))).sum(1).astype(np.int32))


def word_scores(model: Model, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """words x languages log-odds, and each word's letters."""
    slots, word = gram_slots(t)
    starts = np.cumsum(t.end - t.start) - (t.end - t.start)
    gained = model.table[slots[:, 0]] + model.table[slots[:, 1]]
    scores = np.add.reduceat(gained, starts, axis=0)
    scores = np.maximum(scores - scores.max(1, keepdims=True), -WORD_RANGE)
    bits = np.bitwise_or.reduceat(script_bits(t.codes[np.repeat(t.start - starts, t.end - t.start) + np.arange(len(word))]), starts)
    allowed = (model.scripts[None, :] & bits[:, None]) == bits[:, None]
    allowed |= ~allowed.any(1, keepdims=True)
    return np.where(allowed, scores, np.float32(-4 * WORD_RANGE)), t.end - t.start


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word; texts are the ranges between bounds. All texts advance together, word by word.

    Runs over whole columns of texts, the longest texts first, so that each step handles those still running.
    """
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    first, n = bounds[:-1][order], n[order]
    longest = int(n[0]) if len(n) else 0
    running = np.searchsorted(-n, -np.arange(longest), "left")  # texts with more than k words
    came = np.zeros(scores.shape, np.int8 if scores.shape[1] < 127 else np.int32)
    labels = np.zeros(len(scores), np.int32)
    here = np.arange(scores.shape[1], dtype=came.dtype)
    best = scores[first].copy() if longest else None
    for k in range(1, longest):
        m = running[k]
        prior = best[:m]
        top = prior.argmax(1)
        jump = prior[np.arange(m), top] - np.float32(switch)
        stay = prior >= jump[:, None]
        came[first[:m] + k] = np.where(stay, here, top[:, None].astype(came.dtype))
        best[:m] = np.where(stay, prior, jump[:, None]) + scores[first[:m] + k]
    if longest:
        state = best.argmax(1)
        labels[first + n - 1] = state
        for k in range(longest - 1, 0, -1):
            m = running[k]
            state[:m] = came[first[:m] + k, state[:m]]
            labels[first[:m] + k - 1] = state[:m]
    return labels


@dataclass
class Labels:
    """The words of many texts with their labels: the texts' bounds among them, each word's letters, its place in its text."""

    bounds: np.ndarray
    label: np.ndarray
    letters: np.ndarray
    start: np.ndarray


def label_words(model: Model, texts: list[str]) -> Labels:
    """Words are scored chunk by chunk; then Viterbi goes through all texts at once."""
    bounds, scores, letters, starts = [np.zeros(1, int)], [], [], []
    for a, b in chunks(texts):
        t = tokenize(texts[a:b])
        bounds.append(bounds[-1][-1] + t.bounds[1:])
        if len(t.start):
            s, n = word_scores(model, t)
            offsets = np.cumsum([0, *(len(x.lower()) + 1 for x in texts[a : b - 1])])
            scores.append(s)
            letters.append(n.astype(np.int32))
            starts.append((t.start - np.repeat(offsets, np.diff(t.bounds))).astype(np.int32))
    edges = np.concatenate(bounds)
    if not scores:
        return Labels(edges, np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32))
    return Labels(edges, viterbi(np.concatenate(scores), edges), np.concatenate(letters), np.concatenate(starts))


def predict(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    out, score = ["und"] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return out, score
    n = len(model.languages)
    for a, b in chunks(texts, GROUP):
        w = label_words(model, texts[a:b])
        doc = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(w.bounds))
        letters = np.bincount(doc * n + w.label, w.letters, (b - a) * n).reshape(b - a, n)
        total = letters.sum(1)
        for k in np.flatnonzero(total):
            out[a + k] = model.languages[letters[k].argmax()]
        np.divide(letters.max(1), total, out=score[a:b], where=total > 0)
    return out, score


def spans(model: Model, text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, language) of the runs of one language, by positions in the lower-cased text."""
    out: list[tuple[int, int, str]] = []
    w = label_words(model, [text or ""])
    for s, n, k in zip(w.start, w.letters, w.label, strict=True):
        lang = model.languages[k]
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], int(s + n), lang)
        else:
            out.append((int(s), int(s + n), lang))
    return out


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` documents of each language, none of the held-out fold."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT))
    return fit(bounded_sample(learn.select("doc_id", "text", "lang"), "lang", per_language, SAMPLE_CHARS))


def identify(docs: DataFrame, model: Model, out: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """docs with all their columns, and the predicted language and its score by the names in ``out``, which must be new."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").alias(out[0]), F.lit(0.0).alias(out[1])).schema
    at = docs.columns.index("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predict(known.value, texts_in(batch, at))
            columns = [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *out])

    return docs.mapInArrow(label, schema)


def language_report(docs: DataFrame) -> DataFrame:
    model = train(docs)
    rows = identify(docs.select("doc_id", text_of().alias("text")), model)
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
