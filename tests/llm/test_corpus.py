import collections
import datetime
import gzip
import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import common, decontaminate, fingerprint, htmltext, langid, mixing, neardup, queries, secretscan, sharding, tokens, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i:03d}" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


ODD = [None, "", " ", "!!!", "one", "one", prose(1, 6000), "same text " * 20, "same text " * 20, "ﬁ Ünḯ \U0001f600 \x00"]


@pytest.fixture(scope="module")
def frames():
    return {t: pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages", "labels", "benchmark")}


def shingle_set(text, words=r"[^\W_]+"):
    w = re.findall(words, (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted(cur.fetchall(), key=key)


def test_fingerprints(spark, frames):
    got = {r.doc_id: r for r in queries.queries()["op1_fingerprints"](spark, SF).collect()}
    d = frames["documents"].sort_values("doc_id")
    texts = list(d.text)
    errors = []
    for i, t in zip(d.doc_id, texts):
        nxt = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        a, b = shingle_set(t), shingle_set(edited)
        errors.append(got[i].near_edited - len(a & b) / max(1, len(a | b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_fingerprint_edges(spark):
    ids = [7, None, 1 << 40, -5, 7, 3, 1 << 41, 64, 65, 128]
    rows = {(r.doc_id, r.n_chars): r for r in fingerprint.fingerprint_documents(docs_of(spark, ODD, ids)).collect()}
    assert len(rows) == 10
    assert rows[(7, 0)].fingerprint == "" == rows[(None, 0)].fingerprint
    order = sorted(range(10), key=lambda k: (ids[k] is not None, ids[k] or 0, ODD[k] or ""))
    for a, b in zip(order, order[1:] + order[:1]):
        t, n = ODD[a] or "", ODD[b] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert rows[(ids[a], len(t))].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert fingerprint.fingerprint_documents(docs_of(spark, [])).collect() == []
    single = fingerprint.fingerprint_documents(docs_of(spark, [prose(2, 50)])).first()
    assert single.near_next == 1.0


@pytest.mark.parametrize("wide", [0, 1 << 62])
def test_fingerprints_of_hot_ids(spark, monkeypatch, wide):
    r = random.Random(9)
    rows = [(None, prose(k % 40, 12)) for k in range(120)] + [(7, f"common beginning {prose(k, 8)}") for k in range(60)]
    rows += [(7, "") for _ in range(30)] + [(None, None), (None, "ﬁ"), (None, "a"), (None, "a\x00")] + [(k, prose(k, 20)) for k in range(60, 300)] + [(wide, "end"), (-wide, "start")]
    r.shuffle(rows)
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(5)
    columns = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    facts = lambda: collections.Counter(tuple(x[c] for c in columns) for x in fingerprint.fingerprint_documents(docs).collect())
    whole = facts()
    monkeypatch.setattr(fingerprint, "HOT_ROWS", 20)
    assert facts() == whole
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    want = collections.Counter()
    for (known, i, t), (_, _, n) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want[(i if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    got = collections.Counter()
    for x, k in whole.items():
        got[x[:3]] += k
    assert got == want


def test_successors_over_several_levels(spark):
    r = random.Random(5)
    ids = sorted({r.randrange(-(10**9), 10**12) for _ in range(300)})
    rows = fingerprint.following(spark.createDataFrame([(i,) for i in ids], "g long"), ids[0], ids[-1]).collect()
    assert {x.g: x.next for x in rows} == dict(zip(ids, ids[1:] + ids[:1]))


PAGE = "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class='x'>Top box</div><article><h1>A &amp; B</h1><p>Some <b>bo</b>ld\n text {}.<br>more<p>next&nbsp;one<aside>no</aside></article><footer>f</footer></body>"


def test_html(spark, frames):
    assert htmltext.main_text(PAGE.format("here")) == "A & B Some bold text here. more next one"
    assert htmltext.main_text("<p>a<p>b<script>x='</p>'</script><div id=comments>c</div><!-- d -->") == "a b"
    assert [htmltext.main_text(x) for x in (None, "", "<", "plain", "<div" * 3000, "<div>" * 3000 + "deep")] == ["", "", "<", "plain", "", "deep"]
    rows = [(i, "http://h/" + str(i), f"<body><div><span>Site box</span></div><div>Words of page {i} {prose(i, 30)}</div></body>") for i in range(6)] + [(90, None, None), (91, "x", "")]
    got = {r.page_id: r.text for r in htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Site box" not in got[i] and got[i].startswith(f"Words of page {i} ") for i in range(6)) and got[90] == got[91] == ""
    same = [(i, "http://h/", PAGE.format("copy")) for i in range(9)]
    assert {r.text for r in htmltext.extract_pages(spark.createDataFrame(same, "page_id long, url string, html string")).collect()} == {"A & B Some bold text copy. more next one"}
    whole = {r.page_id: r.text for r in queries.queries()["op2_html_text"](spark, SF).collect()}
    for i, h in zip(frames["pages"].page_id, frames["pages"].html):
        body = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        body = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", body))
        assert whole[i] == " ".join(__import__("html").unescape(body).split())


def test_html_template_join_for_many_hashes(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}/", f"<body><div><i>Box {i % 2}</i></div><div>Page {i} {prose(i, 30)}</div></body>") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(tuple(r) for r in htmltext.extract_pages(pages).collect())
    monkeypatch.setattr(htmltext, "BROADCAST_ROWS", 1)
    assert sorted(tuple(r) for r in htmltext.extract_pages(pages).collect()) == want and "Box" not in str(want)


def test_toxicity_learns_and_handles_odd_rows(spark):
    r = random.Random(1)
    bad = ["grommel", "grommels", "vexling", "vexlings"]
    rows, labels = [], []
    for i in range(500):
        y = i % 3 == 0
        w = prose(i, r.randrange(5, 120)).split()
        if y:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(y)))
    rows += [(1000 + k, t, None, None, None) for k, t in enumerate(ODD)] + [(None, "grommel", None, None, None)]
    labels += [(0, 1, 1), (7777, 0, 1), (None, 0, 0)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_report(docs, marks).collect()
    assert len(got) == 511
    held = [g for g in got if g.held_out and g.doc_id < 500]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got if g.doc_id is not None)
    assert np.mean([g.predicted == (g.doc_id % 3 == 0) for g in held]) > 0.95
    assert all(0 <= g.score <= 1 for g in got)
    assert {r.score for r in toxicity.toxicity_report(docs, marks.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity_report(docs.limit(0), marks).collect() == []


def test_network_gradients():
    p = {k: v.astype(np.float64) for k, v in toxicity._init(3).items()}
    t = tokens.tokenize(["alpha beta gamma delta", "beta beta epsilon"])
    w = toxicity.distinct_words(t)
    start, text = toxicity.windows_of(t.bounds)
    index = toxicity._index(w, t.bounds, start, text)
    x = toxicity.inputs(p, w).astype(np.float64)
    keep = {}
    out = toxicity.forward(p, x, index, keep)
    d = np.array([1.0, -0.5])[: len(out)]
    g, dx = toxicity.backward(p, x, keep, d)
    for key in ("uf", "wb", "cb", "att", "out"):
        at = tuple(0 for _ in p[key].shape)
        old = p[key][at]
        vals = []
        for e in (1e-3, -1e-3):
            p[key][at] = old + e
            vals.append(float(toxicity.forward(p, x, index) @ d))
        p[key][at] = old
        assert abs((vals[0] - vals[1]) / 2e-3 - g[key][at]) < 2e-3


def brute_base(text):
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets(spark, frames):
    got = {r.doc_id: r for r in queries.queries()["op4_secrets"](spark, SF).collect()}
    for i, t in zip(frames["documents"].doc_id, frames["documents"].text):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_base(t))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    key = 'password = "hunter2hunter2"'
    b64 = lambda b: base64.b64encode(b).decode()
    nested = "x " + b64(("see " + b64(gzip.compress(key.encode()))).encode()) + " y"
    assert secretscan.find(nested).spans == [("assign", 2, len(nested) - 2)] and not secretscan.find(nested).base
    assert secretscan.find("é p%61ssword%3Dabcdefghijk z").spans == [("assign", 2, 26)]
    assert secretscan.find("\\u0070assword=abcdefghij").spans == [("assign", 0, 24)]
    assert secretscan.find("&#112;assword=abcdefghij").spans == [("assign", 0, 24)]
    assert secretscan.find("%2541KIA" + "A" * 16).spans == [("access", 0, 24)]
    assert [secretscan.find(t).spans for t in ODD] == [[]] * len(ODD)
    assert [r.spans for r in secretscan.scan_documents(docs_of(spark, [None, ""])).collect()] == ["", ""]


def test_decontamination_edges(spark, monkeypatch):
    long = prose(9, 60)
    items = [(1, long), (2, "Short item é"), (3, ""), (4, None), (5, "!!"), (6, long), (10, prose(8, 13))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [long.upper() + " x", prose(3, 300) + " short ITEM é " + prose(4, 300), "short item", " ".join(long.split()[:12]), " ".join(long.split()[:13]), prose(7, 2000) + " " + long, *ODD]
    want = None
    for most in (100_000, 0):  # with the broadcast set, and without
        monkeypatch.setattr(decontaminate, "MOST_GRAMS", most)
        rows = {r.doc_id: r for r in decontaminate.contamination_report(docs_of(spark, texts), bench).collect()}
        assert len(rows) == len(texts)
        assert (rows[0].n_hit, rows[0].n_items, rows[0].contaminated) == (60, 2, True)
        assert rows[0].items_sha256 == hashlib.sha256(b"1,6").hexdigest()
        assert (rows[1].n_hit, rows[1].n_items, rows[1].contaminated) == (3, 1, False)
        assert (rows[2].n_hit, rows[3].n_hit, rows[4].n_hit, rows[5].contaminated) == (0, 0, 13, False)
        assert (rows[6].n_words, rows[6].contaminated) == (0, False)
        assert want is None or want == rows
        want = rows
    assert len(decontaminate.keep_uncontaminated(docs_of(spark, texts), bench).collect()) == len(texts) - 2
    odd = docs_of(spark, texts[:2]).select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(("gram", "row_id", "n_words", "_w", "row", "items"))])
    got = {r.doc_id: r for r in decontaminate.decontaminate(odd, bench).collect()}
    assert (got[0].n_words, got[0].n_words_, got[0]._w, got[0].row) == (2, 61, 3, 4) and sorted(got[0].items_) == [1, 6]
    mapped = odd.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert [r.doc_id for r in decontaminate.keep_uncontaminated(mapped, bench).collect()] == [1]
    unnamed = spark.createDataFrame([(None, long)], "item_id long, text string")
    assert tuple(decontaminate.contamination_report(docs_of(spark, [long]), unnamed).first())[1:4] == (60, 60, 0)
    none = decontaminate.contamination_report(docs_of(spark, ["a b"]), bench.limit(0)).first()
    assert (none.n_words, none.n_hit, none.contaminated) == (2, 0, False)


def common_in_order(a, b):
    """Longest common subsequence by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_near_duplicates_against_all_pairs(spark, frames):
    """Classes of the pairs whose alignment of words reaches 0.8; these hold all pairs with 0.8 of their five-word runs in common."""
    d = frames["documents"]
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in zip(d.doc_id, d.text)}
    bags = {i: collections.Counter(w) for i, w in words.items()}
    sets = {i: shingle_set(t) for i, t in zip(d.doc_id, d.text)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    runs = []
    for a in sets:
        for b in sets:
            if a < b and words[a] and words[b]:
                n = len(words[a]) + len(words[b])
                if sum((bags[a] & bags[b]).values()) * 1.8 >= 0.8 * n - 1e-9:
                    m = common_in_order(words[a], words[b])
                    if m >= 0.8 * (n - m) - 1e-9:
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    runs.append((a, b))
    got = {r.doc_id: r.class_id for r in queries.queries()["op6_near_duplicates"](spark, SF).collect()}
    assert got == {i: find(i) for i in sets}
    assert runs and all(got[a] == got[b] for a, b in runs)


@pytest.mark.parametrize("share, least", [(0.01, 1.0), (0.03, 0.99), (0.05, 0.97), (0.1, 0.9)])
def test_recall_by_share_of_edited_words(spark, share, least):
    """Pairs of a text and one copy: words changed, left out and put in, each a third of the edits."""
    r = random.Random(int(share * 1000))
    texts = []
    for k in range(300):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        texts.append(" ".join(words))
        for e in range(int(share * 200)):
            at = r.randrange(len(words))
            words[at : at + (e % 3 != 1)] = [] if e % 3 == 2 else [f"e{r.randrange(10**6)}"]
        texts.append(" ".join(words))
    got = {x.doc_id: x.class_id for x in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(300)) >= least * 300
    assert len(set(got.values())) >= 300


def test_near_duplicate_groups_and_edges(spark):
    r = random.Random(4)
    base = prose(50, 200).split()
    texts = []
    for _ in range(60):
        w = list(base)
        w[r.randrange(200)] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(w))
    shuffled = base[100:] + base[:100]  # the same runs, another order
    texts += [" ".join(shuffled), *ODD]
    rows = {r.doc_id: r for r in neardup.near_duplicates(docs_of(spark, texts)).collect()}
    assert {rows[i].class_id for i in range(60)} == {0} and rows[0].class_size == 60 and rows[60].class_id == 60
    odd = {k: rows[61 + k].class_id - 61 for k in range(len(ODD))}
    assert odd == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9}
    assert neardup.near_duplicates(docs_of(spark, [])).collect() == []
    again = docs_of(spark, ["a b c", "d e f", "d e f", "x y z", None], [1, 1, 2, None, None])
    assert sorted((str(r.doc_id), r.class_id) for r in neardup.near_duplicates(again).collect()) == [("1", 1), ("1", 1), ("2", 1), ("None", None), ("None", None)]
    assert sorted(str(r.doc_id) for r in neardup.keep_representatives(again).collect()) == ["1", "None", "None"]


def test_alignment_equals_full_table():
    r = np.random.default_rng(2)
    for _ in range(60):
        a = r.integers(0, 6, r.integers(1, 40)).astype(np.uint64)
        b = np.delete(a, r.integers(0, len(a))) if r.random() < 0.5 else np.concatenate([a[:3], r.integers(0, 6, 2).astype(np.uint64), a[3:]])
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        m = table[-1, -1]
        s = m / (len(a) + len(b) - m)
        assert neardup.similarity(a, b) == pytest.approx(s if s >= 0.8 else 0.0)


def test_quick_answers_agree_with_the_alignment():
    r = np.random.default_rng(6)
    for _ in range(400):
        a = r.integers(0, 80, r.integers(1, 60)).astype(np.uint64)
        b = a.copy()
        for _ in range(r.integers(0, 12)):
            at = r.integers(0, len(b) + 1)
            b = r.choice([0, 1, 2]) and np.concatenate([b[:at], r.integers(0, 80, 1).astype(np.uint64), b[at + r.integers(0, 2) :]]) if len(b) else a.copy()
            b = np.atleast_1d(np.asarray(b, np.uint64))
        assert neardup._anchored(a, b) <= common_in_order(a.tolist(), b.tolist())
        assert neardup.near(a, b) == (neardup.similarity(a, b) > 0)


def test_rows_that_repeat_an_id(spark):
    texts = [prose(70, 80), prose(71, 80), prose(71, 80), prose(72, 80), None, ""]
    docs = docs_of(spark, texts, [1, 1, 2, 3, 3, None]).withColumn("m", F.create_map(F.lit("a"), F.lit(1))).withColumn("id", F.lit(9)).withColumn("_id", F.lit(8))
    kept = sorted((str(r.doc_id), r.text or "") for r in neardup.keep_representatives(docs).collect())
    assert [i for i, _ in kept] == ["1", "3", "None"] and kept == sorted((str(r.doc_id), r.text or "") for r in neardup.keep_representatives(docs.repartition(3)).collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (101, 103), (102, 103), (7, 7)]
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}


def test_sharding_round_trip(spark, tmp_path):
    docs = docs_of(spark, [prose(i, 50) for i in range(500)] + [None, ""], [*range(500), None, 500]).withColumn("shard", F.lit("mine"))
    s = sharding.ShardSet(spark, f"file://{tmp_path}/s", target=200_000, small=4_000, shard_rows=20)
    for part in sharding.arrivals(docs, 3):
        s.append(part)
    first = s.version()
    before = len(s.manifest())
    assert s.compact() > first and len(s.manifest()) < before
    rows = lambda df: sorted((str(r.doc_id), r.text or "", r.shard) for r in df.collect())
    assert rows(s.read(out=("n", "b"))) == rows(docs) == rows(s.read(first, ("n", "b")))
    assert not s.runs(s.manifest()) and all(x.bytes <= 200_000 for x in s.manifest())
    s.vacuum()
    assert rows(s.read(first, ("n", "b"))) == rows(docs)
    s.vacuum(0)
    assert rows(s.read(out=("n", "b"))) == rows(docs)
    with pytest.raises(sharding.ManifestConflict):
        s.commit(s.version() - 1, [])
    assert sharding.placement(docs_of(spark, [])).collect() == []
    assert sharding.placement(docs).count() == 502


def test_language(spark, frames):
    d = frames["documents"].set_index("doc_id")
    got = queries.queries()["op8_language"](spark, SF).collect()
    held = [g for g in got if g.held_out]
    assert np.mean([g.lang_pred == d.lang[g.doc_id] for g in held]) > 0.9
    model = langid.fit([(t, x) for t, x in zip(frames["documents"].text, frames["documents"].lang)] + [("привет как дела друг " * 9, "ru")])
    by = {x: t.split("\n")[0] for t, x in zip(frames["documents"].text, frames["documents"].lang) if len(t) > 400 and "%" not in t}
    assert langid.predict(model, ["привет", None or "", "123", "漢字"])[0][:3] == ["ru", "und", "und"]
    mixed = " ".join((by["en"] + " ") .split()[:25] + "привет как дела".split() + by["de"].split()[:25])
    labels = [x for _, _, x in langid.spans(model, mixed)]
    assert labels[0] == "en" and "ru" in labels and labels[-1] == "de"
    rows = langid.language_report(docs_of(spark, ODD)).collect()
    assert [r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 3)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in langid.language_report(docs_of(spark, ["a b"]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_report(docs_of(spark, [])).collect() == []


def test_viterbi_against_all_paths():
    r = np.random.default_rng(1)
    import itertools

    for n in (1, 2, 5):
        s = r.normal(0, 3, (n, 3)).astype(np.float32)
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(s[i, k] for i, k in enumerate(p)) - 2 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(langid.viterbi(s, np.array([0, n]), 2.0)) == best


def test_url_filters(spark):
    day = lambda x: f"2022-01-{x:02d}"
    entries = spark.createDataFrame([("a.com", day(5), "block"), ("a.com", day(10), "remove"), ("x.a.com", day(7), "allow"), ("a.com", day(5), "allow"), (None, day(1), "block"), ("com", day(1), "block")], "key string, day string, action string").withColumn("day", F.to_date("day"))
    rows = [(1, "http://a.com/", 4), (2, "http://A.com:80/q", 5), (3, "http://u@y.a.com?", 9), (4, "http://a.com", 10), (5, "http://x.a.com/", 8), (6, None, 8), (7, "nohost", 8), (8, "http://x.a.com", 6), (8, "http://x.a.com", 6), (9, "http://a.com", None)]
    captures = spark.createDataFrame([(i, u, None if d is None else day(d), "z") for i, u, d in rows], "page_id long, url string, fetch_day string, extra string").withColumn("fetch_day", F.to_date("fetch_day"))
    got = sorted((r.page_id, r.verdict) for r in urlfilter.evaluate(captures, entries).collect())
    assert got == [(1, "keep"), (2, "block"), (3, "block"), (4, "keep"), (5, "keep"), (6, "keep"), (7, "keep"), (8, "block"), (8, "block"), (9, "keep")]
    assert urlfilter.evaluate(captures.limit(0), entries).collect() == []
    assert {r.verdict for r in urlfilter.evaluate(captures, entries.limit(0)).collect()} == {"keep"}
    clash = captures.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("host", "rule", "_row", "key", "day", "id"))])
    out = urlfilter.evaluate(clash, entries)
    assert out.columns == [*clash.columns, "host_", "verdict", "rule_", "rule_since"]
    assert {(r.host, r.rule, r._row, r.key) for r in out.collect()} == {(0, 1, 2, 3)} and sorted((r.page_id, r.verdict) for r in out.collect()) == got


def test_as_of_against_every_interval(spark):
    r = random.Random(8)
    start = datetime.date(2020, 1, 15)
    day = lambda: start + datetime.timedelta(r.randrange(900))
    keys = ["a.com", "x.a.com", "b.org", "c.net", "y.c.net"]
    entries = [(r.choice(keys[:4]), day(), r.choice(["block", "allow", "remove"])) for _ in range(60)]
    rows = [(i, f"http://{'y.c.net' if i % 3 == 0 else r.choice(keys)}/", day()) for i in range(1500)]  # a hot key
    got = {x.page_id: (x.verdict, x.rule, x.rule_since) for x in urlfilter.evaluate(spark.createDataFrame(rows, "page_id long, url string, fetch_day date"), spark.createDataFrame(entries, "key string, day date, action string")).collect()}
    rank = {"remove": 0, "allow": 1, "block": 2}
    for i, url, at in rows:
        host, want = url[7:-1], ("keep", None, None)
        for key in sorted(keys, key=len):
            own = [(d, rank[a]) for k, d, a in entries if k == key and d <= at]
            if (host == key or host.endswith("." + key)) and own and max(own)[1]:
                want = ("block" if max(own)[1] == 2 else "keep", key, max(own)[0])
        assert got[i] == want


def test_mixing(spark, frames, monkeypatch):
    sizes = iter([900, 50, 30, 20, 10, 7, 300, 40])  # every combination occurs, so that all marginals can be met
    cells = [(s, x, t, next(sizes)) for s in ("s1", None) for x in ("en", "fr") for t in ("a", "b")]
    w = mixing.rake(cells, {"lang": {"en": 0.5, "fr": 0.5}, "source": {"s1": 0.4, None: 0.6}}, 200)
    assert w.sum() == pytest.approx(1) and w[:4].sum() == pytest.approx(0.4, abs=1e-6)
    assert w[[2, 3, 6, 7]].sum() == pytest.approx(0.5, abs=1e-6)
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").groupBy("source", "lang", mixing.topic_of(F.col("text")).alias("topic")).agg(F.sum(mixing.tokens_of(F.col("text")))).collect()
    real = sorted((tuple(r) for r in real), key=str)
    assert mixing.deviation(real, mixing.rake(real)) < 1e-4 and mixing.deviation(real, mixing.rake(real, rounds=200)) < mixing.deviation(real, mixing.rake(real, rounds=1))
    p = mixing.calibrate(w, np.array([c[-1] for c in cells], float), 0.3)
    assert (p * [c[-1] for c in cells]).sum() == pytest.approx(0.3 * 1357) and p.max() <= 1
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), mixing.tokens_of(F.col("text")).alias("tokens"))
    want = {tuple(r)[:3]: r.probability for r in mixing.probabilities(docs, rounds=5).collect()}
    monkeypatch.setattr(mixing, "MOST_CELLS", 3)
    got = {tuple(r)[:3]: r.probability for r in mixing.probabilities(docs, rounds=5).select("source", "lang", "topic", "probability").collect()}
    assert got == pytest.approx(want, rel=1e-9)
    corpus = spark.read.parquet(f"{SF}/documents.parquet")
    large = {r.doc_id for r in mixing.mix_sources(corpus).collect()}
    monkeypatch.undo()
    assert large == {r.doc_id for r in mixing.mix_sources(corpus).collect()}
    odd = docs_of(spark, ODD).withColumn("source", F.lit(None).cast("string")).withColumn("_topic", F.lit(1))
    assert set(mixing.mix_sources(odd, budget=1.0).columns) == {*odd.columns, "mix_topic", "mix_tokens", "probability"}
    # texts without tokens are kept by the probability of their cell, here 1 for every cell
    assert sorted(r.doc_id for r in mixing.mix_sources(odd, budget=1.0).select("doc_id").collect()) == list(range(len(ODD)))
    assert mixing.mix_sources(docs_of(spark, [])).collect() == [] == mixing.mix_sources(docs_of(spark, [None])).collect()


def test_raking_many_cells(spark, monkeypatch):
    """Beyond MOST_CELLS: null as value and as target, an attribute without tokens, factors joined by shuffle, no tokens at all."""
    schema = "source string, lang string, topic string, tokens long"
    cells = spark.createDataFrame([("a", "x", "t", 5), (None, "x", "t", 3), ("a", "y", "t", 2), ("z", "y", "u", 0)], schema)
    targets = {"source": {"a": 0.4, None: 0.6, "absent": 0.5}}
    of = lambda df: {(r.source, r.lang, r.topic): r.probability for r in df.collect()}
    want = of(mixing.probabilities(cells, targets, rounds=2))
    monkeypatch.setattr(mixing, "MOST_CELLS", 1)
    assert of(mixing.probabilities(cells, targets, rounds=2)) == pytest.approx(want, rel=1e-6)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert of(mixing.probabilities(cells, targets, rounds=1)) == pytest.approx(of_small(spark, cells, targets), rel=1e-6)
    assert set(of(mixing.probabilities(cells.withColumn("tokens", F.lit(0).cast("long")), targets, rounds=1)).values()) == {0.0}


def of_small(spark, cells, targets):
    """The same by the numpy path: one round."""
    rows = sorted((tuple(r) for r in cells.collect()), key=str)
    p = mixing.calibrate(mixing.rake(rows, targets, 1), np.array([r[-1] for r in rows], float), mixing.BUDGET)
    return {r[:3]: float(x) for r, x in zip(rows, p)}


def test_join_hot_keeps_every_row(spark):
    left = spark.createDataFrame([(1 if i < 900 else i, i) for i in range(1000)] + [(None, 5000)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (950, "c")], "k long, x string")
    got = collections.Counter(r.x for r in common.join_hot(left, right, ["k"], 1001, F.xxhash64("v")).collect())
    assert got == {"a": 900, "b": 900, "c": 1, None: 100}


def test_bounded_sample(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 10 == 0, "x").otherwise("y").alias("k"))
    n = collections.Counter(k for _, k in common.bounded_sample(rows, "k", 100, 10**6))
    assert n == {"x": 100, "y": 100}
    # a value all of whose rows share an id, one all of whose rows are the same, one with long texts
    hot = spark.range(30000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("text"), F.lit("hot").alias("k"))
    same = spark.range(30000).select(F.lit(8).alias("doc_id"), F.lit("s").alias("text"), F.lit("same").alias("k"))
    long_ = spark.range(50).select(F.col("id").alias("doc_id"), F.repeat(F.lit("l"), 1000).alias("text"), F.lit("long").alias("k"))
    got = common.bounded_sample(rows.union(hot).union(same).union(long_), "k", 100, 2500)
    assert collections.Counter(k for _, k in got) == {"x": 100, "y": 100, "hot": 100, "same": 1, "long": 3}
    assert common.bounded_sample(rows.limit(0), "k", 100, 10**6) == []


def test_pipeline(spark, frames):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = common.materialize(stage(spark, at, SF), name)
        kept[name] = {r.doc_id for r in at.collect()}
        if name != "sharding":
            assert at.columns == docs.columns
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert kept["near_dedup"] == {i for i in kept["language"] if classes[i] == i}
    bad = {r.doc_id for r in decontaminate.contamination_report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert bad and kept["decontamination"] == kept["near_dedup"] - bad
    assert kept["mixing"] and kept["mixing"] < kept["decontamination"] and kept["sharding"] == kept["mixing"]
    odd = docs_of(spark, ODD).unionByName(docs).withColumn("lang_pred", F.lit(3)).withColumn("shard", F.lit(4)).withColumn("k1", F.lit(5)).withColumn("_tokens", F.lit(6))
    for name, stage in corpus_pipeline.STAGES:
        odd = common.materialize(stage(spark, odd, SF), name)
    assert odd.count() > 0
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = common.materialize(stage(spark, empty, SF), name)
    assert empty.count() == 0
