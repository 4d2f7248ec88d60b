import re
import time

import pandas as pd
from pyspark.sql import functions as F

from tidelog.llm import htmltext, queries

SCHEMA = "page_id long, url string, html string"


def site(k):
    """No class names and no article: a menu whose items change, a notice, rotating boxes, a footer, and the page's own words."""
    menu = "".join(f"<li><a href='/{k}{i}'>Item {k} {i}</a></li>" for i in range(4 + k % 3))
    words = " ".join(f"word{k}x{i}" for i in range(40))
    return f"<body><div><ul>{menu}</ul></div><div>We use biscuits on this site, read all about them here and there.</div><div><h1>Title {k}</h1><p>{words}</p></div><section><p>Box number {k % 5}</p></section><div>Imprint</div></body>", f"Title {k} {words}"


def test_counting_alone_gives_the_article(spark):
    rows = [(k, f"http://h/{k}", site(k)[0]) for k in range(40)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r for r in htmltext.extract_pages(pages).collect()}
    assert all(got[k].text == site(k)[1] and got[k].n_template == 4 for k in range(40))


def test_templates_of_the_pages_table(spark):
    """Without class names, tags of their own and articles, counting alone takes menus and boxes away; the query's texts are whole either way."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    rows = htmltext.with_host(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    by = {}
    for host, subtree in htmltext.template_subtrees(rows).collect():
        by.setdefault(host, set()).add(subtree)
    changed = 0
    for url, page in zip(pages.url, pages.html):
        host = re.sub(r"^https?://([^/:]+).*", r"\1", url)
        bare = htmltext.main_text(page, frozenset(), False, False)
        less = htmltext.main_text(page, by.get(host, frozenset()), False, False)
        whole = htmltext.main_text(page)
        changed += bare != less
        assert whole in bare and whole in less  # nothing of the article goes
    assert changed > 100
    assert queries.queries()["op2_html_text"](spark, "/root/testdata/sf0.01").where("n_template > 0").count() == changed


def test_nothing_else_is_dropped_inside_the_article():
    page = "<article><header><h1>Head</h1></header><figure><figcaption>Caption</figcaption></figure><div class='related-work'>Related</div><math><mi>x</mi></math><div class='share widget'>Share</div><div class='ad'>no</div><footer>no</footer></article>"
    assert htmltext.main_text(page) == "Head Caption Related x Share"


def test_broken_pages_in_linear_time():
    began = time.time()
    assert htmltext.main_text("<a " * 200_000 + '"') == ""
    assert htmltext.main_text("<div>" * 30_000 + "</x>" * 200_000 + "deep") == "deep"
    assert htmltext.main_text("<p>it's <b title=\"5'\">so</b> <i x='>'>or</i>" + " not" * 100_000).startswith("it's so or not")
    assert time.time() - began < 30


def test_repeated_rows_extra_columns_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://h/1", "<p>a</p>")] * 4, SCHEMA).withColumn("host", F.lit("mine")).withColumn("text", F.lit(1))
    assert [tuple(r) for r in htmltext.extract_pages(pages).collect()] == [(1, "http://h/1", "a", 1, 0)] * 4
    assert htmltext.extract_pages(pages.limit(0)).collect() == []
