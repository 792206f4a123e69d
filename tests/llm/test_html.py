import html as H
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.llm import html_extract as X


def test_blocks_read_broken_markup():
    page = ("<html><head><title>t</title><style>p{}</style><script>var a='<p>no</p>';</script></head><body>"
            "<!-- <p>no</p> --><nav><ul><li><a href='/x'>One</a><li>Two</ul></nav><article><h1>Head&amp;line</h1>"
            "<p><b>bold text.<br><p>se<i>co</i>nd &eacute;&#x41;  \n para</p><p>cut o")
    got = X.blocks(page)
    assert [b.text for b in got] == ["One", "Two", "Head&line", "bold text.", "second éA para", "cut o"]
    assert [X.role(b.path) for b in got] == [-1, -1, 1, 1, 1, 1]
    assert X.blocks("") == X.blocks("<p> </p><script>x") == []
    assert [b.text for b in X.blocks("a < b <c")] == ["a < b <c"]


@pytest.fixture(scope="module")
def model(spark):
    return X.fit_labeller(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_main_text_of_every_page(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    want = {}
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        body = re.sub(r"</?b>", "", body)
        want[r["page_id"]] = " ".join(H.unescape(re.sub(r"<[^>]+>", " ", body)).split())
    got = {r["page_id"]: r for r in X.op2_html_text(spark, "/root/testdata/sf0.01").collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_unseen_markup(model):
    page = ("<header><h1>Site</h1></header><main><h2>Title</h2><p>First paragraph of it, with words, here.</p>"
            "<aside>Other stories</aside><p>Second paragraph, it goes on and on.</p></main>"
            "<div class='comments'><p>Nice text, says a reader.</p></div><form><label>Mail</label></form>"
            "<div id='cookie-notice'>We use cookies.</div><footer>&copy; 2020</footer>")
    cut = X.blocks(page)
    kept = [b.text for b, k in zip(cut, next(X.label(model, [cut], X.Vectors()))) if k]
    assert kept == ["Title", "First paragraph of it, with words, here.", "Second paragraph, it goes on and on."]


def plain_logits(m, x):
    """One page, step by step, gate by gate."""
    states = []
    for d, order in ((0, range(len(x))), (1, range(len(x) - 1, -1, -1))):
        size = m.u[d].shape[0]
        h, cell, out = np.zeros(size), np.zeros(size), np.zeros((len(x), size))
        for t in order:
            z = x[t].astype(float) @ m.w[d] + h @ m.u[d] + m.b[d]
            i, f, g, o = z[:size], z[size:2 * size], z[2 * size:3 * size], z[3 * size:]
            cell = cell / (1 + np.exp(-f)) + np.tanh(g) / (1 + np.exp(-i))
            h = np.tanh(cell) / (1 + np.exp(-o))
            out[t] = h
        states.append(out)
    return (np.concatenate(states, axis=1) @ m.v + m.c)[:, 0]


def test_batches_equal_a_plain_loop(model, pages):
    cut = [X.blocks(p["html"]) for p in pages[:60]] + [[]]
    got = list(X.label(model, cut, X.Vectors()))
    for found, keep in zip(cut, got):
        logits = plain_logits(model, X.features(found, X.Vectors())) if found else []
        assert all(k == (z >= 0) for k, z in zip(keep, logits) if abs(z) > 1e-4) and len(keep) == len(found)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()


def scrambled(page, rng, tags):
    """The page with meaningless class names, and meaningless elements if `tags`."""
    names = {}

    def new(name):
        return names.setdefault(name, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)))
    page = re.sub(r'class="([^"]*)"', lambda m: f'class="{new(m[1])}"', page)
    for t in ("nav", "article", "footer", "ul", "li") if tags else ():
        page = re.sub(rf"<{t}\b", f'<div class="{new(t)}"', page).replace(f"</{t}>", "</div>")
    return page


def f1(model, cut, truth):
    kept = np.concatenate([np.array(k, bool) for k in X.label(model, cut, X.Vectors())])
    return 2 * (kept & truth).sum() / (kept.sum() + truth.sum())


def test_held_out_pages_with_scrambled_names(spark, pages):
    even = spark.createDataFrame([(p["page_id"], p["html"]) for p in pages if p["page_id"] % 2 == 0],
                                 "page_id long, html string")
    model, odd, rng = X.fit_labeller(even), [p["html"] for p in pages if p["page_id"] % 2], random.Random(3)
    truth = np.array([any("article" in n for n in b.path) for p in odd for b in X.blocks(p)])
    assert f1(model, [X.blocks(p) for p in odd], truth) >= 0.999
    assert f1(model, [X.blocks(scrambled(p, rng, False)) for p in odd], truth) >= 0.97
    assert f1(model, [X.blocks(scrambled(p, rng, True)) for p in odd], truth) >= 0.95


def test_labels_do_not_hang_on_names(pages):
    cut = [X.blocks(p["html"]) for p in pages]
    truth = np.array([any("article" in n for n in b.path) for c in cut for b in c])
    votes = np.concatenate([X.votes(c, X.cues(c)) for c in cut])
    assert ((X.trusted(votes) >= 0.5) == truth).mean() > 0.995
    assert ((X.trusted(votes[:, 1:]) >= 0.5) == truth).mean() > 0.99


def test_reliable_voters_overrule_the_names():
    main, other = [1, 0, 1, 0, 1, 1, 0], [-1, -1, -1, -1, 0, -1, -1]
    misnamed, silent = [-1, 0, 1, 0, 1, 1, 0], [0, -1, -1, -1, 0, -1, 0]
    p = X.trusted(np.array([main] * 300 + [other] * 300 + [misnamed] * 20 + [silent] * 20))
    assert p[0] > 0.9 and p[300] < 0.1 and p[600] > 0.5 > p[620]


def test_repeated_ids_and_long_pages_in_the_sample(spark):
    page = "<title>a b c</title><nav><a href='/'>x</a></nav><article><h1>a b c</h1>" + "<p>words, " * 3000
    rows = [(1, page), (1, "<article><p>other"), (None, page), (2, ""), (2, None)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    one, two = X.fit_labeller(df), X.fit_labeller(df.orderBy(F.col("html").desc()))
    assert all((a == b).all() for a, b in zip(one.weights(), two.weights()))


def test_gradients():
    rng = np.random.default_rng(1)
    m = X.Labeller.fresh(5, 3)
    x, mask = rng.normal(size=(4, 2, 5)), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], bool)
    y, weight = rng.integers(0, 2, (4, 2)).astype(float), mask.astype(float)
    _, grads = m.gradients(x, mask, y, weight)
    for w, g in zip(m.weights(), grads):
        at = tuple(rng.integers(0, s) for s in w.shape)
        w[at] += 1e-5
        up = m.gradients(x, mask, y, weight)[0]
        w[at] -= 2e-5
        down = m.gradients(x, mask, y, weight)[0]
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", "<p>same</p>"), (3, "u", "<p>same</p>"),
            (4, "u", "<article>" + "<p>long one, of words.</p>" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS n_chars")
    got = X.extract_text(df, model).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == by[2]["text"] == "" and by[4]["n_blocks"] == 5000
    assert X.extract_text(df.limit(0), None).count() == 0
    assert X.fit_labeller(df.limit(0)) is None
    assert X.extract_text(df, None).where("page_id = 3").first()["text"] == "same"


def test_an_article_shorter_than_the_footer(model):
    page = ("<title>Anthre.</title><nav><ul><li><a href='/x'>One</a><li><a href='/y'>Two</a></ul></nav>"
            "<div class='ad'>And therhean is the is esndha.</div><article><h1>Anthre.</h1><p>Anthre.<p>Two words</article>"
            "<footer>&copy; tion.example.net &middot; Beverbe in dieentz and a long line of more words.</footer>")
    cut = X.blocks(page)
    assert [k for k in next(X.label(model, [cut], X.Vectors()))] == [False] * 3 + [True] * 3 + [False]
