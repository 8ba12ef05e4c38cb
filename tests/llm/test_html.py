import itertools
import math
import re
import time
from html import unescape

import pytest

from siftstone.llm import html, html_pages, queries


@pytest.fixture(scope="module")
def model():
    return html.default_model()


def test_blocks_of_unseen_layouts(model):
    right = total = 0
    for seed in range(5000, 5100):
        part = html_pages.labelled_page(seed)
        page, labels = html.parse(html_pages.page_html(part)), []
        html._labels(part, labels)
        assert len(labels) == len(page.nodes)
        near = model.marginals(page)
        for node, _ in page.blocks:
            total += 1
            right += (near[node] >= 0.5) == (labels[node] == 1)
    assert right / total > 0.98


def test_messages_match_enumeration(model):
    source = "<body><nav><a href=x>k</a></nav><div class=post><p>One two, three.</p><h2>T</h2></div><footer>f</footer></body>"
    page = html.parse(source)
    own = model.unary(page)
    weight = {}
    for labels in itertools.product((0, 1), repeat=len(own)):
        w = sum(u for u, y in zip(own, labels) if y)
        w += sum(model.edges[html._kind(n)][labels[n.parent]][labels[i]] for i, n in enumerate(page.nodes) if i)
        weight[labels] = math.exp(w)
    z = sum(weight.values())
    for i, p in enumerate(model.marginals(page)):
        assert p == pytest.approx(sum(w for y, w in weight.items() if y[i]) / z, abs=1e-9)
    for i, p in model.edge_marginals(page):
        assert p[1][0] == pytest.approx(sum(w for y, w in weight.items() if y[page.nodes[i].parent] and not y[i]) / z, abs=1e-9)


def test_pages_table_matches_its_articles(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op5_html_extraction(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.sub(r"<[a-zA-Z/!][^>]*$", "", r.html.split("<article>", 1)[1].split("</article>")[0])
        blocks = (" ".join(unescape(re.sub(r"<br>|</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))


def test_markup(model):
    page = "<html><head><title>T</title></head><body><script>var a='<p>x</p>'</script><nav class=menu><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>one\n  two&nbsp;<b>three</b><br>four<p>5 &lt; 6 &#233;</article><footer>end"
    assert html.main_text(page, model) == "A & B\none two three four\n5 < 6 é"


def test_odd_rows(spark, model):
    deep = "<div>" * 5000 + "text" + "</div>" * 4000
    odd = [(1, None, "u"), (2, "", "u"), (3, "<<<>>> & &bogus; <", "u"), (3, "<!-- never closed", "u"), (None, "<p 'x", "u"), (5, deep, "u"), (6, "<a " + '"' * 3001 + "<p>" * 50, "u")]
    rows = html.extract(spark.createDataFrame(odd, "page_id long, html string, text string"), ["page_id", "text"], model=model).collect()
    assert len(rows) == len(odd) and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows if r.page_id in (1, 2)} == {""}
    assert html.extract(spark.createDataFrame([], "page_id long, html string"), ["page_id"], model=model).count() == 0


@pytest.mark.parametrize(
    "source, want",
    [
        ("<article><p>Let x be a number.</p></article>", "Let x be a number."),
        ("<html><body><article><p>Let <math><mi>x</mi></math> be a number. And so on.</p></article></body></html>", "Let x be a number. And so on."),
        ("<p>Hello there.</p>", "Hello there."),
        ("<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>One two three four.</p><details><summary>More</summary>Hidden text here.</details><p>End of it.</p></article><footer>f</footer></body>", "T\nOne two three four.\nMore\nHidden text here.\nEnd of it."),
        ('<nav><a href="/x">Home</a></nav>', ""),
        ('<body><div class="cookie">We use cookies.</div></body>', ""),
    ],
)
def test_small_pages(model, source, want):
    assert html.main_text(source, model) == want


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 100_000 + "</p>" * 100_000,
        "<b>" * 150_000 + "</i>" * 150_000,
        "<i>" * 100_000 + "<b>" * 100_000 + "</i>" * 100_000,
        "<li><ul>" + "<x>" * 80_000 + "<li></li>" * 80_000,
        "<svg><foreignobject>" + "<g>" * 100_000 + "<p>" * 100_000,
        "<svg><i><g>" + "<b>" * 100_000 + "</i>" * 100_000,
        "<head>" * 150_000,
        "<svg>" + "".join(f"<x{i}>" for i in range(100_000)),
    ],
    ids=range(8),
)
def test_a_megabyte_of_broken_tags_takes_seconds(model, source):
    began = time.process_time()
    html.main_text(source, model)
    assert time.process_time() - began < 20
