import html
import math
import random
import re

import pytest

from skarn.llm import main_text
from skarn.llm.common import table

TEXT = "The council met on Monday and decided, after a long debate, to rebuild the old bridge over the river. "
LINKS = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(8))


def page(body, head="<title>Site - Bridge</title><style>p{margin:0}</style>"):
    return f'<!DOCTYPE html><html lang="en"><head>{head}</head><body class="has-sidebar">{body}</body></html>'


def paragraphs(n):
    return "".join(f"<p>{TEXT * (1 + i % 3)}</p>" for i in range(n)), " ".join((TEXT * (1 + i % 3)).strip() for i in range(n))


def test_article_among_all_that_is_none():
    inner, want = paragraphs(5)
    body = f"""<header class="masthead"><h1>The Site</h1><a href="/">Home</a></header><nav><ul>{LINKS}</ul></nav>
      <div class="cookie-notice">We use cookies to make this site better for you, and for all who come after you. <button>Fine</button></div>
      <div id="wrapper"><aside class="sidebar"><p>{TEXT}</p></aside>
      <article class="post"><header><h1>Bridge</h1></header>{inner}
        <div class="ad"><p>{TEXT}</p></div><form action="/x"><label>Your mail</label><input name=q><p>{TEXT}</p></form>
        <script>document.write("<p>{TEXT}</p>")</script><p>The end.</p>
        <section id="comments"><article class="comment"><p>{TEXT * 9}</p></article></section>
      </article></div><footer><p>{TEXT}</p></footer>"""
    assert main_text.main_text(page(body)) == f"Bridge {want} The end."


@pytest.mark.parametrize("frame", ['<div class="x1">{}</div>', "<main>{}</main>", '<div role="main">{}</div>', "<table><tr><td>{}</td></tr></table>", "<div><div><section>{}</section></div></div>"])
def test_article_without_its_own_element(frame):
    inner, want = paragraphs(6)
    menu = f"<div><ul>{LINKS}</ul></div>"
    body = f"{menu}{frame.format(inner + '<p>Short.</p>')}<div><ul>{LINKS}</ul></div><div class='footer'>{TEXT}</div>"
    assert main_text.main_text(page(body)) == want + " Short."


def test_sections_that_are_as_dense_belong_to_it():
    a, x = paragraphs(4)
    b, y = paragraphs(6)
    body = f"<div><ul>{LINKS}</ul></div><div><div>{a}</div><div><ul>{LINKS}</ul></div><div>{b}</div></div>"
    assert main_text.main_text(page(body)) == f"{x} {y}"


def test_title_before_the_article():
    inner, want = paragraphs(4)
    body = f"<div><h1>Site</h1><ul>{LINKS}</ul></div><div class='post'><div class='post-header'><h1>Bridge</h1></div><div class='post-body'>{inner}</div><div class='post-comments'>{TEXT * 9}</div></div>"
    assert main_text.main_text(page(body)) == f"Bridge {want}"


def test_references_space_and_blocks():
    body = "<article><p>a &lt;b&gt; &amp;amp; caf&eacute; &#8212;&#x41; &copy 5 < 6 &unknown;</p><p>one<b>two</b>  three\n\tfour&nbsp;five<br>six<i>seven</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><pre>a\n b</pre>"
    assert main_text.main_text(body) == "a <b> &amp; café —A © 5 < 6 &unknown; onetwo three four five sixseven x y 1 2 a b"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<html><head><title>only</title></head><body></body></html>", ""), ("plain words", "plain words"), ("<p>cut <b>off</p><a href='x", "cut off"),
        ("<!-- <p>no</p> --><p>yes</p><!-- open <p>no</p>", "yes"), ("<p title='a>b'>it's <a b=it's>so</a></p>", "it's so"), ("</div></p></b><p>x</p></article>", "x"), ("<script>never ends <p>a</p>", ""), ("<p>a</script>b</p>", "ab"),
        ("<nav><p>all of it is a menu</p></nav>", ""), ("<p>x</p><p hidden>y</p><p style='display: none'>z</p>", "x"), ("<SCRIPT>a</SCRIPT ><P>B</P>", "B"), ("a<![CDATA[b]]>c<?php d ?>e", "ace"),
    ],
)
def test_odd_pages(raw, want):
    assert main_text.main_text(raw) == want


def test_deep_and_long():
    assert main_text.main_text("<div>" * 50_000 + TEXT + "</div>" * 20_000) == TEXT.strip()
    inner, want = paragraphs(20_000)
    assert main_text.main_text(page(f"<nav>{LINKS * 50}</nav><article>{inner}</article>")) == want
    assert main_text.main_text("<a" * 50_000) == "" and main_text.main_text('<p x="' * 20_000) == ""


def slow(tree):
    """Densities by their definition, each node by itself."""
    n = len(tree.tag)

    def ancestors(k):
        while k >= 0:
            yield k
            k = tree.parent[k]

    body = next((k for k in range(n) if tree.tag[k] == "body"), 0)

    def counts(k):
        pieces = [(node, "".join(p.split())) for node, p in tree.text if k in ancestors(node)]
        below = [d for d in range(n) if d != k and k in ancestors(d)]
        return sum(len(p) for _, p in pieces), sum(len(p) for node, p in pieces if any(tree.tag[a] == "a" for a in ancestors(node))), len(below), sum(tree.tag[d] == "a" for d in below)

    cb, lb, _, _ = counts(body)
    out = []
    for k in range(n):
        c, lc, t, lt = counts(k)
        if not c:
            out.append(0.0)
            continue
        base = math.log(c / max(1, c - lc) * lc + (lb / cb if cb else 0) * c + math.e)
        x = c / max(1, t) * math.log(c / max(1, lc) * max(1, t) / max(1, lt))
        out.append(max(0.0, x / math.log(base) if base > 1 + 1e-9 else x))
    return out


def test_densities_against_their_definition():
    rng = random.Random(1)
    for _ in range(60):
        parts = [rng.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<ul><li>", "</ul>", "<nav>", "</nav>", "some words ", "more", "<br>", "<b>", "</b>"]) for _ in range(rng.randint(1, 60))]
        tree = main_text._parse("<body>" + "".join(parts))
        density, sums, dropped = main_text._densities(tree)
        want = slow(tree)
        assert density == pytest.approx(want)
        for k in range(len(want)):
            assert sums[k] == pytest.approx(sum(want[c] for c in range(1, len(want)) if tree.parent[c] == k and not dropped[c]))


def test_given_pages(spark):
    rows = table(spark, "/root/testdata/sf0.001", "pages")
    got = {r["page_id"]: r for r in main_text.extract(rows).collect()}
    for r in rows.collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("</?b>", "", re.sub("<(/?p|br|/?h1)>", " ", article))).split())
        assert tuple(got[r["page_id"]]) == (r["page_id"], r["url"], want, len(want))


def test_rows(spark):
    rows = [(None, None, None, 1), (1, "u", "<p>a b</p>", 2), (1, "u", "<p>a b</p>", 2), (2, None, "", 3)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text int")
    got = main_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(None, None, "", 0), (1, "u", "a b", 3), (1, "u", "a b", 3), (2, None, "", 0)], got.schema).collect()))
    assert main_text.extract(pages.limit(0)).count() == 0
