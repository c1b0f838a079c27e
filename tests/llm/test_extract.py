"""Main text of pages against texts that the pages were made from, and the given pages against a plain reading of their one template."""

import html
import random
import re

import pytest

from cablewright.llm import extract

COLUMNS = "page_id long, url string, html string, text string, host string, winners string, n_chars int"


def _page(body, rng, kind):
    menu = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Topic {k}</a></li>" for k in range(5)) + "</ul></nav>"
    paras = "".join(f"<p>{html.escape(b)}" + ("</p>" if rng.random() < 0.7 else "") for b in body)
    sell = "<div class='ad-slot top'>Buy the best thing that money can buy, today and tomorrow.</div>"
    talk = "".join(f"<div class=comment><p>Reader {k} thinks that this is quite long and even more than that.</p></div>" for k in range(30))
    head = f"<!DOCTYPE html><html><head><title>x &amp; y</title><style>p>a{{}}</style><script>if (a</p>/.x) t('</div><p>no</p>')</script></head><body class='has-sidebar'><header><h1>The site's own name.</h1></header>{menu}"
    foot = "<aside class=x><p>See what else there is on this site, and much more of it, for you.</p></aside><footer>&copy; somebody</footer>"
    form = "<form action=/><label>Your name</label><input name=q><p>Do write to us, we answer.</p></form>"
    if kind == "article":
        inner = f"<article>{paras}<section id=comments><article class=comment><p>First! And then a whole long sentence.</p></article></section>{form}</article>{sell}"
    elif kind == "div":
        inner = f"<div class='wrap w{rng.randrange(99)}'>{sell}<div class='post-{rng.randrange(99)} text' data-x=\"a>b\">{paras}<!-- <p>not this</p> --></div><div id='disqus_thread'>{talk}</div></div>"
    elif kind == "table":
        inner = f"<table><tr><td class=left><ul>{''.join(f'<li><a href=/>A link of some words {k}</a>' for k in range(9))}</ul><td class=mid>{paras}</table>"
    else:
        inner = paras + "<div class=cookie-notice><p>We use cookies for all that we do here, as everyone does.</p></div>"
    return head + inner + foot + ("</body></html>" if rng.random() < 0.5 else "")


def _cases():
    rng = random.Random(9)
    rows, want = [], []
    for host, kind in (("a.example.org", "article"), ("B.example.org", "div"), ("c.example.org", "table"), ("d.example.org", "bare")):
        for k in range(12):
            body = [" ".join(rng.choice(("word", "a & b", "é<i>", "1 > 0", "“so”")) + str(rng.randrange(99)) for _ in range(rng.randrange(5, 40))) + "." for _ in range(rng.randrange(1, 7))]
            url = rng.choice(("http", "https")) + f"://{host}/{k}?q#f"
            rows.append((len(rows), url, _page(body, rng, kind)))
            want.append("\n".join(body))
    return rows, want


def test_planted_texts(spark):
    rows, want = _cases()
    d = spark.createDataFrame([(*r, "t", "h", "w", 1) for r in rows], COLUMNS).repartition(4)
    got = extract.extract(d)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in got.collect()}
    for (i, url, _), text in zip(rows, want, strict=True):
        assert (found[i].url, found[i].text, found[i].n_chars) == (url, text, len(text)), url


def test_both_joins_agree(spark, monkeypatch):
    rows, want = _cases()
    rows += [rows[0], (None, None, rows[0][2]), (5, "no host", None), (6, "http://x.org", "")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    key = lambda r: str(tuple(r))
    small = sorted(extract.extract(d).collect(), key=key)
    monkeypatch.setattr(extract, "MOST_SENT", -1)
    assert sorted(extract.extract(d).collect(), key=key) == small
    assert len(small) == len(rows) and sum(r.text == want[0] for r in small) == 3 and sum(r.n_chars == 0 for r in small) == 2
    assert extract.extract(d.limit(0)).collect() == []


def test_the_host_settles_what_one_page_can_not(spark):
    long = "A teaser of another story, which goes on and on and is longer than what there is to say here. " * 3
    page = lambda text, more: f"<div class=story7><p>{text}</p></div><div class=zz><p>{more}</p></div>"
    rows = [(k, f"https://h.org/{k}", page(f"Story {k} is told here, in as many words as it takes to tell it well. " * 4, "Short.")) for k in range(9)]
    rows += [(9, "https://h.org/9", page("Only this.", long)), (10, "https://h.org/10", "<p>Another page.</p>"), (11, "https://else.org/", page("Only this.", long))]
    found = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[9] == "Only this." and found[10] == "Another page." and found[11] == "Only this.\n" + long.strip()


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("just a text", "just a text"),
        ("<p>a<br>b  \n c</p>d", "a b c\nd"),
        ("<p>&lt;b&gt; &amp &#233;&#x1F600;&nbsp;x&am", "<b> & é😀 x&am"),
        ("<article><p>One.</p><p>cut off <b", "One.\ncut off"),
        ("<article><p>One.<!-- never ended <p>Two.", "One."),
        ("<article><p>One.<script>never ended <p>Two.", "One."),
        ("<article><h1>T</h1><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "T\none\ntwo\nx\ny"),
        ("<article>" + "<div>" * 3000 + "deep." + "</div></p>" * 3000 + "</article>", "deep."),
        ("<article><p>1 < 2 and 3 > 2.</p></article>", "1 < 2 and 3 > 2."),
        ("<article><p>See <a href='x'>this <p>and that, which isn't a link at all any more.</article>", "See this\nand that, which isn't a link at all any more."),
    ],
)
def test_odd_pages(page, text):
    assert extract.main_text(page) == text


def test_a_long_page():
    page = "<article>" + "<p>" + "word &amp; " * 20 + "<p>" * 3 + "</article>"
    assert len(extract.main_text(page * 1)) == len("word & " * 20) - 1
    many = [f"Paragraph number {k} stands here." for k in range(100_000)]
    assert extract.main_text("<div class=body>" + "".join(f"<p>{p}" for p in many)) == "\n".join(many)


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search("<article>(.*)</article>", r.html, re.DOTALL)[1]
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        want[r.page_id] = "\n".join(x for x in lines if x)
    assert {r.page_id: r.text for r in extract.extract(pages).collect()} == want
