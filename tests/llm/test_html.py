"""Main text of pages: the parser's rules, layouts that training doesn't know, and the driver's pages."""

import random
import re
import time

from inkspark.llm import html_text

PLAIN = "<html><body><nav><a href=/>Home</a></nav><article>{}</article></body></html>"


def texts(page):
    return [b.text for b in html_text.blocks(page)]


def test_quotes_open_a_value_only_after_an_equals_sign():
    assert texts("<p title=it's>One para.</p><p>Two.</p>") == ["One para.", "Two."]
    assert texts("<p data-x='a > b' class=\"c>d\">Three.</p>") == ["Three."]
    assert texts("<p class=\"open>Four.</p><p>Five.</p>") == ["Four.", "Five."]
    assert texts('<p a= "x>y" b=>Six.</p>') == ["Six."]


def test_unclosed_elements_hide_nothing_but_scripts_and_styles():
    for tag in ("select", "svg", "iframe", "noscript", "textarea", "title", "template"):
        assert texts(f"<p>One.</p><{tag}><p>Two.</p><p>Three.</p>") == ["One.", "Two.", "Three."]
        assert texts(f"<p>One.</p><{tag}>hidden</{tag.upper()} ><p>Two.</p>") == ["One.", "Two."]
    assert texts("<p>One.</p><script>if (a < b) { x('<p>') }") == ["One."]
    assert texts("a < b and <3 &lt;p&gt; &eacute;<!-- no") == ["a < b and <3 <p> é"]


def test_very_long_and_deep_pages_take_time_in_proportion():
    def took(n):
        page = "<div class='a b'>" * n + "<p>word</p></span>" * n
        began = time.time()
        found = html_text.blocks(page)
        assert len(found) == n
        return time.time() - began

    took(500)
    small, large = took(4000), took(32_000)
    assert large < 24 * small + 1
    net = html_text.trained()
    long = " ".join(f"w{i}" for i in range(60_000))
    assert html_text.main_text([PLAIN.format(f"<h1>Title here</h1><p>{long}.</p>")], net) == [f"Title here\n\n{long}."]


def f1(pages, net):
    tp = fp = fn = 0
    for (_, good), got in zip(pages, html_text.main_text([p for p, _ in pages], net)):
        left = list(good)
        for x in filter(None, got.split("\n\n")):
            if x in left:
                left.remove(x)
                tp += 1
            else:
                fp += 1
        fn += len(left)
    return 2 * tp / (2 * tp + fp + fn)


def sentence(rng, a=8, b=25):
    words = ["".join(rng.choices("abcdefghiklmnoprstuvw", k=rng.randint(2, 9))) for _ in range(rng.randint(a, b))]
    return " ".join(words).capitalize() + "."


def unseen(rng, kind):
    """Layouts that the training rules don't build."""
    s = lambda *a: sentence(rng, *a)
    good = [s(3, 8)] + [" ".join(s() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 8))]
    paras = "".join(f"<p class='txt'>{p}</p>\n" for p in good[1:])
    links = "".join(f"<li class='item'><a href='/{i}'>{s(1, 3)}</a></li>" for i in range(8))
    if kind == 0:
        page = f"<div id='site-header'><div class='logo'><a href='/'>{s(1, 2)}</a></div><ul class='menu'>{links}</ul></div><div class='entry-content'><h1 class='entry-title'>{good[0]}</h1>{paras}</div><div id='comments' class='comments-area'><ol>{''.join(f'<li class=comment><p>{s()}</p></li>' for _ in range(3))}</ol></div><div id='footer'>{s(2, 5)}</div>"
    elif kind == 1:
        page = f"<header role='banner'><nav aria-label='main'><ul>{links}</ul></nav></header><main role='main'><article class='story'><header><h1>{good[0]}</h1></header>{paras}<aside class='related-articles'><h3>{s(1, 3)}</h3><ul>{links}</ul></aside></article></main><footer role='contentinfo'><p>{s(3, 6)}</p></footer>"
    elif kind == 2:
        page = f"<table class='layout'><tr><td class='sidebar nav'><ul>{links}</ul></td><td class='content main'><h1>{good[0]}</h1>{paras}</td></tr></table><div class='footer copyright'>{s(2, 4)}</div>"
    else:
        page = f"<div class='cookie-notice'><p>{s(6, 12)}</p><button>{s(1, 2)}</button></div><div class='wrapper'><div class='post-body'><h2>{good[0]}</h2>{paras}</div><div class='share-buttons'>{links}</div></div><form class='search'><label>{s(1, 2)}</label><input></form>"
    return f"<html><head><title>{s(2, 4)}</title></head><body>{page}</body></html>", good


def test_layouts_not_seen_in_training():
    rng, net = random.Random(12), html_text.trained()
    scores = [round(f1([unseen(rng, kind) for _ in range(30)], net), 3) for kind in range(4)]
    print("\nF1 by layout", scores)
    assert min(scores) >= 0.85 and sum(scores) / 4 >= 0.93


def test_pages_of_the_driver(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    truth = [(p, texts(re.search(r"<article>(.*?)</article>", p, re.S)[1])) for p in pages]
    assert f1(truth, html_text.trained()) >= 0.99


def test_odd_tables(spark):
    kind = "page_id long, url string, html string, text string, n_chars string"
    assert html_text.extract_text(spark.createDataFrame([], kind)).count() == 0
    one = (1, "u", PLAIN.format("<h1>A title here</h1><p>Some text of the page, long enough.</p>"), "x", "y")
    got = html_text.extract_text(spark.createDataFrame([one, one, (None, None, None, None, None)], kind)).collect()
    assert sorted(r.n_chars for r in got) == [0, len(got[0].text or got[1].text), len(got[0].text or got[1].text)]
