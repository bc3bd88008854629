import pytest

from kindred.llm import html


@pytest.fixture(scope="module")
def field():
    return html.trained()


def test_fresh_labelled_pages(field):
    """Exact texts of pages that training has not seen."""
    pages = html.labelled_pages(150, seed=1234)
    right = sum(html.main_text(p, field) == "\n".join(a) for p, a in pages)
    assert right / len(pages) >= 0.98


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>One &amp; two.<p>Three<br>four&nbsp;five.<script>var x='<p>no</p>'</script></article>", "One & two.\nThree four five."),
        ("<nav><a href=/>Home</a></nav><article><h1>A title here</h1><p>Some text that is long enough to be read.</p></article><footer>&copy; site</footer>", "A title here\nSome text that is long enough to be read."),
        ("<article><p>Words <b>in <i>inline</i> tags</b> stay   in\n one line.</p><!-- no --><style>p{}</style></article>", "Words in inline tags stay in one line."),
        ("<article><p>Unclosed <b>bold text is here.<p>Next paragraph of it.</article><div class=ad>Buy this now</div>", "Unclosed bold text is here.\nNext paragraph of it."),
        ("<article><p>Before the comments there is a text.</p></article><section id=comments><div class=comment><p>I do not agree with any of this, dear author.</p></div></section>", "Before the comments there is a text."),
        ("<article><p>a &lt;b&gt; c &#233; &#x1F642;</p></article>", "a <b> c é 🙂"),
        (None, ""), ("", ""), ("   ", ""), ("<html><head><title>x</title></head><body></body></html>", ""),
    ],
)
def test_pages(field, page, text):
    assert html.main_text(page, field) == text


def test_misnested_and_broken_markup_does_not_crash(field):
    for page in ("<", "<<<>>", "<p", "</p></div>", "<a href='x><p>t", "<!--", "<![CDATA[x", "<table><tr><td>a<td>b<tr><td>c</table>", "<p>" * 3000, "&#xffffffff; &bogus;", "<script>", "<ul><li>a<li>b</ul>" * 500):
        assert isinstance(html.main_text(page, field), str)


def test_marginals_and_decoding_agree_with_enumeration():
    """The gradient is that of the log likelihood, and Viterbi finds the best of all labelings."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    field = html.Field(["a", "b", "c"])
    field.w, field.t = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))
    fs = [["a"], ["b", "c"], ["c"], ["a", "b"]]
    e = field.emissions(fs)
    value = lambda ls: sum(e[i, y] for i, y in enumerate(ls)) + sum(field.t[x, y] for x, y in itertools.pairwise(ls))
    every = list(itertools.product((0, 1), repeat=4))
    assert tuple(field.decode(fs)) == max(every, key=value)
    ids = [[field.index[x] for x in f] for f in fs]
    gw, gt = np.zeros((3, 2)), np.zeros((2, 2))
    got = field.gradient(ids, [0, 1, 1, 0], gw, gt)
    assert np.isclose(got, value((0, 1, 1, 0)) - np.log(sum(np.exp(value(x)) for x in every)))
    field.w[1, 0] += 1e-6
    assert np.isclose((field.gradient(ids, [0, 1, 1, 0], np.zeros((3, 2)), np.zeros((2, 2))) - got) / 1e-6, gw[1, 0], atol=1e-4)


LONG = "The council met on Tuesday to talk about the old bridge, which has stood over the river for more than two hundred years."
MORE = "Several members said that repairs would cost too much, while others held that the town owes it to those who built it."

#: Pages in the manner of common site software, written by hand.
WRITTEN = [
    # a blog: theme classes on the body, sidebar widgets, a share bar inside the article
    (f"""<body class="single has-sidebar widget-area"><header class="site-header"><a href=/ class="site-logo">Riverside Blog</a><nav class="main-navigation"><ul><li><a href=/a>About</a><li><a href=/c>Contact</a></ul></nav></header>
    <div class="site-content"><main id="main"><article class="post type-post"><h1 class="entry-title">The old bridge</h1><div class="entry-content"><p>{LONG}</p><p>{MORE}</p></div>
    <div class="social-share"><a href=#>Tweet</a> <a href=#>Post</a></div></article></main><aside class="widget-area sidebar"><section class="widget"><h2>Recent posts</h2><ul><li><a href=/x>Older things</a></li></ul></section></aside></div>
    <footer class="site-footer">&copy; 2024 Riverside Blog. All rights reserved.</footer></body>""", ["The old bridge", LONG, MORE]),
    # an office page inside one form, with tables for layout
    (f"""<body><form method=post action=default.aspx id=aspnetForm><input type=hidden name=__VIEWSTATE value=abc><div id="header"><a href=/>Town office</a></div><div id="nav"><a href=/1>Home</a> | <a href=/2>Services</a></div>
    <div id="main"><h1>Bridge works</h1><p>{LONG}</p><p>{MORE}</p></div><div id="footer">Town office, 1 High Street</div></form></body>""", ["Bridge works", LONG, MORE]),
    # names of the article's subject that hint at other things
    (f"""<div class="nav-menu"><a href=/>Start</a></div><article class="legal-analysis"><h2>Who owns it?</h2><div class="social-policy"><p>{LONG}</p></div><section id="popular-science"><p>{MORE}</p></section></article><div class="cookie-banner"><p>We use cookies to make this site better. <button>OK</button></p></div>""",
     ["Who owns it?", LONG, MORE]),
    # comments, an advert between paragraphs, a newsletter box and a dialog
    (f"""<main><h1>Bridge stays</h1><p>{LONG}</p><div class="advert-slot">Boots that last. Order now and get them tomorrow, free of charge.</div><p>{MORE}</p><form class="newsletter-signup"><label>Your mail address</label><input name=m><button>Send</button></form></main>
    <div id="comments"><h3>2 comments</h3><div class="comment-body"><p>I crossed it every day as a child, and would not want to lose it at all.</p></div></div><div role="dialog" class="modal"><p>Log in to go on reading all that we have.</p></div>""", ["Bridge stays", LONG, MORE]),
    # lists, a quotation and a table inside an article; text straight in the body element of an old page
    (f"""<ul class="breadcrumbs"><li><a href=/>Home</a><li><a href=/n>News</a></ul><article><p>{LONG}</p><ul><li>Stone from the hill quarry.</li><li>Wood from the north forest.</li></ul><blockquote>{MORE}</blockquote><table><tr><td>Built</td><td>1790</td></tr></table></article>""",
     [LONG, "Stone from the hill quarry.", "Wood from the north forest.", MORE, "Built", "1790"]),
    # the title attribute says hidden, the element is not
    (f"""<article><p title="the hidden truth">{LONG}</p><p hidden>{MORE}</p></article>""", [LONG]),
]


@pytest.mark.parametrize(("page", "article"), WRITTEN)
def test_pages_that_the_training_generator_did_not_write(field, page, article):
    assert html.main_text(page, field).split("\n") == article


def test_deep_pages_cost_in_proportion(field):
    import time

    def seconds(page):
        start = time.perf_counter()
        html.main_text(page, field)
        return time.perf_counter() - start

    for page in (lambda n: "<div>x" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n + "x<hr>" * n, lambda n: "<div>" * n + "</section>" * n + "x"):
        assert seconds(page(32_000)) < 12 * seconds(page(8_000)) + 0.5


def test_extract(spark, field, clashing):
    from pyspark.sql import functions as F

    rows = [(1, "u", "<article><p>Text of the page is here.</p></article>"), (2, None, None), (None, "u", ""), (1, "u", "<article><p>Text of the page is here.</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit(c).alias(c) for c in clashing))
    out = html.extract(df, field)
    assert out.columns == [*df.columns, "main_text_"]
    found = out.collect()
    assert all(r[c] == c for r in found for c in clashing)
    assert sorted((str(r["page_id"]), r["main_text_"]) for r in found) == [("1", "Text of the page is here."), ("1", "Text of the page is here."), ("2", ""), ("None", "")]
    assert html.extract(df.limit(0), field).count() == 0
