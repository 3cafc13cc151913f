import pytest

from larkspur.llm.htmltext import extract, extract_pages, smooth

PAGE = """<!DOCTYPE html><html><head><title>Site</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id="leftSidebar"><p>Side story with some words to read.</p></div>
<article><header><h1>Head &amp; tail</h1></header><p>First   para&shy;graph with <b>bold</b>,<br>a break &#8212; and more.
<p>Second one<ul><li>alpha<li>beta</ul><div class="ad-box">Buy now</div><table><tr><td>x<td>y</table><p>End.</p>
<form><input name=q><button>Go</button></form><section class="comments"><p>Nice article!</p></section></article>
<aside>More</aside><div class="ad">Advert</div><footer>&copy; 2024</footer></body></html>"""


def test_article():
    assert extract(PAGE).split("\n") == ["Head & tail", "First para­graph with bold, a break — and more.", "Second one", "alpha", "beta", "x", "y", "End."]


def test_without_article():
    body = "".join(f"<p>{'A sentence of the story goes on here. ' * 4}</p>" for _ in range(5))
    links = "".join(f"<div><a href=/{k}>Link number {k}</a></div>" for k in range(12))
    got = extract(f"<html><body><div>{links}</div><div><h2>Title</h2>{body}</div><footer>foot</footer></body></html>")
    assert got.startswith("Title\nA sentence") and "Link" not in got and got.count("\n") == 5


@pytest.mark.parametrize("html", [None, "", "   ", "<html><body></body></html>", "<nav>menu</nav>", "<script>x</script>", "<"])
def test_nothing(html):
    assert extract(html) in ("", "<")


def test_broken_markup():
    assert extract("<article><p><b>One<p>Two</b></i></article>") == "One\nTwo"
    assert extract("<p>open <div>inner") == "open\ninner"


def test_smooth_keeps_constants():
    import numpy as np

    assert np.allclose(smooth(np.full(7, 3.0)), 3.0)


def test_pages(spark):
    rows = [(1, "u", PAGE, "a"), (2, None, None, "b"), (2, None, None, "b"), (None, "v", "<p>x</p>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted((tuple(r) for r in extract_pages(df).collect()), key=str)
    assert len(out) == 4 and all(len(r[2]) == r[3] for r in out)
    assert extract_pages(df.limit(0)).count() == 0


def test_names_that_only_contain_a_mark():
    page = "<article><h1>Title</h1><p>" + "Long text of the story. " * 9 + '</p><div class="search-history"><p>How it was found.</p></div><section id="related-work"><p>Others wrote of it.</p></section></article>'
    assert extract(page).split("\n")[2:] == ["How it was found.", "Others wrote of it."]
    for wrapper in ('<div class="layout with-sidebar">', '<section class="post share-enabled">', '<div class="sidebar">', '<div id="content-widget">'):
        got = extract(f"<body><nav>menu</nav>{wrapper}{page}<div class='ad'>Buy</div></div></body>")
        assert got.startswith("Title\nLong") and "Others" in got and "Buy" not in got and "menu" not in got, wrapper


def test_clusters_decide_inside_articles():
    links = "".join(f"<li><a href=/{k}>Another story number {k}</a></li>" for k in range(9))
    body = "".join(f"<p>{'A sentence of the story goes on here. ' * 6}</p>" for _ in range(6))
    got = extract(f"<article><h1>Title</h1>{body}<p>See <a href=/x>this one</a>.</p><p>Short.</p>{body}<div><ul>{links}</ul></div></article>")
    assert "Another" not in got and "See this one." in got and "Short." in got and got.startswith("Title")


@pytest.mark.parametrize("part", ["<div>text", "<b>text", "<p><b>text", "<ul><li>x", "<table><tr><td>x", "</i><b>y", "<section class=ad>t", "<article>t"])
def test_deep_nesting_takes_linear_time(part):
    import time

    begin = time.time()
    extract(part * 100_000)
    once = time.time() - begin
    extract("<div><b>" * 50_000 + "<p>t</p></i>" * 50_000)
    assert once < 30 and time.time() - begin < 60


def pages(seed, n):
    """Pages whose text is known: an own generator with several families of markup."""
    import random

    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    text = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))) + "."
    families = [
        ("<article>", "</article>", {"menu": "<nav>{}</nav>", "side": "<aside>{}</aside>", "note": '<div class="cookie-notice">{}</div>', "ad": '<div class="ad">{}</div>', "said": '<section class="comments">{}</section>'}),
        ('<main class="page-content"><div class="post">', "</div></main>", {"menu": '<div role="navigation">{}</div>', "side": '<div id="leftSidebar">{}</div>', "note": '<div class="alert">{}</div>', "ad": '<div class="ad-box sponsored">{}</div>', "said": '<ol class="comment-list">{}</ol>'}),
        ('<div class="layout with-sidebar"><article class="share-enabled">', "</article></div>", {"menu": '<ul class="nav-menu">{}</ul>', "side": '<div class="side-bar sidebar">{}</div>', "note": '<p class="newsletter-signup">{}</p>', "ad": '<div class="advert">{}</div>', "said": '<div id="disqus_thread">{}</div>'}),
    ]
    for k in range(n):
        start, end, other = r.choice(families)
        items = "".join(f"<li><a href=/{word()}>{word()}</a></li>" for _ in range(r.randint(3, 8)))
        lines, body = [text(3, 8)], []
        body.append(f"<h1>{lines[0]}</h1>")
        for _ in range(r.randint(3, 12)):
            kind, t = r.random(), text(1, 4) if r.random() < 0.2 else text(12, 60)
            if kind < 0.6:
                body.append(f"<p>{t}</p>" if r.random() < 0.8 else f"<p>{t}")
            elif kind < 0.7:
                body.append(f"<blockquote>{t}</blockquote>")
            elif kind < 0.8:
                body.append(f"<div class='search-history'><p><b>{t}</b></p></div>")
            else:
                more = [text(2, 12) for _ in range(2)]
                body.append(f"<p>{t}<ul>" + "".join(f"<li>{x}" for x in more) + "</ul>")
                lines += [t, *more]
                continue
            lines.append(t)
            if r.random() < 0.15:
                body.append(other["ad"].format(text(2, 5)))
        said = other["said"].format(f"<li><p>{text(3, 20)}</p></li>")
        page = f"<html><head><title>{lines[0]}</title><style>p{{}}</style></head><body><header>{text(2, 4)}</header>{other['menu'].format(items)}{other['note'].format(text(4, 9))}{start}{''.join(body)}{said}{end}{other['side'].format('<p>' + text(5, 20) + '</p>')}<footer>{text(3, 9)}</footer></body></html>"
        yield page, "\n".join(lines)


def test_known_texts():
    got = [(extract(page), want) for page, want in pages(1, 200)]
    wrong = [x for x in got if x[0] != x[1]]
    assert not wrong, f"{len(wrong)}: {wrong[0]}"


def test_pages_table_against_a_plain_reading(spark):
    """The query's texts: the paragraphs of each page's article, as a pattern reads them from the source."""
    import html
    import re

    folder = "/root/testdata/sf0.001"
    from larkspur.llm.queries import queries

    source = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in queries()["op7_html_text"](spark, folder).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", source[r.page_id] or "", re.S)[1]
        blocks = re.split(r"</?(?:p|h1|div|section|ul|li|article)[^>]*>", re.sub(r"<!--.*?-->", "", body, flags=re.S))
        want = [" ".join(html.unescape(re.sub(r"<br[^>]*>", " ", x)).split()) if "<" not in x.replace("<br", "") else " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in blocks]
        assert r.text.split("\n") == [x for x in want if x] and r.n_chars == len(r.text), r.page_id
