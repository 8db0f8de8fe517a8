import re
import time
from html import unescape

from larkspur.llm import html_text


def text_of(source, templates=()):
    return html_text.main_text(html_text.parse(source), set(templates))


def test_blocks_and_furniture():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>About</ul></nav><div class="ad">Buy</div><div id=cookie-notice>Cookies</div>
    <article><h1>A &amp; B</h1><p><b>One<br>two<p>Three&nbsp;  four &#8364;<!-- no --><ul><li>x<li>y</ul><form>f<input></form><aside>s</aside>
    <section class="comments"><p>nice</p></section><div hidden>h</div><table><tr><td>1<td>2</table></article><article class="comment">c</article><footer>&copy;</footer></body></html>"""
    assert text_of(page) == "A & B\nOne two\nThree four €\nx\ny\n1\n2"


def test_broken_and_plain_pages():
    assert text_of("") == ""
    assert text_of("plain  text") == "plain text"
    assert text_of("<p>a<p>b</div></p><script>never ends") == "a\nb"
    assert text_of("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert text_of("<body><p title='>'>a</p><p class=\"x>b</p>") .startswith("a")
    assert text_of("<article><header><h2>Head</h2>by me</header><p>x</p></article>") == "Head\nx"


def test_templates_of_a_host_go_and_copies_stay(spark):
    notice = "<div>You have three free articles left.</div>"
    rows = [(i, f"https://User@Site.example:80/{i}", f"<body>{notice}<div><p>Story number {i} is here.</p></div></body>") for i in range(30)]
    rows += [(100 + i, "http://copies.example/a", f"<article><p>The same story.</p></article>{i}") for i in range(30)]
    rows += [(200, None, None), (201, "nonsense", ""), (None, "http://one.example", "<p>x</p>"), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, templates int")
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()]
    want = [(i, t := f"Story number {i} is here.", len(t)) for i in [*range(30), 0]] + [(100 + i, "The same story.", 15) for i in range(30)]
    assert sorted(map(str, got)) == sorted(map(str, [*want, (200, "", 0), (201, "", 0), (None, "x", 1)]))
    assert html_text.extract(df.limit(0)).collect() == []


def test_templates_alone_remove_the_furniture(spark):
    menu = "<section><b>Home</b> <i>World</i> <u>Sport</u></section>"
    top, side, end = "<div><p>The Daily Site</p></div>", "<div><ul><li>Most read<li>Weather</ul></div>", "<div>All rights <b>reserved</b> 2024</div>"
    story = lambda i: f"<div><h1>Title {i}</h1><p>Some <b>bold</b> words of story {i}.<p>And more of <i>number</i> {i}</div>"
    page = lambda i: f"<html><body>{menu}{top}{story(i)}{side if i % 2 else ''}{end}</body></html>"
    rows = [(i, f"http://many.example/{i}", page(i)) for i in range(20)] + [(100 + i, f"http://few.example/{i}", page(i)) for i in range(2)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    clean = lambda i: f"Title {i}\nSome bold words of story {i}.\nAnd more of number {i}"
    assert all(got[i] == clean(i) for i in range(20))
    assert all(got[100 + i] == html_text.main_text(html_text.parse(page(i)), set()) and clean(i) in got[100 + i] for i in range(2))


def test_menus_that_change_go_by_their_shape(spark):
    menu = lambda i: "<section><ul>" + "".join(f"<li><a href='/{i}{k}'>Other story {i} {k}</a>" for k in range(3 + i % 4)) + "</ul></section>"
    story = lambda i: f"<div><h1><a href='/{i}'>Title {i}</a></h1><p>Story {i} cites <a href='#'>source {i}</a>.<p><a href='#'>Only a link {i}</a></div>"
    rows = [(i, f"http://menus.example/{i}", f"<body>{menu(i)}{story(i)}</body>") for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nStory {i} cites source {i}.\nOnly a link {i}" for i in range(20)}


def test_broken_pages_are_read_in_one_pass():
    began = time.monotonic()
    for page in ("<a " * 300_000, "x<a " * 300_000 + ">", "<p><button>" + "<div>" * 200_000, "<a '\">" * 100_000, '<a ">" ' * 100_000, "<!x " * 200_000, "<li><ul>" * 50_000 + "<li>" * 100_000, "a<!--" * 200_000):
        html_text.parse(page)
    assert time.monotonic() - began < 40
    assert text_of("a <b> c <!-- never ends") == "a c" and text_of("a <!-- x") == "a" and text_of("1 < 2 <a") == "1 < 2 <a"
    assert text_of("<p>a<button>b<p>c</button><p>d") == "a\nd" and text_of("<table><tr><td><p>a<table><tr><td>b</table>c<td>d</table>") == "a\nb\nc\nd"


def test_long_pages(spark):
    rows = [(i, f"http://long.example/{i}", f"<body><div>menu</div>{''.join(f'<p>line {k} of {i}' for k in range(30_000))}</body>") for i in range(6)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text.split("\n") == [f"line {k} of {r.page_id}" for k in range(30_000)] for r in got)


def test_whole_table_against_the_articles(spark, sf):
    from larkspur.llm.queries import op5_html_templates

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op5_html_templates(spark, sf).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        lines = (" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert r.text.replace("\n", " ").split() == " ".join(x for x in lines if x).split()
        assert r.n_chars == len(r.text)
