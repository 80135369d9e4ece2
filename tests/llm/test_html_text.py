import html
import re
import time

from opslake.llm import html_text, queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h1>Site of the day and the night</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site and you accept them by going on with it.</div><!-- ad <p>x</p> -->
<div class='top ad'>Buy the best of all the things that you have not got, and have them now.</div>
<article><header><h1>The &amp; head&nbsp;line</h1></header><p><b>First   par<i>a</i>graph of<br>the text.<p>Short.</p>
<ul><li>One <a href="/x">link</a></li><li><a href="/y">Only link</a></li></ul><aside>Not this</aside>
<div id="comments"><p>I am a reader and this is what I think of it.</p></div>%%% $$$ ###</article>
<form><p>Your name</p><input value="a>b"></form><footer>&copy; all of it</footer></body></html>"""


def test_article_and_nothing_else():
    assert html_text.main_text(PAGE) == "The & head line\n\nFirst paragraph of the text.\n\nShort.\n\nOne link\n\nOnly link\n\n%%% $$$ ###"


def test_two_passes_without_an_article():
    good = "This is the text of a page that has a lot to say about all of the things in it."
    bad = "Alpha Beta Gamma Delta Epsilon Zeta Theta Kappa Lambda Omega Sigma Omicron Upsilon"
    page = f"<div>Lead</div><p>{good}</p><p>Short one</p><p>{good}</p><p>{bad}</p><div>Tail</div><p><a href='/'>{good}</a></p>"
    assert html_text.main_text(page) == "\n\n".join(["Lead", good, "Short one", good])
    assert html_text.main_text("<p>Short only</p>") == ""


def test_articles_beside_an_unmarked_body():
    body = "This is the text of a page that has a lot to say about all of the things in it, and it goes on with more of them."
    text = "\n\n".join([body] * 3)
    plain = f"<div>{body}</div>" * 3
    teaser = "<article><h3><a href='/x'>Grand Opening Harbour Museum Tuesday Evening</a></h3><p><a href='/x'>Read more</a></p></article>"
    listing = "<article><p>Harbour Museum, Grand Opening, Tuesday Evening, Tickets, Exhibition, Guided Tours, Cafe</p></article>"
    assert html_text.main_text(teaser * 4 + plain) == text
    assert html_text.main_text(plain + listing * 2) == text
    for name in ("comment", "comment-body", "div-comment-7 comment", "related-posts"):
        assert html_text.main_text(f"{plain}<article class='{name}'><p>I am a reader and {body}</p></article>") == text
    assert html_text.main_text(f"<article class='social-life-post'>{plain}</article>") == text


def test_rows_of_links_inside_an_article():
    body = "This is the text of a page that has a lot to say about all of the things in it."
    links = "".join(f"<li><a href='/{i}'>Story {i}</a></li>" for i in range(4))
    assert html_text.main_text(f"<article><p>{body}</p><ul>{links}</ul><p>{body}</p></article>") == f"{body}\n\n{body}"
    long = "<p><a href='/'>Alpha Beta Gamma Delta Epsilon Zeta Theta Kappa Lambda Omega Sigma Omicron</a></p>"
    assert html_text.main_text(f"<article><p>{body}</p>{long}<p>{body}</p></article>") == f"{body}\n\n{body}"


def test_languages_without_a_stop_list():
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności oraz swych praw, są obdarzeni rozumem."
    russian = "Все люди рождаются свободными и равными в своём достоинстве и правах, они наделены разумом и совестью."
    turkish = "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar, akıl ve vicdana sahiptirler, kardeşçe davranırlar."
    portuguese = "Todos os seres humanos nascem livres e iguais em dignidade e em direitos, dotados de razão e de consciência."
    chinese = "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。"
    english = "This is the text of a page that has a lot to say about all of the things in it."
    for text in (polish, russian, turkish, portuguese, chinese):
        menu = "".join(f"<p><a href='/{i}'>{text}</a></p>" for i in range(2))
        page = f"<body>{menu}<div>{text}</div><div>1. X</div><div>{text}</div>{menu}</body>"
        assert html_text.main_text(page) == f"{text}\n\n1. X\n\n{text}"
    quoting = f"<p>{polish}</p>" * 5 + f"<p>{english}</p>"
    assert html_text.main_text(f"<html lang='pl'><body>{quoting}</body></html>").count(polish) == 5
    names = "<p>Alpha Beta Gamma Delta Epsilon Zeta Theta Kappa Lambda Omega Sigma Omicron Upsilon</p>" * 5
    assert html_text.main_text(f"<html lang='en'><body><p>{english}</p>{names}</body></html>") == english


def test_names_that_hold_a_marking_word_by_chance():
    body = "This is the text of a page that has a lot to say about all of the things in it."
    heads = ['<h2 id="related-work">Related work</h2>', '<h2 id="search">Search</h2>', '<h2 class="social">Social</h2>']
    for head in heads:
        title = re.sub("<.*?>", "", head)
        for page in (f"<article><p>{body}</p>{head}<p>{body}</p></article>", f"<div><p>{body}</p>{head}<p>{body}</p></div>"):
            assert html_text.main_text(page) == f"{body}\n\n{title}\n\n{body}"
    for part in (
        f'<section id="social-impact"><h2>Impact</h2><p>{body}</p></section>',
        f'<div class="related-work"><h2>Impact</h2><p>{body}</p></div>',
        f'<h2>Impact</h2><p class="notice">{body}</p>',
        f'<h2>Im<span id="Advertising">pact</span></h2><p>{body}</p>',
    ):
        assert html_text.main_text(f"<article><p>{body}</p>{part}</article>") == f"{body}\n\nImpact\n\n{body}"
    outside = f'<div><p>{body}</p><section id="social-impact"><h2>Impact</h2><p>{body}</p></section></div>'
    assert html_text.main_text(outside) == f"{body}\n\nImpact\n\n{body}"
    for name in ('class="related-posts"', 'id="comments"', 'class="share-links"', 'role="search"', 'class="ad-slot-3"'):
        assert html_text.main_text(f"<article><p>{body}</p><div {name}><p>{body}</p></div></article>") == body
    names = "<p>Alpha Beta Gamma Delta Epsilon Zeta Theta Kappa Lambda Omega Sigma Omicron Upsilon</p>"
    assert html_text.main_text(f'<article><p>{body}</p><div class="my-sidebar">{names}</div></article>') == body


def test_what_is_left_open_ends_where_the_next_part_begins():
    good = "This is the text of a page that has a lot to say about all of the things in it."
    page = f"<html><head><title>T</title><body><p class=notice><b>We use cookies on it<p>{good}<p>{good}</html>"
    assert html_text.main_text(page) == f"{good}\n\n{good}"


def test_broken_and_long_pages():
    for page in ("", "<", "<p", "a < b", "<!-- x", "<script>x", "<p a='", "</p></p>", "<" * 50_000, "<p>" * 50_000, "<a '" * 5_000, "&" * 50_000):
        html_text.main_text(page)
    long = "<article>" + "<p>The words of it &amp; all</p>" * 20_000 + "</article>"
    assert html_text.main_text(long) == "\n\n".join(["The words of it & all"] * 20_000)


def test_odd_rows(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, "y"), (2, "v", "", "z"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html_text.extract(pages).collect()]
    text = html_text.main_text(PAGE)
    assert got == [(1, "u", text, len(text)), (None, None, "", 0), (2, "v", "", 0), (1, "u", text, len(text))]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_query_against_the_marked_articles(spark):
    """Pages of the tables mark their article, so a few replacements find its blocks."""
    directory = "/root/testdata/sf0.1"
    got = {r.page_id: r for r in queries.op10_html_text(spark, directory).collect()}
    pages = queries.table(spark, directory, "pages").collect()
    assert len(got) == len(pages)
    for page in pages:
        inner = re.search(r"<article>(.*)</article>", page.html, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", inner)
        plain = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
        assert got[page.page_id].text == "\n\n".join(b for b in plain if b)
        assert got[page.page_id].n_chars == len(got[page.page_id].text) and got[page.page_id].url == page.url


def test_very_many_open_elements_take_linear_time():
    n = 100_000
    page = "<body><article><p>" + "the one of them and it was with that <i>" * 50 + "<i>" * n + "</b>" * n + "<p>it was the end of that</article>"
    started = time.time()
    assert "it was with that" in html_text.main_text(page)
    html_text.main_text("<div>" * n + "<p>" * n + "</span>" * n)
    assert time.time() - started < 20
