"""Operator 3: known pages, induction on unmarked pages, edges."""

from conftest import prose

from reportlake.llm import extract
from reportlake.llm.htmltree import Page, candidates, match, merge

FRAME = """<html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<aside>Side</aside><article><h1>{h}</h1><p>First&nbsp;<b>b</b>old   &amp; <i>it</i>alic
line<p>{p}<br>after</p><div class="ad">Buy</div><form><input>Sign <button>up</button></form>
<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><section id="comments"><article class="comment">Nice!</article></section></article><footer>&copy; x</footer>"""


def text(html):
    return " ".join(t for _, t in candidates(Page(html)))


def test_page_with_article():
    assert text(FRAME.format(h="Head &lt;1&gt;", p="second")) == "Head <1> First bold & italic line second after one two c1 c2"
    assert text("<article>a<p>b</article><main>longer text outside</main>") == "a b"
    assert text("<div class=ad>never closed <article><p>kept</p></article>") == "kept"
    for cut in range(len(FRAME)):
        text(FRAME[:cut])
    assert text("<" * 5000) is not None and text("<div>" * 20000 + "x") == "x"
    assert text("plain words  only") == "plain words only" and text("") == "" and text(None) == ""
    assert text("<p>a</p><!-- b --><p>c<!-- d") == "a c"


def test_simple_tree_matching():
    leaf = lambda t: (t, ())
    a = ("body", (leaf("h1"), ("div", (leaf("p"), leaf("ul"))), leaf("p")))
    b = ("body", (leaf("h1"), ("div", (leaf("p"),)), leaf("table"), leaf("p")))
    assert match(a, b, {})[0] == 5 and match(a, ("html", ()), {})[0] == 0
    assert merge(a, b, {}) == ("body", (leaf("h1"), ("div", (leaf("p"), leaf("ul"))), leaf("table"), leaf("p")))


def _page(i):
    body = "".join(f"<p>{prose(100 * i + k, 30)}</p>" for k in range(1 + i % 3))
    return f"<html><body><div>Welcome to our site</div><div><p>All rights kept since 1999</p>{body}</div><div>Read more on this page</div></body></html>", " ".join(prose(100 * i + k, 30) for k in range(1 + i % 3))


def test_template_is_what_stays_constant(spark):
    made = [_page(i) for i in range(12)]
    rows = [(i, f"https://one.example.com/{i}", h) for i, (h, _) in enumerate(made)]
    copy = "<html><body><div><p>" + prose(5, 80) + "</p></div></body></html>"
    rows += [(100 + i, f"https://copies.example.com/{i}", copy) for i in range(8)]
    rows += [(200, "https://single.example.com/", made[0][0]), (300, None, "<p>x</p>"), (301, "https://one.example.com/e", ""), (302, "https://one.example.com/n", None), (0, rows[0][1], rows[0][2]), (None, "https://q.example.com", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract.main_text(pages.selectExpr("*", "1 as key", "'x' as host", "'t' as text")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == t for i, (_, t) in enumerate(made))  # the frame is gone, the slots stay
    assert all(by[100 + i].text == prose(5, 80) for i in range(8))
    assert by[200].text.startswith("Welcome") and by[300].text == "x" and by[301].text == by[302].text == "" and by[None].text == "y"
    assert all(r.n_chars == len(r.text) for r in got)
    assert extract.main_text(pages.where("false")).collect() == []


def test_roles_are_whole_class_tokens():
    article = '<article>a<h2 id="related-work">h</h2><section id="search">s</section><div id="discussion">d</div><p class="social-history">p</p>{}</article>'
    assert text(article.format("")) == "a h s d p"
    gone = '<div class="post-comments">1</div><div class="related-posts">2</div><aside>3</aside><p class="ad">4</p><div class="google-ad">5</div><div class="share buttons">6</div><section id="comments"><p>7</section>'
    assert text(article.format(gone)) == "a h s d p"
    assert text('<div class="content has-sidebar"><p>body text</p></div><div class="cookie-notice">c</div><div id="site-header">h</div>') == "body text"
    assert text('<p>the real body</p><div class="comments"><article>Nice</article></div>') == "the real body"
    assert text("<form><div><article>body</article></div></form><p>x") == "body"


def test_all_articles_and_inline_elements_stay():
    assert text('<article>one</article><article>two <p>x</article><article class="comment">c</article><p>out') == "one two x"
    assert text("<article>let <math><mi>x</mi></math> be <object>o</object></article>") == "let x be o"
    menu = "<ul><li><a>Home</a><li><a>About</a></ul><div><a>More</a></div>"
    assert text(menu + "<p><a>linked title</a></p><ul><li>text here</li><li><a>link</a></li></ul>") == "linked title text here link"


def test_any_depth(spark):
    assert text("<div>" * 70 + "<article>deep<p>in</article>" + "</div>after") == "deep in"
    deep = '<div class="widget">' * 1200 + "<article>in<p>b</article>"
    rows = [(i, "https://deep.example.com", deep + str(i)) for i in range(6)] + [(9, "https://deep.example.com", "<section>" * 5000 + "x")]
    got = extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {**{i: "in b" for i in range(6)}, 9: "x"}


def test_frame_in_several_languages(spark):
    words = ("Read more about us", "Lesen Sie mehr", "En savoir plus", "Leer mas")
    rows = [(i, "https://four.example.com", f"<body><h3>{words[i % 4]}</h3><div><p>{prose(i, 30)}</p><p>{prose(500, 12) if i % 9 == 0 else prose(900 + i, 12)}</p></div></body>") for i in range(80)]
    got = extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"{prose(i, 30)} {prose(500, 12) if i % 9 == 0 else prose(900 + i, 12)}" for i in range(80)}
