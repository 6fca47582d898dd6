"""Main text of web pages: wrappers, slots, template text, odd pages, and a plain reader of the same rules."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from radiopos.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) "</p>";</script></head><body><nav><a href=/>x</a></nav>
<div class="ad">buy</div><article><h1>Head {n}</h1><p>One {n} &amp; <b>two</b><br>three<p>four {n}{more}</article><!-- <p>no</p> --><div id=comments><p>c</p></div><footer>f</footer></body></html>"""


def read(*sources):
    """Each page's text with the wrapper of all of them."""
    pages = [html.Page(s) for s in sources]
    wrapper = html.Wrapper.read(html.infer(pages).written())
    return [html.extract(p, wrapper) for p in pages]


def alone(source):
    return html.extract(html.Page(source), None)


def prose(seed, words=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(words))


def test_main_text(spark):
    pages = [(i, f"http://h{i % 3}.example/{i}", PAGE.format(n=i, more="<ul><li>a<li>b</ul>" if i % 2 else "")) for i in range(30)]
    odd = [(100, None, None), (101, "nonsense", ""), (102, "http://h0.example/", "plain & simple"), (103, "http://h0.example/z", "<p>a</p><script>x</p>"), (104, "http://h9.example", "<div><" * 2000), pages[0], (None, None, "<main>m</main>t")]
    df = spark.createDataFrame([(*r, 1) for r in pages + odd], "page_id long, url string, html string, host int")
    rows = html.main_text(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages + odd)
    for i in range(30):
        assert got[i] == f"Head {i}\nOne {i} & two three\nfour {i}" + ("\na\nb" if i % 2 else "")
    assert (got[100], got[101], got[102], got[103], got[None]) == ("", "", "plain & simple", "a", "m")
    assert html.main_text(df.limit(0)).count() == 0


def test_salted_wrappers_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h{i % 2}.example/", PAGE.format(n=i, more="")) for i in range(12)], "page_id long, url string, html string")
    want = sorted(map(tuple, html.main_text(df).collect()))
    monkeypatch.setattr(html, "BROADCAST_CHARS", 0)
    assert sorted(map(tuple, html.main_text(df).collect())) == want


def test_template_text_goes_only_by_the_wrapper():
    pages = [f"<body><article><h1>t{i}</h1><p>{prose(i)}</p><div class=x>Printed by Example Press</div></article></body>" for i in range(6)]
    for i, text in enumerate(read(*pages)):
        assert text == f"t{i}\n{prose(i)}"
        assert alone(pages[i]) == text + "\nPrinted by Example Press"
    # three pages, or copies of one, are no evidence
    assert read(*pages[:3])[0].endswith("Example Press")
    copies = [pages[0].replace("<body>", f"<body><script>{i}</script>") for i in range(6)]
    assert read(*copies)[0] == alone(pages[0])


def test_pages_without_articles_are_read_by_slots():
    page = "<body><div class=top>Daily Example</div><header><h1>Story {0}</h1>Desk</header><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><div class=b{0}>{1}</div><p>{2}</p></body>"
    got = read(*(page.format(i, prose(i), prose(i + 50)) for i in range(5)))
    assert got == [f"Story {i}\n{prose(i)}\n{prose(i + 50)}" for i in range(5)]
    assert alone(page.format(1, "x", "y")) == "Daily Example\nx\ny"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<html><head><title>T</title><body><p>kept</p>", "kept"),
        ("<head><meta charset=x><link rel=y><p>kept", "kept"),
        ("<article class=a>one</article><article class=b>two</article><p>out</p>", "one\ntwo"),
        ("<article><header>Site name<h2>Title</h2></header>text</article>", "Title\ntext"),
        ("<body><header>Site name</header><p>text</p>", "text"),
        ("<article><p class=notice>stays</p><section id=related>stays too</section><div class=notice>goes</div></article>", "stays\nstays too"),
        ("<article>a<section class=related><a>x</a><a>y</a></section></article>", "a"),
        ("<article>a<aside>b</aside><form>c</form><div class='user-comments'>d</div></article><article class=comment>e</article>", "a"),
        ("<p title=5\">a</p><p>say \"b\" <i>c</i>", "a\nsay \"b\" c"),
        ("<p>a<select><option>b<option>c</select>d<object>e</object><svg><text>f</text></svg>", "ad"),
        ("a</p>b<br>c<!-- d --><!--> e</ f>", "a\nb c e"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<ul><li>a<ul><li>b</ul>c<li>d</ul>", "a\nb\nc\nd"),
        ("<p>&lt;b&gt; &#233;&nbsp;&amp;x <p", "<b> é &x"),
        ("x < y <", "x < y <"),
        ("<textarea>a</textarea><style>b", ""),
    ],
)
def test_single_pages(source, text):
    assert alone(source) == text
    assert read(source) == [text]


@pytest.mark.parametrize("body", ["<h1>Title</h1><p>{0}</p><blockquote>quoted</blockquote><p>{1}</p>", "<p>{0}</p><ul><li>one</li></ul><p>{1}</p><table><tr><td>cell</td></tr></table>", "<div class='a'>{0}</div><div class='b'>{1}</div>", "<section><p>{0}</p></section><p>{1}</p><figure>image</figure>"])
@pytest.mark.parametrize("page", ["<html><body>{0}</body></html>", "{0}", "<body class='x'><nav>menu</nav>{0}</body>"])
def test_text_beside_other_blocks_is_kept(body, page):
    source = page.format(body.format("first " * 40, "second " * 30))
    expected = re.sub("<nav>.*?</nav>|<[^>]*>", " ", source).split()
    assert alone(source).split() == expected and read(source)[0].split() == expected


def fits(wrapper, page):
    """Whether every element's content matches the wrapper."""
    todo = [(0, 0)]
    while todo:
        node, i = todo.pop()
        found, whole = wrapper.content(node).match(page.keys(i))
        if not whole:
            return False
        todo += zip((wrapper.nodes[node][1][m] for m in found), page.kids[i], strict=True)
    return True


def test_wrappers_generalise():
    sources = [f"<body><h1>t</h1>{'<p>x</p>' * k}{'<div>o</div>' if k % 2 else ''}</body>" for k in range(1, 6)]
    wrapper = html.infer([html.Page(s) for s in sources])
    assert all(fits(wrapper, html.Page(s)) for s in sources)
    assert fits(wrapper, html.Page("<body><h1>t</h1>" + "<p>x</p>" * 50 + "</body>"))
    assert not fits(wrapper, html.Page("<body><table>t</table></body>"))


def random_tree(rng, depth=0):
    out = ""
    for _ in range(rng.randint(0, 5)):
        name = rng.choice(["div", "span", "ul", "section", "b", "aside", "h2", 'div class="x"', 'div class="ad"'])
        out += rng.choice([f"w{rng.randint(0, 99)} ", ""])
        if depth < 4:
            out += f"<{name}>{random_tree(rng, depth + 1)}</{name.split()[0]}>"
    return out


@pytest.mark.parametrize("seed", range(20))
def test_wrappers_match_all_their_pages(seed):
    rng = random.Random(seed)
    pages = [html.Page(f"<body>{random_tree(rng)}</body>") for _ in range(rng.randint(1, 8))]
    wrapper = html.infer(pages)
    assert all(fits(wrapper, p) for p in pages)


class Plain(HTMLParser):
    """The text of a well-formed page by the rules for one page, element by element."""

    def __init__(self):
        super().__init__()
        self.lines, self.now, self.closed = [], "", []

    def end(self):
        if text := " ".join(self.now.split()):
            self.lines.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag not in ("span", "b"):
            self.end()
        self.closed.append(tag == "aside" or dict(attrs).get("class") == "ad")

    def handle_endtag(self, tag):
        if tag not in ("span", "b"):
            self.end()
        self.closed.pop()

    def handle_data(self, data):
        if not any(self.closed):
            self.now += data


@pytest.mark.parametrize("seed", range(20))
def test_pages_follow_a_plain_reader(seed, monkeypatch):
    # the plain reader goes by names alone; containers of most of the text have tests of their own
    monkeypatch.setattr(html, "LEAST", 10**9)
    source = f"<body>{random_tree(random.Random(100 + seed))}</body>"
    plain = Plain()
    plain.feed(source)
    plain.end()
    assert alone(source) == read(source)[0] == "\n".join(plain.lines)


def test_streams_too_long_to_align_match_in_any_order(monkeypatch):
    monkeypatch.setattr(html, "ALIGNED", 10)
    rng = random.Random(3)
    pages = [html.Page("".join(f"<{t}>{i}</{t}>" for t in rng.choices(["p", "ul", "h2"], k=40))) for i in range(3)]
    wrapper = html.infer(pages)
    assert all(fits(wrapper, p) for p in pages)
    assert all(html.extract(p, wrapper) == html.extract(p, None) for p in pages)


@pytest.mark.parametrize("part", ["<div>x", "<b>", "<p>x<b>", '<a "', "<li>x", "<object>", "</p>", "<script>", '<a b="', "<a ", "<!--", "<h1>x<p>"])
def test_time_grows_with_the_page(part):
    began = time.process_time()
    html.extract(page := html.Page(part * 100_000), None)
    assert time.process_time() - began < 5
    html.extract(page, html.infer([page]))
    assert time.process_time() - began < 30


LONG = prose(1, 120)


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="content with-sidebar no-sidebar"><p>{LONG}</p></div><div class="sidebar">s</div></body>',
        f'<body><div class="comments-free"><p>{LONG}</p></div></body>',
        f'<body><form id=f action="/"><div class=menu>m</div><p>{LONG}</p></form></body>',
        f'<body><div class="wrap has-ads"><article class="post no-comments"><p>{LONG}</p></article></div></body>',
        f'<body><form><article class="sidebar-right"><p>{LONG}</p></article></form></body>',
        f'<body><div class="notice"><h1>{LONG}</h1></div><div class=notice>cookies</div></body>',
    ],
)
def test_most_of_a_page_is_no_furniture_by_name(page):
    assert alone(page) == LONG
    others = [page.replace(LONG, prose(i + 50, 120)) for i in range(5)]
    assert read(page, *others) == [LONG, *(prose(i + 50, 120) for i in range(5))]


def test_comments_adverts_and_what_is_not_shown():
    page = f"""<body><article><p>{LONG}</p><p class="ad">buy now</p><div hidden>unseen</div><p style="color:red; display: none">dark</p>
    <article class="comment">first!</article><div class="comment-list"><article>second</article></div><p>end</p></article></body>"""
    assert alone(page) == f"{LONG}\nend"
    # comments longer than the text remain comments, also where no article is marked
    page = f"<body><div><h1>t</h1><p>{prose(2, 30)}</p></div><div id=comments><p>{prose(3, 400)}</p></div></body>"
    assert alone(page) == f"t\n{prose(2, 30)}"
    others = [f"<body><div><h1>t{i}</h1><p>{prose(i, 30)}</p></div><div id=comments><p>{prose(90 + i, 400)}</p></div></body>" for i in range(6)]
    assert read(*others)[4] == f"t4\n{prose(4, 30)}"
    # a page of menus and footers has no text
    assert alone(f"<body><nav>{LONG}</nav><footer>{LONG}</footer></body>") == "" and alone("<body><div class=footer>only this</div></body>") == ""


def test_slots_decide_before_names():
    """A container that is named like furniture and holds less than half of each page's text: on its host most of what
    differs is in it, as another part repeats on every page."""
    fixed, body, aside = prose(7, 40), lambda i: prose(100 + i, 50), lambda i: prose(200 + i, 85)
    page = lambda i: f'<body><div class="widget-side sidebar"><p>{aside(i)}</p></div><div class="about"><p>{fixed}</p></div><p>{body(i)}</p></body>'
    assert alone(page(0)) == f"{fixed}\n{body(0)}"
    assert read(*(page(i) for i in range(6))) == [f"{aside(i)}\n{body(i)}" for i in range(6)]


def test_compound_classes(spark):
    rng = random.Random(9)
    states = ["with-sidebar", "no-menu", "has-banner", "comments-open", "footer-visible", "is-popup", "ad-free", "js-nav", "without_ads", "sidebar-left"]
    for i in range(60):
        names = " ".join(rng.sample(["content", "page", "post-body", "main-column", *states], rng.randint(1, 5)))
        rest = "".join(f"<div class='{c}'>{prose(i + 1, 4)}</div>" for c in rng.sample(["sidebar", "menu", "ads", "footer", "newsletter"], 2))
        page = f"<html><body><div class='{names}'><h2>{prose(i, 3)}</h2><p>{prose(i + 7, 30)}</p></div>{rest}</body></html>"
        assert alone(page) == f"{prose(i, 3)}\n{prose(i + 7, 30)}", names
