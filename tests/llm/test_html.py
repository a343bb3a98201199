import html
import math
import re

import pytest

from sheafline.llm import html_text, queries


def test_whole_table(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.op8_html_extraction(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = by_pattern(pages[r.page_id])
        assert r.text == want and r.n_chars == len(want)


def by_pattern(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def test_densities_alone_find_the_article(spark, small, monkeypatch):
    """Without classes, and with the article as a plain block, the sums of densities decide; characters alone do not."""
    pages = [r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    plain = [re.sub(r"(</?)article", r"\1div", re.sub(r' (class|id)="[^"]*"', "", page)) for page in pages]
    found = lambda: sum(html_text.main_text(x) == by_pattern(page) for x, page in zip(plain, pages))
    assert found() >= 0.9 * len(pages)
    measure = html_text.measure

    def by_chars(nodes):
        body = measure(nodes)
        for n in nodes:
            n.density = float(n.chars)
        for n in nodes:
            n.total = sum(x.density for x in n.children if not isinstance(x, str))
        return body

    monkeypatch.setattr(html_text, "measure", by_chars)
    assert found() <= 0.2 * len(pages)


@pytest.mark.parametrize("page", ["<div>{}</div>", "<div><p>{}</i></p></div>", "<div><p>{}</b>", "<article><li><b>{}", "<section><article><p>{}</p>"])
def test_deep_pages_take_time_in_proportion(page):
    import time

    head, tail = page.split("{}")
    began = time.process_time()
    html_text.main_text("<body>" + (head + "some text here") * 20_000 + tail * 20_000)
    assert time.process_time() - began < 6


def density_by_hand(chars, tags, link_chars, link_tags, share):
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    return chars / max(tags, 1) * math.log(max(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1), 1 + 1e-9)) / max(math.log(base), 1.0)


def test_densities_by_hand():
    tree = html_text.Tree()
    tree.feed("<body><div><p>aaaa bbbb</p><p>cc <a href=x>dd</a></p></div><div><a href=y>eeeee</a></div></body>")
    body = html_text.measure(tree.nodes)
    share = 7 / 17
    one, two = (n for n in body.children)
    first, second = one.children
    assert (body.chars, body.link_chars, body.tags, body.link_tags) == (17, 7, 6, 2)
    for node, counts in ((first, (8, 0, 0, 0)), (second, (4, 1, 2, 1)), (one, (12, 3, 2, 1)), (two, (5, 1, 5, 1))):  # chars, tags, link chars, link tags
        assert node.density == pytest.approx(density_by_hand(*counts, share)), counts
    assert one.total == pytest.approx(first.density + second.density) and two.total == 0


TEXT = "A first paragraph of the article, long enough to count as text by any measure of it. "


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><div id=menu><a href=x>Home</a><a href=y>About</a></div><div class=content><h1>Title</h1><p>{TEXT}</p><p>Short.</p><ul><li>one<li>two</ul></div><div class='sidebar'><p>{TEXT}</p></div><div id=comments><p>{TEXT * 4}</p></div></body>", "Title " + TEXT.strip() + " Short. one two"),
        (f"<body><header><h1>Paper</h1><nav><a href=a>A</a></nav></header><main><article><header><h1>Head</h1></header><p>{TEXT}<a href=q>li</a>nk<br>next</p><aside>Side</aside><form><p>Mail us</p></form></article><section class=comments><p>{TEXT * 9}</p></section></main><footer>f</footer>", "Head " + TEXT + "link next"),
        (f"<body><div class='cookie-notice'>{TEXT * 3}</div><div class=ad>Buy</div><div><p>{TEXT}<b>bold&amp;</b>&eacute;&#x41;&nbsp;x</p><script>var t='</p>'</script><style>p{{}}</style></div></body>", TEXT + "bold&éA x"),
        (f"<body><div class='layout has-sidebar'><div class='wrap sidebar'><article class=post><h1>T</h1><p>{TEXT}</p></article></div><div class='entry-header'>E</div><article class='comment'><p>{TEXT * 9}</p></article></div></body>", "T " + TEXT.strip()),
        (f"<body><div class='entry-header'><h1>Head</h1></div><div class=text><p>{TEXT}</p><p>{TEXT}</p></div><div class='comment-list'><p>{TEXT * 9}</p></div></body>", "Head " + TEXT.strip() + " " + TEXT.strip()),
        ("just text &lt; here", "just text < here"), ("", ""), (None, ""), ("<html><head><title>t</title></head><body></body></html>", ""), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<body><p>one<p>two<table><tr><td>a<td>b</table>", "one two a b"), ("<p>a\n  b\t c</p>  <p> </p>", "a b c"),
    ],
)
def test_cases(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("wrapper", ["<form id=aspnetForm>", "<div class='page comments-closed'>", "<div class='has-comments'>", "<div class='comments'>"])
@pytest.mark.parametrize("inner", ["<article><p>{}</p></article>", "<div><p>{}</p></div>"])
def test_wrappers_lose_only_their_noise(wrapper, inner):
    page = f"<body>{wrapper}<input value=x><nav>Menu</nav>{inner.format(TEXT)}<div class=comments><p>Nice</p></div><button>Go</button></{wrapper[1:5].strip()}><footer>f</footer></body>"
    assert html_text.main_text(page) == TEXT.strip()


def test_forms_and_comments_beside_the_article_go():
    page = f"<body><div><p>{TEXT * 3}</p></div><form><p>Mail us</p></form><p class='no-comments'>Comments are closed.</p><div class=comments><article><p>{TEXT}</p></article></div></body>"
    assert html_text.main_text(page.replace("<div><p>", "<article><p>").replace("</p></div><form>", "</p></article><form>")) == (TEXT * 3).strip()


@pytest.mark.parametrize("promo", ["<div><p>Buy now!</p></div>", "<div><h2>Offer</h2><p>Today <i>only</i></p></div>", "<table><tr><td>Rate<td>us</table>", "<div><div><a href=x>Home</a> or <a href=y>away</a></div></div>"])
def test_sparse_boilerplate_without_telling_classes_goes(promo):
    core = f"<div><h2>Part</h2><p>{TEXT}</p><p>{TEXT}</p><p>Short.</p></div>"
    page = f"<body><div>{promo}<div><h1>Head</h1></div>{core}{promo}</div>{promo}</body>"
    assert html_text.main_text(page) == f"Head Part {TEXT}{TEXT}Short."


def test_dense_neighbours_of_the_core_stay():
    rich = f"<div><p>{TEXT * 4}</p></div>"
    page = f"<body><div><p>{TEXT * 4}</p><p>{TEXT * 4}</p><p>{TEXT * 4}</p></div>{rich}<div><div><span>x</span><p>y</p></div></div></body>"
    assert html_text.main_text(page) == (TEXT * 16).strip()


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(None, None, None, "clash"), (1, "u", "", ""), (1, "u", "", ""), (2, None, "<p>x</p>", "clash")]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html_text.extract_pages(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("2", "x", 1), ("None", "", 0)]
    assert html_text.extract_pages(spark.createDataFrame([], schema)).count() == 0
