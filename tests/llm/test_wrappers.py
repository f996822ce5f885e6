"""Main text by wrappers: templates written here, the given pages, and the parts."""

import html
import random
import re
import time

import pytest

from sondera.llm import wrappers

from .conftest import DATA

COLUMNS = "page_id long, url string, html string, host string, rule string"


def texts(spark, pages):
    rows = [(k, url, page, "x", "y") for k, (url, page) in enumerate(pages)]
    got = wrappers.extract(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(pages)
    return [r.text for r in sorted(got)]


def plain(page):
    """Text of the one article element of a given page."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())


def test_given_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = sorted((r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in pages.collect())
    assert sorted(map(tuple, wrappers.extract(pages).collect())) == want


def words(rng, n):
    return " ".join(rng.choice(["river", "stone", "light", "winter", "garden", "letter", "window", "summer"]) + str(rng.randrange(99)) for _ in range(n))


def plain_site(rng, k):
    """A site without any element or class that names the article."""
    body = [words(rng, 30) for _ in range(1 + k % 4)]
    title = words(rng, 4)
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words(rng, 3).split())
    extra = f"<div><ul>{links}</ul></div>" if k % 2 else ""
    page = f"<body><div>Our Site of the Year</div><div><ul>{links}</ul></div><div><h1>{title}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div>{extra}<div>All rights reserved by us</div></body>"
    return page, " ".join([title, *body])


def rich_site(rng, k):
    body = [words(rng, 20) for _ in range(1 + k % 3)]
    title = words(rng, 4)
    comments = "".join(f'<article class="comment"><p>{words(rng, 12)}</p></article>' for _ in range(k % 3))
    page = f"""<!DOCTYPE html><HTML><head><title>{title}</title><style>p > a {{ }}</style></head><body class="no-sidebar has-cookie">
      <header><h2>Site</h2><nav><a href=/a>A</a></nav></header><div id="cookie-notice">We use cookies <button>OK</button></div>
      <main><article><header><h1>{title}</h1></header><div class="ad-slot">Buy {words(rng, 2)}</div>
      {"".join(f"<p>{b}<p class=x>{b[::-1]}" for b in body)}<ul><li>one<li>t<b>w</b>o &lt;3</ul><span class="share">Share it</span><script>if (a<b) {{ "</article>" }}</script>
      <table><tr><td>c1<td>c2<tr><td>c3</table></article><aside>{words(rng, 9)}</aside></main>
      <section class="comments"><h2>Comments</h2>{comments}<form><textarea>say</textarea><label>Name</label></form></section><footer>&copy; us</footer></body>"""
    return page, " ".join([title, *(x for b in body for x in (b, b[::-1])), "one two <3 c1 c2 c3"])


def named_site(rng, k):
    body = [words(rng, 25) for _ in range(2 + k % 2)]
    page = f"<div class=topMenu><a href=x>{words(rng, 2)}</a></div><div class='entry-content'>{''.join(f'<h2>S{i}</h2><p>{b}</p><p>{b}</p>' for i, b in enumerate(body))}</div><div class=widget>{words(rng, 5)}</div>"
    return page, " ".join(f"S{i} {b} {b}" for i, b in enumerate(body))


@pytest.mark.parametrize("site", [plain_site, rich_site, named_site])
def test_sites(spark, site):
    rng = random.Random(5)
    made = [site(rng, k) for k in range(12)]
    assert texts(spark, [(f"https://{site.__name__}.example.org/{k}", page) for k, (page, _) in enumerate(made)]) == [want for _, want in made]


def test_salted_join_gives_the_same(spark, monkeypatch):
    rng = random.Random(6)
    made = [plain_site(rng, k) for k in range(20)]
    pages = [(f"https://h{k % 2}.example.org/{k}", page) for k, (page, _) in enumerate(made)]
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    assert texts(spark, pages) == [want for _, want in made]


def test_edges(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    pages = [
        (None, None), ("", ""), ("http://a", "   "), ("http://a", "bare text &amp; more &copy &bogus; a < b"), ("not an address", "<p>x<p>y"), ("http://u:p@B.example:80/x", long), ("http://c", deep), ("http://d", "<article>cut <b>here <a href='"),
        ("http://d", "<!-- never ends <p>gone"), ("http://d", "<article><p>a  b<br>c</p></article><script>never ends"), ("http://e", "<article>same</article>"), ("http://e", "<article>same</article>"),
    ]
    got = texts(spark, pages)
    assert got[:5] == ["", "", "", "bare text & more © &bogus; a < b", "x y"]
    assert got[5] == " ".join(["word & word"] * 20_000) and got[6] == "deep text"
    assert got[7].startswith("cut here") and got[8:] == ["", "a b c", "same", "same"]
    assert wrappers.extract(spark.createDataFrame([], COLUMNS)).collect() == []


def test_copies_of_one_article_stay(spark):
    """A host whose pages all carry one article: what is the same everywhere is still the article."""
    page = "<body><nav><a href=x>m</a></nav><div><h1>T</h1><p>One and the same text.</p></div></body>"
    assert texts(spark, [("http://copies", page)] * 4) == ["T One and the same text."] * 4


def test_inference():
    parts = lambda s: wrappers.folded(wrappers.parse(s))
    a = parts("<ul><li>1<li>2</ul><h2>a</h2><p>x</p><p>y</p><h2>b</h2><p>z</p>")
    b = parts("<ul><li>1</ul><h2>a</h2><p>x</p><table><td>q</table>")
    merged = wrappers.merge_nodes(a, b, False)
    assert wrappers.dump(merged) == '["",0,["ul",0,["li",1,["#",0]]],["(h2 p)",1,["h2",0,["#",0]],["p",1,["#",0]]],["table",2,["td",0,["#",0]]]]'
    assert wrappers.dump(wrappers.load(wrappers.dump(merged))) == wrappers.dump(merged)
    assert all(number is not None for page in (a, b) for number, _, _ in wrappers.slots(page, merged))


def test_alignment_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        got = wrappers.align(x, y)
        assert len(got) == table[-1][-1] and all(x[i] == y[j] for i, j in got) and got == sorted(got)


def test_hostile_pages_take_linear_time():
    for page in ('<a "' * 60_000, "<p " * 60_000, "<" * 200_000, "<div>" * 60_000, "</p>" * 60_000, "<!--" * 60_000, "&" * 200_000, "<h2>a</h2><p>b</p><ul></ul>" * 8000):
        start = time.time()
        wrappers.dump(wrappers.folded(wrappers.parse(page)))
        assert time.time() - start < 8
