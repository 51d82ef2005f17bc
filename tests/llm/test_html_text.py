"""Main text: every page of the table against a plain reading of its template, and odd markup."""

from __future__ import annotations

import html
import random
import re
import time
import tracemalloc

import numpy as np
import pytest

from jobscope.llm import html_text
from jobscope.llm.queries import QUERIES
from jobscope.session import load
from tests.conftest import DATA


def plain(source):
    """The given pages: one article, its blocks parted by paragraph and heading tags."""
    article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark):
    got = {r["page_id"]: r for r in QUERIES["op7_html_extraction"](spark, f"{DATA}/sf0.01").collect()}
    rows = load(spark, f"{DATA}/sf0.01", "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == plain(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(plain(r["html"])) and got[r["page_id"]]["url"] == r["url"]


@pytest.mark.parametrize(
    "source,want",
    [
        ("", []),
        ("plain &amp; simple\n\ttext&nbsp;&eacute;&#233;&#xe9;", [(0, "plain & simple text ééé")]),
        ("<p>one<p>two<br>more<div>three</div>four", [(0, "one"), (0, "two more"), (0, "three"), (0, "four")]),
        ("<nav>menu</nav><main><p>a</p></main><footer>f</footer>", [(1, "a")]),
        ("<main><nav>m</nav><article>x<aside>s</aside>y</article></main>", [(2, "x"), (2, "y")]),
        ("<article><header><h1>T</h1></header><p>b</p><footer>f</footer></article>", [(2, "T"), (2, "b")]),
        ("<header>site</header><article>a<div class='cookie-notice'>c<div>d</div></div>e</article>", [(2, "a"), (2, "e")]),
        ("<article>a</article><section id=comments><article>no</article></section>", [(2, "a")]),
        ("<script>if (a < b) '</p>'</script><STYLE>p{}</STYLE ><p>t</p><!-- <p>c</p> --><p>u", [(0, "t"), (0, "u")]),
        ('<p title="a > b">q</p><p title=\'x>\'>r</p>', [(0, "q"), (0, "r")]),
        ("<p>1 < 2 and 3 > 2</p>", [(0, "1 < 2 and 3 > 2")]),
        ("<p>cut <b", [(0, "cut")]),
        ("<p>cut <!-- open", [(0, "cut")]),
        ("<p class=ad>buy<p>read</p>", [(0, "read")]),
        ("<div class='advert'>x</section>y</div>z", [(0, "z")]),
        ("<body class='has-ads sidebar'><main id=menu-page>m</main></body>", [(1, "m")]),
        ("<div class='row with-sidebar'>a<div class='sidebar left'>b</div></div>", [(0, "a")]),
        ("<article class='ad-free'>a</article><article class='comment'>b</article>", [(2, "a")]),
        ("<form><nav>n</nav>x<article>a<form>f</form></article>y</form>", [(2, "a")]),
        ("<p>a<b>b</b>c</p><table><tr><td>d<td>e</tr></table><ul><li>f<li>g</ul>", [(0, "abc"), (0, "d e"), (0, "f"), (0, "g")]),
        ("<title>no</title><form>no<input></form><p>" + "long " * 50_000 + "</p>", [(0, ("long " * 50_000).strip())]),
    ],
)
def test_lines(source, want):
    assert html_text.page_lines(source) == want


def test_shared_lines_are_a_longest_common_subsequence():
    draw = random.Random(0)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(9))] for _ in range(2))
        length = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1, j + 1] = length[i, j] + 1 if x == y else max(length[i, j + 1], length[i + 1, j])
        shared = [x for x, m in zip(a, html_text.shared_lines(a, b)) if m]
        rest = iter(b)
        assert len(shared) == length[-1, -1] and all(x in rest for x in shared)


def test_pages_without_article_lose_what_the_nearest_page_has(spark):
    rows = [(i, f"http://h.org/news/{i}", f"<p>Menu</p><p>Story {i}</p><p>About us</p>") for i in range(10, 30)]
    rows += [(90, "http://h.org/shop/1", "<p>Other menu</p><p>Ware</p>"), (91, "http://h.org/shop/2", "<p>Other menu</p><p>More</p>")]
    rows += [(95, "http://alone.org/", "<p>Menu</p><p>Alone</p>"), (96, None, None), (97, "", ""), (96, None, None)]
    rows += [(98, "http://copy.org/a", "<p>Same</p>"), (99, "http://copy.org/b", "<p>Same</p>")]
    rows += [(50, "http://h.org/news/50", "<article>Menu</article>")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, row int")
    for parts in (1, 7):
        got = sorted((r["page_id"], r["text"]) for r in html_text.main_text(df.repartition(parts)).collect())
        want = [(i, f"Story {i}") for i in range(10, 30)] + [(90, "Ware"), (91, "More"), (95, "Menu\nAlone"), (96, ""), (96, ""), (97, "")]
        assert got == sorted(want + [(98, "Same"), (99, "Same"), (50, "Menu")])
    assert html_text.main_text(df.limit(0)).collect() == []


def test_nearest_is_the_longest_common_path(spark):
    draw = random.Random(4)
    rows = [("h" + draw.choice("12"), "".join(draw.choice("ab/") for _ in range(draw.randrange(8))), i) for i in range(60)]
    got = dict(map(tuple, html_text.nearest_pages(spark.createDataFrame(rows, "host string, path string, row long").repartition(5)).collect()))

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    for host, path, row in rows:
        best = max(common(path, p) for h, p, r in rows if h == host and r != row)
        partner = rows[got[row]]
        assert partner[0] == host and common(path, partner[1]) == best and got[row] != row


@pytest.mark.parametrize(
    "source",
    ["x<a " * 250_000, "<!" * 500_000, '<a "' * 250_000, "<a '\">" * 150_000, "<a" * 500_000, "<a \"'" * 250_000 + ">", "<div>" * 80_000 + "</p></section>" * 80_000],
)
def test_broken_pages_take_time_in_proportion(source):
    begun = time.perf_counter()
    html_text.page_lines(source)
    assert time.perf_counter() - begun < 20  # hours, if each tag looked through the rest of the page


def test_long_pages_are_aligned_in_little_memory():
    a, b = [str(i % 5000) for i in range(40_000)], [str(i * 7 % 6001) for i in range(40_000)]
    tracemalloc.start()
    marks = html_text.shared_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    shared, rest = [x for x, m in zip(a, marks) if m], iter(b)
    assert len(shared) > 5_000 and all(x in rest for x in shared) and peak < 60_000_000


def test_a_teaser_does_not_displace_the_text(spark):
    story = "<main><p>A story of some length.</p><p>It goes on.</p><article>Teaser</article></main>"
    article = "<main><article><p>A story of some length.</p></article><p>Next</p></main>"
    outside = "<p>Some words of the page around it</p><article>Short</article>"
    df = spark.createDataFrame([(1, "http://a/1", story), (2, "http://a/2", article), (3, "http://a/3", outside)], "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got == {1: "A story of some length.\nIt goes on.\nTeaser", 2: "A story of some length.", 3: "Short"}


def test_every_page_is_paired_and_aligned(spark):
    """Marked pages too: their lines meet those of the nearest page, furniture included."""
    pages = load(spark, f"{DATA}/sf0.01", "pages")
    prints = html_text._prints(html_text._keyed(pages, "page_id", "url", "html"), "url", "html").localCheckpoint()
    got = html_text.aligned(prints).collect()
    hosts = {r["row"]: r["host"] for r in prints.collect()}
    alone = {h for h in hosts.values() if list(hosts.values()).count(h) == 1}
    assert len(got) == pages.count() == len(hosts) and len(alone) < len(got) // 2
    assert all((r["partner"] is None) == (hosts[r["row"]] in alone) for r in got)
    assert all(r["partner"] is None or hosts[r["partner"]] == hosts[r["row"]] for r in got)
    plan = html_text.main_text(pages)._jdf.queryExecution().toString()
    assert "kept" in plan and "SortMergeJoin" in plan


def test_the_nearest_page_may_be_one_that_names_its_article(spark):
    """Its menu goes from a page without marks; what it names as its article does not."""
    marked = "<nav>Home</nav><nav>Shop</nav><article><h1>Story</h1><p>First part.</p><p>Last part.</p></article><footer>(c)</footer>"
    bare = "<div>Home</div><div>Shop</div><p>Story</p><p>First part.</p><p>Last part.</p><p>Printed today</p><div>(c)</div>"
    rows = [(1, "http://h.org/news/1", marked), (2, "http://h.org/news/1/print", bare), (2, "http://h.org/news/1/print", bare)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in html_text.main_text(df).collect())
    story = "Story\nFirst part.\nLast part."
    assert got == [(1, story), (2, story + "\nPrinted today"), (2, story + "\nPrinted today")]


def test_kept_lines():
    def prints(*marked):
        return html_text.line_prints([(html_text._PROTECTED if t.isupper() else html_text._DROPPED if t.startswith("-") else html_text._ASKED, t.strip("-").lower()) for t in marked])

    def kept(own, other):
        return html_text.kept_lines(prints(*own), prints(*other)).tolist()

    assert kept(["menu", "a", "end"], ["menu", "b", "end"]) == [False, True, False]
    assert kept(["menu", "-x", "a"], ["-menu", "-y", "A"]) == [False, True]
    assert kept(["-menu", "A", "B"], ["-menu", "A", "C"]) == [True, True]
    assert kept(["-m", "a", "b"], ["-n", "a", "b"]) == [True, True]
    assert kept(["a", "-b"], []) == [True] and kept([], ["a"]) == []
