"""HTML extraction: cases, runs against a plain search, hosts in parts, hostile pages."""

import random
import time
from collections import defaultdict

import pytest

from keyloom.llm import html_text

def page(body, head="<title>T</title><script>var t='</p><article>x</article>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}"


MENU = "<nav><ul><li><a href='/a'>Home</a><li><a>About</a></ul></nav>"
CASES = [
    (page(MENU + "<article><h1>A &amp; B</h1><p>One\n  two<b>three<br>four<p>five</article><footer>&copy; x</footer></body></html>"), "A & B\nOne twothree\nfour\nfive"),
    (page('<header>Site</header><div class="ad">Buy<article><header><h1>Title</h1></header><p>Text</p><aside>see</aside><form>f<input></form><div class="comments"><p>me too</p></div></article>'), "Title\nText"),
    (page("<div class='page-header'><h1>Site</h1></div><article><div class='entry-header'><h1>T</h1></div><div class='alert'>!</div><p>x</article>"), "T\nx"),
    (page("<main><p>a<!-- b --><style>c</style>d</p><div id='cookie-notice'>e</div><p hidden>f</p></main><p>outside</p>"), "ad"),
    (page("<div class='sidebar'>s</div><p>no article &lt;here&gt;</p><noscript>n</noscript>"), "no article <here>"),
    (page("<article><p>1 < 2 and <i>3</i></p></section></div><p>end"), "1 < 2 and 3\nend"),
    ("<article><p class='ad-free'>kept? yes", "kept? yes"),
    ("plain text\n only", "plain text only"),
    ("<article><textarea>x</textarea><table><tr><td>a<td>b</table><select><option>o</select></article>", "a\nb"),
    ("<article class='post category-social tag-search'><p>x<p class='legal-analysis'>y</p><p id=share-price>z</p><p class='socialPolicy'>u", "x\ny\nz\nu"),
    ("<article><p>a</p><div class='relatedPosts'>b</div><div class='share-buttons'>c</div><div class='user-comments'>d</div><article class='comment'>e</article><p>f</article>", "a\nf"),
    ("<article><p>Press <button>OK</button> or <math><mi>x</mi></math> <label>now</label>.</p><button>Share</button><p class='related-work'><a href=x>one</a> <a href=y>two</a></p>", "Press OK or x now."),
    ("<article><p title='a > b' class=x o'clock>It's <b data-x=\"1<2\">so</b></p><p>&#99999999999999999999; &#x41;&amp</article>", "It's so\n\ufffd A&"),
    ("", ""),
    (None, ""),
    ("<<<>>><a", "<<<>>>"),
]


def test_html_cases(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.example/x", h) for i, (h, _) in enumerate(CASES)], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert out == {i: t for i, (_, t) in enumerate(CASES)}


def some_pages(rng, n, words=10_000):
    """Blocks and flags: shared openings, notices in and out of articles, short lines."""
    text = lambda k: " ".join(f"w{rng.randrange(words)}" for _ in range(k))
    shared = [text(rng.choice([3, 16, 17, 25, 60, 120])) for _ in range(12)]
    pages = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            b = rng.choice(shared) if rng.random() < 0.5 else text(rng.choice([1, 5, 16, 17, 40, 90]))
            if rng.random() < 0.2:
                b += " " + text(rng.randint(1, 30))
            parts.append((b, rng.choice([0, 0, 1, 1, 1, 2, 3])))
        pages.append(([b for b, _ in parts], bytes(f for _, f in parts)))
    return pages + pages[: n // 5]


def sampled_places(pages, s):
    """For each block the places of its sampled suffixes: the first, the last, and what a hash of the tokens picks."""
    places = defaultdict(set)
    for b, p in zip(s.block.tolist(), s.place.tolist(), strict=True):
        places[b].add(p)
    k, picked, passed = 0, set(), set()
    for texts, _ in pages:
        for t in texts:
            w = t.split(" ")
            last = max(len(w) - html_text.RUN_TOKENS, 0)
            assert {0, last} <= places[k] <= set(range(last + 1))
            for i in range(1, last):
                (picked if i in places[k] else passed).add(tuple(w[i : i + html_text.RUN_TOKENS]))
            k += 1
    assert not picked & passed  # the same everywhere
    return places


def plain_repeats(pages, places):
    """Runs on RUN_PAGES distinct pages, by their tokens, and those outside an article."""
    on, outside, k = defaultdict(set), set(), 0
    for texts, flags in pages:
        for b, f in zip(texts, flags, strict=True):
            w = b.split(" ")
            for i in places[k]:
                run = tuple(w[i : i + html_text.RUN_TOKENS])
                on[run].add("\n".join(texts))
                if not f & 1:
                    outside.add(run)
            k += 1
    often = {r for r, p in on.items() if len(p) >= html_text.RUN_PAGES}
    return often, often & outside


def test_runs_against_plain_search():
    rng = random.Random(6)
    for words in (10_000, 3):
        pages = some_pages(rng, 60, words)
        s = html_text.Suffixes(pages)
        often, outside = plain_repeats(pages, sampled_places(pages, s))
        runs, loose = html_text._repeated(*s.repeats())
        tokens = [b.split(" ") for texts, _ in pages for b in texts]
        of = lambda k: tuple(tokens[s.block[k]][s.place[k] : s.place[k] + html_text.RUN_TOKENS])  # noqa: B023,E731
        known = dict(zip(runs.tolist(), loose.tolist(), strict=True))
        for k, run in enumerate(s.run.tolist()):
            assert (run in known) == (of(k) in often) and known.get(run, False) == (of(k) in outside)
        assert words == 3 or len(known) > 10


def test_blocks_that_stay():
    """Against the rule said plainly."""
    rng = random.Random(16)
    pages = some_pages(rng, 80)
    s = html_text.Suffixes(pages)
    places = sampled_places(pages, s)
    often, outside = plain_repeats(pages, places)
    stays = s.kept(*html_text._repeated(*s.repeats())).tolist()
    k, gone = 0, 0
    for texts, flags in pages:
        want = []
        for j, b in enumerate(texts):
            w = b.split(" ")
            runs = [tuple(w[p : p + html_text.RUN_TOKENS]) for p in places[k + j]]
            share = lambda which: sum(r in which for r in runs) / len(runs)  # noqa: B023,E731
            boilerplate = share(often) >= html_text.COVER and (flags[j] != 1 or share(outside) >= html_text.COVER)
            want.append((flags[j] & 1 > 0, not boilerplate))
        if any(a for a, _ in want):
            want = [a and s for a, s in want]
        else:
            want = [s or not any(t for _, t in want) for _, s in want]
        assert stays[k : k + len(texts)] == want
        gone += want.count(False)
        k += len(texts)
    assert gone > 20


def test_boilerplate_of_a_host(spark):
    """Unmarked boilerplate goes; what only articles share stays, also on pages with an article, unless markup hints at it."""
    rng = random.Random(7)
    text = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    legal, quote = text(25), text(25)
    own = [text(40) for _ in range(12)]
    html = [f"<body><p>{legal}</p><p>{t}</p>" for t in own[:6]] + [f"<body><article><p>{quote}</p><p>{t}</p><p class=legal-hint>Some rights</p></article><p>{legal}</p>" for t in own[6:]]
    rows = [(i, "http://site.example/p", h) for i, h in enumerate(html)] + [(100 + i, "http://copies.example", html[0]) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert [out[i] for i in range(6)] == own[:6]
    assert [out[i] for i in range(6, 12)] == [f"{quote}\n{t}" for t in own[6:]]
    assert {out[100 + i] for i in range(5)} == {f"{legal}\n{own[0]}"}  # copies of one page are one page


@pytest.mark.parametrize("broadcast_hosts", [0, 1000])
def test_parts_of_a_host_give_what_the_whole_host_gives(spark, broadcast_hosts):
    """A host of 2,000 pages in one and in some forty parts; a notice on four of its pages and an opening in three articles."""
    rng = random.Random(17)
    text = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    notice, opening, line = text(25), text(25), "Read on our site"
    html = [f"<body><p>{text(20)}</p><p>{line}</p>" + (f"<p>{notice}</p>" if i % 500 == 7 else "") + "</body>" for i in range(1000)]
    html += [f"<body><article><p>{opening if i < 3 else text(9)}</p><p>{text(20)}</p>" + (f"<p>{notice}</p>" if i in (5, 700) else "") + "</article></body>" for i in range(1000)]
    rows = [(i, "http://site.example/p", h) for i, h in enumerate(html + html[:4])] + [(5000 + i, f"http://h{i}.example/", h) for i, h in enumerate([*html[:9], "", "<p>a"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    found = lambda part_bytes: {r["page_id"]: (r["text"], r["repeated_blocks"]) for r in html_text.extract_text(df, part_bytes=part_bytes, broadcast_hosts=broadcast_hosts).collect()}
    whole = found(1 << 40)
    assert not any(notice in t or line in t for i, (t, _) in whole.items() if i < 5000) and sum(opening in t for t, _ in whole.values()) == 3
    assert found(8_000) == whole


@pytest.mark.parametrize("part_bytes", [1 << 40, 500])
def test_every_place_of_a_block_counts(spark, part_bytes):
    """Own words between a shared beginning and a shared end stay; boilerplate goes though each page's begins with its own word."""
    rng = random.Random(18)
    text = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    begin, end, notice = text(16), text(16), text(100)
    own = [f"{begin} {text(8)} {end}\n{text(40)}" for _ in range(6)]
    rows = [(i, "http://site.example/p", "<body><p>" + t.replace("\n", "<p>") + f"<p>Hello{i} {notice}") for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: (r["text"], r["repeated_blocks"]) for r in html_text.extract_text(df, part_bytes=part_bytes).collect()} == {i: (t, 1) for i, t in enumerate(own)}


def test_runs_from_every_place_and_their_anchors():
    """Every run is there, repeats are those of a plain search over all of them, and none of them has an anchor that repeats less."""
    rng = random.Random(19)
    for words in (10_000, 40, 3):
        pages = some_pages(rng, 60, words)
        s = html_text.Suffixes(pages)
        blocks = [b.split(" ") for texts, _ in pages for b in texts]
        places = {k: set(range(max(len(w) - html_text.RUN_TOKENS, 0) + 1)) for k, w in enumerate(blocks)}
        assert sorted(zip(s.block.tolist(), s.place.tolist(), strict=True)) == [(k, i) for k in places for i in sorted(places[k])]
        often, outside = plain_repeats(pages, places)
        runs, loose = html_text._repeated(*s.repeats())
        assert (len(runs), loose.sum()) == (len(often), len(outside))
        of = defaultdict(set)
        for k, i, anchor in zip(s.block.tolist(), s.place.tolist(), s.anchor.tolist(), strict=True):
            of[tuple(blocks[k][i : i + html_text.RUN_TOKENS])].add(anchor)
        assert all(len(a) == 1 for a in of.values())
        assert words < 10_000 or len(s.sparse()[0]) < len(s.run) / 3


def test_html_edges(spark):
    schema = "page_id long, url string, html string, host string, part int, parts int, blocks int, body string, text string"
    rows = [(1, None, "<p>a", "h", 1, 1, 1, "b", "t"), (1, None, "<p>a", "h", 1, 1, 1, "b", "t"), (None, "x", "<article>" + "word " * 100_000, None, None, None, None, None, None)]
    out = html_text.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(len(r["text"]) for r in out) == [1, 1, 499_999]
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0


def test_hostile_pages_take_linear_time():
    n = 1_000_000
    pages = [
        "<a " * (n // 3), "<a x=\"" * (n // 6), "<div>" * (n // 10) + "</b>" * (n // 8), "<b><article>" + "<div>" * (n // 10) + "</b>" * (n // 8), "<!" * (n // 2), "<!--" * (n // 4),
        "<a" + " x=\"<b\"" * (n // 7) + "<", "<script>" * (n // 8), "&" * n, "&#" + "9" * n, "<p " + "a" * n, "<" * n, "<p>" * (n // 3), "='" * (n // 2) + "<p ='>" * 1000, "<article>" * (n // 9) + "</main>" * 9000,
    ]
    for k, html in enumerate(pages):
        began = time.perf_counter()
        html_text.blocks(html)
        assert time.perf_counter() - began < 8, k
