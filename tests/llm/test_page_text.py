import random
import re
import time
from collections import Counter

import pytest

from tallyjoin.llm import page_text as pt

PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a>Menu</a></nav><article><h1>Head &amp; more</h1><p><b>One\n two<br>three<p>Four&nbsp;five</article><footer>f</footer>", "Head & more\nOne two three\nFour five"),
    ("<article><p>a</p><div class='comments'><article class=comment><p>no</p></article></div><p>b</p></article>", "a\nb"),
    ("<article class='post has-sidebar'><p>a<script>if (a < b) { x('</p></article>') }</script> c</p><aside>no</aside><form>no</form></article>", "a c"),
    ("<main><p>m</p><div id=\"newsletter\">no<div>no</div></div><div class='ad'>no</div></main><p>out</p>", "m"),
    ("<article><table><tr><td>x<td>y<tr><td>z</table><ul><li>1<li>2</ul><p>1 &lt; 2 < 3</article", "x y\nz\n1\n2\n1 < 2 < 3"),
    ("<article><header><h1>Title</h1></header><p>t</p><footer>by</footer></article>", "Title\nt"),
    ("<article><!-- <p>no</p> --><p>a<!-- unclosed", "a"),
    ("<article></article><p>x</p>", "x"),
    ("<article><p>He wrote a <span class=\"notice\">short</span> book, see <a class=\"related\">the sequel</a> now.</p></article>", "He wrote a short book, see the sequel now."),
    ("<article><p>Read <button>Share <b>it</b></button>on <select><option>no</select>here</p></article>", "Read on here"),
    ("<article><p>a <a href=\"x>y</a> b</p><p>1 < 2 <b c='<'>d</b></p></article>", "a y b\n1 < 2 d"),
    ("plain text", "plain text"),
    ("", ""),
    (None, ""),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, host int")


def test_structure(spark):
    rows = [(i, f"http://h{i}.org/x", h) for i, (h, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0]), (None, "not a url", PAGES[1][0])]
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in pt.extract(frame(spark, rows)).collect())
    want = [str(i) for i in range(len(PAGES))] + ["0", "None"]
    texts = [t for _, t in PAGES] + [PAGES[0][1], PAGES[1][1]]
    assert got == sorted((i, t, len(t)) for i, t in zip(want, texts, strict=True))


MENU = "Home News About Contact Help Terms Privacy Jobs Press"


def page(own, menu=MENU):
    return f"<body><div>{menu}</div><div>{own}</div><p>All rights are reserved by the people of this host</p></body>"


def brute(rows):
    """The texts of (url, html) by looking at every run of every page of a host."""
    parsed = [pt.blocks_of(h or "") for _, h in rows]
    hosts = [re.match(r"(?:[a-z]+:)?//([^/?#]*)|", u or "")[1] or "" for u, _ in rows]
    streams = [tuple(w for _, t in p for w in [*t.split(), "\n"]) for p in parsed]
    out = []
    for mine, host, stream in zip(parsed, hosts, streams, strict=True):
        others = {s for s, h in zip(streams, hosts, strict=True) if h == host}
        held = Counter(run for s in others for run in {s[i : i + 8] for i in range(len(s) - 7)})
        repeated, often = set(), set()
        for i in range(len(stream) - 7):
            n = held[stream[i : i + 8]]
            repeated |= set(range(i, i + 8)) if n > 1 else set()
            often |= set(range(i, i + 8)) if n >= max(5, len(others) / 2) else set()
        best = next((z for z in ("article", "main") if any(zone == z for zone, _ in mine)), "other")
        at, kept, gone, size = 0, [], 0, 0
        for zone, text in mine:
            words = text.split()
            places = range(at, at + len(words))
            at += len(words) + 1
            if zone == best == "other":
                kept.append((" ".join(w for w, i in zip(words, places, strict=True) if i not in repeated), False))
            elif zone == best:
                kept.append((text, all(i in often for i in places)))
                size, gone = size + len(words), gone + len(words) * kept[-1][1]
        out.append("\n".join(t for t, hidden in kept if t and (not hidden or 2 * gone > size)))
    return out


APPEAL = "Please support this newspaper with a gift so that it can go on"


def site(rnd):
    """Pages of three hosts: with articles that hold an appeal without a name, quotations and near copies, and without articles."""
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    quote, rows = say(30), []
    for i in range(60):
        body = f"<p>{say(40)}</p><p>{APPEAL}</p>" + f"<blockquote>{quote}</blockquote>" * (i % 9 == 0) + f"<p>{say(3)}</p>"
        rows.append((f"http://news.org/{i}", f"<nav>{MENU}</nav><article>{body}</article><footer>{say(4)}</footer>"))
    rows += [("http://news.org/copy", rows[5][1].replace("</article>", f"<p>{say(1)}</p></article>")), ("http://news.org/5", rows[5][1])]
    rows += [(f"http://plain.org/{i}", page(say(9 + i % 3))) for i in range(60)]
    text = say(60)
    return rows + [(f"http://copies.org/{i}", f"<main><p>{text}</p><p>{say(2)}</p></main>") for i in range(20)] + [(None, page(say(9)))]


@pytest.mark.parametrize(("chars", "few"), [(4 << 20, 200_000), (6000, 200_000), (6000, 0)])
def test_texts_against_every_run_of_every_page(spark, monkeypatch, chars, few):
    """Also where hosts are dealt out in shards, so that only the join finds what repeats, and where nothing is broadcast."""
    monkeypatch.setattr(pt, "SHARD_CHARS", chars)
    monkeypatch.setattr(pt, "BROADCAST_ROWS", few)
    rows = site(random.Random(4))
    got = {r.page_id: r.text for r in pt.extract(frame(spark, [(i, *r) for i, r in enumerate(rows)])).collect()}
    want = brute(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert not any(APPEAL in t for t in want[:60]) and any(APPEAL in h for _, h in rows[:60])  # the array's work alone
    assert not any(MENU in t for t in want[62:122]) and MENU in want[-1]


def thin_site(rnd):
    """Two hosts whose runs stand about once in a shard: appeals in about half of the articles, or in five of nine, and pages
    without an article that quote a single one."""
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    rows = []
    for host, n, least, most in (("half.org", 40, 15, 29), ("few.org", 9, 3, 7)):
        appeals = [(say(12), set(rnd.sample(range(n), rnd.randrange(least, most)))) for _ in range(24)]
        own = [say(400) for _ in range(n)]
        rows += [(f"http://{host}/{i}", f"<article><p>{own[i]}</p>" + "".join(f"<p>{a}</p>" for a, on in appeals if i in on) + "</article>") for i in range(n)]
        rows += [(f"http://{host}/list{i}", f"<div>{say(9)} {own[i][:90]} {say(9)}</div>") for i in range(6)]
    return rows


@pytest.mark.parametrize(("chars", "few"), [(30_000, 200_000), (9000, 200_000), (9000, 800), (3000, 0)])
def test_texts_dont_depend_on_the_shards(spark, monkeypatch, chars, few):
    monkeypatch.setattr(pt, "SHARD_CHARS", chars)
    monkeypatch.setattr(pt, "BROADCAST_ROWS", few)
    rows = thin_site(random.Random(3))
    got = {r.page_id: r.text for r in pt.extract(frame(spark, [(i, *r) for i, r in enumerate(rows)])).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows)


@pytest.mark.parametrize("chars", [4 << 20, 200])
def test_boilerplate_repeated_on_a_host_goes(spark, monkeypatch, chars):
    """Also where each page is in a shard of its own."""
    monkeypatch.setattr(pt, "SHARD_CHARS", chars)
    own = [" ".join(f"word{k}of{i}" for k in range(9)) for i in range(12)]
    rows = [(i, f"http://Host.org/{i}", page(own[i])) for i in range(12)]
    rows += [(50, "http://host.org/copy", rows[0][2]), (51, "http://other.org/", page("Alone here"))]
    got = {r.page_id: r.text for r in pt.extract(frame(spark, rows)).collect()}
    assert all(got[i] == own[i] for i in range(12)) and got[50] == got[0]
    assert got[51] == f"{MENU}\nAlone here\nAll rights are reserved by the people of this host"


@pytest.mark.parametrize("piece", ["<a href=\"x", "<b\"", "<div>", "</b><p>", "<a '\"", "<", "<!--", "<a <a ", "<p>x", "&amp;", "<script>"])
def test_very_long_pages_take_linear_time(piece):
    began = time.perf_counter()
    pt.blocks_of("<article>" + piece * (1_000_000 // len(piece)) + "</b>" * 1000)
    assert time.perf_counter() - began < 20


def test_equal_pages_dont_delete_each_other(spark):
    rows = [(i, "http://h.org/", page("The same long words stand on both of these pages")) for i in range(3)]
    assert all("The same long words" in r.text for r in pt.extract(frame(spark, rows)).collect())


def test_articles_keep_what_they_share(spark):
    rows = [(i, "http://h.org/", f"<article><p>A passage of many words that all of these articles share</p><p>{i}</p></article>") for i in range(3)]
    assert all(r.text.startswith("A passage of many words that all of these articles share\n") and r.n_chars == len(r.text) for r in pt.extract(frame(spark, rows)).collect())


def test_runs_by_comparing_all():
    rnd = random.Random(0)
    for _ in range(20):
        streams = [[rnd.choice("ab") for _ in range(rnd.randrange(40))] for _ in range(rnd.randrange(7))]
        arrays = pt.Arrays(streams)
        want = Counter(r for s in streams for r in {tuple(s[i : i + 8]) for i in range(len(s) - 7)})
        assert sorted(arrays.pages().tolist()) == sorted(want.values()) and len(set(arrays.hashes().tolist())) == len(want)
        mask = [any(want[tuple(s[j : j + 8])] > 1 for j in range(max(0, i - 7), min(i, len(s) - 8) + 1)) for s in streams for i in range(len(s) + 1)]
        assert arrays.covered(arrays.pages() > 1).tolist() == mask


def test_empty(spark):
    assert pt.extract(frame(spark, [])).collect() == []
