import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import host_suffixes as H
from tideline.llm import page_blocks as B

PAGE = """<!DOCTYPE html><html class="no-sidebar"><head><title>Not text</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body><header class="site"><a href="/">Home of all</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies</div>
<main><div id="ad-1">Buy now</div><article class="post"><header><h1>Title &amp;  more</h1></header><p>First&nbsp;line<br>goes   on &#8211; here<p>Second <b>bold</b><i>er</i> text &lt;b&gt;
<!-- hidden --><form><input value="x">Sign up</form><ul><li>point a</li><li>point b</li></ul><aside>See also</aside><script>x</script>
<div class="comments"><p>I like it</p></div><p hidden>Not seen</p></article><section>Around</section></main><footer>&copy; us</footer></body></html>"""


def test_article_of_a_full_page(spark):
    df = spark.createDataFrame([(1, "http://a.example/x", PAGE)], "page_id long, url string, html string")
    row = H.main_texts(df).first()
    assert row["text"] == "Title & more\nFirst line goes on – here\nSecond bolder text <b>\npoint a\npoint b"
    assert row["n_chars"] == len(row["text"])


def site(n):
    """Pages without an article element: the same unnamed box on all, other text on each."""
    box = "this box of many words stands on every page of the site and says nothing"
    return [(i, "http://b.example/%d" % i, f"<body><div>{box}</div><p>page {i} has its own words {' '.join(f'u{i}x{j}' for j in range(12))}</p></body>") for i in range(n)]


def test_repeats_go_and_unique_runs_stay(spark):
    rows = [*site(6), (90, "http://c.example/1", site(1)[0][2]), (91, "http://b.example/91", site(1)[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part in (1_000_000, 60):  # a host in one part, and in many
        out = {r["page_id"]: r for r in H.main_texts(df, part_tokens=part).collect()}
        assert len(out) == len(rows)
        assert all(out[i]["text"].startswith(f"page {i} has its own words") and out[i]["n_repeated"] > 0 for i in range(6))
        assert out[90]["text"].startswith("this box") and out[91]["text"] == out[0]["text"]
    few = H.main_texts(df.where("page_id < 2")).collect()
    assert all(r["text"].startswith("this box") for r in few)  # two pages are too few


def test_near_copies_on_a_large_host_keep_their_text(spark):
    rows = site(60)
    said = "an article that was published as three near copies keeps all of its many words"
    rows += [(100 + i, f"http://b.example/c{i}", rows[0][2].split("<p>")[0] + f"<p>{said}</p><p>date {i}</p></body>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for part in (1_000_000, 300):
        out = {r["page_id"]: r["text"] for r in H.main_texts(df, part_tokens=part).collect()}
        assert [out[100 + i] for i in range(3)] == [f"{said}\ndate {i}" for i in range(3)]
        assert all(out[i].startswith(f"page {i} has its own words") for i in range(60))


NOTICE = "we use small files on your device to remember what you like and to count our readers"
TEASER = "how the long bridge over the wide river was built again in only nine months"


def news(n):
    """Articles, the later ones with the site's notice among their paragraphs, the earlier ones with it beside them."""
    out = []
    for i in range(n):
        own = [f"story {i} part {j} " + " ".join(f"w{i}x{j}x{k}" for k in range(10)) for j in range(3)]
        shared = "a sentence that the editors put into all their stories and that is their text"
        told = [own[0], NOTICE, "All accepted", own[1], shared, own[2]] if 3 * i >= 2 * n else [own[0], own[1], shared, own[2]]
        beside = "" if 3 * i >= 2 * n else f"<div class='cookie-notice'><p>{NOTICE}</p><p>All accepted</p></div>"
        menu = f"<aside><a>{TEASER}</a></aside>"
        html = f"<body>{menu}{beside}<article>{''.join(f'<p>{t}</p>' for t in told)}</article></body>"
        out.append((i, f"http://n.example/{i}", html, "\n".join(t for t in told if t not in (NOTICE, "All accepted"))))
    return out


def test_boilerplate_within_articles_goes_and_article_text_stays(spark):
    rows = news(12)
    # The article that the menus tell of, on its own page and on a near copy; another host has the notice in articles alone.
    for i in (50, 51):
        rows.append((i, f"http://n.example/{i}", f"<body><article><h1>{TEASER}</h1><p>the bridge itself</p></article><p>{i}</p></body>", f"{TEASER}\nthe bridge itself"))
    rows += [(60 + i, f"http://o.example/{i}", f"<article><p>other {i}</p><p>{NOTICE}</p><p>end {i}</p></article>", f"other {i}\n{NOTICE}\nend {i}") for i in range(6)]
    rows.append(rows[11])
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    for part in (1_000_000, 100):
        out = H.main_texts(df, part_tokens=part).collect()
        assert sorted((r["page_id"], r["text"]) for r in out) == sorted((r[0], r[3]) for r in rows)
        repeated = {r["page_id"]: r["n_repeated"] for r in out}
        assert repeated[11] >= len(NOTICE.split()) and repeated[60] == 0


@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_suffix_array_matches_brute_force(raw):
    streams = [np.array(s, np.uint64) for s in raw]
    prints, pages, _ = B.repeated_prefixes(streams, 4)
    want = {}
    for i, s in enumerate(raw):
        for p in range(len(s) - 3):
            want.setdefault(tuple(s[p : p + 4]), set()).add(i)
    assert sorted(pages.tolist()) == sorted(len(v) for v in want.values()) and len(set(prints.tolist())) == len(want)
    often = np.sort(prints[pages >= 2])
    for s in raw:
        hit = [any(p <= i < p + 4 and len(want[tuple(s[p : p + 4])]) >= 2 for p in range(len(s) - 3)) for i in range(len(s))]
        assert B.covered(np.array(s, np.uint64), often, 4).tolist() == hit


def test_suffix_array_is_sorted():
    streams = [np.array(s, np.uint64) for s in ([1, 2, 3, 1, 2], [2, 3, 1, 2, 9], [1, 2, 3])]
    order, rank, owner = B.prefix_ranks(streams, 8)
    assert np.all(np.diff(rank[order]) >= 0) and len(order) == sum(len(s) + 1 for s in streams) and len(np.unique(owner)) == 3


def test_edges(spark):
    long = "<article><p>" + "word &amp; " * 200_000 + "</p></article>"
    rows = [
        (1, None, None, "x"), (2, "::bad[url", "", "x"), (2, "::bad[url", "", "x"), (3, "http://a/", "plain < text & more", "x"), (4, "http://a/", "<p", "x"), (None, "http://a/", "<div><!-- open", "x"),
        (5, "http://a/", long, None), (6, "http://a/", "<article><p>a</div></p></span>b<table><tr><td>c<td>d</table>", "x"), (7, "http://a/", "<p a=\"x>y\" b='>'>ok" + "\"" * 5000, "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    out = H.main_texts(df).collect()
    by = {r["page_id"]: r for r in out}
    assert len(out) == len(rows)
    assert by[1]["text"] == "" and by[2]["text"] == "" and by[None]["text"] == "" and by[3]["text"] == "plain < text & more"
    assert by[5]["n_chars"] == 200_000 * 7 - 1 and by[6]["text"] == "a\nb\nc\nd" and by[7]["text"].startswith("ok")
    assert H.main_texts(df.limit(0)).count() == 0


def test_given_pages_are_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in H.main_texts(pages).collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(p for p in parts if p)


def test_articles_in_forms_and_layouts_are_found():
    """Where no article has text otherwise, a form or a layout's name around one does not hide it; comments still do."""
    main = lambda page: [said for zone, said in B.blocks(page) if zone == B.MAIN]
    for page in (
        '<form id="aspnetForm"><article><p>one two</p></article></form>', '<div class="layout sidebar-right"><article>one two</article></div>',
        '<div id="widget-area-main"><main>one two</main></div>', '<body><form><div class="nav-left"><main><p>one <math>two</math></p></main></div></form></body>',
    ):
        assert main(page) == ["one two"], page
    assert main('<div class="comments"><article>said a reader</article></div><p>text</p>') == []
    assert main('<form><article>in a form</article></form><article>the article</article>') == ["the article"]


def test_names_within_an_article_count_as_a_whole():
    kept = '<p class="share-price">a</p><div class="ad-hoc">b</div><p class="notice-of-intent">c</p><table class="related-work"><tr><td>d</td></tr></table>'
    gone = '<div class="share-buttons">e</div><div class="related">f</div><div id="ad-slot-3">g</div><section class="post-comments"><article>h</article></section>'
    found = B.blocks(f"<article>{kept}{gone}<p>end</p></article>")
    assert [said for zone, said in found if zone == B.MAIN] == ["a", "b", "c", "d", "end"]
