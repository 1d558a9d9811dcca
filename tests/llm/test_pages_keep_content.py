"""Main content that pages of a host have in common only in form, or as copies, stays."""

from tallywright.llm import pages


def texts(spark, bodies):
    rows = [(i, f"https://h.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_numbers_of_articles_stay(spark):
    got = texts(spark, [f"<div class='x'>Page 1{i}</div><article><p>Alpha {'abcdefghijkl'[i]}</p><table><tr><td>{100 + i}</td><td>{7 * i}</td></tr></table></article>" for i in range(12)])
    assert got[3] == "Alpha d 103 21" and got[11] == "Alpha l 111 77"


def test_copies_without_an_article_stay(spark):
    bodies = [f"<div>Site slogan</div><p>Own text {'abcdefghijklmnopqrst'[i]}</p>" for i in range(20)]
    bodies += ["<div>Site slogan</div><p>A copied page</p><p>of two paragraphs</p>"] * 10
    bodies += ["<main><p>Copied main</p></main>"] * 9
    got = texts(spark, bodies)
    assert got[0] == "Own text a" and got[25] == "A copied page of two paragraphs" and got[35] == "Copied main"


def test_copies_on_most_pages_of_a_host_stay(spark):
    got = texts(spark, ["<article><p>One text</p><p>on all pages</p></article>"] * 20 + [f"<article><p>Other {'abcd'[i]}</p></article>" for i in range(4)])
    assert got[0] == "One text on all pages" and got[20] == "Other a"


def test_headings_and_cells_of_articles_stay(spark):
    got = texts(spark, [f"<article><h2>Introduction</h2><p>Own {'abcdefghijkl'[i]}</p><td>7</td></article>" for i in range(12)] + ["<article><p>One article</p></article>"] * 9)
    assert got[0] == "Introduction Own a 7" and got[15] == "One article"


def test_templates_of_plain_pages_go_and_only_those(spark):
    """Pages of <div>s alone: what recurs over the host's different contents goes, at any depth; what is each page's own stays."""
    frame = "<div><div>Site slogan</div><ul><li>Home</li><li>About</li></ul></div><div><h1>Title {0}</h1><p>Body {0} &amp; more</p><div>Follow us</div></div><div>All rights, 2024</div>"
    bodies = [frame.format("abcdefghijklmnopqrst"[i]) for i in range(20)] + ["<div>Lone page</div>"]
    got = texts(spark, bodies)
    assert got[2] == "Title c Body c & more" and got[20] == "Lone page"
    assert pages.main_text(f"<body>{bodies[2]}</body>") == "Site slogan Home About Title c Body c & more Follow us All rights, 2024"


def test_templates_need_different_contents(spark):
    rows = [(i, f"https://h.example/{i}", "<div>Slogan</div><p>same</p>") for i in range(30)] + [(40 + i, "https://two.example/", f"<div>Slogan</div><p>{i}</p>") for i in range(7)]
    rows += [(60 + i, "https://three.example/", f"<div>Slogan</div><article>x{i}</article>") for i in range(9)] + [(80, "https://three.example/", "<div>Slogan</div><p>plain</p>")]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Slogan same" and got[42] == "Slogan 2" and got[80] == "plain" and got[61] == "x1"


def test_names_that_tell_nothing_stay():
    kept = ["<div class='social-history'>k</div>", "<p class='notice-of-intent'>k</p>", "<label>k</label>", "<object>k</object>", "<p class='comments-on-method'>k</p>", "<span class='ad-hoc'>k</span>", "<div/>k", "<nav/>k"]
    lost = ["<div class='cookie-notice'>x</div>", "<div class='reader-comments'>x</div>", "<section id='comment-list'>x</section>", "<p class='ad'>x</p>", "<div role='search'>x</div>", "<button>x</button>", "<menu>x</menu>"]
    for body in kept:
        assert pages.main_text(f"<article>a {body}</article>").split() == ["a", "k"], body
    for body in lost:
        assert pages.main_text(f"<article>a {body}</article>") == "a", body


def test_references_are_decoded_text_by_text():
    assert pages.main_text("<article>&am<b>p;lt;</b></article>") == "&amp;lt;"
    assert pages.main_text("<article>&lt;b&gt; &amp;amp;</article>") == "<b> &amp;"


def test_whole_table_is_the_same_page_by_page(spark):
    """What Spark gives equals the templates counted plainly and applied to each page alone; long, repeated and odd rows among them."""
    bodies = ["<div>Slogan</div>" * (i % 3) + f"<p>t {i % 11}</p>" + "<article>a</article>" * (i % 5 == 0) for i in range(60)] + [None, "", "<div>" * 5000 + "deep", "x" * 300_000]
    rows = [(i if i % 9 else None, None if i % 13 == 0 else f"http://{'ab'[i % 2]}.example/{i % 4}", b, "clash", "clash") for i, b in enumerate([*bodies, *bodies[:7]])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")
    seen = {}
    for _, url, html, *_ in rows:
        key, _, marks = pages.page_parts(html)
        seen.setdefault(url.split("/")[2] if url else "", {}).setdefault(key, []).append({h for h, _, _ in marks})
    template = {}
    for host, contents in seen.items():
        counts = {}
        for group in contents.values():
            for h in min(group, key=sorted):
                counts[h] = counts.get(h, 0) + 1
        template[host] = {h for h, n in counts.items() if n >= pages.MIN_PAGES and n >= pages.MIN_SHARE * len(contents)}
    want = sorted(map(repr, ((i, url, pages.main_text(html, template[url.split("/")[2] if url else ""])) for i, url, html, *_ in rows)))
    got = pages.extract_pages(df).collect()
    assert sorted(repr((r["page_id"], r["url"], r["text"])) for r in got) == want and all(r["n_chars"] == len(r["text"]) for r in got)
