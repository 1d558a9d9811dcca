"""Long texts full of tags, spans and open elements take time in proportion to their length, and templates work inside marked contents."""

import time

import numpy as np
import pytest

from tallywright.llm import licenses, pages, pii, quality

CASES = {
    "tags": (licenses.scan, lambda n: " AND ".join(["spdx-license-identifier:mit"] * n), 15_000),
    "parentheses": (licenses.scan, lambda n: "spdx-license-identifier:" + "(" * n, 300_000),
    "mails": (lambda t: pii.all_spans(t, pii.Field({}, np.zeros((0, len(pii.KINDS))), np.zeros((len(pii.KINDS) + 1, len(pii.KINDS) + 1)))), lambda n: " ".join(f"mail{k}@example{k}.org or 10.1.2.{k % 250}" for k in range(n)), 3000),
    "stray inline ends": (pages.main_text, lambda n: "<b>" * n + "</i>" * n, 30_000),
    "ends behind a cell": (pages.main_text, lambda n: "<i><td>" + "<b>" * n + "</i>" * n, 30_000),
    "rules in open inline elements": (pages.main_text, lambda n: "<b>" * n + "<hr>" * n, 30_000),
    "closed inline elements": (pages.main_text, lambda n: "<b/>" * n, 30_000),
    "headers in headers": (pages.main_text, lambda n: "<article>" + "<header>" * n + "<h1>x", 30_000),
    "boxes in boxes": (pages.main_text, lambda n: "<article>" + "<div>x" * n, 20_000),
}


@pytest.mark.parametrize("case", CASES)
def test_time_follows_length(case):
    work, make, n = CASES[case]
    took = []
    for size in (n, 4 * n):
        text = make(size)
        best = []
        for _ in range(2):
            begin = time.process_time()
            work(text)
            best.append(time.process_time() - begin)
        took.append(min(best))
    assert took[1] < 9 * max(took[0], 0.02), took  # 4 in proportion, 16 squared


@pytest.mark.parametrize(
    ("expression", "labels"),
    [
        ("EPL-2.0 OR Unlicense", "epl,unlicense"),
        ("Zlib AND CDDL-1.0", "cddl,zlib"),
        ("(EUPL-1.2 OR BSL-1.0) AND Artistic-2.0", "artistic,bsl,eupl"),
        ("GPL-2.0+ WITH Classpath-exception-2.0", "gpl"),
        ("0BSD or AGPL-3.0-or-later", "agpl,bsd"),
        ("CC-BY-NC-4.0", "cc-by,cc-by-nc"),
        ("plain words that are no licence", ""),
    ],
)
def test_families_of_the_public_list(expression, labels):
    assert licenses.scan(f"SPDX-License-Identifier: {expression}")[5] == labels


def test_an_expression_ends_at_the_next_tag():
    row = licenses.scan("SPDX-License-Identifier: MIT AND SPDX-License-Identifier: GPL-2.0")
    assert row[5] == "gpl,mit" and row[7] == 2 and row[8] is False


def texts(spark, bodies):
    rows = [(i, f"https://h.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_boxes_that_recur_inside_articles_go(spark):
    """A share bar without a telling name is template; a paragraph, a heading and a cell that recur as often stay, and so does a box of one page."""
    letters = "abcdefghijkl"
    bodies = [f"<article><h2>Summary</h2><div class='x7'>Send this on <a>now</a></div><p>Own {c}</p><p>See the next page.</p><table><tr><td>7</td></tr></table><div>Box {c}</div><ul><li>Latest</li><li>Popular</li></ul></article>" for c in letters]
    got = texts(spark, bodies)
    assert got[2] == "Summary Own c See the next page. 7 Box c"
    assert pages.main_text(bodies[2]) == "Summary Send this on now Own c See the next page. 7 Box c Latest Popular"


def test_boxes_beside_articles_do_not_count_inside(spark):
    bodies = [f"<div>Site slogan</div><article><p>Own {c}</p></article>" for c in "abcdefghijkl"] + ["<article><div>Site slogan</div><p>About it</p></article>"]
    assert texts(spark, bodies)[12] == "Site slogan About it"


def test_sampled_rows_are_packed():
    """Rows of any length come back as they were, in at most 32 kilobytes."""
    rng = np.random.default_rng(0)
    for n in (0, 1, 100, 8191, 8192, 200_000, 1 << quality.BITS):
        places = rng.permutation(1 << quality.BITS)[:n]
        packed = quality.Packed.pack(places)
        assert len(packed) <= (1 << quality.BITS) // 8 and sorted(quality.Packed([packed])[0].tolist()) == sorted(places.tolist())
