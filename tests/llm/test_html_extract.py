"""Main text of pages whose article is divided."""

import math
import os
import random
import re
import time
from collections import defaultdict

import pytest

from embergrid.llm.html_extract import LEAST, main_text, tag_path_scores, text_nodes

PARTS = [f"Paragraph {i} tells of rain, wind and snow, in turn." for i in range(12)]


@pytest.mark.parametrize("part", ["<section><p>{}</p></section>", "<div>{}</div>", "<div><div><p>{}</p></div></div>"])
def test_divided_text_without_article_is_kept_whole(part):
    page = "<body><div id=c>" + "".join(part.format(p) for p in PARTS) + "</div></body>"
    assert main_text(page) == " ".join(PARTS)


def test_table_layout_and_small_sections_are_kept():
    assert main_text("<body><table>" + "".join(f"<tr><td>{p}</td></tr>" for p in PARTS) + "</table></body>") == " ".join(PARTS)
    sizes = [f"<section><p>{' '.join(PARTS)}</p></section>"] + [f"<section><p>{p}</p></section>" for p in PARTS[:2]]
    assert main_text("<body>" + "".join(sizes) + "</body>") == " ".join(PARTS + PARTS[:2])


def test_small_article_does_not_hide_the_text_around_it():
    page = "<body><div>" + "".join(f"<p>{p}</p>" for p in PARTS) + "</div><article><p>One, more.</p></article></body>"
    assert main_text(page) == " ".join([*PARTS, "One, more."])


@pytest.mark.parametrize("mark", ["class='content has-sidebar'", "class=social", "id=related", "class='legal'", "class=widget", "role=form"])
def test_marked_wrapper_of_the_article_is_read(mark):
    article = "<h1>Head</h1>" + "".join(f"<p>{p}</p>" for p in PARTS)
    want = " ".join(["Head", *PARTS])
    assert main_text(f"<body><div class=menu>Home, about.</div><div {mark}><article>{article}</article></div></body>") == want
    assert main_text(f"<body><form id=page><div class=menu>Home, about.</div><div {mark}>{article}</div></form></body>") == want


def test_marked_sections_are_dropped_whatever_their_length():
    long = "".join(f"<p>{p}</p>" for p in PARTS)
    for around in ("<article>{}</article>", "<div>{}</div>"):
        page = around.format("<h1>Head</h1><p>Short news, once.</p>")
        assert main_text(f"<body><div class=ad>{long}</div>{page}<div id=comments>{long}</div></body>") == "Head Short news, once."
    assert main_text(f"<body><article><p>Short news, once.</p><div class=comments>{long}</div></article></body>") == "Short news, once."


LONG = [f"Paragraph {i} tells of rain, wind and snow, in turn, and of much else that one would want to read." for i in range(3)]
BODY = "".join(f"<p>{p}</p>" for p in LONG)


@pytest.mark.parametrize("page", [
    "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul><div>{}</div><div>Copyright 2024 by us, all rights reserved.</div>",
    "<table><tr><td><a href=/>Home</a><br><a href=/x>News, all</a></td><td>{}</td></tr></table>",
    "<div><a>Home</a> <a>About</a></div><div>{}<div><a>Share</a> <a>Print</a></div></div><div>Write to us. Or call.</div>",
])
def test_menus_and_footers_without_names_are_dropped(page):
    assert main_text(f"<body>{page.format(BODY)}</body>") == " ".join(LONG)


def test_headings_and_short_items_of_the_text_are_kept():
    page = f"<body><div><a>Home</a></div><div><h1>News</h1><h2>Weather</h2><p>By us</p>{BODY}<ul><li>rain</li><li>snow</li></ul>{BODY}</div><div>Contact us.</div></body>"
    assert main_text(page) == " ".join(["News Weather By us", *LONG, "rain snow", *LONG])


def test_a_paragraph_with_a_name_like_others_is_kept_in_an_article():
    assert main_text(f"<body><article><header><h1>Head</h1></header>{BODY}<p class=caption>Fig. 1</p></article></body>") == " ".join([*LONG, "Fig. 1"])


def brute_ratios(nodes):
    """The ratios from whole path strings, node by node."""
    def path(node):
        return path(node.parent) + "/" + node.tag if node.parent else node.tag

    of = defaultdict(list)
    for node, text, _ in nodes:
        of[path(node)].append(text)
    raw = [tuple(sum(f(t) for t in of[path(n)]) / len(of[path(n)]) for f in (len, lambda t: len(re.findall("[.,;:!?。，、]", t)))) for n, _, _ in nodes]
    weights = [math.exp(-0.5 * k * k) for k in range(-2, 3)]
    out = []
    for i in range(len(raw)):
        near = [raw[min(max(i + k, 0), len(raw) - 1)] for k in range(-2, 3)]
        smooth = [sum(w * x[c] for w, x in zip(weights, near)) / sum(weights) for c in (0, 1)]
        out.append(min(math.sqrt(smooth[0] * smooth[1]), math.sqrt(raw[i][0] * raw[i][1])))
    sizes = [len(t) for _, t, _ in nodes]
    return out, LEAST * sum(s * n for s, n in zip(out, sizes)) / sum(sizes)


def test_ratios_against_brute_force():
    rng = random.Random(0)
    for _ in range(30):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<li>", "<td>", "One, two. ", "x ", "Long text; it goes on! "]) for _ in range(80))
        nodes = [x for x in text_nodes(page) if x[1].strip()]
        if nodes:
            scores, threshold = tag_path_scores(nodes)
            want, least = brute_ratios(nodes)
            assert scores.tolist() == pytest.approx(want) and threshold == pytest.approx(least)


def test_deep_and_long_pages_take_time_in_proportion():
    for page in ("<p>Hello, world. This is it.</p>" + "<span>x, " * 20_000, "<div><b>x, " * 10_000 + "</i></p>" * 10_000 + "<p>Y, z.</p>" * 10_000, "<div class=menu>" * 20_000 + "x, y."):
        began = time.process_time()
        main_text(f"<body>{page}</body>")
        assert time.process_time() - began < 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_pages_read_alike_without_their_names(spark):
    """With structural names and classes taken away, the ratios alone find nearly all texts."""
    def plain(page):
        page = re.sub(r'<(?!a\b)(\w+)[^>]*?\s(class|id|role)="[^"]*"', r"<\1", page or "")
        return re.sub(r"<(/?)(nav|header|footer|aside|article|main|section)\b", r"<\1div", page)

    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    same = sum(main_text(p) == main_text(plain(p)) for p in pages)
    assert same >= 0.8 * len(pages)


def test_repeated_rows_are_alike(spark):
    from embergrid.llm.html_extract import extract

    rows = extract(spark.createDataFrame([(1, BODY, "x"), (1, BODY, "y"), (2, None, "z")], "page_id long, html string, text string")).collect()
    assert [r.text for r in rows] == [" ".join(LONG)] * 2 + [""] and [r.n_chars for r in rows] == [len(" ".join(LONG))] * 2 + [0]
