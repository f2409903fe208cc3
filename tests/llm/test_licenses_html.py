import functools
import random
import re
import time
from html import unescape

import numpy as np
import pytest

from linewright.llm import html, licenses
from linewright.llm.queries import op1_license_scans, op5_html_extraction

LINE = re.compile(r"Released under the MIT License|Licensed under the Apache License, Version 2\.0|This work is licensed under the GNU General Public License, version 3|Licensed under CC BY-NC 4\.0")


def test_license_lines_of_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = sorted((d, m.start(), m.end()) for d, t in docs.items() for m in LINE.finditer(t or ""))
    got = op1_license_scans(spark, sf_dir).collect()
    assert want and sorted((r.doc_id, r.start, r.end) for r in got) == want


def test_licenses_in_odd_places(spark, odd_docs, no_docs):
    assert licenses.scan(odd_docs).count() == 0 == licenses.scan(no_docs).count()
    mit = next(t for n, f, t in licenses.TEMPLATES if (n, f) == ("MIT", "grant"))
    changed = mit.replace("free of charge", "at no charge at all").replace("merge, ", "")
    rows = [(1, "é🙂 " + mit.upper().replace(" ", "\n * ")), (1, changed), (2, "and released (under) the MIT license, maybe"), (2, "Released under our own licence"), (3, "x " * 50_000 + mit + " y" * 50_000 + " " + mit), (None, "Licensed under CC BY 4.0.")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.license, r.form) for r in got) == [(0, "CC-BY-4.0", "line"), (1, "MIT", "grant"), (1, "MIT", "grant"), (2, "MIT", "line"), (3, "MIT", "grant"), (3, "MIT", "grant")]
    texts = {3: rows[4][1]}
    for r in got:
        if r.doc_id == 3:
            assert r.coverage == 1.0 and texts[3][r.start : r.end] == mit[:-1]
    assert any(r.doc_id == 1 and 0.9 < r.coverage < 1 for r in got)


@pytest.mark.parametrize(
    "text, want",
    [
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 4.", []),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1"]),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["AGPL-3.0"]),
        ("Licensed under the Apache License, Version 2.1.", []),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["CC-BY-ND-4.0"]),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["CC-BY-NC-SA-4.0"]),
        ("It is not licensed under the terms of the MIT license. It is not released under the MIT License.", []),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("code // SPDX-License-Identifier: GPL-2.0-or-later and more words here to follow", ["GPL-2.0"]),
        ("# SPDX-License-Identifier: GPL-3.0-only", ["GPL-3.0"]),
        ("SPDX-License-Identifier: Apache-2.0\nSPDX-License-Identifier: BSD-3-Clause", ["Apache-2.0", "BSD-3-Clause"]),
        ("Licensed under the BSD 2-Clause License.", ["BSD-2-Clause"]),
    ],
)
def test_neighbouring_licenses_are_told_apart(text, want):
    words, index = licenses.words_of(f"some words before {text}"), licenses.Index(licenses.TEMPLATES)
    hashed = licenses.shingles(np.array([licenses._words[w] for w in words], dtype=np.uint64), np.array([len(words)]))
    found = licenses.places_in(words, list(map(int, index.hits(hashed, licenses.winnow(hashed)))), hashed, index)
    assert [index.templates[t][0] for t, *_ in found] == want


def test_every_template_finds_itself():
    index = licenses.Index(licenses.TEMPLATES)
    for name, form, text in licenses.TEMPLATES:
        words = licenses.words_of(f"one two three {text} four five six")
        hashed = licenses.shingles(np.array([licenses._words[w] for w in words], dtype=np.uint64), np.array([len(words)]))
        found = licenses.places_in(words, list(map(int, index.hits(hashed, licenses.winnow(hashed)))), hashed, index)
        assert [(index.templates[t][0], a, b) for t, a, b, _ in found] == [(name, 3, len(words) - 3)], (name, form)


def test_alignment_equals_brute_force():
    """With a band as wide as the texts the alignment is the best of all; a narrow one finds what lies in it."""

    def brute(template, text):
        @functools.cache
        def best(i, j, started):
            if i == len(template):
                return 0, 0
            found = [(-1, 0, best(i + 1, j, started))]
            if j < len(text):
                hit = template[i] == text[j]
                found.append((2, 1, best(i + 1, j + 1, True)) if hit else (-1, 0, best(i + 1, j + 1, started)))
                found.append((-1 if started else 0, 0, best(i, j + 1, started)))
            return max((s + r[0], n + r[1]) for s, n, r in found)

        return best(0, 0, False)

    rng = random.Random(4)
    for _ in range(300):
        template, text = (["abcd"[rng.randrange(4)].encode() for _ in range(rng.randrange(1, 9))] for _ in range(2))
        score, matched = brute(tuple(template), tuple(text))
        n, first, end = licenses.align(template, text, 0, band=20)
        assert n == matched, (template, text)
        assert not n or 0 <= first < end <= len(text)
    words = [b"%d" % k for k in range(60)]
    changed = [*(b"x" for _ in range(7)), *words[:20], b"y", b"z", *words[23:40], *words[42:]]
    assert licenses.align(words, changed, 7) == (55, 7, len(changed))


def plain(page):
    article = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.S)
    if not article:
        return ""
    cut = re.sub(r"<[^>]*\Z", "", article[1])
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", cut))
    return "\n".join(x for x in blocks if x)


def test_articles_of_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op5_html_extraction(spark, sf_dir).collect():
        assert (r.text, r.n_chars) == (plain(pages[r.page_id]), len(plain(pages[r.page_id])))


SENTENCE = "This is a sentence of the story, and it goes on for a while. "


def test_pages_without_an_article_element():
    page = f"""<html><body><header><h2>Site</h2></header><div id="main-menu" class="menu"><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div>
      <div class="page"><div class="story"><h1>A &amp; B</h1><p>{SENTENCE * 3}<p>One<br>two &lt;3 &nbsp; {SENTENCE}<blockquote>{SENTENCE}</blockquote><script>if (a<b) "</div>"</script></div>
      <aside>{SENTENCE}</aside><div class="cookie-notice">{SENTENCE}</div><form><label>{SENTENCE}</label></form><section id="comments"><p>{SENTENCE * 5}</p></section></div>
      <footer>{SENTENCE}</footer>"""
    s = SENTENCE.strip()
    assert html.main_text(page) == "\n".join(["A & B", " ".join([s] * 3), f"One two <3 {s}", s])


def test_paths_decide_where_names_say_nothing(monkeypatch):
    """No article element, no telling class: only tag paths tell the story from what surrounds it."""
    story = [SENTENCE.strip() + " " + SENTENCE.strip() for _ in range(6)]
    links = "".join(f"<li>Another item number {i}</li>" for i in range(60))
    page = f"""<body><div class="a1"><ul>{links}</ul></div><div class="b2"><div>Short offer</div><div>Another one</div></div>
      <div class="c3"><div class="d4"><h2>Title of it</h2>{"".join(f"<p>{x}</p>" for x in story)}<ul><li>short item</li></ul></div></div>
      <div class="e5"><span>Contact us</span></div><table><tr><td>1</td><td>2</td></tr></table></body>"""
    want = "\n".join(["Title of it", *story, "short item"])
    flat = f"<body><div>Menu here</div><h1>Title of it</h1>{''.join(f'<p>{x}</p>' for x in story)}<div>Buy now</div></body>"
    assert html.main_text(page) == want and html.main_text(flat) == "\n".join(["Title of it", *story])
    # names that speak against long, punctuated text do not outweigh it
    assert html.main_text(f'<body><div class="share"><p>{SENTENCE * 40}</p></div><div>x</div></body>').startswith(SENTENCE.strip())
    monkeypatch.setattr(html, "chosen", set)  # without the threshold
    assert html.main_text(page) != want and "Contact us" in html.main_text(page) and "Buy now" in html.main_text(flat)


def test_time_grows_with_the_page():
    for page in ("<div>a" * 50_000, '<a "' * 50_000, "<div>" * 50_000 + "</span></p>" * 50_000, "<p>a" * 50_000):
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 5


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text, no tags"), (4, "u", "<article>"), (5, "u", "<p>a<p"), (6, "u", "<nav>only</nav>"), (7, "u", "<p>" + "x " * 100_000), (7, "u", "<p>" * 5000 + "deep"), (None, None, "<article><p>b</p></article>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got][:6] == ["", "", "plain text, no tags", "", "a", ""] and got[8].text == "b"
    assert all(r.n_chars == len(r.text) for r in got)


STORY = f"<article><h1>Title of it</h1>{'<p>This is a long paragraph, with words and marks; it goes on.</p>' * 6}</article>"
WANT = "\n".join(["Title of it"] + ["This is a long paragraph, with words and marks; it goes on."] * 6)


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="content share-enabled">{STORY}</div><footer>f</footer></body>',
        f'<body class="nav"><div class="page sidebar">{STORY}</div><div class="sidebar">x y z</div></body>',  # the frame is not what its class says
        STORY.replace("</article>", '<div class="user-remarks"><p>Nice text, really, I like it a lot; thanks!</p></div></article>'),
        STORY.replace("</article>", '<div class="commentList"><p>Nice text, really, I like it a lot; thanks!</p></div></article>'),
        STORY.replace("</article>", "<ul><li><a href=x>Read this next story</a></li><li><a href=y>And that one</a></li></ul></article>"),
        f'<body><div id="cookie-box"><p>We use them, as all do; agree.</p></div>{STORY}<div class="ad_slot">Buy now.</div></body>',
    ],
)
def test_names_count_as_a_whole_and_links_for_nothing(page):
    assert html.main_text(page) == WANT


def test_paragraphs_with_links_stay():
    page = STORY.replace("</article>", '<p>See <a href="x">the other story</a> for more of it.</p></article>')
    assert html.main_text(page) == WANT + "\nSee the other story for more of it."
    assert html.main_text("<body><ul><li><a href=x>One story, told</a></li><li><a href=y>Two stories, told</a></li></ul></body>") == "One story, told\nTwo stories, told"


def plain_scores(page):
    """The score of each path from its definition: ratios of text and punctuation to blocks, smoothed, multiplied."""
    blocks = [(page.kind[node], len(text) - links, len(html._punctuation.findall(text)), page.apart[node], page.inside[node]) for (node, text), links in zip(page.blocks, page.links)]
    ratios = {}
    for kind in {b[0] for b in blocks}:
        mine = [b for b in blocks if b[0] == kind]
        weight = html.ASIDE if mine[0][3] else html.ARTICLE if mine[0][4] else 1.0
        ratios[kind] = (sum(b[1] for b in mine) * weight / len(mine), sum(b[2] for b in mine) / len(mine) + 1)
    found = {}
    for kind in ratios:
        total = 0.0
        for i, b in enumerate(blocks):
            if b[0] == kind:
                near = [ratios[kind]] if b[3] else [ratios[x[0]] for x in blocks[max(0, i - 1) : i + 2]]
                total += (ratios[kind][0] + sum(r[0] for r in near) / len(near)) * (ratios[kind][1] + sum(r[1] for r in near) / len(near))
        found[kind] = total / sum(b[0] == kind for b in blocks)
    return found


def test_scores_equal_their_definition(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(200).collect():
        page = html.Page(r.html or "")
        got, want = html.scores(page), plain_scores(page)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)
