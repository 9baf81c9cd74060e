import math
import os
from collections import Counter

import pytest

from corvane.llm import sitetree

PAGE = "page_id long, url string, html string"
SF = "/root/testdata/sf0.01"


def slots(i):
    ad = ["Buy one today", "Try it for free", "New and good now"][i % 3]
    return f"<body><ul class=m><li>{'abcdefgh'[i % 8]}<li>{'stuvwxyz'[i % 7]}</ul><div class=z>{ad} {i}</div><div class=t>{'<p>Own words of this page, ' * (i % 5 + 1)}{'and more ' * i}{i}.</div><div class=f>One footer</div></body>"


def text_of(i):
    return "\n".join(["Own words of this page,"] * (i % 5) + [f"Own words of this page, {'and more ' * i}{i}."])


def test_tree_removes_static_and_rotating_branches(spark):
    rows = [(i, "http://a.org/", slots(i)) for i in range(40)] + [(100 + i, f"http://b{i}.org/", slots(i)) for i in range(4)]
    df = spark.createDataFrame(rows, PAGE)
    for shipped in (1000, 0):
        got = {r["page_id"]: r["text"] for r in sitetree.extract(df, shipped=shipped, prior=False).collect()}
        # hosts of one page have no tree of their own; that of all hosts decides for them
        assert got == {i: text_of(i % 100) for i, _, _ in rows}


def test_statistics_equal_a_plain_count(spark):
    rows = [(i, "http://a.org/x", slots(i)) for i in range(25)] + [(90 + i, "http://c.org/", "<div><p>Same</div>") for i in range(3)]
    tree = {(r["host"], r["node"]): r for r in sitetree.style_tree(spark.createDataFrame(rows, PAGE), prior=False).collect()}
    variants = {}
    for _, url, html in rows:
        p = sitetree.Page(html, False)
        below = {}
        for key, text, _ in p.texts:
            below.setdefault(key, []).append(text)
        for host in (sitetree.host_of(url), "*"):
            for node, seq in set(p.nodes):
                variants.setdefault((host, node, "presentation"), []).append(seq)
            for node, t in below.items():
                variants.setdefault((host, node, "content"), []).append(tuple(t))
                variants.setdefault((host, node, "shape"), []).append(tuple(len(x.split()) for x in t))
    for (host, node, kind), seen in variants.items():
        m = len(seen)
        want = 1 - sum(c * math.log(c) for c in Counter(seen).values()) / (m * math.log(m)) if m > 1 else 1.0
        assert tree[host, node][kind] == pytest.approx(want), (host, kind)
    assert {k for k in tree} == {(h, n) for h, n, _ in variants}


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<main><p>Lead.</p><article><p>Body.</p></article><p>Closing.</p></main><p>Outside main.", "Lead.\nBody.\nClosing."),
        ("<h1>Head</h1><article><p>Body.</p></article><nav>Menu</nav>", "Head\nBody."),
        ("<article><div class='reply-share-analysis'><p>Kept.</p></div><div class='share-buttons'>Tweet</div></article>", "Kept."),
        ("<article><div class='site-header-study'>Kept.</div><div id=comment-list-2><p>Reader</p></div></article>", "Kept."),
        ("<article><table><tr><td>1<td>2</table><blockquote>Q &#65;&#x42;&eacute;</blockquote></article>", "1\n2\nQ ABé"),
        ("<nav>Only menu</nav>", ""),
        ("x" * 400_000 + "<div class='sidebar left'>side</div>", "x" * 400_000),
        ("<div><div><div>" * 3000 + "deep", "deep"),
    ],
)
def test_what_a_single_page_keeps(html, want):
    assert sitetree.Page(html).main_text(frozenset()) == want


def test_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(1, None, "<p>a")] * 3 + [(None, "http://[bad", None), (2, "", "")]
    df = spark.createDataFrame(rows, PAGE).withColumnRenamed("none", "none").selectExpr("*", "1 AS node", "'x' AS host", "true AS low", "0 AS text")
    got = sitetree.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r["page_id"] or 0, r["text"]) for r in got.collect())) == [(0, ""), (1, "a"), (1, "a"), (1, "a"), (2, "")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_the_tree_alone_changes_every_page_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    bare = {r["page_id"]: r["text"] for r in sitetree.extract(pages, least_pages=10**9, prior=False).collect()}
    tree = {r["page_id"]: r["text"] for r in sitetree.extract(pages, prior=False).collect()}
    full = {r["page_id"]: r["text"] for r in sitetree.extract(pages).collect()}
    assert all(bare[k] != tree[k] for k in tree)
    assert sum(full[k] == tree[k] for k in tree) >= 0.9 * len(tree)
