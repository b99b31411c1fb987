"""The minimum cut decides: costs are fitted, edges are comparable, and odd wrappers don't empty a page."""

import random
import re
import time

import pytest
from corvane.llm import html_main

TEXT = "Some words of the article, long enough to be read as a paragraph of it. " * 3
SAID = " ".join(TEXT.split())


@pytest.mark.parametrize("page", [
    f"<nav><a href=/>Home</a></nav><article class='post has-sidebar'><p>{TEXT}</p></article>", f"<main class='content with-sidebar'><p>{TEXT}</p></main>",
    f"<div id=content class=no-sidebar><p>{TEXT}</p></div><div class=sidebar><a href=/>a</a></div>", f"<article class=ad-free><p>{TEXT}</article>",
    f"<article class=article-share-enabled><p>{TEXT}</article>", f"<form id=aspnetForm><div class=menu><a href=/>menu</a></div><div class=content><p>{TEXT}</div><div class=footer>imprint</div></form>",
    f"<article><p>{TEXT}<span class='ad'><span>buy</span> now cheap</span></p></article>", f"<article><script src=/js/>code</script><p>{TEXT}</p></article>",
])
def test_pages_that_one_word_used_to_empty(page):
    assert html_main.main_text(page) == SAID


def test_hidden_parts_go_whole():
    page = f"<article><p>{TEXT}</p><div hidden><p>secret<div>inner</div></div><p>end <span style='display:none'>x<span>y</span>z</span>of it.</article>"
    assert html_main.main_text(page) == SAID + "\n\nend of it."


@pytest.mark.parametrize(("page", "text"), [
    ('<p>Write <span class="comment"># add one</span> and then save</p>', "Write # add one and then save"),
    ('<p>Choose <b class="menu">File</b> and press <kbd class="ui-menu">Save</kbd> to finish</p>', "Choose File and press Save to finish"),
    (f"<article><p>{TEXT}</p><p>Open the <em class='nav'>Start <b>menu</b></em>, then wait.</p></article>", SAID + "\n\nOpen the Start menu, then wait."),
    (f"<article><p>{TEXT} <span class='sponsored'>Buy now</span></p><p>Before <i class=ad>cheap</i> after it.</p></article>", SAID + "\n\nBefore after it."),
    (f"<article><p>{TEXT}</p><p><span class='comment'>Nice post!</span></p></article><div class=comments><p>more</p></div>", SAID),
    (f"<div class=x><h2>Steps</h2><ul><li>Cut</li><li>Stir</li><li>Bake</li></ul><p>{TEXT}</p></div>", "Steps\n\nCut\n\nStir\n\nBake\n\n" + SAID),
])
def test_no_word_removes_text_by_itself(page, text):
    assert html_main.main_text(page) == text


@pytest.mark.parametrize(("page", "kept"), [
    (f"<section><p>{TEXT}</p><p><a href=/y>Map</a></p><p>{TEXT}</p></section>", [True, True, True]),  # a linked line between paragraphs
    (f"<div><table><tr><td>{TEXT}</td></tr><tr><td><a href=/a>Source</a></td></tr><tr><td>{TEXT}</td></tr></table></div>", [True, True, True]),
    (f"<div><p><a href=/a>Latest</a></p><p><a href=/b>Sport</a></p><p>Ten ways to make your garden bloom</p><p><a href=/c>Weather</a></p></div><article><p>{TEXT}</p></article>", [False] * 4 + [True]),  # a line without a link among links
])
def test_the_cut_is_right_where_the_threshold_is_not(page, kept):
    """Layouts that the fit has not seen, by names that say nothing."""
    found, keep, _ = html_main.labelled(page)
    assert keep == kept
    assert [o > 0 for o in html_main.odds_of(found)] != kept


def test_the_cut_mends_labels_and_flow_settles_blocks(monkeypatch):
    settled = []
    flow = html_main._max_flow_side
    monkeypatch.setattr(html_main, "_max_flow_side", lambda nodes, odds, near: settled.extend(nodes) or flow(nodes, odds, near))
    rng = random.Random(99)
    alone = cut = n = 0
    for _ in range(150):
        page, truth = html_main.layout(rng)
        found, keep, _ = html_main.labelled(page)
        own = [truth[b.text] for b in found]
        alone += sum((o > 0) == t for o, t in zip(html_main.odds_of(found), own, strict=True))
        cut += sum(k == t for k, t in zip(keep, own, strict=True))
        n += len(own)
    assert cut > alone and cut / n > 0.97
    assert len(settled) > 0.02 * n


def test_flow_settles_blocks_of_the_tables(spark, sf_dir):
    found = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        blocks = html_main.blocks(r.html)
        near = [0.0] * len(blocks)
        for i, j, w in html_main.edges(blocks):
            near[i] += w
            near[j] += w
        found += sum(abs(o) < w for o, w in zip(html_main.odds_of(blocks), near, strict=True))
    assert found > 0


@pytest.mark.parametrize("piece", ["<div>", "<span hidden>", "</section>", "<li>", "<dt></dt>", "<a ", "<b x='", "<article><nav>", "<header>"])
def test_time_grows_with_the_length(piece):
    def seconds(n):
        page = "<div>" * n + piece * n + "text" + "</section>" * n
        began = time.perf_counter()
        html_main.main_text(page)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(8000) < 12 * seconds(2000) + 0.5


def test_text_of_long_pages_is_whole():
    words = " ".join(f"w{k}" for k in range(100_000))
    assert html_main.main_text(f"<article><p>{words}.</p></article>") == words + "."
    assert not re.search(r"[<>]", html_main.main_text("<article><p>a<" + "b" * 10))
