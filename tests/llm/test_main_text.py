"""Main text by window sums: a naive scan of the windows, and pages on which tags alone would decide wrongly."""

import random

import pytest
from pyspark.sql import functions as F

from oddsmill.llm import htmltext
from oddsmill.llm.htmltext import SURGE, WINDOW


def naive_spans(weights, homes):
    """Every line by its own two windows, then runs of lines between a surge and the next dive or border of an article."""
    n = len(weights)
    ahead = [sum(weights[j] for j in range(n) if i <= j < i + WINDOW) for i in range(n)]
    behind = [sum(weights[j] for j in range(n) if i - WINDOW < j <= i) for i in range(n)]
    surges = [weights[i] > 0 and (ahead[i] >= SURGE or behind[i] >= SURGE) for i in range(n)]
    spans, i = [], 0
    while i < n:
        if not surges[i]:
            i += 1
            continue
        end = i + 1
        while end < n and homes[end] == homes[i] and (surges[end] or ahead[end] >= SURGE):
            end += 1
        spans.append((i, end))
        i = end
    return spans


def test_spans_by_naive_scan():
    rng = random.Random(9)
    for _ in range(2000):
        n = rng.randrange(0, 40)
        weights = [rng.choice((0, 0, 3, 12, 39, 40, 41, 200)) for _ in range(n)]
        homes = sorted(rng.choice((0, 1, 2)) for _ in range(n))
        assert htmltext.spans_of(weights, homes) == naive_spans(weights, homes)


BODY = "a sentence of the article that is long enough to weigh something in any window of lines"


@pytest.mark.parametrize("page,text", [
    # A teaser card in an article element does not hide the text outside it.
    (f"<article><p>teaser</p></article><ul><li></li></ul><div><p>{(BODY + ' ') * 9}</p><p>{(BODY + ' ') * 9}</p></div>", " ".join([BODY] * 18)),
    # A short line after an article, outside it, is not its text; short lines inside are.
    (f"<article><p>{BODY}</p><p>End.</p></article><p>Made with care</p>", f"{BODY} End."),
    (f"<article><p>{BODY}</p><aside>x</aside><aside>y</aside><aside>z</aside><p>tail</p></article>", f"{BODY} tail"),
    # Without an article the windows alone decide: lines of links carry no weight.
    (f"<div><a href=a>one</a></div><div><a href=b>two</a></div><div><a href=c>three</a></div><p>{BODY}</p><p>{BODY}</p><div><a href=d>four</a></div>", f"{BODY} {BODY}"),
    ("<p>few words</p>", "few words"),
    ("<p><a href=a>only a link</a></p>", "only a link"),
    ("<nav>menu</nav>", ""),
    ("", ""),
])
def test_windows_decide(page, text):
    assert htmltext.main_text(page) == text


def test_null_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "  "), (4, "<p>words</p>"), (4, "<p>words</p>"), (5, "<p>" + "w " * 50_000)], "page_id long, html string")
    got = sorted((r.page_id, r.t) for r in pages.select("page_id", htmltext.extracted(F.col("html")).alias("t")).collect())
    assert got == [(1, ""), (2, ""), (3, ""), (4, "words"), (4, "words"), (5, " ".join(["w"] * 50_000))]
    assert pages.where("false").select(htmltext.extracted(F.col("html"))).count() == 0
