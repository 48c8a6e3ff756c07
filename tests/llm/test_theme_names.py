"""What a class is called deletes no text of an article; adverts and comments in it go; link lines that the next page has too go."""

import pytest
from pyspark.sql import functions as F

from tripleweft.llm import html_extract


def text(page):
    return [t for t, z in html_extract.lines(page) if z != html_extract.DROPPED]


@pytest.mark.parametrize("inside", [
    '<p class="share-price">Shares rose by a tenth.</p>', '<section class="related-work"><p>Others did this before.</p></section>', '<div class="alert-summary">Storms are expected.</div>',
    '<ul class="menu-items"><li>Soup of the day</ul>', '<p class="notice">The town took notice.</p>', '<div id="promotion">She was promoted.</div>', '<p class="comment-on-law">A word on the law.</p>',
])
def test_text_of_the_article_stays(inside):
    assert len(text(f"<article><p>First.</p>{inside}</article>")) == 2


@pytest.mark.parametrize("inside", [
    '<div class="ad">Buy</div>', '<div class="wide ad-slot">Buy</div>', '<section id="comments"><p>I agree.</p></section>', '<div class="comment-list">Me too.</div>', '<nav>Home</nav>', "<aside>Else</aside>", "<form>Name</form>",
    "<footer>Filed under news</footer>", '<div role="complementary">Else</div>', '<div class="share-buttons">Tell a friend</div>',
])
def test_what_is_not_the_article_goes(inside):
    assert text(f"<article><p>First.</p>{inside}</article>") == ["First."]


@pytest.mark.parametrize("outside", ['<div class="share-price">A</div>', '<div class="menu-items">A</div>'])
def test_compound_names_outside(outside):
    assert text(outside) == ["A"]


def test_shared_link_lines_of_articles_go(spark):
    page = "<article><p>Day {0} of the trial.</p><p>All rights reserved.</p><p><a href='/x'>More on the trial</a> <a href='/y'>All trials</a></p><p>See <a href='/z'>the law</a>.</p></article>"
    rows = [(i, f"http://h.org/a/{i}", page.format(i)) for i in range(3)] + [(7, "http://else.org/", page.format(7))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(3):
        assert got[i] == f"Day {i} of the trial. All rights reserved. See the law."
    assert got[7] == "Day 7 of the trial. All rights reserved. More on the trial All trials See the law."
