"""Classes that themes set on the page or around its article don't lose the article."""

import pytest

from tripleweft.llm import html_extract

STORY = "<p>The story of the day is long enough to be read.</p>"


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'><article>{}</article></body>", "<body><main class='no-sidebar'>{}</main></body>", "<body class='single comments-open'><p></p>{}</body>",
    "<body><article class='post social-science'>{}</article></body>", "<html class='nav'><body id='menu'>{}</body></html>", "<body><div class='with-sidebar'><ARTICLE>{}</ARTICLE></div></body>",
])
def test_the_article_stays(page):
    assert [t for t, z in html_extract.lines(page.format(STORY) + "<div class='sidebar'>Links</div>") if z != html_extract.DROPPED] == ["The story of the day is long enough to be read."]


def test_a_teaser_does_not_displace_the_text():
    found = html_extract.lines(f"<body class='has-sidebar'>{STORY}<div class='related'><article>Read on</article></div></body>")
    assert [t for t, z in found if z != html_extract.DROPPED] == ["The story of the day is long enough to be read."]
