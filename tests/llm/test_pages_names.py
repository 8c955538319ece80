"""Pages whose wrappers hold the words of comments and of what is hidden, and pages without rows."""

import pytest

from logloom.llm import pages

ARTICLE = "some text of the article here. " * 20
OWN = " ".join(ARTICLE.split())
LONG = "a reader says that this is not so. " * 60

CASES = {
    "overflow": (f'<body><div class="min-h-screen overflow-hidden"><div class="c">{ARTICLE}</div></div>', OWN),
    "wide screens": (f'<body><div class="hidden md:block"><div class="c">{ARTICLE}</div></div>', OWN),
    "small screens": (f'<body><div class="md:hidden"><div class="c">{ARTICLE}</div></div>', OWN),
    "state of the site": (f'<body><div id=page class="site comments-open"><div class="c">{ARTICLE}</div></div>', OWN),
    "state of the post": (f'<body><article class="post no-replies">{ARTICLE}</article><footer>f</footer>', OWN),
    "until found": (f'<body><div hidden="until-found"><article>{ARTICLE}</article></div>', OWN),
    "veiled article": (f'<body><div class="hidden"><article>{ARTICLE}</article></div><p>Please wait.</p>', OWN),
    "around all": (f'<body><div class="with-comments comments-wrap"><article>{ARTICLE}</article><div class="comment">{LONG[:300]}</div></div>', OWN),
    "no script": (f"<body><noscript><article>{ARTICLE}</article></noscript>", OWN),
    "comments beside": (f'<body><article>{ARTICLE}</article><div class="comments-area"><div class="comment-content">{LONG}</div></div>', OWN),
    "comments without an article": (f'<body><div class="c">{ARTICLE}</div><div id="comments"><div class="text">{LONG}</div></div>', OWN),
    "comments as articles": (f'<body><div class="entry">{ARTICLE}</div><ol class="commentlist"><li><article class="comment-body">{LONG}</article></ol>', OWN),
    "bare attribute": (f"<body><div class=c>{ARTICLE}</div><div hidden>{LONG}</div>", OWN),
    "aria": (f'<body><div class=c>{ARTICLE}</div><div aria-hidden="true">{LONG}</div>', OWN),
    "style": (f'<body><div class=c>{ARTICLE}</div><div style="display: none">{LONG}</div>', OWN),
    "class": (f'<body><div class=c>{ARTICLE}</div><div class="hidden">{LONG}</div>', OWN),
    "deep": ("<body>" + "<div>" * 300 + ARTICLE + "<nav>menu</nav><aside>side</aside>", OWN),
}


@pytest.fixture(scope="module")
def read(spark):
    """Every case as four pages of a host of its own."""
    rows = [(f"{name} {i}", f"https://{name.replace(' ', '-')}.org/{i}", html) for name, (html, _) in CASES.items() for i in range(4)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    return {r.page_id: r.text for r in pages.extract_pages(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_articles_stay_and_comments_go(read, name):
    assert {read[f"{name} {i}"] for i in range(4)} == {CASES[name][1]}


def test_empty_table(spark):
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
