"""Pages whose main text lies outside articles, in several parts, or under names of furniture."""

import random
import time

import pytest

from siltworks.llm.html_extraction import main_text

WORDS = "river house morning light walked toward small garden where children played until evening".split()


def story(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randrange(25, 75))) + "." for _ in range(n)]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_teasers_in_articles_do_not_replace_the_story():
    own = story(10)
    cards = "".join(f"<article><h3><a href='/{i}'>Teaser {i}</a></h3><p>A short line about it.</p></article>" for i in range(4))
    for cards_div in (f"<div>{cards}</div>", cards):
        found = main_text(f"<body><div><h1>Title</h1>{paragraphs(own)}</div>{cards_div}</body>").split("\n")
        assert found[:11] == ["Title", *own] and len(found) < 15


def test_content_beside_an_article_stays():
    own, more = story(6), story(3, 2)
    found = main_text(f"<body><article>{paragraphs(own)}</article><div><h2>Part two</h2>{paragraphs(more)}</div></body>").split("\n")
    assert [line for line in found if line != "Part two"] == own + more


def test_content_beside_the_largest_element_stays():
    lead, own, more = story(1, 3)[0], story(9), story(3, 2)
    found = main_text(f"<body><div><h1>The title of it all</h1><p>{lead}</p><div class='body'>{paragraphs(own)}</div></div></body>").split("\n")
    assert found == ["The title of it all", lead, *own]
    assert main_text(f"<body><div>{paragraphs(own)}</div><div>{paragraphs(more)}</div></body>").split("\n") == own + more


@pytest.mark.parametrize(
    "wrapper", ["div class='content with-sidebar'", "div class='no-sidebar'", "section class='post has-comments'", "div class='entry share-enabled'"]
)
def test_layout_flags_do_not_remove_the_story(wrapper):
    own = story(8)
    tag = wrapper.split()[0]
    page = f"<body><{wrapper}>{paragraphs(own)}<div class='ad'><p>{own[0]}</p></div></{tag}><div id='sidebar'><p>{own[1]}</p></div></body>"
    assert main_text(page).split("\n") == own
    page = "<body>" + "".join(f"<{wrapper}><p>{t}</p></{tag}>" for t in own) + "<div class='cookie-notice'>We use cookies.</div></body>"
    assert main_text(page).split("\n") == own


def test_names_of_furniture_inside_a_line():
    own = story(3)
    page = "<body><div>" + paragraphs(t + " <span class='ad'>Buy now</span>" for t in own) + "</div></body>"
    assert main_text(page).split("\n") == own


def test_a_form_around_the_page_is_no_form():
    own = story(6)
    page = f"<body><form id='aspnetForm'><div>{paragraphs(own)}</div><form class='search'><p>Search here</p><input></form></form></body>"
    assert main_text(page).split("\n") == own
    sign_up = "<form><p>Leave your address, and a letter comes to you each week with all that is new.</p><input></form>"
    assert main_text(f"<body><div>{paragraphs(own)}</div>{sign_up}</body>").split("\n") == own


@pytest.mark.parametrize("name", ["comment-list", "comments", "discussion-thread", "commentBody"])
@pytest.mark.parametrize("place", ["inside", "beside", "no article"])
def test_comments_longer_than_the_story_go(name, place):
    own, said = story(3), story(20, 5)
    comments = f"<div class='{name}'>" + "".join(f"<div><b>Reader {i}</b><p>{t}</p></div>" for i, t in enumerate(said)) + "</div>"
    page = {
        "inside": f"<article>{paragraphs(own)}{comments}</article>",
        "beside": f"<article>{paragraphs(own)}</article>{comments}",
        "no article": f"<div>{paragraphs(own)}</div>{comments}",
    }[place]
    assert main_text(f"<body>{page}</body>").split("\n") == own


def test_a_page_of_comments_alone_keeps_them():
    said = story(8)
    assert main_text(f"<body><div class='discussion'>{paragraphs(said)}</div></body>").split("\n") == said


def test_deep_pages_and_unfinished_tags_take_time_in_proportion():
    start = time.perf_counter()
    deep = "".join(f"<div>line {i} of a deep page" for i in range(12_000))
    assert len(main_text(deep).split("\n")) == 12_000
    assert main_text("<p>before</p>" + "<a " * 40_000) == "before"
    assert main_text("<p>a &lt; b</p> 1 < 2") == "a < b\n1 < 2"
    assert time.perf_counter() - start < 5
