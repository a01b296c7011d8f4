"""Everyday pages, and pages of a second generator whose habits the fitted ones do not have."""

import random
import time

import pytest

from urbanloom.llm import html_extract, page_model

FIRST = "One long paragraph of prose that stands here, first of all."
LAST = "Another long paragraph of prose stands here, last of all."
INSERTS = (
    '<div class="ad">Buy our shiny new phones now!</div>', "<form><p>Your mail address</p><input></form>", '<div class="share">Share this on social media</div>', '<div class="notice"><p>We use cookies to make this better.</p></div>',
    '<aside><p>Most read stories of the week</p></aside>',
)


@pytest.mark.parametrize("insert", INSERTS)
@pytest.mark.parametrize("home", ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>'])
def test_what_follows_an_insert_stays(insert, home):
    page = "<body>" + home.format(f"<h1>Title of it</h1><p>{FIRST}</p>{insert}<p>{LAST}</p>") + "<footer>(c) us</footer></body>"
    assert html_extract.main_text(page) == f"Title of it\n{FIRST}\n{LAST}"


@pytest.mark.parametrize("tag", ["<p title=it's>", '<p title=5">', "<p data-a=x'y id=k>", "<p title='a>b'>", '<p title = "it\'s > that">', "<p it's>", "<p a=b=\"c>"])
def test_quotes_open_a_value_only_behind_an_equals_sign(tag):
    assert html_extract.main_text(f"<article><h1>Title of it</h1>{tag}{FIRST}</p><p>{LAST}</p></article>") == f"Title of it\n{FIRST}\n{LAST}"


def test_tables_and_lists_of_terms_stay():
    table = "<table><tr><th>Year</th><th>Sales</th></tr><tr><td>2001</td><td>17</td></tr><tr><td>2002</td><td>19</td></tr></table>"
    assert html_extract.main_text(f"<article><h1>Title of it</h1><p>{FIRST}</p>{table}<p>{LAST}</p></article>") == f"Title of it\n{FIRST}\nYear Sales\n2001 17\n2002 19\n{LAST}"
    hours = "<h1>Opening hours</h1><dl><dt>Monday</dt><dd>From nine to five.</dd><dt>Tuesday</dt><dd>Closed all day.</dd></dl><address>12 High Street, Oldtown</address>"
    assert html_extract.main_text(f"<article>{hours}</article>") == "Opening hours\nMonday\nFrom nine to five.\nTuesday\nClosed all day.\n12 High Street, Oldtown"


def test_no_neighbours_outvote_a_sure_block():
    weights, agree = page_model.fitted()
    for html, _ in page_model.pages(150, 21):
        blocks = html_extract.blocks_of(html)
        content, boiler = html_extract.terminal_costs(blocks, weights)
        edges = html_extract.edges_of(blocks, agree)
        held = [sum(w for a, b, w in edges if k in (a, b)) for k in range(len(blocks))]
        side = html_extract.minimum_cut(content, boiler, edges)
        assert all(h <= html_extract.SCALE * html_extract.HELD for h in held)
        assert all(s == (c > b) for s, c, b in zip(side, content, boiler, strict=True) if abs(c - b) > html_extract.SCALE * html_extract.HELD)


def other_page(rng):
    """Pages of other words, containers and orders than those that the classifier is fitted on."""
    words = "the of and a to in is was he for it with as his on be at by this had not are but from or have an they which one you were".split()
    sentence = lambda low, high: " ".join(rng.choice(words) for _ in range(rng.randint(low, high))).capitalize() + "."
    kept, body = [], []

    def keep(text, form):
        kept.append(text)
        body.append(form.format(text))

    keep(sentence(3, 7)[:-1], '<h1 itemprop="headline">{}</h1>')
    for _ in range(rng.randint(3, 8)):
        keep(" ".join(sentence(6, 20) for _ in range(rng.randint(1, 5))), rng.choice(["<p>{}</p>", '<p class="paragraph">{}</p>', "<div><p>{}</p></div>", "<section><p>{}</p></section>"]))
        if rng.random() < 0.2:
            body.append(rng.choice(INSERTS))
        if rng.random() < 0.15:
            keep(sentence(2, 5)[:-1], "<h3>{}</h3>")
    menu = "<nav><ol>" + "".join(f'<li><a href="#{k}">{sentence(1, 2)[:-1]}</a>' for k in range(6)) + "</ol></nav>"
    foot = f'<footer><ul><li><a href="/i">{sentence(1, 3)}</a></ul><small>&copy; {sentence(2, 6)}</small></footer>'
    home = rng.choice(['<main id="page-main">{}</main>', '<article itemscope>{}</article>', '<div role="main"><article>{}</article></div>'])
    return f'<!doctype html><html lang=en><body>{menu}{home.format("".join(body))}{foot}</body></html>', kept


def test_pages_of_another_generator(monkeypatch):
    wrong, blocks, lost = {}, 0, 0
    for edge in (0, html_extract.EDGE):
        monkeypatch.setattr(html_extract, "EDGE", edge)
        rng = random.Random(5)
        wrong[edge] = 0
        for _ in range(150):
            html, kept = other_page(rng)
            found = [b.text for b in html_extract.main_blocks(html)]
            wrong[edge] += len(set(found) ^ set(kept))
            lost += edge > 0 and len(set(kept) - set(found))
            blocks += edge > 0 and len(html_extract.blocks_of(html))
    assert wrong[html_extract.EDGE] <= wrong[0] and wrong[html_extract.EDGE] < 0.03 * blocks and lost < 0.02 * blocks


def test_time_is_linear_in_depth():
    def took(n, unclosed):
        page = "<div>" * n + "deep text is found in here" + ("</p></section>" * n if unclosed else "</div>" * n)
        began = time.perf_counter()
        assert html_extract.blocks_of(page)
        return time.perf_counter() - began

    for unclosed in (False, True):
        assert took(40_000, unclosed) < 25 * max(took(4_000, unclosed), 0.01)
