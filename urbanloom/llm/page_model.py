"""The block classifier of html_extract: logistic regression on made-up pages whose main text is known.

``pages`` writes pages in many habits of markup (landmark elements, named or nameless containers, misleading names),
so the weights come from data, not from hand; ``fitted`` learns them and how often neighbouring blocks agree.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from functools import lru_cache

import numpy as np

#: Made-up pages that the classifier is fitted on, and the seed they are made from.
TRAIN_PAGES, TRAIN_SEED = 600, 1
RIDGE = 0.5
#: No block is surer than this, so that neighbours can always outvote it.
SUREST = 0.995
#: DOM distances from here on are alike.
FAR = 6


def _words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("aeiourstlnmdcp") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def _sentence(rng: random.Random, low: int, high: int) -> str:
    words = _words(rng, rng.randint(low, high))
    return " ".join(words).capitalize() + rng.choice(".....?!")


def _prose(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_sentence(rng, 4, 16) for _ in range(rng.randint(low, high)))


def _links(rng: random.Random) -> str:
    return "".join(f'<li><a href="/{k}">{" ".join(_words(rng, rng.randint(1, 4)))}</a></li>' for k in range(rng.randint(3, 9)))


def _inserted(rng: random.Random) -> str:
    """What stands between an article's paragraphs and is none of it."""
    return rng.choice([
        '<div class="ad">{}</div>', '<div class="advert"><p>{}</p></div>', "<aside><p>{}</p></aside>", '<form><p>{}</p><input></form>', '<form><label>{}</label></form>', '<div class="share">{}</div>',
        '<div class="social-share"><p>{}</p></div>', '<div class="notice"><p>{}</p></div>', '<div role="alert">{}</div>', '<div class="newsletter"><p>{}</p></div>', '<div class="related">{}</div>',
    ]).format(_sentence(rng, 2, 14))


def _inside(rng: random.Random, kept: list[str]) -> str:
    """Main text; every block goes to ``kept`` as well."""
    out = []
    cells = lambda n: [" ".join(_words(rng, rng.randint(1, 2))) if rng.random() < 0.5 else str(rng.randint(1, 9999)) for _ in range(n)]

    def keep(text: str, form: str) -> None:
        kept.append(text)
        out.append(form.format(text))

    keep(_sentence(rng, 3, 9)[:-1], "<h1>{}</h1>")
    for _ in range(rng.randint(1, 9)):
        if rng.random() < 0.12:
            out.append(_inserted(rng))
        kind = rng.random()
        if kind < 0.06:
            out.append("<table>")
            for _ in range(rng.randint(2, 6)):
                row = cells(rng.randint(2, 4))
                kept.append(" ".join(row))
                out.append("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>")
            out.append("</table>")
        elif kind < 0.1:
            out.append("<dl>")
            for _ in range(rng.randint(1, 4)):
                keep(" ".join(_words(rng, rng.randint(1, 3))), "<dt>{}</dt>")
                keep(_sentence(rng, 2, 12), "<dd>{}</dd>")
            out.append("</dl>")
        elif kind < 0.12:
            keep(_sentence(rng, 3, 9)[:-1], "<address>{}</address>")
        elif kind < 0.55:
            keep(_prose(rng, 1, 6), "<p>{}</p>")
        elif kind < 0.65:
            keep(_sentence(rng, 1, 4), "<p>{}</p>")
        elif kind < 0.75:
            keep(_sentence(rng, 2, 6)[:-1], "<h2>{}</h2>")
        elif kind < 0.82:
            keep(_prose(rng, 1, 2), "<blockquote>{}</blockquote>")
        elif kind < 0.9:
            out.append("<ul>")
            for _ in range(rng.randint(2, 5)):
                keep(_sentence(rng, 2, 10), rng.choice(["<li>{}</li>", "<li>{}</li>", '<li><a href="/x">{}</a></li>']))
            out.append("</ul>")
        elif kind < 0.95:
            keep(_prose(rng, 1, 3), f'<div class="{rng.choice(["story-share-count", "text-block", "row", "ad-free", "media-body", "x7"])}"><p>{{}}</p></div>')
        else:
            keep(_prose(rng, 1, 3), "<div>{}</div>")
    return "".join(out)


def page(rng: random.Random) -> tuple[str, list[str]]:
    """(html, its main blocks)."""
    pick, kept = rng.choice, []
    named = lambda tag, *names: f'<{tag} class="{pick(names)}">{{}}</{tag}>'
    nav = pick(["<nav><ul>{}</ul></nav>", "<header><ul>{}</ul></header>", "<ul>{}</ul>", "<div><ul>{}</ul></div>", named("div", "menu", "main-nav", "top-navigation", "navbar")]).format(_links(rng))
    masthead = pick(["<header><p>{}</p></header>", named("div", "header", "masthead", "site-header"), "<div>{}</div>"]).format(_sentence(rng, 2, 6))
    advert = pick([named("div", "ad", "adverts", "sponsored", "promo-banner"), named("section", "ad-slot", "promotion"), "<aside>{}</aside>"])
    notice = pick([named("div", "cookie-notice", "alert", "disclaimer"), '<div role="alert">{}</div>', named("p", "notice", "copyright", "consent-text")])
    side = pick(["<aside><p>{}</p><ul>{}</ul></aside>", '<div class="sidebar"><p>{}</p><ul>{}</ul></div>', '<div class="related-widget"><h3>{}</h3><ul>{}</ul></div>', "<div><h3>{}</h3><ul>{}</ul></div>"]).format(_sentence(rng, 2, 12), _links(rng))
    form = pick(["<form><p>{}</p><input></form>", '<div class="newsletter"><p>{}</p></div>', '<form><label>{}</label></form>', '<div class="subscribe-form">{}</div>']).format(_sentence(rng, 2, 9))
    remarks = "".join(pick(["<p>{}</p>", "<div><p>{}</p></div>", '<li><p>{}</p></li>', '<article class="comment"><p>{}</p></article>', "<article><p>{}</p></article>", '<div class="reply">{}</div>']).format(_prose(rng, 1, 3)) for _ in range(rng.randint(1, 5)))
    comments = pick(['<section id="comments"><h3>{}</h3>{}</section>', '<div class="comment-list"><h3>{}</h3>{}</div>', '<div class="discussion"><h4>{}</h4>{}</div>']).format(" ".join(_words(rng, 2)), remarks)
    footer = pick(["<footer>{}</footer>", "<footer><address>{}</address></footer>", "<footer><table><tr><td>{}</td></tr></table></footer>", "<footer><p>{}</p></footer>", named("div", "footer", "site-footer", "legal"), "<div><p>{}</p></div>"]).format("&copy; " + _sentence(rng, 2, 12))
    body = _inside(rng, kept)
    for extra in (advert.format(_sentence(rng, 3, 14)), side, form):
        if rng.random() < 0.15:
            body += extra
    if rng.random() < 0.15:
        body += comments
        comments = ""
    home = pick(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<main class="main search-results">{}</main>', '<article class="{0}">{{}}</article>'.format(pick(["post no-ads", "entry", "comment-open story"])), "<div>{}</div>", '<div class="content">{}</div>', '<div id="story-body">{}</div>', '<section>{}</section>', '<div class="col c8">{}</div>']).format(body)
    parts = [masthead if rng.random() < 0.6 else "", nav if rng.random() < 0.9 else "", advert.format(_sentence(rng, 3, 14)) if rng.random() < 0.6 else "", notice.format(_sentence(rng, 4, 20)) if rng.random() < 0.5 else ""]
    rng.shuffle(parts)
    after = [side if rng.random() < 0.6 else "", form if rng.random() < 0.4 else "", comments if rng.random() < 0.5 else "", footer if rng.random() < 0.9 else ""]
    start = pick(["<body>", '<body class="has-sidebar no-ads">', '<body class="page">'])
    wrap = pick(["{}", "{}", "<div>{}</div>", '<div class="wrapper has-menu">{}</div>'])
    return "<html><head><title>t</title></head>" + start + wrap.format("".join(parts) + home + "".join(after)) + "</body></html>", kept


def pages(n: int, seed: int) -> list[tuple[str, list[str]]]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]


def labels(blocks: list, kept: list[str]) -> list[bool]:
    """Which blocks are main text; a text that stands elsewhere as well is practically never made up twice."""
    main = set(kept)
    return [b.text in main for b in blocks]


@lru_cache(maxsize=1)
def fitted() -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(the classifier's weights, the log-odds that two neighbours agree by their distance in the DOM)."""
    from urbanloom.llm.html_extract import blocks_of, dom_distance, features, neighbours

    rows, truth, same = [], [], defaultdict(lambda: [1.0, 1.0])
    for html, kept in pages(TRAIN_PAGES, TRAIN_SEED):
        blocks = blocks_of(html)
        known = labels(blocks, kept)
        rows += features(blocks)
        truth += known
        for a, b in neighbours(blocks):
            same[min(FAR, dom_distance(blocks[a], blocks[b]))][known[a] == known[b]] += 1
    x, y = np.array(rows), np.array(truth, float)
    theta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(theta))
        theta -= np.linalg.solve(hessian, x.T @ (p - y) + RIDGE * theta)
    agree = [max(0.0, math.log(same[d][1] / same[d][0])) for d in range(FAR + 1)]
    return tuple(theta.tolist()), tuple(agree)
