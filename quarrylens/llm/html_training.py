"""Labelled pages for the page model: hand-made layouts whose content elements carry the attribute data-main.

A label is inherited by the element's children; data-side ends it (a share bar inside an article, say).
"""

from __future__ import annotations

import random

_WORDS = "river stone market letter garden winter story engine window paper silver morning people bridge music harbour field season council report history answer village teacher pattern number".split()


def _sentence(r: random.Random) -> str:
    words = [r.choice(_WORDS) for _ in range(r.randint(4, 18))]
    return " ".join(words).capitalize() + r.choice([".", ".", ".", ".", "!", "?", "", ","])


def _paragraphs(r: random.Random, tag: str = "p") -> str:
    out = []
    for _ in range(r.randint(1, 7)):
        body = " ".join(_sentence(r) for _ in range(r.choice([1, 1, 2, 3, 5, 9])))
        if r.random() < 0.3:
            body = f"<b>{_sentence(r)}</b> {body}"
        if r.random() < 0.2:
            body += f' <a href="/x">{r.choice(_WORDS)}</a> {_sentence(r)}'
        out.append(f"<{tag}>{body}</{tag}>")
    if r.random() < 0.25:
        out.insert(len(out) // 2, "<ul>" + "".join(f"<li>{_sentence(r)}</li>" for _ in range(3)) + "</ul>")
    if r.random() < 0.25:
        out.insert(1, f"<h2>{r.choice(_WORDS)} {r.choice(_WORDS)}</h2>")
    if r.random() < 0.15:
        out.append(f"<blockquote><p>{_sentence(r)}</p></blockquote>")
    if r.random() < 0.1:
        out.append(f"<table><tr><td>{_sentence(r)}</td><td>{r.choice(_WORDS)}</td></tr></table>")
    if r.random() < 0.1:
        out.append(f"<pre>{_sentence(r)}</pre><figure><figcaption>{_sentence(r)}</figcaption></figure>")
    return "".join(out)


def _links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.choices(_WORDS, k=n)) + "</ul>"


def _side(r: random.Random) -> str:
    words = lambda: " ".join(_sentence(r) for _ in range(r.randint(1, 3)))
    return r.choice(
        [
            lambda: f"<nav>{_links(r, r.randint(3, 8))}</nav>",
            lambda: f'<div class="{r.choice(["menu", "navbar", "nav-list", "breadcrumb", "pagination"])}">{_links(r, 4)}</div>',
            lambda: f'<div class="{r.choice(["ad", "ads", "advert", "advertisement", "ad-box", "banner", "sponsored", "promo"])}">{words()}</div>',
            lambda: f'<aside{r.choice(["", " class=side"])}><h3>{r.choice(_WORDS)}</h3><p>{words()}</p>{_links(r, 3)}</aside>',
            lambda: f'<div id="{r.choice(["sidebar", "side", "related", "widget", "rail"])}"><p>{words()}</p></div>',
            lambda: f'<div class="{r.choice(["cookie-notice", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay"])}"><p>{words()}</p><button>{r.choice(_WORDS)}</button></div>',
            lambda: f'<form action="/go"><label>{r.choice(_WORDS)}</label><input name="q"><p>{words()}</p><button>{r.choice(_WORDS)}</button></form>',
            lambda: f'<{(t := r.choice(["section", "div"]))} {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "replies", "discussion", "disqus"])}"><h3>{r.choice(_WORDS)}</h3><div class="comment"><p>{words()}</p></div><div class="comment"><p>{words()} {words()}</p></div></{t}>',
            lambda: f'<div class="{r.choice(["share", "social", "newsletter", "subscribe", "tags", "related-posts"])}">{words()}{_links(r, 2)}</div>',
            lambda: f"<div role=\"{r.choice(['navigation', 'banner', 'complementary', 'contentinfo', 'search', 'dialog'])}\"><p>{words()}</p></div>",
        ]
    )()


def labelled_page(r: random.Random) -> str:
    """One page; elements with data-main are content."""
    body = "<br>".join(_sentence(r) for _ in range(r.choice([1, 3, 30]))) if r.random() < 0.15 else _paragraphs(r)
    if r.random() < 0.2:
        body = r.choice([f"<p>{_sentence(r)}</p>", f"<p>{r.choice(_WORDS)}</p>", _sentence(r)]) if r.random() < 0.6 else f"<p>{' '.join(_sentence(r) for _ in range(60))}</p>"
    inner = f"<h1>{_sentence(r)}</h1>{body}" if r.random() < 0.7 else body
    for _ in range(r.choice([0, 0, 0, 1, 2, 3])):
        inner += _side(r).replace(">", " data-side>", 1)
    if r.random() < 0.1:
        inner = f'<header data-side class="site"><p>{_sentence(r)}</p></header>' + inner
    main = r.choice(
        [
            lambda: f"<article data-main>{inner}</article>",
            lambda: f"<article data-main>{inner}</article>",
            lambda: f"<article data-main>{inner}</article>",
            lambda: f'<main>{_side(r)}<article data-main class="post">{inner}</article></main>',
            lambda: f"<main data-main>{inner}</main>",
            lambda: f'<div class="{r.choice(["content", "article", "post-body", "entry-content", "story", "main-text", "article-body"])}" data-main>{inner}</div>',
            lambda: f'<div id="wrapper"><div id="{r.choice(["content", "main", "article", "body-text"])}" data-main>{inner}</div>{_side(r)}</div>',
            lambda: f"<section><article data-main><div>{inner}</div></article></section>",
        ]
    )()
    before = "".join(_side(r) for _ in range(r.randint(0, 3)))
    after = "".join(_side(r) for _ in range(r.randint(0, 3)))
    title = r.choice([f"<p>{_sentence(r)}</p>", f"<h1>{r.choice(_WORDS)}</h1>", f"<h1><a href=/>{r.choice(_WORDS)} {r.choice(_WORDS)}</a></h1>"])
    header = f"<header>{title}{_links(r, 3) if r.random() < 0.7 else ''}</header>" if r.random() < 0.5 else ""
    footer = f'<{(t := r.choice(["footer", "footer", "div"]))}{" class=footer" if t == "div" else ""}>&copy; {_sentence(r)} {_links(r, 2) if r.random() < 0.5 else ""}</{t}>' if r.random() < 0.9 else ""
    page = f"<!DOCTYPE html><html><head><title>{_sentence(r)}</title></head><body>{header}{before}{main}{after}{footer}</body></html>"
    return page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.1 else page


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    return [labelled_page(r) for _ in range(n)]
