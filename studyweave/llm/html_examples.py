"""Labelled pages for the block classifier: elements with data-keep="1" hold main text, the others do not.

Written for this library; the wording is invented. Each page becomes a few rows of the labelled table. Half of the
pages name their containers; the others are neutral boxes, made by rule, where only sizes, links and neighbours tell.
"""

import random

_LONG = "the river turns slowly past the old mill and the fields where people worked for many years before the bridge was built and trade moved on"
_MID = "they met again in spring and spoke about the harvest and the road"
_SHORT = "a quiet morning"
_LINKS = "<li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>Contact us</a></li>"


def _page(body: str) -> str:
    return f"<html><head><title>{_SHORT}</title><style>p{{}}</style></head><body>{body}</body></html>"


def _article(*parts: str) -> str:
    return "".join(f"<p data-keep='1'>{p}</p>" for p in parts)


#: Around an article: what is never main text.
_BEFORE = [
    f"<nav><ul>{_LINKS}</ul></nav>",
    f"<header><div>{_SHORT}</div><ul>{_LINKS}</ul></header>",
    f"<div class='menu'><ul>{_LINKS}</ul></div>",
    f"<div class='ad'>{_MID}</div>",
    f"<div class='ad banner'>{_LONG}</div>",
    f"<div class='cookie-notice'><p>{_LONG}</p><button>OK</button></div>",
    f"<div id='breadcrumbs'><a href='/'>Start</a> &gt; <a href='/x'>Texts</a></div>",
    f"<div role='banner'>{_SHORT}</div>",
    f"<ul>{_LINKS}</ul>",
    f"<p><a href='/a'>Home</a> | <a href='/b'>News</a></p>",
    f"<form><label>{_SHORT}</label><input><p>{_MID}</p></form>",
]
_AFTER = [
    f"<footer>&copy; example &middot; {_MID}</footer>",
    f"<footer><p>{_LONG}</p><ul>{_LINKS}</ul></footer>",
    f"<aside><h3>{_SHORT}</h3><p>{_MID}</p></aside>",
    f"<div class='sidebar'><p>{_LONG}</p></div>",
    f"<section id='comments'><h2>Comments</h2><div class='comment'><p>{_LONG}</p></div><div class='comment'><p>{_SHORT}</p></div></section>",
    f"<div class='related'><ul>{_LINKS}</ul></div>",
    f"<div class='newsletter'><form><p>{_MID}</p></form></div>",
    f"<ul>{_LINKS}</ul><p>&copy; example</p>",
    f"<div class='share-buttons'><a href='#'>Share</a> <a href='#'>Post</a></div>",
    f"<p><a href='/1'>{_MID}</a></p><p><a href='/2'>{_MID}</a></p>",
]
_MAIN = [
    "<article><h1 data-keep='1'>" + _SHORT + "</h1>" + _article(_LONG, _MID, _LONG) + "</article>",
    "<article><h1 data-keep='1'>" + _MID + "</h1>" + _article(_SHORT, _LONG + " " + _LONG) + "</article>",
    "<main><h1 data-keep='1'>" + _SHORT + "</h1>" + _article(_LONG, _SHORT, _MID) + "</main>",
    "<div class='post-content'><h2 data-keep='1'>" + _SHORT + "</h2>" + _article(_MID, _LONG, _SHORT) + "</div>",
    "<article>" + _article(_SHORT) + "</article>",
    "<article>" + _article(_SHORT, "<a href='/z'>" + _SHORT + "</a>", _SHORT) + "<ul><li data-keep='1'>" + _SHORT + "</li><li data-keep='1'>" + _MID + "</li></ul></article>",
    "<div><h1 data-keep='1'>" + _MID + "</h1>" + _article(_LONG, _LONG, _MID, _LONG) + "</div>",
    "<div>" + _article(_LONG + " <a href='/q'>" + _SHORT + "</a> " + _LONG, _LONG) + "</div>",
    "<main><article><h1 data-keep='1'>" + _SHORT + "</h1>" + _article(_LONG) + "<div class='ad'>" + _LONG + "</div>" + _article(_LONG) + "<div class='comments'><p>" + _LONG + "</p></div></article></main>",
    "<article><header><h1 data-keep='1'>" + _SHORT + "</h1></header>" + _article(_MID, _LONG) + "<aside><p>" + _LONG + "</p></aside><table><tr><td data-keep='1'>" + _SHORT + "</td></tr></table></article>",
]


#: Pages of neutral markup, and pages whose boxes are named, made by rule.
NEUTRAL = 320
NAMED = 320
_FRAMES = ["<nav>", "<aside>", "<footer>", "<form>", "<header>", "<div class='ad'>", "<div class='cookie-notice'>", "<div id='sidebar'>", "<section class='comments'>", "<div class='related'>"]
_BODIES = ["<article>", "<main>", "<div class='entry-content'>"]
_WORDS = (_LONG + " " + _MID).split()


def _made(rng: random.Random, named: bool) -> str:
    """A page of plain boxes: menus, teasers, prose with headings and captions, link lists, closing lines; or, if
    named, of a marked body with marked frames of any size before, in and after it."""

    def words(low: int, high: int) -> str:
        return " ".join(rng.choices(_WORDS, k=rng.randint(low, high)))

    def box(text: str, tag: str = "div") -> str:
        return f"<{tag} class='c{rng.randint(1, 99)}'>{text}</{tag}>"

    def link(low: int = 1, high: int = 4) -> str:
        return f"<a href='/{rng.randint(1, 999)}'>{words(low, high)}</a>"

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"

    def kept(text: str, tag: str = "p") -> str:
        return f"<{tag} data-keep='1'>{text}</{tag}>"

    def prose(n: int) -> list[str]:
        out = []
        for _ in range(n):
            kind = rng.random()
            if kind < 0.5:
                out.append(kept(words(20, 120)))
            elif kind < 0.65:
                out.append(kept(f"{words(10, 40)} {link(1, 5)} {words(5, 40)}"))
            elif kind < 0.8:
                out.append(kept(words(1, 12)))  # a caption, a line of a dialogue
            elif kind < 0.9:
                out.append(kept(words(1, 8), "h2") + kept(words(15, 80)))
            else:
                out += [kept(words(2, 9), rng.choice(["p", "div", "li"])) for _ in range(rng.randint(2, 6))]  # verses, points
        return out

    if named:

        def frames(most: int, kinds: list[str] = _FRAMES) -> str:
            return "".join(_closed(rng.choice(kinds), rng.choice([links(rng.randint(1, 6)), f"<p>{words(1, 8)}</p>", f"<p>{words(4, 90)}</p>", f"<h3>{words(1, 4)}</h3><p>{words(1, 40)}</p>"])) for _ in range(rng.randint(0, most)))

        body = [*prose(rng.randint(1, 6)), *([kept(link(1, 9))] if rng.random() < 0.3 else []), *[kept(words(1, 3)) for _ in range(rng.randint(0, 2))]]
        rng.shuffle(body)
        body = ([kept(words(1, 14), "h1")] if rng.random() < 0.6 else []) + body
        body.insert(rng.randint(0, len(body)), frames(1, [f for f in _FRAMES if f != "<header>"]))  # an article's own header is text
        return _page(frames(3) + _closed(rng.choice(_BODIES), "".join(body)) + frames(3))

    top = []
    if rng.random() < 0.8:
        top.append(box(links(rng.randint(3, 8))) if rng.random() < 0.7 else box(" | ".join(link() for _ in range(rng.randint(3, 9)))))
    if rng.random() < 0.4:
        top.insert(rng.randint(0, len(top)), box(words(1, 5)) + links(rng.randint(2, 5)))  # a site's name over its menu
    body = ([kept(words(1, 10), "h1")] if rng.random() < 0.85 else []) + prose(rng.randint(1, 9))
    end = []
    if rng.random() < 0.5:  # teasers: a linked line, a short text, a link to the rest
        end.append("".join(f"<h3>{link(3, 8)}</h3><p>{words(6, 18)}</p><p>{link(1, 3)}</p>" for _ in range(rng.randint(2, 4))))
    if rng.random() < 0.6:
        end.append(f"<h3>{words(1, 4)}</h3>" + links(rng.randint(3, 7)))
    if rng.random() < 0.3:
        end.append(f"<p>{' '.join(link(1, 2) for _ in range(rng.randint(4, 12)))}</p>")
    if end and rng.random() < 0.6:
        end.append(box(words(2, 8)))  # who runs the site
    return _page("".join(top + body + end))


def _closed(tag: str, inner: str) -> str:
    return f"{tag}{inner}</{tag[1:-1].split()[0]}>"


def labelled_pages() -> list[str]:
    """Every main part with every surrounding, and the pages made by rule."""
    rng, n = random.Random(11), max(len(_BEFORE), len(_AFTER))
    named = [_page(_BEFORE[(i + k) % len(_BEFORE)] + _BEFORE[(i + 3 * k + 1) % len(_BEFORE)] + main + _AFTER[(i + k) % len(_AFTER)] + _AFTER[(2 * i + k + 1) % len(_AFTER)]) for k, main in enumerate(_MAIN) for i in range(n)]
    return named + [_made(rng, False) for _ in range(NEUTRAL)] + [_made(rng, True) for _ in range(NAMED)]
