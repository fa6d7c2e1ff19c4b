"""Main text of web pages: flat text blocks, classified by a small decision tree.

Markup is flattened into blocks of text. A block is described by its word count and link density, those of the
blocks before and after it, and by what it lies in: a container of main text (article, main, content-like names), a
container of anything else (nav, footer, aside, form, names of adverts, notices, comments and the like), or a
heading. A decision tree fitted to the labelled table of :mod:`html_examples` keeps or drops it. Where a page names
its containers, these decide (names of states, such as no-sidebar, don't count, nor does a form around an article); on pages of neutral markup, words and links of the block and its neighbours do.

Defined cases: null and empty html give empty text; unclosed and crossing tags are tolerated; the content of
scripts, styles and the head is never text; <br> is white space; null page_ids and urls stay null; rows that repeat a
page_id stay separate; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, hand_back
from .html_examples import labelled_pages

# A quote in a tag ends at its next like, however far. Linear: quotes permute the states (outside, in ", in '), so of
# the tags tried and given up no more than three ever read the same character.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-zA-Z!?][^<>]*+>?", re.S)
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = frozenset("script style noscript template svg math iframe object embed canvas audio video select option textarea button head title map datalist".split())
_HIDDEN_END = {t: re.compile(f"</{t}\\b[^>]*>", re.I) for t in _HIDDEN}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FRAMES = frozenset("nav footer aside form fieldset dialog menu".split())
_BODY = frozenset("article main".split())
#: A frame that is but a form.
_FORM = 2
#: Parts of class and id names, and roles: fixed words that sites use for what is not, and what is, main text.
_NOT_TEXT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side|widget|footer|header|masthead|topbar|share|sharing|social|related|recommend(?:ed|ations)?|more-?stories|comments?|comment-?list|respond|replies|reply|disqus|discussion|pagination|pager|search|toolbar|skip-?link|complementary|contentinfo|search|alertdialog)(?:$|[\s_-])",
    re.I,
)
#: Names of a state or of what is missing (``no-sidebar``, ``comments-open``): they say nothing of what a container holds.
_STATE = re.compile(r"(?:no|not|has|have|with|without|is)[_-].*|.*[_-](?:open|opened|closed|enabled|disabled)", re.I)
#: Names that head or divide an article when they stand in one: its own header, a section on side effects or a discussion.
_PART = re.compile(r"(?:^|[\s_-])(?:header|discussion|side(?=-effects?\b))(?:$|[\s_-])", re.I)
_TEXT = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|article-?body|main|text)(?:$|[\s_-])", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_body", "in_frame", "heading")
#: Bounds of the tree: its depth, and the rows of the labelled table that a leaf stands for.
MAX_DEPTH = 8
LEAF_ROWS = 6


def blocks(page: str, marked: bool = False) -> list[tuple[str, int, int, int, int, int, int]]:
    """(text, words, linked words, in body, in frame, heading, label) of each block in page order.

    Labels are read from pages of the labelled table alone (``marked``); elsewhere they are 0.
    """
    out, parts, linked = [], [], 0
    stack: list[tuple[str, int, int, int]] = []  # tag, body, frame, label
    body = frame = label = heading = in_link = 0
    at, end = 0, len(page)

    def flush():
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            words = (html_lib.unescape(text) if "&" in text else text).split()
            if words:
                out.append((" ".join(words), len(words), min(linked, len(words)), body, frame, heading, label))
        parts, linked = [], 0

    while at < end:
        tag = _TAG.search(page, at)
        stop = tag.start() if tag else end
        if stop > at:
            piece = page[at:stop]
            parts.append(piece)
            if in_link:
                linked += len(piece.split())
        if not tag:
            break
        at = tag.end()
        name = tag[2]
        if not name:
            continue
        name, closing, raw = name.lower(), tag[1], tag[3] or ""
        if name == "br":
            parts.append(" ")
        elif name in _HIDDEN and name not in ("head", "map"):
            if not closing and not raw.endswith("/"):
                close = _HIDDEN_END[name].search(page, at)
                at = close.end() if close else (end if name in ("script", "style") else at)
        elif name in _INLINE:
            if name == "a":
                in_link = 0 if closing else 1
        else:
            flush()
            in_link = 0
            if name in _VOID:
                continue
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            else:
                if name == "p" and stack and stack[-1][0] == "p":
                    stack.pop()
                up = stack[-1] if stack else ("", 0, 0, 0)
                named_frame = False
                is_body, is_frame, mark = name in _BODY, name in _FRAMES or (name == "header" and not up[1]), up[3]
                if raw:
                    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
                    hint = " ".join(n for k in ("class", "id", "role") if k in named for n in named[k].split() if not _STATE.fullmatch(n))
                    if hint and name not in ("body", "html"):
                        other = _PART.sub(" ", hint) if up[1] and not up[2] else hint
                        named_frame = bool(_NOT_TEXT.search(other)) and not is_body
                        is_frame = is_frame or named_frame
                        is_body = is_body or (not is_frame and bool(_TEXT.search(hint)))
                    if "hidden" in named or "display:none" in named.get("style", "").replace(" ", ""):
                        is_frame = True
                    if marked and "data-keep" in named:
                        mark = int(named["data-keep"])
                # some servers wrap the whole page in a form: an article or main part within it is none of its fields
                framed = up[2] and not (name in _BODY and up[2] == _FORM)
                own = _FORM if name == "form" and not named_frame else 1
                stack.append((name, int(up[1] or is_body), framed or (own if is_frame else 0), mark))
            top = stack[-1] if stack else ("", 0, 0, 0)
            body, frame, label = top[1], int(top[2] > 0), top[3]
            heading = int(len(top[0]) == 2 and top[0][0] == "h" and top[0][1].isdigit())
    flush()
    return out


def features(rows: list[tuple]) -> np.ndarray:
    """One line of FEATURES per block."""
    x = np.zeros((len(rows), len(FEATURES)))
    if rows:
        words = np.array([r[1] for r in rows], float)
        links = np.array([r[2] for r in rows], float) / words
        x[:, 0], x[:, 1] = words, links
        x[1:, 2], x[1:, 3] = words[:-1], links[:-1]
        x[:-1, 4], x[:-1, 5] = words[1:], links[1:]
        x[:, 6:9] = np.array([r[3:6] for r in rows])
    return x


def grow(x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH):
    """A decision tree by Gini impurity: a leaf is 0 or 1, an inner node (feature, cut, low, high)."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = (share * (1 - share) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, below = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        p, q = below[:-1] / n, (below[-1] - below[:-1]) / (len(y) - n)
        cost = p * (1 - p) * n + q * (1 - q) * (len(y) - n)
        cost[(values[1:] == values[:-1]) | (n < LEAF_ROWS) | (len(y) - n < LEAF_ROWS)] = np.inf
        k = int(np.argmin(cost))
        if cost[k] < best[0]:
            best = (cost[k], f, (values[k] + values[k + 1]) / 2)
    if best[1] is None:
        return int(share >= 0.5)
    left = x[:, best[1]] <= best[2]
    low, high = grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)
    return low if low == high and isinstance(low, int) else (int(best[1]), float(best[2]), low, high)


@lru_cache(maxsize=1)
def trained():
    """The tree of the labelled table, fitted once on the driver; a few dozen nodes go to the tasks."""
    pages = [blocks(p, marked=True) for p in labelled_pages()]
    return grow(np.concatenate([features(p) for p in pages]), np.array([r[6] for p in pages for r in p]))


def decide(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), bool(tree))
    feature, cut, low, high = tree
    left = x[:, feature] <= cut
    out = np.empty(len(x), bool)
    out[left], out[~left] = decide(low, x[left]), decide(high, x[~left])
    return out


def main_text(page: str, tree=None) -> str:
    rows = blocks(page)
    keep = decide(trained() if tree is None else tree, features(rows))
    return "\n".join(r[0] for r, k in zip(rows, keep) if k)


def _extracted(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
            hand_back()

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extracted(trained()), "page_id long, url string, text string, n_chars long")
