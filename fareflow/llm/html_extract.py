"""Operator 2: main text of web pages by tag-path ratios.

A page is read once into text blocks, each with the path of structural tags
from the root to it.  Text length (without links) and punctuation are
aggregated per path and divided by the path's blocks.  Both ratios are
smoothed along the page among blocks of one parent, fused, and compared with a
share of their deviation over the page: paths whose fused ratio stays below it
are left out, unless they are headings or other prose inside the same element
as content.  Elements that say what they are (menus, footers, adverts,
forms, comments ...) take no part; a declared article or main part raises the
fused ratio of the paths inside it, which are judged like all others.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_batches, whole_text

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script|style|noscript|template|iframe|object|svg|math|canvas|audio|video|textarea|select|title|xmp"
_INLINE = frozenset(("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small "
                     "span strike strong sub sup time tt u var label").split())
_CLOSES_P = frozenset(("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                       "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul").split())
_SIBLINGS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
             "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
             "option": (("option",), ("select",)), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
             "tfoot": (("thead", "tbody", "tr", "td", "th"), ("table",))}
# What is no part of an article, by element, role, and word of a class or id.
_LEFT_OUT = frozenset("nav aside footer form menu dialog button fieldset input datalist head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_HINTS = frozenset((
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead banner ad ads adv advert adverts "
    "advertisement advertising adsbygoogle sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond reply replies widget widgets pagination pager toolbar copyright legal disclaimer search "
    "form paywall teaser teasers adslot adbox adunit adsense cookiebar cookiebanner sidemenu submenu topnav sitenav mainnav "
    "leaderboard outbrain taboola sitemap").split())
_CONTENT_HINTS = frozenset("article post entry content story main body text".split())
# Hints that a content word beside them cancels; first words of names that say what is beside an element.
_WEAK_HINTS = frozenset("header widget widgets".split())
_MODIFIERS = frozenset("has with no without is".split())
_DECLARED = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    rf"|<(?P<raw>{_RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_BEGUN = re.compile(r"<[a-zA-Z/!?]")
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|\b(hidden)\b""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡\"“”«»()]")
#: Share of the deviation that a path's fused ratio must reach; weights of a block's neighbours.
THRESHOLD, KERNEL = 0.4, (0.25, 0.5, 0.25)
#: What the fused ratio of a path inside a declared article or main part is multiplied by.
DECLARED_WEIGHT = 1.5


def _says(tag: str, attrs: str, declared: bool) -> bool:
    """Whether an element is marked as no part of the article."""
    if tag in _LEFT_OUT or tag == "header" and not declared:
        return True
    if not attrs or attrs.isspace() or tag in ("html", "body") or tag in _DECLARED:
        return False
    names: list[str] = []
    for key, a, b, c, hidden in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if hidden or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key in ("class", "id"):
            names += value.split()
    return _named_out(names)


def _named_out(names: list[str]) -> bool:
    """Whether class names or an id say that an element is no part of the
    article.  In a compound of a hint and a content word the outer words count:
    ``post-comments`` and ``comment-body`` are comments.  A name that speaks
    of content only cancels plain hints (``content sidebar-right``), and names
    such as ``has-sidebar`` say what is beside the element."""
    plain = compound = content = weak = any_content = False
    for name in names:
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or words[0] in _MODIFIERS:
            continue
        says_content = not _CONTENT_HINTS.isdisjoint(words)
        any_content |= says_content
        weak |= not _WEAK_HINTS.isdisjoint(words)
        strong = [w in _HINTS and w not in _WEAK_HINTS for w in words]
        if not any(strong):
            content |= says_content
        elif not says_content:
            plain = True
        elif strong[0] or strong[-1]:
            compound = True
    return compound or plain and not content or weak and not any_content


class Outline:
    """The paths of structural tags of a page as a tree of numbers: a path is
    its parent's number and its last tag; 0 is the empty path, and a parent
    comes before its children."""

    def __init__(self):
        self.parent, self.tag, self._number = [0], [""], {}

    def child(self, path: int, tag: str) -> int:
        n = self._number.get((path, tag))
        if n is None:
            n = self._number[path, tag] = len(self.tag)
            self.parent.append(path)
            self.tag.append(tag)
        return n


def blocks(page: str) -> tuple[Outline, list[tuple[int, bool, str, int]]]:
    """The outline and (path, in a declared article, text, code points in
    links) of the text blocks that no element excludes, in page order."""
    outline = Outline()
    out: list[tuple[int, bool, str, int]] = []
    stack: list[tuple[str, int, bool, bool]] = []         # open elements: tag, path above, whether it excludes, declares
    open_at: dict[str, list[int]] = {}                    # their places in the stack, by tag
    path = 0                                              # of structural tags
    left_out = declared = links = 0                       # how many open elements exclude, declare, link
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(held).split())
        if text:
            out.append((path, declared > 0, text, linked))
        held.clear()
        linked = 0

    def nearest(tags: tuple[str, ...]) -> int:
        """Place of the innermost open element with one of ``tags``; -1: none."""
        return max((at[-1] for t in tags if (at := open_at.get(t))), default=-1)

    def close(depth: int) -> None:
        nonlocal left_out, declared, links, path
        if stack[depth][1] != path:                       # a structural element ends
            flush()
        path = stack[depth][1]
        while len(stack) > depth:
            tag, _, excludes, declares = stack.pop()
            open_at[tag].pop()
            left_out -= excludes
            declared -= declares
            links -= tag == "a"

    # past the last ">" no markup is complete: what begins there is cut off, and the text before it stays
    last = page.rfind(">") + 1
    cut = _BEGUN.search(page, last)
    for m in _TOKEN.finditer(page[: cut.start() if cut else len(page)]):
        text = m["text"] or m["cdata"]
        if text is not None:
            if not left_out:
                text = html_lib.unescape(text) if m["cdata"] is None and "&" in text else text
                held.append(text)
                linked += len(text) if links else 0
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue                                      # a comment, a declaration, or raw content
        tag = tag.lower()
        if m["end"] or m["end2"]:
            at = nearest((tag,))
            if at >= 0:
                close(at)
            elif tag not in _INLINE:
                flush()
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if tag in _CLOSES_P and (at := nearest(("p",))) >= 0:
            close(at)
        if tag in _SIBLINGS:
            ends, within = _SIBLINGS[tag]
            if (at := nearest(ends)) > nearest(within):
                close(at)
        if tag in _VOID:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if attrs.endswith("/") and tag not in _INLINE and tag not in _CLOSES_P:
            continue
        excludes, declares = _says(tag, attrs, declared > 0), tag in _DECLARED
        if excludes and tag in _INLINE:
            flush()
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, path, excludes, declares))
        if tag not in _INLINE:
            path = outline.child(path, tag)
        left_out += excludes
        declared += declares
        links += tag == "a"
    flush()
    return outline, out


def _smooth(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Weighted mean of each value and its neighbours, among runs of blocks with one parent."""
    border = np.concatenate([[True], groups[1:] != groups[:-1], [True]])
    before, after = np.concatenate([values[:1], values[:-1]]), np.concatenate([values[1:], values[-1:]])
    return (KERNEL[0] * np.where(border[:-1], values, before) + KERNEL[1] * values + KERNEL[2] * np.where(border[1:], values, after))


def _keep_company(keep: np.ndarray, outline: Outline, prose: np.ndarray) -> None:
    """What stands in one element with content paths is content too, unless
    it is mostly links: headings of the same parent, and all that the element
    holds if it is not the page itself."""
    home = np.zeros(len(keep), bool)
    home[np.array(outline.parent)[keep]] = True
    inside = [False] * len(keep)                          # in an element that holds content paths
    for path in range(1, len(keep)):
        up = outline.parent[path]
        inside[path] = inside[up] or bool(home[up]) and up > 0 and outline.tag[up] not in ("html", "body")
    for path in np.flatnonzero(prose & ~keep).tolist():
        keep[path] = inside[path] or home[outline.parent[path]] and outline.tag[path] in _HEADINGS


def main_text(page: str) -> str:
    """Text blocks of the content paths, joined by line feeds."""
    outline, found = blocks(page)
    if not found:
        return ""
    n = len(outline.tag)
    path = np.array([f[0] for f in found])
    count = np.maximum(1, np.bincount(path, minlength=n))
    length = np.bincount(path, [max(0, len(t) - k) for _, _, t, k in found], n) / count
    marks = np.bincount(path, [len(_PUNCTUATION.findall(t)) for _, _, t, _ in found], n) / count
    parents = np.array(outline.parent)[path]
    fused = _smooth(length[path], parents) * np.sqrt(_smooth(marks[path], parents) + 0.25)
    of_path = np.bincount(path, fused, n) / count
    declared, used = np.zeros(n, bool), np.zeros(n, bool)
    declared[path[[f[1] for f in found]]] = True
    used[path] = True
    keep = used & (of_path * np.where(declared, DECLARED_WEIGHT, 1.0) >= THRESHOLD * fused.std())
    whole = np.bincount(path, [len(t) for _, _, t, _ in found], n) / count
    _keep_company(keep, outline, used & (length >= 0.5 * whole))
    return "\n".join(f[2] for f, p in zip(found, path) if keep[p])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: id, url, ``text``, ``n_chars`` (its code points), then the columns ``keep``.

    Null and empty pages have an empty text; markup that is cut off or not
    closed is read as far as it goes; repeated rows keep a row each; an empty
    table gives an empty result; further columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fareflow.llm.html_extract import main_text

        for b in batches:
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *b.columns[3:]],
                [id_col, url_col, "text", "n_chars", *keep])

    rows = pages.select(F.col(id_col), F.col(url_col), whole_text(html_col).alias("html"), *keep)
    kind = {f.name: f for f in rows.schema.fields}
    schema = StructType([kind[id_col], kind[url_col], StructField("text", StringType()), StructField("n_chars", LongType()),
                         *[kind[k] for k in keep]])
    return map_batches(rows, run, schema)
