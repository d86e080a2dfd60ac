"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks. Each has its word count and link density, those of the blocks before and after
it, its size against the page's largest plain block, and where it stands: within a landmark of the page's frame, under a name that
advertisements, menus or comments have, in the article with the most text or another one, in the box that holds most of the text, and whether its words are
those of notices. Landmarks that were never closed and names of wrappers count for nothing where they would hold the page's text. A decision
tree, trained on the blocks of the labelled layouts in ``html_layouts``, tells text from boilerplate; no single feature decides but as the tree says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import column
from .html_layouts import LAYOUTS

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|<[!?][^>]*+(?:>|\Z)|[^<]++|<", re.S)
_RAW = frozenset("script style noscript template svg math iframe object textarea select title".split())
#: Those that run to the end of the page where their end tag is missing.
_RAW_TO_END = frozenset("script style textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr head html body".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an element of the same kind ends.
_SIBLINGS = frozenset("p li dt dd tr td th option".split())
_FRAME = frozenset("nav footer aside button dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Names of boxes: as a whole class or id, as its first part, as its last part.
_NAMED = frozenset(
    "ad ads advert advertisement banner promo sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe sidebar menu nav navbar navigation footer header masthead topbar "
    "breadcrumb breadcrumbs share sharing social related recommended comment comments commentlist respond replies reply widget login signup pagination pager toc skip thread discussion reactions teaser teasers".split()
)
_FIRST = frozenset("ad ads advert sponsor sponsored cookie cookies consent gdpr comment comments commentlist disqus newsletter sidebar nav navbar menu breadcrumb breadcrumbs popup modal related share".split())
_LAST = frozenset("ad ads advert footer nav navbar menu comment comments newsletter breadcrumbs banner".split())
#: Names that mark a paragraph, a heading or an item by itself; others are names of the text's own parts there.
_OF_LINES = frozenset("ad ads advert advertisement sponsored promo cookie cookies consent gdpr newsletter breadcrumb breadcrumbs skip copyright".split())
_LINES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd blockquote pre figcaption figure caption".split())
#: Names of readers' words, which may be longer than the page's own.
_READERS = frozenset("comment comments commentlist respond replies reply disqus thread discussion reactions".split())
_HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
#: Headings of reader comments; those that tell a number are no titles of sections.
_COMMENTS = re.compile(r"\W*(\d*)\s*(?:reader |user )?(?:comments?|replies|responses|kommentare?|antworten|commentaires?|réponses|comentarios?|respuestas|comentários?|commenti)\s*(?:\(?(\d+)\)?)?\W*", re.I)
#: Words of notices.
_NOTICE = re.compile(r"\bcookies?\b|\bsubscribe|\bsign up\b|\bnewsletter|\ball rights reserved|©|\bcopyright\b|\bprivacy policy|\bterms of (?:use|service)", re.I)
_BOXES = frozenset("div section article main form aside".split())

Tree = tuple | int


class Block:
    """A run of text between tags: its words, the share of them in links, and what it stands in.

    ``marks`` are the numbers of the landmarks and named boxes around it, ``article`` that of the innermost article and ``box`` that of the innermost box (0: none).
    """

    __slots__ = ("text", "words", "density", "marks", "article", "in_main", "box", "notice")

    def __init__(self, text: str, words: int, density: float, marks: tuple, article: int, in_main: bool, box: int):
        self.text, self.words, self.density, self.marks, self.article, self.in_main, self.box = text, words, density, marks, article, in_main, box
        self.notice = words < 60 and _NOTICE.search(text) is not None


class Mark:
    """What a landmark or a name says of its element: frame is 2 in landmarks, 1 in forms, 0 for a name; ``share`` of the page's plain words from which on it is not believed."""

    __slots__ = ("frame", "share", "plain", "closed", "void")

    def __init__(self, frame: int, share: float):
        self.frame, self.share, self.plain, self.closed, self.void = frame, share, 0.0, False, False


class Page:
    """The blocks of a page in order, its marks, and for each article the one around it."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.marks: list[Mark] = []
        self.around: list[int] = [0]


def _name_of(value: str, line: bool) -> str | None:
    """The part of a class or id that names a box of the frame, if one does."""
    for name in value.lower().split():
        parts = name.replace("_", "-").split("-")
        if line:
            if name in _OF_LINES or len(parts) > 1 and (parts[0] in _OF_LINES or parts[-1] in _OF_LINES):
                return name
        elif name in _NAMED:
            return name
        elif len(parts) > 1 and parts[0] in _FIRST:
            return parts[0]
        elif len(parts) > 1 and parts[-1] in _LAST:
            return parts[-1]
    return None


def _marks_of(tag: str, attributes: str, in_text: bool) -> list[Mark]:
    """The marks that an element gives to what it encloses."""
    out = []
    if tag in _FRAME or tag == "header" and not in_text:
        out.append(Mark(2, 2.0))
    elif tag == "form":
        out.append(Mark(1, 2.0))
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            found = _name_of(value, tag in _LINES)
            if found:
                out.append(Mark(0, 0.9 if found in _READERS else 0.6))
        elif name == "role" and value.lower() in _ROLES or name == "style" and _HIDDEN.search(value) or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            out.append(Mark(2, 0.9))
    return out


def parse(html: str) -> Page:
    """The page's text blocks in order, with what they stand in."""
    page = Page()
    text: list[str] = []
    linked: list[str] = []
    # tag, marks, own marks, article, in main, box, blocks before it
    stack: list[list] = [["", (), (), 0, False, 0, 0]]
    link = 0  # depth of the stack where the open link began
    boxes = 0
    unclosed: set[str] = set()

    def mark(found: list[Mark]) -> tuple:
        page.marks.extend(found)
        return tuple(range(len(page.marks) - len(found), len(page.marks)))

    def close() -> None:
        body = " ".join(unescape("".join(text)).split()) if text else ""
        if body:
            tag, marks, _, article, in_main, box, _ = stack[-1]
            words = body.count(" ") + 1
            title = _COMMENTS.fullmatch(body) if tag in _HEADINGS else None
            # what follows in the element around such a heading are comments, if it tells their number or begins an element outside of the text
            if title and len(stack) > 1 and (title[1] or title[2] or not article and not in_main and stack[-2][0] and stack[-2][6] == len(page.blocks)):
                own = mark([Mark(0, 0.9)])
                stack[-1][1] = stack[-2][1] = marks = stack[-2][1] + own
            page.blocks.append(Block(body, words, min(1.0, len(unescape("".join(linked)).split()) / words), marks, article, in_main, box))
        text.clear()
        linked.clear()

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                if link:
                    linked.append(piece)
            continue
        tag, closes = tag.lower(), bool(m[1])
        if not closes and tag in _RAW and not m[3].endswith("/"):
            found = None if tag in unclosed else re.compile(rf"</{tag}(?![\w:-])[^>]*>", re.I).search(html, at)
            if found:
                at = found.end()
            elif tag in _RAW_TO_END:
                at = end
            else:
                unclosed.add(tag)
            text.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                link = 0 if closes else len(stack)
            elif tag == "br":
                text.append(" ")
            own = _marks_of(tag, m[3], True) if not closes and m[3] and tag in ("span", "label", "a") else ()
            if own:
                close()
                own = mark(own)
                stack.append([tag, stack[-1][1] + own, own, *stack[-1][3:6], len(page.blocks)])
            elif closes and stack[-1][0] == tag and len(stack) > 1:
                close()
                for k in stack.pop()[2]:
                    page.marks[k].closed = True
            continue
        close()
        if tag in _VOID:
            continue
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    for n in stack[k][2]:
                        page.marks[n].closed = True
                    del stack[k:]
                    break
        else:
            while len(stack) > 1 and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in _SIBLINGS or stack[-1][0] in ("td", "th") and tag in ("td", "th", "tr")):
                stack.pop()
            _, marks, _, article, in_main, box, _ = stack[-1]
            if tag == "h1" and not article and not in_main:  # what holds the page's heading is no box
                for n in marks:
                    page.marks[n].void |= not page.marks[n].frame
            if tag == "article":
                page.around.append(article)
                article = len(page.around) - 1
            in_main = in_main or tag == "main"
            if tag in ("article", "main"):  # forms and names of boxes around it are wrappers
                marks = tuple(n for n in marks if page.marks[n].frame == 2 or page.marks[n].share > 0.6)
            if tag in _BOXES:
                boxes += 1
                box = boxes
            own = mark(_marks_of(tag, m[3], bool(article) or in_main))
            stack.append([tag, marks + own, own, article, in_main, box, len(page.blocks)])
        if link > len(stack):
            link = 0
    close()
    return page


def _believed(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(frame, named) of each block, by the marks that can be believed: not those that were never closed, or name a wrapper, and hold most of the page's plain words."""
    plain = [b.words * (1 - b.density) for b in page.blocks]
    for b, w in zip(page.blocks, plain):
        for n in b.marks:
            page.marks[n].plain += w
    whole = sum(plain)
    for m in page.marks:
        if m.frame == 2:
            m.void |= m.plain >= (m.share if m.closed or m.share < 1 else 0.5) * whole > 0
    open_words = sum(w for b, w in zip(page.blocks, plain) if not any(page.marks[n].frame == 2 and not page.marks[n].void for n in b.marks))
    inside = dict.fromkeys(range(len(page.marks)), 0.0)
    for b, w in zip(page.blocks, plain):
        if not any(page.marks[n].frame == 2 and not page.marks[n].void for n in b.marks):
            for n in b.marks:
                inside[n] += w
    for n, m in enumerate(page.marks):
        if m.frame == 0:
            m.void |= inside[n] >= m.share * open_words > 0
    frame = [max((page.marks[n].frame for n in b.marks if not page.marks[n].void), default=0) for b in page.blocks]
    named = [any(page.marks[n].frame == 0 and not page.marks[n].void for n in b.marks) for b in page.blocks]
    return np.array(frame, float), np.array(named, float)


def _place(page: Page, plain: np.ndarray) -> np.ndarray:
    """Where each block stands by articles: 1 in one that has a third of the largest one's plain words at least and is not nested in a larger one, -1 in others and,
    if the largest is no less than half of any other box, around them; 0 where no article counts. Without articles the main element takes their place."""
    n = len(page.blocks)
    article = np.array([b.article for b in page.blocks])
    box = np.array([b.box for b in page.blocks])
    own = np.bincount(article, plain, len(page.around))
    outside = np.bincount(box[article == 0], plain[article == 0], 1).max(initial=0.0)
    if (article > 0).any():
        own[0] = 0
        top = own.max()
        good = own * 3 >= top
        for k in range(1, len(page.around)):
            up = page.around[k]
            while up and good[k]:
                good[k], up = own[up] < own[k], page.around[up]
        good[0] = False
        if 2 * top >= outside:
            return np.where(good[article], 1, -1)
        return np.where(article > 0, -1, 0)
    in_main = np.array([b.in_main for b in page.blocks])
    if in_main.any() and 2 * plain[in_main].sum() >= plain[~in_main].sum():
        return np.where(in_main, 1, -1)
    return np.zeros(n)


def features(page: Page) -> np.ndarray:
    """For each block: words and link density of its own, of the one before and of the one after (-1: none), frame, named, place by articles, whether its box
    holds half of the words of the box with the most plain words, its words in tenths of the largest plain block's, and whether it has words of notices."""
    n = len(page.blocks)
    out = np.full((n, 12), -1.0)
    if n:
        out[:, 0], out[:, 1] = [b.words for b in page.blocks], [b.density for b in page.blocks]
        out[1:, 2:4], out[:-1, 4:6] = out[:-1, :2], out[1:, :2]
        out[:, 6], out[:, 7] = _believed(page)
        plain = out[:, 0] * (1 - out[:, 1]) * (out[:, 6] < 2) * (out[:, 7] == 0)
        out[:, 8] = _place(page, plain)
        box = np.array([b.box for b in page.blocks])
        held = np.bincount(box, plain * (out[:, 8] >= 0))
        out[:, 9] = held[box] * 2 >= max(held.max(), 1e-9)
        out[:, 10] = np.ceil(10 * out[:, 0] / max(1.0, plain.max()))
        out[:, 11] = [b.notice for b in page.blocks]
    return out


def labelled_blocks(layouts: tuple[str, ...] = LAYOUTS) -> tuple[np.ndarray, np.ndarray]:
    """(features, 1 for text) of the blocks of layouts. Marks ``n`` and ``u`` stand for boilerplate and text with words of notices."""
    rows, labels = [], []
    for layout in layouts:

        def words(m: re.Match) -> str:
            notice = m[1] in "nu"
            return " ".join(["tword" if m[1] in "tu" else "bword"] * max(1, int(m[2]) - notice) + ["newsletter"] * notice)

        found = parse(re.sub(r"\b([tbnu])(\d+)\b", words, layout))
        rows.append(features(found))
        labels += [int(b.text.startswith("tword")) for b in found.blocks]
    return np.concatenate(rows), np.array(labels)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 12) -> Tree:
    """A decision tree by Gini impurity: (feature, limit, tree for values up to the limit, tree above) or a class. Of equally good
    splits the last feature's least limit is taken. Each side of a split has ``least`` rows or more, so that no sliver between two values is learned by heart."""
    ones = int(y.sum())
    if depth == 0 or ones in (0, len(y)):
        return int(2 * ones >= len(y))
    best = None
    for f in range(x.shape[1] - 1, -1, -1):
        order = np.argsort(x[:, f], kind="stable")
        v, hit = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= least) & (len(y) - cut - 1 >= least)]
        if not len(cut):
            continue
        n, left = cut + 1.0, hit[cut].astype(float)
        impurity = left * (n - left) / n + (ones - left) * (len(y) - n - ones + left) / (len(y) - n)
        k = int(np.argmin(impurity))
        if best is None or impurity[k] < best[0] - 1e-9:
            best = impurity[k], f, float(v[cut[k]] + v[cut[k] + 1]) / 2
    if best is None:
        return int(2 * ones >= len(y))
    _, f, limit = best
    low = x[:, f] <= limit
    return f, limit, train_tree(x[low], y[low], depth - 1, least), train_tree(x[~low], y[~low], depth - 1, least)


@cache
def default_tree() -> Tree:
    return train_tree(*labelled_blocks())


def is_text(tree: Tree, x: np.ndarray) -> bool:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def main_text(html: str, tree: Tree) -> str:
    """The blocks that the tree takes for text, joined by newlines."""
    page = parse(html)
    return "\n".join(b.text for b, x in zip(page.blocks, features(page).tolist()) if is_text(tree, x))


def extract(pages: DataFrame, tree: Tree | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text, n_chars in code points) of every page.

    Null and empty html give an empty text. Null and repeated ids and repeated rows are rows like others, each answered for itself; columns
    not kept are ignored. Memory is a few times the longest page.
    """
    tree = default_tree() if tree is None else tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = column(batch, html_col)
            for lo in range(0, len(html), 500):
                texts = [main_text(h, tree) for h in html[lo : lo + 500].to_pylist()]
                part = batch.slice(lo, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), *(part.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, *keep, "text", "n_chars"])

    types = "".join(f"`{k}` {pages.schema[k].dataType.simpleString()}, " for k in keep)
    return pages.select(id_col, html_col, *keep).mapInArrow(run, f"{id_col} long, {types}text string, n_chars long")
