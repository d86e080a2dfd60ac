"""The labelled table that the block tree is trained on: small page layouts of many kinds.

In a layout ``t40`` stands for forty words of text, ``b3`` for three words of boilerplate; ``u8`` and ``n8`` are text and boilerplate with
words that notices have. A block has the label of its first mark. Some layouts are written by hand and count at several lengths; the others are put together at random, always the same, from
frames, articles in many kinds of elements, teasers, comments and notices. Every third of those is held out: the tree never sees it.
"""

from __future__ import annotations

import random
import re

_BY_HAND: tuple[str, ...] = (
    # plain articles, with and without a heading, in one column
    "<nav><ul><li><a>b1</a><li><a>b1</a><li><a>b2</a></ul></nav><div class=ad>b7</div><article><h1>t8</h1><p>t40<p>t30<p>t55</article><footer>b9</footer>",
    "<nav><a>b2</a></nav><article><h1>t6</h1><p>t25</p><p>t2</p><p>t60</p></article><footer><p>b20</p><a>b3</a></footer>",
    "<article><h1>t3</h1><p>t1<p>t70<p>t45</article><footer>b12</footer>",
    "<article><h1>t1</h1></article><footer>b5 <a>b2</a></footer>",
    "<article><p>t12</p></article>",
    "<header><a>b2</a><p>b6</p></header><article><h1>t9</h1><p>t80<p>t35<h2>t4</h2><p>t50</article><aside><p>b30<p>b15</aside>",
    "<article><h1>t7</h1><p>t45</p><ul><li>t5<li>t9<li>t14</ul><p>t33</p></article><footer><a>b1</a><a>b1</a></footer>",
    "<main><h1>t5</h1><p>t40</p><blockquote>t22</blockquote><p>t40</p></main><footer>b15</footer>",
    "<main><p>t35</p><p>t20 <a>t6</a> t4</p><p><a>t4</a> t16</p><pre>t12</pre></main>",
    "<article><h1>t6</h1><p>t30 <a>t3</a></p><p><a>t7</a></p><p>t44</p></article><nav><a>b4</a><a>b5</a></nav>",
    "<article><h1>t6</h1><p>t3 <a>t9</a></p><p>t44</p><table><tr><td>t2<td>t1<td>t3<tr><td>t1<td>t1<td>t2</table></article>",
    "<article><h1>t2</h1><p>t3</p><p><a>t9</a></p><p>t2</p><ul><li><a>t3</a><li><a>t8</a><li><a>t2</a></ul></article><footer><a>b2</a></footer>",
    "<article><p><a>t2</a></p><p>t1</p><p>t40</p><p>t2</p><p><a>t12</a></p></article><div><a>b9</a></div>",
    "<main><p><a>t3</a></p><p>t3</p><p><a>t1</a></p><p>t1</p><p>t28</p><p><a>t30</a></p><p><a>t2</a></p></main><nav><a>b3</a></nav>",
    "<article><p>t2 <a>t4</a></p><p><a>t20</a> t2</p><p>t3</p><p><a>t5</a></p><p>t3</p></article>",
    "<article><h1>t5</h1><p>t40</p><aside><p>b20</p><p>b60</p><a>b3</a></aside><p>t30</p><nav><a>b2</a><a>b9</a></nav><footer><p>b8</p></footer></article>",
    "<main><p>t50</p><form><p>b6</p><p>b20</p><p>b45</p></form><p>t44</p></main><form><p>b30</p></form>",
    "<article><p>t60</p><div role=complementary><p>b40</p></div><p>t20</p><footer>b30 <a>b2</a></footer></article>",
    "<article><header><h1>t6</h1><p>t12</p></header><p>t30</p><dialog>b9</dialog><p>t25</p></article>",
    "<form><article><h1>t4</h1><p>t30</p><p>t8</p></article></form>",
    # text around the article
    "<div>b3</div><p>b20</p><article><h1>t9</h1><p>t60<p>t40</article><p>b25</p><p>b40</p><div><a>b5</a></div>",
    "<p>b45</p><article><h2>t4</h2><p>t30<p>t30<p>t30</article><h3>b2</h3><p>b30</p><p>b55</p>",
    "<main><div><a>b1</a> <a>b1</a></div><article><h1>t8</h1><p>t50</p></article><h2>b2</h2><ul><li><a>b6</a><li><a>b8</a></ul></main>",
    # named boxes in and around the text
    "<article><h1>t5</h1><p>t50</p><div class=ad>b12</div><p>t40</p><div class=share><a>b1</a><a>b1</a></div><section class=comments><h3>b2</h3><p>b30<p>b60</section></article>",
    "<article><h1>t5</h1><p>t50</p><p>t20</p><div class=newsletter><p>b14</p><p>b25</p></div><p>t20</p></article>",
    "<div class=cookie-banner><p>b28</p><a>b1</a></div><div><h1>t6</h1><p>t40</p><p>t60</p></div><div id=comments><p>b35</p><p>b22</p><p>b70</p></div>",
    "<div class=sidebar><p>b40</p><ul><li><a>b3</a><li><a>b4</a></ul></div><div><p>t70</p><p>t20</p><p>t35</p></div>",
    "<div class=menu>b6</div><div class=alert>b16</div><p>t33</p><p>t15</p><p>t50</p><div class=related><p>b20</p><a>b6</a></div>",
    "<div class=promo>b50</div><p>t20</p><p>t45</p><div class=footer>b18</div>",
    "<h3>b1</h3><div class=comments><div>b12</div><div>b40</div><div>b6</div><div>b25</div></div>",
    # no landmarks at all: lengths and links decide
    "<div><a>b1</a></div><div><a>b2</a></div><div><a>b1</a></div><h1>t7</h1><div>t60</div><div>t30</div><div>t45</div><div><a>b2</a></div><div><a>b3</a></div>",
    "<div>b2</div><div><a>b1</a></div><div><a>b2</a></div><p>t30</p><p>t25</p><p>t80</p><div><a>b3</a></div><div><a>b2</a></div><div>b4</div>",
    "<p>t30</p><ul><li><a>b2</a><li><a>b4</a><li><a>b2</a></ul>",
    "<p>t12</p><p>t40</p>",
    "<h1>t5</h1><p>t18</p><p>t22</p><p>t26</p>",
    "<p>t90</p>",
    "<h2>t4</h2><p>t40</p><p>t3</p><p>t55</p><h2>t2</h2><p>t38</p>",
    "<p>t40</p><p><a>b2</a></p>",
    "<p>t50</p><p>t40</p><div><a>b3</a></div><div>b3 <a>b2</a></div>",
    "<p>t40</p><p>t25</p><p>t10 <a>t5</a></p><div><a>b8</a></div><div><a>b10</a></div><div><a>b7</a></div>",
    "<ul><li><a>b12</a><li><a>b9</a><li><a>b15</a><li>b2 <a>b11</a></ul><p>t45 <a>t4</a></p><p>t30</p>",
    "<div><a>b2</a> b1 <a>b2</a></div><div>b1 <a>b3</a></div><p>t65</p><p>t30</p><div>b1</div><div><a>b4</a></div>",
    "<div><a>b20</a></div><div><a>b30</a> b6</div><div><a>b25</a> b8</div><p>t40</p><p>t50</p>",
    "<table><tr><td><a>b2</a><td><a>b3</a></table><table><tr><td>t80<td>t5</table><p>t40</p><p><a>b1</a></p>",
    # forms, dialogs, page headers
    "<form><p>b3</p><p>b12</p><label>b2</label></form><p>t40</p><p>t30</p><form><p>b25</p><p>b50</p></form>",
    "<form><div><a>b2</a></div><div><a>b1</a></div><p>t90</p><p>t75</p><p>t110</p></form>",
    "<header><h1>b5</h1><p>b14</p></header><p>t45</p><p>t30</p><div role=dialog><p>b30</p></div><div role=contentinfo>b40</div>",
    "<aside><p>b60</p><p>b90</p></aside><p>t30</p><footer><p>b80</p></footer>",
    "<nav><p>b12</p><p>b45</p></nav><p>t50</p><div hidden><p>b60</p></div>",
)

#: Factors on the lengths of text and of boilerplate of the layouts by hand.
SCALES: tuple[tuple[float, float], ...] = ((1.0, 1.0), (2.5, 1.0), (0.6, 1.5), (1.4, 0.7))


def _scaled(layout: str, long: float, short: float) -> str:
    return re.sub(r"\b([tbn])(\d+)\b", lambda m: f"{m[1]}{max(1, round(int(m[2]) * (long if m[1] == 't' else short)))}", layout)


class _Maker:
    """Pages put together at random."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def n(self, least: int, most: int) -> int:
        """Small numbers more often than large ones."""
        return least + int((most - least) * self.r.random() ** 1.7)

    def some(self, chance: float) -> bool:
        return self.r.random() < chance

    def links(self, least: int = 2, most: int = 9, words: int = 4) -> str:
        items = [f"<a>b{self.n(1, words)}</a>" for _ in range(self.n(least, most))]
        kind = self.r.choice(("ul", "div", "p", "bare"))
        if kind == "ul":
            return f"<ul>{''.join(f'<li>{i}' + '</li>' * self.some(0.6) for i in items)}</ul>"
        return " ".join(items) if kind == "bare" else f"<{kind}>{' | '.join(items)}</{kind}>" if kind == "p" else "".join(f"<div>{i}</div>" for i in items)

    def head(self) -> str:
        out = []
        if self.some(0.3):
            out.append(self.r.choice(("<div class=cookie-banner>n{0} <a>b1</a></div>", "<div id=consent><p>n{0}</p></div>", "<p class=cookie-notice>n{0}</p>", "<div>n{0}</div>", "<p>n{0} <a>b2</a></p>")).format(self.n(8, 30)))
        if self.some(0.3):
            out.append(self.r.choice(("<header>{0}<p>b{1}</p></header>", "<div class=header>{0}<div>b{1}</div></div>", "<div id=masthead>b{1}</div>", "<header><p>b{1}</p></header>", "<div class=top-bar>{0}</div>")).format(self.links(1, 4), self.n(1, 9)))
        if self.some(0.7):
            # a closed frame, or one whose end tag is missing
            out.append(self.r.choice(("<nav>{0}</nav>",) * 4 + ("<div class=menu>{0}</div>", "<div>{0}</div>", "<ul class=navbar><li><a>b1</a><li><a>b2</a></ul>", "<div role=navigation>{0}</div>", "<nav>{0}")).format(self.links()))
        if self.some(0.25):
            out.append(self.advert())
        return "".join(out)

    def advert(self) -> str:
        return self.r.choice(("<div class=ad>b{0}</div>", "<div class='ads banner'><p>b{0}</p></div>", "<div class=sponsor-box><p>b{0}</p><a>b2</a></div>", "<div id=newsletter><p>n{0}</p></div>", "<div class=promo><h3>b3</h3><p>b{0}</p></div>", "<aside><p>b{0}</p></aside>")).format(self.n(3, 40))

    def side(self) -> str:
        return self.r.choice(("<aside><h3>b2</h3>{0}<p>b{1}</p></aside>", "<div class=sidebar>{0}<p>b{1}</p></div>", "<div class=related><h3>b2</h3>{0}</div>", "<div><h3>b2</h3>{0}</div>", "<div id=sidebar-right><p>b{1}</p>{0}</div>")).format(self.links(2, 6, 9), self.n(5, 60))

    def paragraphs(self, short: bool) -> str:
        """The text: paragraphs, titles, lists, quotes, tables, lines of links, with advertisements between them."""
        out = []
        for k in range(self.n(1, 9)):
            size = self.n(1, 8) if short else self.n(3, 110)
            kind = self.r.random()
            if kind < 0.62:
                out.append(f"<p>t{size}" + f" <a>t{self.n(1, 6)}</a> t{self.n(1, 5)}" * self.some(0.2) + "</p>" * self.some(0.75))
            elif kind < 0.68:
                out.append(f"<h2>t{self.n(1, 8)}</h2><p>t{size}</p>")
            elif kind < 0.74:
                out.append(f"<ul>{''.join(f'<li>t{self.n(1, 20)}' for _ in range(self.n(1, 6)))}</ul>")
            elif kind < 0.78:
                out.append(f"<blockquote>t{size}</blockquote>")
            elif kind < 0.82:
                out.append(f"<p><a>t{self.n(1, 14)}</a></p><p>t{size}</p>")
            elif kind < 0.86:
                out.append("<table>" + "".join(f"<tr>{''.join(f'<td>t{self.n(1, 4)}' for _ in range(3))}" for _ in range(self.n(1, 4))) + "</table>")
            elif kind < 0.9:
                out.append(f"<p class={self.r.choice(('footer', 'comment', 'notice', 'lead', 'related', 'alert'))}>t{size}</p>")
            elif kind < 0.94:
                out.append(f"<div>t{size}</div>")
            else:
                out.append(f"<h2>{self.r.choice(('t1', 't2'))}</h2><p>t{size}</p>")
            if self.some(0.08):
                out.append(f"<p>u{self.n(2, 30)}</p>")
            if k and self.some(0.07):
                out.append(self.advert())
            if k and self.some(0.04):
                out.append("<div class=share><a>b1</a><a>b1</a></div>")
        return "".join(out)

    def text(self, short: bool) -> tuple[str, bool]:
        """(the main text in its element, whether it is an article)."""
        body = self.r.choice(("<h1>t{0}</h1>", "<header><h1>t{0}</h1><p>t9</p></header>", "", "<h2>t{0}</h2>")).format(self.n(1, 12)) + self.paragraphs(short)
        if body.startswith("<header>") and self.some(0.4):
            body = body[8:].replace("</header>", "", 1)
        around = self.r.random()
        wrapper = self.r.choice(("content", "post", "entry-content", "modal-open", "related-article", "page has-sidebar", "story-menu", "ad-free", "text"))
        if around < 0.4:
            return (f"<article>{body}</article>", True) if not body.startswith("<header><h1>") or self.some(0.7) else (f"<main>{body}</main>", False)
        body = re.sub("</?header>", "", body)
        if around < 0.52:
            return f"<main>{body}</main>", False
        if around < 0.8:
            return f"<div class='{wrapper}'>{body}</div>", False
        if around < 0.88:
            parts = "".join(f"<section><h2>t{self.n(1, 6)}</h2>{self.paragraphs(short)}</section>" for _ in range(self.n(2, 4)))
            return f"<div>{body}{parts}</div>", False
        return body, False

    def after(self, article: bool, short: bool) -> str:
        out = []
        if self.some(0.2) and not short:
            kind = self.r.choice(("article", "article", "div", "li"))
            teasers = "".join(f"<{kind} class=teaser><h3><a>b{self.n(2, 8)}</a></h3><p>b{self.n(6, 22)}</p></{kind}>" if kind != "article" or self.some(0.5) else f"<article><p>b{self.n(6, 22)}</p></article>" for _ in range(self.n(2, 6)))
            out.append(teasers if kind == "article" else f"<div class=teasers>{teasers}</div>")
        if self.some(0.35) and not short:
            said = [f"b{self.n(2, 60)}" for _ in range(self.n(1, 6))]
            out.append(
                self.r.choice(
                    (
                        "<div class=comments><h3>b2</h3>{p}</div>",
                        "<section id=comments>{p}</section>",
                        "<h3>4 Comments</h3>{d}",
                        "<div><h3>Comments (3)</h3>{p}</div>",
                        "<ol class=commentlist>{l}</ol>",
                        "<div class=thread>{d}</div>",
                        "<section class=comments>{a}</section>",
                    )
                ).format(p="".join(f"<p>{x}</p>" for x in said), d="".join(f"<div>{x}</div>" for x in said), l="".join(f"<li>{x}" for x in said), a="".join(f"<article><p>{x}</p></article>" for x in said))
            )
        if self.some(0.3):
            out.append(self.side())
        if self.some(0.15):
            out.append(self.r.choice(("<form><label>b2</label><p>b{0}</p></form>", "<form><p>n{0}</p></form>", "<div role=dialog><p>b{0}</p></div>")).format(self.n(3, 30)))
        if self.some(0.75):
            out.append(self.r.choice(("<footer><p>b{0}</p>{1}</footer>", "<footer>n{0}</footer>", "<div class=footer>n{0} <a>b2</a></div>", "<div id=footer>{1}</div>", "<div>n{0}</div>", "<p>n{0}</p>", "<footer>b{0}")).format(self.n(2, 20), self.links(1, 4)))
        return "".join(out)

    def page(self) -> str:
        short = self.some(0.12)
        text, article = self.text(short)
        before = self.head() if not short or self.some(0.5) else ""
        side = self.side() if self.some(0.15) and not short else ""
        # a frame that is not closed before a text outside of any article leaves nothing to tell them apart by but their words
        whole = f"{before}{side}{text}{self.after(article, short)}"
        wrapper = self.r.choice(("", "", "<div>{}</div>", "<div class='page header-fixed'>{}</div>", "<body class=modal-open>{}</body>", "<div id=page class=modal-open>{}</div>"))
        return wrapper.format(whole) if wrapper else whole


def generated(many: int, seed: int) -> tuple[str, ...]:
    maker = _Maker(seed)
    return tuple(maker.page() for _ in range(many))


_MADE = generated(1500, 7)
#: What the tree is trained on, and what it is measured on.
LAYOUTS: tuple[str, ...] = tuple(_scaled(layout, *by) for by in SCALES for layout in _BY_HAND) + tuple(page for k, page in enumerate(_MADE) if k % 3 < 2)
HELD_OUT: tuple[str, ...] = tuple(page for k, page in enumerate(_MADE) if k % 3 == 2)
