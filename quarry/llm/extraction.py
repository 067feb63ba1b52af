"""Main-text extraction from HTML by gradient-boosted trees over DOM nodes, decoded along the tree.

Every element gets features: its tag's and attributes' meaning, depth, place among siblings, text and
link density of its subtree, punctuation, its parent's and siblings' statistics. Trees fitted
to generated pages with known main texts give each element's log odds of holding or being main text.
Decoding picks the best consistent choice: an element stays only if its parent does, so its worth is its own
log odds plus what its children are worth where that is positive, from the leaves up; then, from the
root down, what is worth nothing goes with all below it. A phrase of running text, such as a link in a sentence, is never worth less than
nothing, so a sentence stays or goes whole.

Nulls: a null or empty page has an empty text; a null id or url stays. Broken markup is closed as browsers
do in the common cases; nothing is dropped for size, and pages are read in one pass however long or deeply nested. Repeated
rows get one result each; equal choices (worth nothing either way) go. An empty table gives no rows; columns other than
``page_id``, ``url`` and ``html`` are ignored.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import BLOCK, RAW, Dom
from .trees import BoostedTrees

#: Elements whose text is never part of a page's main text, and what they share.
NEVER = frozenset({"head", "button", "select", "option", "input", "svg", "math", "canvas", "object"} | RAW)
#: Words of attributes and tags that speak for and against main text.
FOR = "article content main post entry body story text page blog news".split()
AGAINST = (
    "nav menu header footer sidebar aside ad ads advert advertisement sponsor sponsored promo banner cookie notice consent popup modal "
    "comment comments reply respond form search login signup newsletter subscribe share social related recommended breadcrumb crumbs "
    "pagination pager tag tags meta widget toolbar copyright legal skip"
).split()
_FOR = re.compile(rf"(?<![a-z])(?:{'|'.join(FOR)})(?![a-z])")
_AGAINST = re.compile(rf"(?<![a-z])(?:{'|'.join(AGAINST)})(?![a-z])")
_COMMENT = re.compile(r"(?<![a-z])(?:comments?|reply|replies|respond|discussion)(?![a-z])")
_SPACE = re.compile(r"\s+")
_MAIN_TAGS, _SIDE_TAGS = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "search"))
_LIST_TAGS, _HEADINGS = frozenset(("ul", "ol", "dl", "li", "table", "tr", "td")), frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks that hold running text.
_TEXT_TAGS = _HEADINGS | {"p", "li", "blockquote", "dd", "dt", "td", "th", "figcaption", "pre"}
N_FEATURES = 26


def node_features(dom: Dom) -> np.ndarray:
    """Features of all elements of a page, one row each."""
    n = len(dom.tags)
    chars, links, stops, words, nodes, paragraphs = ([0.0] * n for _ in range(6))
    own = [0.0] * n
    parents, tags = dom.parents, dom.tags
    depth, in_link, place, siblings = [0] * n, [False] * n, [0] * n, [0] * n
    fors, against, comment, up_against, up_for, skip = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for k in range(n):
        tag, up = tags[k], parents[k]
        if k:
            depth[k], in_link[k] = depth[up] + 1, in_link[up] or tag == "a"
            place[k] = siblings[up]
            siblings[up] += 1
            skip[k] = skip[up] or tag in NEVER
            a = dom.attributes[k].lower()
            if a:
                fors[k], against[k], comment[k] = (len(p.findall(a)) for p in (_FOR, _AGAINST, _COMMENT))
            fors[k] += tag in _MAIN_TAGS
            against[k] += tag in _SIDE_TAGS
            up_against[k], up_for[k] = up_against[up] + (against[up] > 0), up_for[up] + (fors[up] > 0)
            nodes[k], paragraphs[k] = 1.0, float(tag == "p")
    for k, text in dom.texts:
        if skip[k]:
            continue
        t = text.strip()
        size = float(len(t))
        own[k] += size
        chars[k] += size
        words[k] += t.count(" ") + bool(t)
        stops[k] += t.count(".") + t.count(",")
        if in_link[k]:
            links[k] += size
    for k in range(n - 1, 0, -1):
        up = parents[k]
        chars[up] += chars[k]
        links[up] += links[k]
        stops[up] += stops[k]
        words[up] += words[k]
        nodes[up] += nodes[k]
        paragraphs[up] += paragraphs[k]
    total = chars[0] or 1.0
    out = np.empty((n, N_FEATURES))
    for k in range(n):
        up = max(parents[k], 0)
        c, tag = chars[k], tags[k]
        out[k] = (
            c, own[k], c / total, c / (nodes[k] or 1.0), links[k] / (c or 1.0), stops[k] / (words[k] or 1.0), words[k], nodes[k], depth[k], place[k],
            (place[k] + 1) / (siblings[up] or 1), siblings[k], paragraphs[k], tag in _MAIN_TAGS, tag in _SIDE_TAGS, tag in _LIST_TAGS, tag in _HEADINGS, tag == "p",
            tag in BLOCK, fors[k], against[k], comment[k], up_against[k], up_for[k], c / (chars[up] or 1.0), links[up] / (chars[up] or 1.0),
        )
    return out


def in_sentences(dom: Dom) -> list[bool]:
    """Whether an element is a phrase of running text: inline, with no attribute that speaks against it, in a block with more text outside links than inside."""
    n = len(dom.tags)
    block, linked, apart = [0] * n, [False] * n, [False] * n
    plain, links = [0] * n, [0] * n
    for k in range(1, n):
        up, inline = dom.parents[k], dom.tags[k] not in BLOCK
        block[k] = block[up] if inline else k
        linked[k] = inline and (linked[up] or dom.tags[k] == "a")
        apart[k] = inline and (apart[up] or bool(dom.attributes[k] and _AGAINST.search(dom.attributes[k].lower())))
    for k, text in dom.texts:
        (links if linked[k] else plain)[block[k]] += len(text.strip())
    return [k > 0 and dom.tags[k] not in BLOCK and not apart[k] and dom.tags[block[k]] in _TEXT_TAGS and plain[block[k]] > links[block[k]] for k in range(n)]


def choose(dom: Dom, odds: np.ndarray) -> list[bool]:
    """The best choice in which an element stays only if its parent does, and a phrase of running text if its parent does."""
    n = len(dom.tags)
    worth = odds.tolist()
    worth[0] = 1e9
    for k, phrase in enumerate(in_sentences(dom)):
        if phrase:
            worth[k] = max(worth[k], 1e-3)
    for k in range(n):
        if dom.tags[k] in NEVER:
            worth[k] = -1e9
        elif dom.tags[k] in ("html", "body"):
            worth[k] = max(worth[k], 1.0)
    for k in range(n - 1, 0, -1):
        if worth[k] > 0:
            worth[dom.parents[k]] += min(worth[k], 1e6) if worth[dom.parents[k]] > -1e8 else 0
    stays = [True] * n
    for k in range(1, n):
        stays[k] = stays[dom.parents[k]] and worth[k] > 0
    return stays


def text_of(dom: Dom, stays: list[bool]) -> str:
    """Texts of the elements that stay: white space inside a block is one space, blocks are two line ends apart."""
    blocks, current = [], []

    def flush():
        if current:
            text = _SPACE.sub(" ", "".join(current)).strip()
            if text:
                blocks.append(text)
            current.clear()

    for kind, value in dom.events:
        if kind == "text":
            owner, text = dom.texts[value]
            if stays[owner]:
                current.append(text)
        elif dom.tags[value] in BLOCK:
            flush()
        elif dom.tags[value] == "br":
            current.append(" ")
    flush()
    return "\n\n".join(blocks)


class _Pages:
    """Generates pages of many layouts; ``data-label`` marks what is main text (1) and what is not (0)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = [a + b for a in "b c d f g l m n p r s t v st th".split() for b in "a e i o u an er on".split()]
        self.vocabulary = ["".join(self.r.choice(syllables) for _ in range(self.r.randint(1, 4))) for _ in range(3000)]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.vocabulary) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(4, 16).capitalize() + self.r.choice(".....!?,") for _ in range(self.r.randint(low, high)))

    def links(self, low: int, high: int) -> str:
        kind = self.r.random()
        items = [f'<a href="/{k}">{self.words(1, 3)}</a>' for k in range(self.r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if kind < 0.7 else " | ".join(items)

    def named(self, *names: str) -> str:
        """A class or id of one of the names, at times none."""
        pick = self.r.choice(names)
        if self.r.random() < 0.2:
            return ""
        return self.r.choice((f' class="{pick}"', f' id="{pick}"', f' class="{pick} wide"', f' class="site-{pick}"'))

    def off(self, body: str, tag: str, *names: str) -> str:
        return f'<{tag} data-label="0"{self.named(*names)}>{body}</{tag}>'

    def block(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.off(self.links(2, 9), r.choice(("nav", "div", "header")), "nav", "menu", "topmenu", "breadcrumb")
        if kind == "header":
            return self.off(f"<h1>{self.words(1, 3)}</h1>" * (r.random() < 0.5) + f"<p>{self.words(2, 6)}</p>" + self.links(1, 4), r.choice(("header", "div")), "header", "banner", "masthead header")
        if kind == "footer":
            return self.off(r.choice((f"&copy; 2020 {self.words(1, 3)} &middot; {self.sentences(1, 3)}", self.links(2, 6), f"<p>{self.words(3, 9)}</p>")), r.choice(("footer", "footer", "div")), "footer", "legal", "copyright")
        if kind == "ad":
            return self.off(r.choice((self.sentences(1, 3), f'<a href="http://x">{self.words(3, 9)}</a>', f"<p>{self.sentences(1, 2)}</p>")), r.choice(("div", "div", "aside", "section")), "ad", "ads", "advert", "sponsored", "promo")
        if kind == "side":
            return self.off(f"<h3>{self.words(1, 3)}</h3>" + r.choice((self.links(3, 8), f"<p>{self.sentences(1, 3)}</p>")), r.choice(("aside", "div")), "sidebar", "widget", "related", "aside")
        if kind == "notice":
            return self.off(f"<p>{self.sentences(1, 2)}</p><button>OK</button>", r.choice(("div", "section", "dialog")), "cookie-notice", "notice", "consent", "popup")
        if kind == "form":
            return self.off(f"<label>{self.words(1, 3)}</label><input><textarea>{self.words(0, 2)}</textarea><button>{self.words(1, 2)}</button>" + f"<p>{self.words(2, 8)}</p>" * (r.random() < 0.5), r.choice(("form", "form", "div")), "form", "search", "newsletter", "login")
        if kind == "share":
            return self.off(self.links(2, 5), "div", "share", "social", "tags")
        body = "".join(f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.sentences(1, 5)}</p></div>' for _ in range(r.randint(1, 6)))
        return self.off(f"<h3>{self.words(1, 2)}</h3>" * (r.random() < 0.6) + body, r.choice(("section", "div", "ol")), "comments", "discussion comments", "respond", "comment-list")

    def main(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(f"<h1>{self.words(2, 9)}</h1>")
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12))):
            kind = r.random()
            if kind < 0.62:
                text = self.sentences(1, 7) if r.random() < 0.8 else self.words(1, 4) + "."
                if r.random() < 0.3:
                    inner = r.choice(("{}", "{}", "<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "<code>{}</code>")).format(self.words(1, 3))
                    link = f'<a href="/x">{inner}</a>' if r.random() < 0.7 else r.choice(("<strong>{}</strong>", "<span>{}</span>")).format(inner)
                    text = f"{text} {link} <em>{self.words(1, 2)}</em>, {self.sentences(1, 2)}"
                out.append(r.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<div>{text}</div>")))
            elif kind < 0.7:
                out.append(f"<h2>{self.words(1, 6)}</h2>")
            elif kind < 0.78:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 12)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.84:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>")
            elif kind < 0.94:
                out.append(f"<p>{' | '.join(self.words(1, 1) for _ in range(r.randint(5, 30)))}</p>")
            else:
                out.append(self.block(r.choice(("ad", "share", "side", "notice", "form"))))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        top = [self.block(k) for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.5]
        last = [self.block(k) for k in ("comments", "side", "share", "ad", "form", "footer", "nav") if r.random() < 0.45]
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        names = self.named("content", "post", "entry-content", "article-body", "main", "story") if tag in ("div", "section") or r.random() < 0.3 else ""
        inner = f'<{tag} data-label="1"{names}>{self.main()}</{tag}>'
        inside = "".join(self.block(k) for k in ("comments", "share", "side") if r.random() < 0.2)
        if inside or r.random() < 0.3:
            inner = f'<{r.choice(("div", "main", "section"))}{self.named("page", "wrapper", "container", "main")}>{inner}{inside}</div>'
        side = [self.block("side")] if r.random() < 0.3 else []
        cut = r.choice(("</body></html>", "", "</body>"))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>" + "".join([*top, *side, inner, *last]) + cut


def labelled(dom: Dom) -> np.ndarray:
    """Labels of elements from the nearest mark above them: 1 for what holds main text, and for what is above it."""
    n = len(dom.tags)
    y, told = np.zeros(n), np.zeros(n, dtype=bool)
    for k in range(1, n):
        mark = [a for a in dom.attributes[k].split() if a in ("0", "1")][:1]
        up = dom.parents[k]
        y[k], told[k] = (float(mark[0]), True) if mark else (y[up], told[up])
    for k in range(n - 1, 0, -1):
        if y[k] == 1 and not told[dom.parents[k]]:
            y[dom.parents[k]] = 1
    return y


@lru_cache(maxsize=1)
def model(pages: int = 700, seed: int = 3) -> BoostedTrees:
    """Trees fitted to generated pages."""
    source, xs, ys = _Pages(seed), [], []
    for _ in range(pages):
        dom = Dom(source.page())
        y = labelled(dom)
        use = np.array([t not in NEVER and t not in ("#root", "html", "body") for t in dom.tags])
        xs.append(node_features(dom)[use])
        ys.append(y[use])
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def main_texts(pages: list[str], trees: BoostedTrees) -> list[str]:
    """Main texts of a lot of pages, their elements scored together."""
    doms = [Dom(p) for p in pages]
    features = [node_features(d) for d in doms]
    odds = trees.log_odds(np.concatenate(features)) if features else np.zeros(0)
    cuts = np.cumsum([len(d.tags) for d in doms])[:-1]
    return [text_of(d, choose(d, o)) for d, o in zip(doms, np.split(odds, cuts))]


def extracted(pages: DataFrame, lot: int = 256) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    trees = model()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, sources = [], batch.column(2)
            for start in range(0, len(sources), lot):
                texts += main_texts([s.as_py() or "" for s in sources[start : start + lot]], trees)
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return out.mapInArrow(run, "page_id long, url string, text string, n_chars long")
