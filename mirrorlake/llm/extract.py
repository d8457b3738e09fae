"""Operator 2: main text of HTML pages by minimum-cut labelling.

A page is read once into blocks (text between block-level tags) with what is known of each: open
elements, their class and id words, share of link text, words, punctuation. A linear classifier gives
each block a cost of being called boilerplate or content; these become the capacities to the two
terminals. Elements such as nav and footer mark all they hold. Class and id words are weaker evidence, which
a block can outweigh; they say nothing in body, main and article, in elements around the largest article (or
main, where there is no article), or in one within it (or in a page without either) that holds nearly all its words.

Smoothness edges follow the page's own tree: a block is tied to its element, the first child to its parent, each
child to the one before it. So neighbours pull each other over, the more the nearer they stand in the tree: a short
line between paragraphs stays, a sentence among menu entries goes. On a tree the maximum flow is found by passing
what a node has left over to the next one, as far as the edge's capacity goes, and the minimum cut by walking back,
so a page costs time in proportion to its length.

Scripts, styles, titles, forms' controls and comments in markup are never text. Character references are
decoded, white space inside a block becomes one space, blocks are joined by one line feed; a line break
element is white space.

Defined cases: null or empty html gives an empty text; broken markup (unclosed or stray tags, unclosed
scripts and comments) is read to the end; null ids and urls and repeated rows are passed through; very
long pages are read whole; an empty table gives an empty result; other columns are ignored.
"""

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: HTML elements by role.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select button object".split())
AWAY = frozenset("nav footer aside form menu dialog".split())
BODY = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id names that mark boilerplate or content.
AWAY_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer bottom colophon copyright legal sidebar aside rail widget widgets cookie cookies consent gdpr notice notification alert popup modal overlay "
    "comment comments commentlist reply replies respond disqus discussion reader form search login signin signup register newsletter subscribe subscription share sharing social "
    "related recommended recommendations more-stories pagination pager paging tags toolbar skip hidden paywall".split()
)
HEAD_WORDS = frozenset("header masthead".split())
BODY_WORDS = frozenset("article content main post entry story text body articlebody postbody entrycontent".split())

#: Comments, tags, tags with a quote that never ends, declarations.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

#: The classifier: log-odds of content.
W_BASE, W_WORDS, W_LINK, W_PARAGRAPH, W_SENTENCE = -2.2, 0.8, -6.0, 1.5, 0.5
W_BODY, W_BODY_WORD, W_OUTSIDE, W_AWAY, W_HEADING = 4.0, 2.0, -3.0, -16.0, 1.5
#: Within an element of an away word: this, and W_BODY does not count.
W_AWAY_WORD = -4.0
#: An element with this share of the words is the text itself, whatever its name.
NEARLY_ALL = 0.8
CLIP = 8.0
#: Capacities of the smoothness edges: block and element, first child and parent, neighbouring children.
TIE_IN, TIE_UP, TIE_NEAR = 2.0, 0.8, 1.2


def _words(attributes: str) -> set[str]:
    out = set()
    for m in _NAMES.finditer(attributes):
        out.update(x.lower() for x in _SPLIT.split(m[1] or m[2] or m[3] or "") if x)
    return out


def _named_away(elements: list[tuple[str, int, bool, bool]], words: list[float]) -> list[bool]:
    """Whether each element stands in one of an away word. elements: name, number of the parent (a lower one), away
    by its tag or that of an outer one, away word; words: of the blocks right in each."""
    total = [0.0 if e[2] else w for e, w in zip(elements, words, strict=True)]
    for k in range(len(total) - 1, 0, -1):
        total[elements[k][1]] += total[k]
    core = 0
    for kind in ("article", "main"):
        found = [k for k, e in enumerate(elements) if e[0] == kind and total[k] > 0]
        if found:
            core = max(found, key=total.__getitem__)
            break
    around, k = {0, core}, core
    while k:
        k = elements[k][1]
        around.add(k)
    out, inside = [False], [core == 0]
    for k, (name, up, _, word) in enumerate(elements[1:], 1):
        inside.append(inside[up] or k == core)
        word = word and name != "body" and name not in BODY and k not in around
        out.append(out[up] or (word and not (inside[k] and total[k] >= NEARLY_ALL * total[core])))
    return out


def blocks(page: str) -> tuple[list[tuple[str, float, int]], list[int], list[float]]:
    """(text, log-odds of content, node) of every block in page order, and the tree of elements and blocks: for each
    node the one that it is tied to, a lower one, and how strongly."""
    out: list[list] = []
    tied, ties, node_of, last = [-1], [0.0], [0], [-1]  # the last two by element: its node, its last child's
    # open elements: name, away by a tag, body, body word, number
    stack = [("", False, False, False, 0)]
    elements, held = [("", 0, False, False)], [0.0]
    count, link, parts, linked = 0, 0, [], 0
    has_body = False

    def node(parent, tie):
        before = last[parent]
        tied.append(node_of[parent] if before < 0 else before)
        ties.append(tie if before < 0 else TIE_NEAR)
        last[parent] = len(tied) - 1
        return last[parent]

    def close():
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            if text:
                name, away, body, word, number = stack[-1]
                links = min(1.0, linked / max(1, len(text)))
                held[number] += (text.count(" ") + 1) * (1 - links)
                out.append([text, name, away, body, word, node(number, TIE_IN), links, number])
            parts, linked = [], 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        ending, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not ending and not attributes.endswith("/"):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else n
            continue
        if name == "a":
            link = 0 if ending else 1
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            close()
            link = 0
            if ending:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name not in VOID:
                if stack[-1][0] in ("p", *HEADINGS):
                    stack.pop()
                if name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == name:
                    stack.pop()
                up = stack[-1]
                words = _words(attributes) if attributes else set()
                body = up[2] or name in BODY
                has_body |= body
                away = up[1] or name in AWAY or (name == "header" and not up[2])
                count += 1
                # the head of an article is part of it
                elements.append((name, up[4], away, any(w in AWAY_WORDS and not (up[2] and w in HEAD_WORDS) for w in words)))
                held.append(0.0)
                node_of.append(node(up[4], TIE_UP))
                last.append(-1)
                stack.append((name, away, body, up[3] or any(w in BODY_WORDS for w in words), count))
    close()
    named = _named_away(elements, held)
    done = []
    for text, name, away, body, word, at, links, number in out:
        odds = W_BASE + W_WORDS * math.log1p(min(text.count(" ") + 1, 200)) + W_LINK * links
        odds += W_PARAGRAPH * (name in ("p", "pre", "blockquote")) + W_SENTENCE * (text[-1] in ".!?:;\"'»”)")
        odds += W_BODY * (not named[number]) if body else W_OUTSIDE * has_body
        odds += W_AWAY_WORD * named[number] + W_BODY_WORD * word + W_AWAY * away + W_HEADING * (name in HEADINGS)
        done.append((text, max(-CLIP, min(CLIP, odds)), at))
    return done, tied, ties


def tree_cut(odds: list[float], tied: list[int], ties: list[float]) -> list[bool]:
    """True for the nodes on the source (content) side of a minimum cut of a tree, whose node k is tied to the lower
    node tied[k] with capacity ties[k]. Positive odds are capacities from the source, negative ones to the sink."""
    left = list(odds)
    for k in range(len(left) - 1, 0, -1):
        left[tied[k]] += max(-ties[k], min(ties[k], left[k]))
    out = [left[0] > 0] if left else []
    for k in range(1, len(left)):
        # more than its edge lets through stays where it is; all else goes with the node that it is tied to
        out.append(left[k] > ties[k] or (left[k] > -ties[k] and out[tied[k]]))
    return out


def main_text(page: str | None) -> str:
    found, tied, ties = blocks(page or "")
    if not found:
        return ""
    odds = [0.0] * len(tied)
    for _, x, at in found:
        odds[at] = x
    keep = tree_cut(odds, tied, ties)
    return "\n".join(text for text, _, at in found if keep[at])


def _extract(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, html="html", page_id="page_id", url="url") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(_extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
