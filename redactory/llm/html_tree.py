"""HTML extraction with a tree-structured graphical model.

Method. A page becomes a tree of its elements, inline ones left out, with its blocks
of text as leaves. Every node is content or not. Tag, class words, length, link
share and punctuation of a node give its own potential, and each parent-child pair
has a potential by what the child is. Sum-product messages upward and then downward
give each node's marginal; leaves whose marginal for content exceeds a half are
the main text. The potentials maximise the likelihood of labelled pages
(:mod:`.html_pages`), by gradient steps on the same marginals.

Blocks: character references are decoded, white space becomes one space, and ends
are trimmed; a line break counts as white space. Unclosed, misnested and
truncated markup is read as far as it goes. Defined results: null and empty pages,
and pages without content, give an empty text; repeated rows give equal texts; an empty
table gives an empty table; other columns are kept.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import html_pages
from .storage import small_batches

FEATURES = 1 << 12
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var label wbr br img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style template title textarea svg iframe object select noembed noframes".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag that ends an open element of one of these, up to the element after the bar.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set())}


def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


@lru_cache(4096)
def _element(tag: str, attributes: str) -> tuple[int, ...]:
    said = [f"tag {tag}"]
    for name, *values in _ATTRIBUTE.findall(attributes):
        words = _WORD.findall("".join(values))
        said += [f"word {w.lower()}" for w in words] + ([f"is {name.lower()}"] if name.lower() in ("role", "hidden") else [])
    return tuple(dict.fromkeys(map(_feature, said)))


@lru_cache(4096)
def _leaf(tag: str, words: int, links: int, stops: int, sign: bool) -> tuple[int, ...]:
    return tuple(map(_feature, (f"leaf in {tag}", f"words {words}", f"links {links}", f"stops {stops}", f"sign {sign}", f"words {words} links {links}", f"words {words} stops {stops}")))


@dataclass
class Tree:
    """Parents stand before their children; ``leaf`` has the text of leaves, None for elements."""

    parent: list[int]
    features: list[tuple[int, ...]]
    leaf: list[str | None]


def parse(page: str) -> Tree:
    tree = Tree([-1], [(_feature("root"),)], [None])
    stack: list[tuple[str, int]] = [("", 0)]  # open elements: tag and node (inline ones have their block's)
    buffer: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                node = stack[-1][1]
                tag = next(t for t, n in reversed(stack) if n == node and t not in _INLINE)
                n = len(text)
                words = min(8, (text.count(" ") + 1).bit_length())
                tree.parent.append(node)
                tree.features.append(_leaf(tag, words, min(4, 4 * linked // max(1, n)), min(3, sum(map(text.count, ".!?"))), "©" in text))
                tree.leaf.append(text)
            buffer.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal in_link
        flush()
        for tag, _ in stack[to:]:
            in_link -= tag == "a"
        del stack[to:]

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            buffer.append(text)
            if in_link > 0:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending = m[1] or m[4]
        if tag == "br":
            buffer.append(" ")
            continue
        if ending:
            to = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag in _INLINE:
                # an inline end tag never closes a block
                if to and all(t in _INLINE for t, _ in stack[to:]):
                    in_link -= sum(t == "a" for t, _ in stack[to:])
                    del stack[to:]
            elif to:
                close(to)
            elif tag == "p":
                flush()
            continue
        if tag in _SILENT:
            buffer.append(" ")
            if not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag in _INLINE:
            if tag not in _VOID:
                stack.append((tag, stack[-1][1]))
                in_link += tag == "a"
            continue
        flush()
        if tag in _CLOSES_P:
            to = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p"), 0)
            if to and all(t == "p" or t in _INLINE for t, _ in stack[to:]):
                close(to)
        if tag in _ENDS:
            ends, bars = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in bars:
                    break
                if stack[i][0] in ends:
                    close(i)
                    break
        if tag in _VOID:
            continue
        tree.parent.append(stack[-1][1])
        tree.features.append(_element(tag, m[3] or m[6] or ""))
        tree.leaf.append(None)
        stack.append((tag, len(tree.parent) - 1))
    flush()
    return tree


@dataclass
class Model:
    """Own weights by feature; ``pair[is_leaf][parent][child]`` as logarithms."""

    own: np.ndarray
    pair: np.ndarray

    def messages(self, tree: Tree) -> tuple[list[float], list[float], list[float]]:
        """Log odds: each node with all below it, the message to its parent, and each node with everything."""
        own, n = self.own.tolist() if isinstance(self.own, np.ndarray) else self.own, len(tree.parent)
        below = [sum(own[f] for f in fs) for fs in tree.features]
        up = [0.0] * n
        pairs = [[[math.exp(x) for x in row] for row in kind] for kind in self.pair.tolist()]
        for i in range(n - 1, 0, -1):
            e = math.exp(min(30.0, max(-30.0, below[i])))
            (a, b), (c, d) = pairs[tree.leaf[i] is not None]
            up[i] = math.log((c + d * e) / (a + b * e))
            below[tree.parent[i]] += up[i]
        full = below[:]
        for i in range(1, n):
            e = math.exp(min(30.0, max(-30.0, full[tree.parent[i]] - up[i])))
            (a, b), (c, d) = pairs[tree.leaf[i] is not None]
            full[i] = below[i] + math.log((b + d * e) / (a + c * e))
        return below, up, full

    def text(self, page: str) -> str:
        tree = parse(page)
        if len(tree.parent) == 1:
            return ""
        full = self.messages(tree)[2]
        return "\n\n".join(t for t, odds in zip(tree.leaf, full, strict=True) if t is not None and odds > 0)

    def column(self, page: Column) -> Column:
        model = Model(self.own.tolist(), self.pair)

        @F.arrow_udf("string")
        def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                yield pa.array([model.text(p) if p else "" for p in b.to_pylist()], pa.string())

        return extracted(page)


def train(pages: list[tuple[str, list[bool]]] | None = None, rounds: int = 12, rate: float = 0.3) -> Model:
    """Maximise the likelihood of labelled pages: each is its HTML and, for every block in page order, whether it is content."""
    samples = []
    for page, labels in pages or html_pages.labelled():
        tree = parse(page)
        y = [0] * len(tree.parent)
        if sum(t is not None for t in tree.leaf) != len(labels):
            raise ValueError("a labelled page has other blocks than labels")
        given = iter(labels)
        for i, t in enumerate(tree.leaf):
            if t is not None:
                y[i] = int(next(given))
        for i in range(len(y) - 1, 0, -1):
            y[tree.parent[i]] |= y[i]
        samples.append((tree, y))
    model = Model(np.zeros(FEATURES), np.zeros((2, 2, 2)))
    seen_own, seen_pair = np.full(FEATURES, 1e-2), np.full((2, 2, 2), 1e-2)
    for _ in range(rounds):
        for tree, y in samples:
            below, up, full = model.messages(tree)
            p = 1 / (1 + np.exp(-np.clip(full, -30, 30)))
            grad = np.zeros(FEATURES)
            for fs, error in zip(tree.features, np.array(y) - p, strict=True):
                for f in fs:
                    grad[f] += error
            grad -= 1e-3 * model.own
            pair = np.zeros((2, 2, 2))
            for i in range(1, len(y)):
                kind, above = int(tree.leaf[i] is not None), full[tree.parent[i]] - up[i]
                joint = np.exp(model.pair[kind] + np.clip(np.array([[0, below[i]], [above, above + below[i]]]), -60, 60))
                pair[kind] -= joint / joint.sum()
                pair[kind][y[tree.parent[i]], y[i]] += 1
            pair -= 1e-2 * model.pair
            seen_own += grad**2
            seen_pair += pair**2
            model.own += rate * grad / np.sqrt(seen_own)
            model.pair += rate * pair / np.sqrt(seen_pair)
    return model


def extract(pages: DataFrame, html_col: str = "html", model: Model | None = None) -> DataFrame:
    """``pages`` with the columns ``text`` and ``n_chars`` (code points)."""
    small_batches(pages.sparkSession)
    out = pages.withColumn("text", (model or train()).column(F.col(html_col)))
    return out.withColumn("n_chars", F.length("text").cast("long"))
