"""Personal data in texts: fixed patterns and a skip-chain conditional random field.

Method. Four patterns (email, ip, card, phone) give base spans, which are observed
nodes of a conditional random field. Its other nodes are runs of number tokens
("415 555 2671" is one), other tokens with a digit or ``@``, ``name(at)host``, and the
mailboxes of the document's emails; all other tokens are fixed at "other" and only seen
as neighbours. Nodes next to each other are joined by chain potentials; a node is also
joined to the last earlier node of the document with the same token, or with a similar
one (the same last seven digits, the same four number groups, the same mailbox), by
skip potentials. Loopy message passing gives each node's marginals over the whole
document, so that what is recognised at one place is recognised at the others. A node
outside base spans whose marginal for a kind reaches ``least`` is added; neighbours of
one kind are one span. Base spans always stay.

Local, chain and skip potentials are trained together, by the gradient of the
conditional likelihood of hidden nodes given the observed ones (beliefs of the same message
passing). As the patterns miss what the field is to find, texts for training get copies of
some of their own spans, far from them and written otherwise (``rewritten``: without
the plus sign, with other separators, ``name(at)host``) or as they were but hidden from the
patterns; and decoys, other values in the same forms that repeat nothing, labelled "other".
What the texts themselves hold outside base spans is "other", too, unless it is joined
to a base span: such nodes have no label and are not learned from.

The fit takes about ``train_docs`` different texts, picked by a hash, without those of
more than ``most_nodes`` nodes (bounds on the fit alone; every whole text is searched).

Defined results: null and empty texts have no spans; positions are code points,
ends exclusive; repeated rows have equal spans; a corpus without any base span
adds nothing; an empty table gives an empty table; other columns are kept, but one named
``pii`` is replaced by :func:`find`.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import small_batches

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = len(KINDS) + 1
FEATURES = 1 << 12
#: A run of number tokens is one node up to so many digits.
RUN_DIGITS = 19
#: Copies of spans in a text for training.
COPIES = 3
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|\(at\)|\[at\]")
_AT = re.compile(r"@|\(at\)|\[at\]")
_NUMBER = re.compile(r"[0-9+().\-/]+")
_GROUPS = re.compile(r"[0-9]+")
_WORD = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
_CORE = re.compile(r"[+(]?[A-Za-z0-9](?:.*[A-Za-z0-9)])?", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, sorted."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:  # an email is looked for around its @
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, end := m.end()))
        at = text.find("@", end if m else at + 1)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def _shape(token: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 4) if len(m[0]) < 9 else "9" * 5 if len(m[0]) < 12 else "9" * 6, token)
    return re.sub(r"[^\W\d_]+", "a", s)[:24]


def tokens(text: str, mailboxes: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Start and end of each token with a digit or an at sign, or that is one of ``mailboxes``, without punctuation at its ends."""
    out, at, size = [], 0, len(text)
    while m := _MARK.search(text, at):
        a, b = m.start(), m.end()
        while a > at and not text[a - 1].isspace():
            a -= 1
        while b < size and not text[b].isspace():
            b += 1
        core = _CORE.search(text, a, b)
        if core:
            out.append((core.start(), core.end()))
        at = b
    if mailboxes:
        named = (_CORE.search(text, m.start(), m.end()) for m in _WORD.finditer(text))
        out = sorted({*out, *((c.start(), c.end()) for c in named if c and c[0].lower() in mailboxes)})
    return out


def _repeats(digits: str, known: dict[str, set[str]]) -> bool:
    """Whether the digits are a known number, without its first digits or with zeros before it."""
    return any(full.endswith(digits) or digits.endswith(full) and not digits[: -len(full)].strip("01") for full in known.get(digits[-7:], ()))


def _runs(text: str, group: list[tuple[int, int]], known: dict[str, set[str]]) -> Iterator[tuple[int, int]]:
    """Number tokens in a row as runs: those that repeat a known number, longest first; the rest up to ``RUN_DIGITS`` digits."""
    digits = [digits_of(text[a:b]) for a, b in group]
    i = first = 0

    def plain(upto: int) -> Iterator[tuple[int, int]]:
        at, held = first, 0
        for j in range(first, upto):
            if j > at and (held + len(digits[j]) > RUN_DIGITS or text[group[j][0]] == "+"):
                yield group[at][0], group[j - 1][1]
                at, held = j, 0
            held += len(digits[j])
        if at < upto:
            yield group[at][0], group[upto - 1][1]

    while i < len(group):
        best, said = 0, ""
        for j in range(i, len(group)) if known else ():
            said += digits[j]
            if len(said) > RUN_DIGITS + 3:
                break
            if len(said) >= 7 and _repeats(said, known):
                best = j + 1
        if best:
            yield from plain(i)
            yield group[i][0], group[best - 1][1]
            i = first = best
        else:
            i += 1
    yield from plain(len(group))


def nodes(text: str, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, int]]:
    """``(start, end, label)`` of the nodes of a text; the label is -1 outside base spans."""
    known: dict[str, set[str]] = {}
    for s, k, e in base:
        if k >= 2:
            known.setdefault(digits_of(text[s:e])[-7:], set()).add(digits_of(text[s:e]))
    mailboxes = frozenset(m for s, k, e in base if k == 0 and len(m := text[s:e].split("@")[0].lower()) >= 4 and not m.isalpha())
    out: list[tuple[int, int, int]] = []
    group: list[tuple[int, int]] = []

    def close() -> None:
        out.extend((s, e, -1) for s, e in _runs(text, group, known))
        group.clear()

    b = covered = 0
    for s, e in tokens(text, mailboxes):
        while b < len(base) and base[b][0] < e:  # base spans up to this token
            lo, kind, hi = base[b]
            if hi > covered:
                close()
                out.append((max(lo, covered), hi, kind))
                covered = hi
            b += 1
        s = max(s, covered)
        while s < e and not text[s].isalnum() and text[s] not in "+(":
            s += 1
        if s >= e or not (_MARK.search(text, s, e) or text[s:e].lower() in mailboxes):
            continue
        if not _NUMBER.fullmatch(text, s, e):
            close()
            out.append((s, e, -1))
            continue
        if group and not (s - group[-1][1] <= 2 and text[group[-1][1] : s].isspace() and "\n" not in text[group[-1][1] : s]):
            close()
        group.append((s, e))
    close()
    return out


def _features(text: str, found: list[tuple[int, int, int]], i: int) -> list[int]:
    a, b = found[i][:2]
    token, digits = text[a:b], digits_of(text[a:b])
    near = lambda j, gap: _shape(text[found[j][0] : found[j][1]]) if 0 <= j < len(found) and not text[slice(*gap)].strip() and gap[1] - gap[0] <= 3 else "word"
    before = near(i - 1, (found[i - 1][1], a)) if i else "word"
    after = near(i + 1, (b, found[i + 1][0])) if i + 1 < len(found) else "word"
    checks = f"{12 <= len(digits) <= 19 and luhn(digits)}{token.count('.')}{_AT.search(token) is not None}{'+' in token}"
    said = ("bias", f"s{_shape(token)}", f"d{min(len(digits), 20)}", f"c{checks}", f"p{before}", f"n{after}", f"ps{before}|{_shape(token)}", f"l{any(c.isalpha() for c in token)}{len(digits) * 4 // max(1, len(token))}")
    return [zlib.crc32(x.encode()) % FEATURES for x in said]


def _keys(token: str) -> list[str]:
    digits, out = digits_of(token), [f"={token.lower()}"]
    if _AT.search(token) or not token.replace(".", "").isdigit() and re.search(r"[A-Za-z]", token):
        out.append(f"@{_AT.split(token)[0].lower()}")
    elif not re.search(r"[A-Za-z]", token):
        if len(digits) >= 7:
            out.append(f"#{digits[-7:]}")
        if len(groups := _GROUPS.findall(token)) == 4 and max(map(len, groups)) <= 3:
            out.append(f".{'.'.join(groups)}")
    return out


@dataclass
class Graph:
    """The nodes of some texts and the edges among nodes of one text."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    seen: np.ndarray  # label inside base spans, else -1
    chain: np.ndarray
    skip: np.ndarray


def graph(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> Graph:
    text, start, end, features, seen, chain, skip = [], [], [], [], [], [], []
    for k, (t, base) in enumerate(zip(texts, bases, strict=True)):
        found = nodes(t, base)
        last: dict[str, int] = {}
        first = len(text)
        for i, (s, e, label) in enumerate(found):
            node = first + i
            text.append(k)
            start.append(s)
            end.append(e)
            seen.append(label)
            features.append(_features(t, found, i))
            if i and found[i - 1][1] <= s <= found[i - 1][1] + 3 and not t[found[i - 1][1] : s].strip():
                chain.append((node - 1, node))
            linked = set()
            for key in _keys(t[s:e]):
                if key in last and last[key] not in linked:
                    skip.append((last[key], node))
                    linked.add(last[key])
                last[key] = node
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(np.array(text, np.int64), np.array(start, np.int64), np.array(end, np.int64), np.array(features, np.int64).reshape(-1, 8), np.array(seen, np.int64), pairs(chain), pairs(skip))


class Messages:
    """Messages along the edges of a graph, both ways."""

    def __init__(self, g: Graph):
        edges = np.concatenate([g.chain, g.skip])
        n = len(edges)
        self.graph, self.src, self.dst = g, np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        self.back = np.concatenate([np.arange(n) + n, np.arange(n)])
        self.held = np.zeros((2 * n, LABELS))

    def passed(self, field: Field, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of beliefs of nodes, and what each end of the directed edges says without that edge."""
        g, m = self.graph, self.held
        unary = field.local[g.features].sum(1)
        known = g.seen >= 0
        unary[known] = -1e3
        unary[np.flatnonzero(known), g.seen[known]] = 0
        cuts = np.cumsum([len(g.chain), len(g.skip), len(g.chain)])
        pots = [np.exp(x) for x in (field.chain, field.skip, field.chain.T, field.skip.T)]
        for _ in range(rounds if len(m) else 0):
            x = (unary + self._gather(len(unary)))[self.src] - m[self.back]
            x = np.exp(x - x.max(1, keepdims=True))
            new = np.log(np.concatenate([part @ pot for part, pot in zip(np.split(x, cuts), pots, strict=True)]))
            step = 0.5 * (new - new.max(1, keepdims=True) - m)
            m += step
            if np.abs(step).max() < 1e-3:
                break
        total = unary + self._gather(len(unary))
        return total, total[self.src] - m[self.back]

    def _gather(self, n: int) -> np.ndarray:
        return np.stack([np.bincount(self.dst, self.held[:, k], n) for k in range(LABELS)], 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    axes = tuple(range(1, x.ndim))
    p = np.exp(x - x.max(axes, keepdims=True))
    return p / p.sum(axes, keepdims=True)


@dataclass
class Field:
    """Potentials as logarithms: local (features x labels), of chains and of skips (labels x labels)."""

    local: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    least: float

    def marginals(self, g: Graph, rounds: int = 20) -> np.ndarray:
        """Loopy sum-product, all messages at once, damped; nodes inside base spans are observed."""
        return _softmax(Messages(g).passed(self, rounds)[0])

    def added(self, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Spans beside the base ones, for each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        g = graph(texts, bases)
        if not len(g.text) or not self.local.any():
            return out
        p = self.marginals(g)
        best = p.argmax(1)
        fresh = np.flatnonzero((g.seen < 0) & (best != OTHER) & (p.max(1) >= self.least))
        follows = {int(b): int(a) for a, b in g.chain}
        for i in fresh.tolist():
            own, kind = out[g.text[i]], int(best[i])
            if own and follows.get(i) is not None and own[-1][1] == kind and own[-1][2] == g.end[follows[i]]:
                own[-1] = (own[-1][0], kind, int(g.end[i]))
            else:
                own.append((int(g.start[i]), kind, int(g.end[i])))
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
        """``(start, kind, end, base)`` for each text, sorted."""
        bases = [base_spans(t) if t else [] for t in texts]
        some = [i for i, t in enumerate(texts) if t and _MARK.search(t)]
        more = self.added([texts[i] for i in some], [bases[i] for i in some])
        out = [[(s, k, e, True) for s, k, e in base] for base in bases]
        for i, extra in zip(some, more, strict=True):
            out[i] = sorted(out[i] + [(s, k, e, False) for s, k, e in extra])
        return out


def rewritten(value: str, kind: int, rng: random.Random) -> str:
    """The value in a form that the patterns miss."""
    digits = digits_of(value)
    if kind == 0:
        name, host = value.split("@", 1)
        return rng.choice([f"{name}(at){host}", f"{name}[at]{host}", name])
    if kind == 1:
        return rng.choice(["-", " "]).join(value.split("."))
    if kind == 2:
        return rng.choice([".", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    national = digits[rng.choice([1, 2]) :]
    a, b, c = national[:-7], national[-7:-4], national[-4:]
    return rng.choice([f"00{digits}", national, f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{b} {c}", value[1:]])


def _other(value: str, kind: int, rng: random.Random) -> str:
    """Another value of the same form."""
    if kind == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    return "".join(rng.choice("0123456789") if "0" <= c <= "9" else rng.choice("abcdefghijklmnopqrstuvwxyz") if kind == 0 and "a" <= c <= "z" else c for c in value)


def lessons(text: str, turns: int) -> list[tuple[Graph, np.ndarray]]:
    """``turns`` lessons of a text with base spans, each with other copies; one of a text without."""
    base = base_spans(text)
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    return [lesson(text, base, random.Random(seed + turn)) for turn in range(turns if base else 1)]


def lesson(text: str, base: list[tuple[int, int, int]], rng: random.Random) -> tuple[Graph, np.ndarray]:
    """A text with copies of its spans and decoys: its graph, and the label of each node, -1 where it is not learned from."""
    gaps = [m.end() for m in re.finditer(r"\s", text)] if base else []
    put: list[tuple[int, str, int]] = []
    for s, k, e in rng.sample(base, min(COPIES, len(base))):
        value = text[s:e]
        for copy, kind in ((value, k), (_other(value, k, rng), OTHER)):
            form = copy if kind != OTHER and rng.random() < 0.25 else rewritten(copy, k, rng)
            times = 1 if kind != OTHER else rng.choice([1, 1, 2])  # some decoys repeat themselves
            free = [g for g in rng.sample(gaps, min(8, len(gaps))) if not any(lo < g < hi for lo, _, hi in base)]
            put += [(g, form, kind) for g in [*free, len(text)][:times]]
    out, at, size, places = [], 0, 0, []
    for g, form, kind in sorted(put):
        out += [text[at:g], " ", form, " "]
        size += g - at + 1
        places.append((size, size + len(form), kind))
        size += len(form) + 1
        at = g
    made = "".join([*out, text[at:]])
    shown = [(s, k, e) for s, k, e in base_spans(made) if not any(s < hi and lo < e for lo, hi, _ in places)]
    g = graph([made], [shown])
    label = np.where(g.seen < 0, OTHER, g.seen)
    joined = g.skip[(g.seen[g.skip] >= 0).any(1)].ravel() if len(g.skip) else g.skip.ravel()
    label[joined[g.seen[joined] < 0]] = -1
    for i in np.flatnonzero(g.seen < 0).tolist():
        for lo, hi, kind in places:
            if g.start[i] < hi and lo < g.end[i]:
                whole = min(hi, int(g.end[i])) - max(lo, int(g.start[i])) >= 0.6 * max(hi - lo, int(g.end[i] - g.start[i]))
                label[i] = kind if whole else -1
    return g, label


def _joined(graphs: list[Graph]) -> Graph:
    first = np.cumsum([0, *(len(g.text) for g in graphs)])
    one = lambda name: np.concatenate([getattr(g, name) for g in graphs])
    edges = lambda name: np.concatenate([getattr(g, name) + n for g, n in zip(graphs, first, strict=False)])
    return Graph(np.repeat(np.arange(len(graphs)), np.diff(first)), one("start"), one("end"), one("features"), one("seen"), edges("chain"), edges("skip"))


def train(g: Graph, label: np.ndarray, least: float, rounds: int, ridge: float = 0.02) -> Field:
    """All potentials together, by Adam on the conditional likelihood; messages go on from step to step."""
    field = Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)), least)
    messages, n = Messages(g), max(1, int(((g.seen < 0) & (label >= 0)).sum()))
    hidden = np.flatnonzero((g.seen < 0) & (label >= 0))
    ends = np.concatenate([g.chain, g.skip])
    use = (label[ends] >= 0).all(1) & (g.seen[ends] < 0).any(1)
    w = np.zeros(FEATURES * LABELS + 2 * LABELS**2)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        total, said = messages.passed(field, 3)
        p = _softmax(total)[hidden]
        p[np.arange(len(hidden)), label[hidden]] -= 1
        x = g.features[hidden]
        local = np.stack([np.bincount(x.ravel(), np.repeat(p[:, k], x.shape[1]), FEATURES) for k in range(LABELS)], 1)
        pairs = []
        for part, pot in ((slice(0, len(g.chain)), field.chain), (slice(len(g.chain), len(ends)), field.skip)):
            both = _softmax(said[: len(ends)][part][:, :, None] + pot + said[len(ends) :][part][:, None, :])
            both[np.arange(len(both)), label[ends[part, 0]], label[ends[part, 1]]] -= 1
            pairs.append(both[use[part]].sum(0).ravel())
        grad = (np.concatenate([local.ravel(), *pairs]) + ridge * w) / n
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
        cut = FEATURES * LABELS
        field = Field(w[:cut].reshape(FEATURES, LABELS), w[cut : cut + LABELS**2].reshape(LABELS, LABELS), w[cut + LABELS**2 :].reshape(LABELS, LABELS), least)
    return field


_LESSON = "features array<int>, seen array<int>, label array<int>, chain array<int>, skip array<int>"


def fit(docs: DataFrame, text_col: str = "text", train_docs: int = 4000, most_nodes: int = 500, turns: int = 4, least: float = 0.7, rounds: int = 150) -> Field:
    """Train on about ``train_docs`` different texts that have a digit or ``@``, ``turns`` lessons each, of at most ``most_nodes`` nodes."""
    small_batches(docs.sparkSession)
    some = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    n = docs.count()
    if n > train_docs:
        some = some.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(train_docs / n * (1 << 30)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                rows += [(g.features.ravel(), g.seen, label, g.chain.ravel(), g.skip.ravel()) for g, label in lessons(text, turns) if 0 < len(label) <= most_nodes]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in range(5)], names=["features", "seen", "label", "chain", "skip"])

    # Copies of a text become one on the executors, before their graphs come to the driver.
    once = some.groupBy(F.xxhash64("text").alias("hash")).agg(F.min("text").alias("text"))
    table = once.orderBy("hash").select("text").mapInArrow(gather, _LESSON).toArrow()
    numbers = lambda name: [np.asarray(x, np.int64) for x in table.column(name).to_pylist()]
    label = np.concatenate([np.zeros(0, np.int64), *numbers("label")])
    seen = numbers("seen")
    if not any((x >= 0).any() for x in seen):
        return Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)), least)
    graphs = [Graph(s, s, s, f.reshape(-1, 8), s, c.reshape(-1, 2), k.reshape(-1, 2)) for f, s, c, k in zip(numbers("features"), seen, numbers("chain"), numbers("skip"), strict=True)]
    return train(_joined(graphs), label, least, rounds)


def spans(text: Column, field: Field) -> Column:
    """A column of :data:`SPANS`: all spans, by start and then by kind as listed."""

    @F.arrow_udf(SPANS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = field.spans([t or "" for t in b.to_pylist()])
            flat = [s for r in rows for s in r]
            values = pa.StructArray.from_arrays(
                [pa.array([KINDS[k] for _, k, _, _ in flat], pa.string()), *(pa.array([s[i] for s in flat], pa.int32()) for i in (0, 2)), pa.array([s[3] for s in flat], pa.bool_())],
                ["kind", "start", "end", "base"],
            )
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), values)

    return found(text)


def masked(text: str, found: list[tuple[int, int, int, bool]]) -> str:
    """Spans become their kinds in angle brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for s, k, e, _ in found:
        if s < at:
            if e > at:
                at = e
            continue
        out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def redacted(text: Column, field: Field) -> Column:
    """The text with every span masked; null stays null."""

    @F.arrow_udf("string")
    def hide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts = b.to_pylist()
            yield pa.array([t if t is None or not found else masked(t, found) for t, found in zip(texts, field.spans([t or "" for t in texts]), strict=True)], pa.string())

    return hide(text)


def find(docs: DataFrame, text_col: str = "text", field: Field | None = None, **options) -> DataFrame:
    """``docs`` with the column ``pii`` (:data:`SPANS`); a field that is not given is fitted to ``docs``."""
    return docs.withColumn("pii", spans(F.col(text_col), field or fit(docs, text_col, **options)))


def redact(docs: DataFrame, text_col: str = "text", field: Field | None = None, **options) -> DataFrame:
    """``docs`` with every span of the text masked; a field that is not given is fitted to ``docs``."""
    return docs.withColumn(text_col, redacted(F.col(text_col), field or fit(docs, text_col, **options)))
