"""Personal data: base patterns, and a skip-chain conditional random field for mentions that they miss.

Base patterns find addresses of mail and network, card and phone numbers. What they miss are other spellings: a phone
number without its country, a card number with a digit lost, an address with the at sign written out. One such spelling
alone can't be told from any other number. The field therefore labels all candidates of a document together. Its nodes
are the base spans, whose labels are observed, and the words with a digit, an at sign or a bracketed "at" or "dot" beside
them, as far as they have seven digits, a sign, a key in common with another, or are within ``REACH`` words of such a
candidate; every other word is labelled none. Neighbours share a transition potential. Candidates that repeat or resemble one
another anywhere in the document (same word, same last digits, same digits but one, same groups, same name before the at
sign) share a potential with a variable of their own that stands for the value they have in common, so that k of them
make k edges, not k * k. Loopy belief propagation passes messages over both kinds of edges; a candidate whose marginal
for a label reaches ``LEAST`` is reported, adjacent ones of a label as one span.

Weights are trained here, by maximum likelihood with the same message passing. Examples are mentions of the base kinds,
each followed by a second spelling made by rule, along with spellings that nothing supports and candidates that the base
patterns leave alone, both labelled none. Mentions come from a bounded sample of the documents (``SAMPLE_DOCS`` of them,
``SAMPLE_EACH`` mentions and candidates of each, ``SAMPLE_MENTIONS`` different mentions of these) and from a fixed generator, so that a table without any still has a model.

Offsets are code points, the end is exclusive. Time is in proportion to a text's length and the candidates in it.

Defined results: a null text is an empty one, without spans; a null ``doc_id`` is carried through; repeated rows are
scanned one by one; extra columns are kept by ``redact`` and ignored by ``scan``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeworks.llm._text import text_slices

Span = tuple[str, int, int]

#: Base kinds in the order that breaks ties, then those of spans that the field adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"link_{k}" for k in BASE))

#: The least marginal of a reported candidate.
LEAST = 0.6
#: Documents of the training sample, mentions and candidates taken from each, and different mentions in all.
SAMPLE_DOCS, SAMPLE_EACH, SAMPLE_MENTIONS = 2048, 32, 400
#: Rounds of message passing.
ROUNDS = 12
#: Characters of the longest candidate, and how many words a candidate draws in on either side.
LONGEST, REACH = 256, 3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        x = int(d) * (1 + place % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign, with as much before it as belongs to a name and isn't taken yet, and a domain after it."""
    taken, at, before = 0, text.find("@"), -1
    while at >= 0:
        low = max(taken, before + 1)
        name = _LOCAL.match(text[low:at][::-1])
        domain = _DOMAIN.match(text, at + 1) if name else None
        if domain:
            taken = domain.end()
            yield at - name.end(), taken
        before, at = at, text.find("@", max(at + 1, taken))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind, those that fail its check dropped; ordered by start, then kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0][:64])) <= 19 and m.end() - m.start() <= 38 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return _ordered(out)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the graph of a document ---------------------------------------------------------------------------------------

#: Labels of the field: none, then the base kinds.
NONE, LABELS = 0, 1 + len(BASE)
_CUE = r"[\[({<]\s?(?:at|dot)\s?[\])}>]"
_HIT = re.compile(rf"[0-9@＠]|{_CUE}", re.I)
_CUE_WORD = re.compile(rf"{_CUE}|@|＠", re.I)
_HAS_CUE = re.compile(_CUE, re.I)
_AT = re.compile(r"[\[({<]\s?at\s?[\])}>]|@|＠", re.I)
_NEXT = re.compile(r"[\x20\x09-\x0D]{1,8}([^\x20\x09-\x0D])")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_PUNCTUATION = "\"'`,;:.!?|=*#&$%_~^/\\<>[]{}"
_JOINED = re.compile(r"[\x20\x09-\x0D\"'`,;:.!?|]{1,8}")
_GROUPS = re.compile(r"[0-9]+")
_NUMERIC = re.compile(r"[+(]*[0-9][0-9().+/_-]*")
_DATE = re.compile(r"[0-9]{1,4}[-/.:][0-9]{1,2}(?:[-/.:][0-9]{1,4})?(?:T.*)?")

FEATURES = ("bias", "at", "cue", "near_cue", "name_domain", "d1_3", "d4_6", "d7_9", "d10_13", "d14_19", "d20", "ip_like", "plus", "parens", "letters", "decimal", "separated", "date", "luhn")
KEYS = ("same", "groups", "last10", "last7", "one_off", "name")


@dataclass
class Graph:
    """Nodes of one or more documents. A clamped node's label is observed; ``gold`` is known in training only."""

    features: list[list[int]] = field(default_factory=list)
    clamped: list[int] = field(default_factory=list)
    spans: list[tuple[int, int, int]] = field(default_factory=list)  # document, start, end
    chain: list[tuple[int, int]] = field(default_factory=list)
    hubs: int = 0
    star: list[tuple[int, int, int]] = field(default_factory=list)  # node, hub, kind of key


def _words(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Words that hold a digit, an at sign or a cue, and the neighbours of cues, in order, outside the taken spans."""
    end, n = 0, len(text)
    found: list[tuple[int, int]] = []

    def bounds(at: int, low: int) -> tuple[int, int]:
        start = max(text.rfind(c, low, at) for c in " \t\n\v\f\r") + 1
        stop = _SPACE.search(text, at)
        return max(start, low), stop.start() if stop else n

    while m := _HIT.search(text, end):
        a, b = bounds(m.start(), end)
        b = max(b, m.end())
        if _CUE_WORD.fullmatch(text, a, b):
            left = len(text[max(end, a - 80) : a].rstrip(" \t\n\v\f\r")) + max(end, a - 80)
            if left > max(end, a - 80) and left > end:
                found.append(bounds(left - 1, end))
            found.append((a, b))
            after = _NEXT.match(text, b)
            if after and not _HIT.match(text, after.start(1)):
                a, b = bounds(after.start(1), b)
                found.append((a, b))
        else:
            found.append((a, b))
        end = b
    k = 0
    for a, b in found:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k == len(taken) or taken[k][0] >= b:
            yield a, b


def _plain_email(core: str) -> str:
    return re.sub(r"[\[({<]\s?dot\s?[\])}>]", ".", _AT.sub("@", core), flags=re.I).lower()


def _describe(core: str, near: bool) -> list[int]:
    """Indexes of the features that hold."""
    d, groups = _digits(core), _GROUPS.findall(core)
    letters = any(x.isalpha() for x in core)
    mail = _plain_email(core)
    name, at, domain = mail.partition("@")
    size = len(d)
    holds = {
        "bias": True, "at": "@" in core or "＠" in core, "cue": bool(_HAS_CUE.search(core)), "near_cue": near,
        "name_domain": bool(at and name and "." in domain.strip(".")),
        "d1_3": 1 <= size <= 3, "d4_6": 4 <= size <= 6, "d7_9": 7 <= size <= 9, "d10_13": 10 <= size <= 13, "d14_19": 14 <= size <= 19, "d20": size > 19,
        "ip_like": len(groups) == 4 and not letters and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        "plus": core.startswith(("+", "00")), "parens": "(" in core, "letters": letters and size > 0, "decimal": len(groups) == 2 and ("." in core or "," in core),
        "separated": len(groups) >= 3, "date": bool(_DATE.fullmatch(core)), "luhn": 14 <= size <= 19 and luhn(d),
    }
    return [i for i, f in enumerate(FEATURES) if holds[f]]


def _keys(core: str, near: bool) -> Iterator[tuple[int, str]]:
    """What the candidate may share with others: (kind of key, value)."""
    if len(core) >= 6:
        yield 0, core.lower()
    d = _digits(core)
    if 10 <= len(d) <= 24:
        yield 2, d[-10:]
    if 7 <= len(d) <= 24:
        yield 3, d[-7:]
    if 10 <= len(d) <= 19:
        for x in {d, *(d[:i] + d[i + 1 :] for i in range(len(d)))}:
            yield 4, x
    groups = _GROUPS.findall(core)
    if len(groups) == 4 and all(len(g) <= 3 for g in groups) and not any(x.isalpha() for x in core):
        yield 1, ".".join(str(int(g)) for g in groups)
    name = _plain_email(core).partition("@")[0].strip(_PUNCTUATION)
    if len(name) >= 4 and ("@" in _plain_email(core) or near):
        yield 5, name


def add_document(graph: Graph, doc: int, text: str, base: Sequence[Span]) -> None:
    """Adds a document's nodes and edges."""
    taken: list[tuple[int, int]] = []
    for _, a, b in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    nodes = [(a, b, 1 + BASE.index(k)) for k, a, b in base]
    for a, b in _words(text, taken):
        raw = text[a:b]
        cue = bool(_CUE_WORD.fullmatch(raw))
        core = raw if cue else raw.strip(_PUNCTUATION) if not _HAS_CUE.search(raw) else raw.strip("\"'`,;:.!?|=*#&$%_~^/\\")
        if core and len(core) <= LONGEST:
            a += raw.index(core)
            nodes.append((a, a + len(core), -1))
    nodes.sort()
    shared: dict[tuple[int, str], set[int]] = defaultdict(set)
    cue_at = [bool(_CUE_WORD.fullmatch(text, a, b)) for a, b, _ in nodes]
    joined = [bool(_JOINED.fullmatch(text, x[1], y[0])) for x, y in zip(nodes, nodes[1:], strict=False)]
    near = [i > 0 and joined[i - 1] and cue_at[i - 1] or i + 1 < len(nodes) and joined[i] and cue_at[i + 1] for i in range(len(nodes))]
    kept = np.zeros(len(nodes), bool)
    run: list[int] = []
    place_of = list(range(len(nodes)))  # the first word of the number that a word is part of
    for i, (a, b, label) in enumerate(nodes):
        core = text[a:b] if b - a <= LONGEST else ""
        for key in _keys(core, near[i]):
            shared[key].add(i)
        kept[i] = label >= 0 or cue_at[i] or near[i] or bool(_CUE_WORD.search(core)) or len(_digits(core)) >= 7
        # Numbers in several words have the keys of the whole, too.
        numeric = label < 0 and bool(_NUMERIC.fullmatch(core)) and len(core) <= 24
        if run and not (numeric and joined[i - 1]):
            kept[run] |= _share_run(shared, run, nodes, text)
            run = []
        if numeric:
            run.append(i)
            place_of[i] = run[0]
    kept[run] |= _share_run(shared, run, nodes, text)
    # The same nodes often share several keys; one hub, of the first kind, stands for all, or their agreement would count many times.
    alike: dict[tuple[int, ...], int] = {}
    for (kind, _), members in shared.items():
        if len({place_of[i] for i in members}) > 1:
            group = tuple(sorted(members))
            alike[group] = min(kind, alike.get(group, kind))
            kept[list(group)] = True
    link = np.array(joined, bool)
    for _ in range(REACH):
        kept[1:], kept[:-1] = kept[1:] | kept[:-1] & link, kept[:-1] | kept[1:] & link
    place = np.cumsum(kept) - 1 + len(graph.spans)
    for i in np.flatnonzero(kept).tolist():
        a, b, label = nodes[i]
        graph.features.append(_describe(text[a:b], near[i]) if label < 0 else [0])
        graph.clamped.append(label)
        graph.spans.append((doc, a, b))
        if i and joined[i - 1] and kept[i - 1]:
            graph.chain.append((int(place[i - 1]), int(place[i])))
    for group, kind in alike.items():
        graph.star += [(int(place[m]), graph.hubs, kind) for m in group]
        graph.hubs += 1


def _share_run(shared: dict[tuple[int, str], set[int]], run: list[int], nodes: list[tuple[int, int, int]], text: str) -> bool:
    """Adds the keys of a number in several words; whether it has any."""
    found = False
    if 2 <= len(run) <= 8:
        for kind, value in _keys(text[nodes[run[0]][0] : nodes[run[-1]][1]], False):
            if kind:
                shared[kind, value] |= set(run)
                found = True
    return found


# --- the field -----------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Log potentials: of features, of transitions, of what a hub's label is by itself, and of agreement with a hub."""

    unary: np.ndarray
    step: np.ndarray
    hub: np.ndarray
    agree: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.unary, self.step, self.hub, self.agree]


def blank() -> Field:
    return Field(np.zeros((len(FEATURES), LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS), np.zeros(len(KEYS)))


@dataclass
class Marginals:
    node: np.ndarray
    hub: np.ndarray
    pair: np.ndarray
    same: np.ndarray


class Layout:
    """A graph as arrays."""

    def __init__(self, graph: Graph):
        self.n, self.hubs = len(graph.spans), graph.hubs
        self.clamped = np.array(graph.clamped, np.int64)
        self.at = np.repeat(np.arange(self.n), [len(f) for f in graph.features])
        self.feature = np.array([f for fs in graph.features for f in fs], np.int64)
        self.chain = np.array(graph.chain, np.int64).reshape(-1, 2)
        self.star = np.array(graph.star, np.int64).reshape(-1, 3)
        self.first = np.ones(self.n, bool)
        self.last = np.ones(self.n, bool)
        self.first[self.chain[:, 1]] = False
        self.last[self.chain[:, 0]] = False


def _added(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], axis=1)


def _normal(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def propagate(g: Layout, f: Field, rounds: int = ROUNDS, pairs: bool = True) -> Marginals:
    """Sum-product messages in parallel over chain and hubs; without ``pairs`` only the nodes' marginals are made. The words beside a candidate that aren't candidates are labelled none."""
    own = _added(g.at, f.unary[g.feature], g.n)
    own += g.first[:, None] * f.step[NONE] + g.last[:, None] * f.step[:, NONE]
    fixed = g.clamped >= 0
    own[fixed] = -1e9
    own[fixed, g.clamped[fixed]] = 0
    hub_own = np.tile(f.hub, (g.hubs, 1))
    a, b = g.chain.T
    node, hub, kind = g.star.T
    psi, bonus = np.exp(f.step), np.expm1(f.agree)[kind][:, None]
    right, left = np.zeros((len(a), LABELS)), np.zeros((len(a), LABELS))
    up, down = np.zeros((len(node), LABELS)), np.zeros((len(node), LABELS))
    log = lambda x: np.log(np.maximum(x, 1e-300))

    def beliefs() -> tuple[np.ndarray, np.ndarray]:
        return own + _added(b, right, g.n) + _added(a, left, g.n) + _added(node, down, g.n), hub_own + _added(hub, up, g.hubs)

    for turn in range(rounds):
        at, at_hub = beliefs()
        keep = 0.3 if turn else 0.0
        x, y = _normal(at[a] - left), _normal(at[b] - right)
        to_right, to_left = sum(x[:, k, None] * psi[k] for k in range(LABELS)), sum(y[:, k, None] * psi[:, k] for k in range(LABELS))
        u, v = _normal(at[node] - down), _normal(at_hub[hub] - up)
        new = [log(m / m.sum(axis=1, keepdims=True)) for m in (to_right, to_left, 1 + bonus * u, 1 + bonus * v)]
        right, left, up, down = (keep * old + (1 - keep) * m for old, m in zip((right, left, up, down), new, strict=True))
    at, at_hub = beliefs()
    if not pairs:
        return Marginals(_normal(at), at_hub, psi, bonus)
    x, y = _normal(at[a] - left), _normal(at[b] - right)
    pair = x[:, :, None] * psi[None] * y[:, None, :]
    u, v = _normal(at[node] - down), _normal(at_hub[hub] - up)
    same = (u * v).sum(axis=1)
    same = (1 + bonus[:, 0]) * same / (1 + bonus[:, 0] * same)
    return Marginals(_normal(at), _normal(at_hub) if g.hubs else at_hub, pair / pair.sum(axis=(1, 2), keepdims=True), same)


def gradient(g: Layout, f: Field, gold: np.ndarray, gold_hub: np.ndarray) -> list[np.ndarray]:
    """Of the log likelihood of the gold labels: what is there less what the field expects."""
    m = propagate(g, f)
    off = np.eye(LABELS)[gold] - m.node
    unary = _added(g.feature, off[g.at], len(FEATURES))
    pair = -m.pair
    a, b = g.chain.T
    pair[np.arange(len(a)), gold[a], gold[b]] += 1
    step = pair.sum(axis=0)
    step[NONE] += off[g.first].sum(axis=0)
    step[:, NONE] += off[g.last].sum(axis=0)
    node, hub, kind = g.star.T
    agree = np.bincount(kind, (gold[node] == gold_hub[hub]) - m.same, len(KEYS))
    return [unary, step, (np.eye(LABELS)[gold_hub] - m.hub).sum(axis=0), agree]


def train(graph: Graph, gold: list[int], steps: int = 150, rate: float = 0.1, spread: float = 2.0) -> Field:
    """Weights of most likelihood under a normal prior of the given spread. A hub's gold label is that of its observed members, else the commonest of its members."""
    g, f = Layout(graph), blank()
    labels = np.array(gold, np.int64)
    node, hub, _ = g.star.T
    votes = _added(hub, np.eye(LABELS)[labels[node]] * np.where(g.clamped[node] >= 0, 1e6, 1)[:, None], g.hubs)
    gold_hub = votes.argmax(axis=1) if g.hubs else np.empty(0, np.int64)
    first, second = ([np.zeros_like(p) for p in f.parts()] for _ in range(2))
    for t in range(1, steps + 1):
        for p, d, m, v in zip(f.parts(), gradient(g, f, labels, gold_hub), first, second, strict=True):
            d = d - p / spread**2
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return f


# --- training examples ---------------------------------------------------------------------------------------------


def respell(rng: random.Random, kind: str, mention: str) -> str:
    """Another spelling of a mention."""
    if kind == "email":
        at, dot = rng.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), ("(at)", "."), (" @ ", "."), ("＠", "."), (" [AT] ", " [DOT] ")])
        name, _, domain = mention.partition("@")
        return name + at + domain.replace(".", dot)
    if kind == "ip":
        return mention.replace(".", rng.choice(["-", "[.]", ",", "_", "/"]))
    d = _digits(mention)
    i = rng.randrange(1, len(d) - 1)
    if kind == "card":
        changed = rng.choice([d[:i] + d[i + 1 :], d[:i] + str((int(d[i]) + rng.randint(1, 9)) % 10) + d[i + 1 :], d[:i] + str(rng.randint(0, 9)) + d[i:]])
        return rng.choice([changed, changed, rng.choice("./_").join(d[j : j + 4] for j in range(0, len(d), 4))])
    local = d[-10:]
    return rng.choice([d, "00" + d, local, f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"{local[:3]} {local[3:6]} {local[6:]}"])


def invent(rng: random.Random, kind: str) -> str:
    """A mention of a kind."""
    some = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    if kind == "email":
        return f"{word()}{rng.choice(['', '.', '_'])}{rng.choice([word(), some(2)])}@{word()}.{rng.choice(['com', 'org', 'net', 'example.com'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "card":
        d = rng.choice("3456") + some(rng.choice([14, 15, 15, 15]))
        d = d[:-1] + next(x for x in "0123456789" if luhn(d[:-1] + x))
        return rng.choice([d, d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))])
    return rng.choice([f"+{rng.randint(1, 99)} ({some(3)}) {some(3)}-{some(4)}", f"+{rng.randint(1, 99)} {some(3)} {some(3)} {some(4)}", f"+{some(11)}"])


def _plain(rng: random.Random, kind: str) -> str:
    """A candidate that is no mention."""
    n = rng.randint(1, 9999)
    return rng.choice([str(n), f"{n}.{n % 97}", f"v{n % 9}.{n % 7}", f"20{n % 90 + 10}-{n % 12 + 1:02}-{n % 28 + 1:02}", f"{n % 24}:{n % 60:02}", f"A{n}", f"meet [at] {n % 12}", "look (at) this", f"@{'abcdef'[n % 6] * 3}user", f"{n}%", str(n) * 2, f"#{n}"])


def examples(mentions: Sequence[tuple[str, str]], others: Sequence[str], seed: int = 7) -> tuple[Graph, list[int]]:
    """A document a mention: the mention, another spelling of it, one that nothing supports, some once more, and candidates that aren't mentions."""
    rng = random.Random(seed)
    graph, gold = Graph(), []
    for number, (kind, mention) in enumerate(mentions):
        text, marks = "", []

        def put(piece: str, label: int) -> None:
            nonlocal text
            if label > 0 or label == NONE:
                marks.append((len(text), len(text) + len(piece), label))
            text += piece + " so it went on "  # noqa: B023

        parts = [(mention, -1)] if rng.random() < 0.9 else []
        supported = bool(parts)
        for _ in range(rng.randint(1, 2)):
            again = respell(rng, kind, mention)
            if not base_spans(again):
                # Nobody writes out an address that isn't one, so that one is an address by itself.
                parts.append((again, 1 + BASE.index(kind) if supported or kind == "email" else NONE))
        for other in rng.choices(BASE[1:], k=2):
            alone = respell(rng, other, invent(rng, other))
            if not base_spans(alone):
                parts += [(alone, NONE)] * rng.choice([1, 1, 2])
        parts += [(_plain(rng, kind), NONE) for _ in range(rng.randint(1, 3))]
        if others:
            parts += [(rng.choice(others), NONE) for _ in range(2)]
        rng.shuffle(parts)
        for piece, label in parts:
            put(piece, label)
        start = len(graph.spans)
        add_document(graph, number, text, base_spans(text))
        for (_, a, b), label in zip(graph.spans[start:], graph.clamped[start:], strict=True):
            gold.append(label if label >= 0 else next((x for s, e, x in marks if s <= a and b <= e), NONE))
    return graph, gold


def generated(n: int = 80, seed: int = 11) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    return [(kind, invent(rng, kind)) for kind in BASE for _ in range(n)]


def fit(docs: DataFrame) -> Field:
    """The field for a table, from a sample that hashes of its rows decide: at most SAMPLE_DOCS rows, whatever the table."""
    n = docs.count()
    h = F.xxhash64(F.col("doc_id").cast("string"), F.length("text"))
    share = F.lit(min(2**62, 2**62 * 2 * SAMPLE_DOCS // max(1, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            kinds, texts, others = [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                graph = Graph()
                add_document(graph, 0, text or "", base)
                base = [x for x in base if x[2] - x[1] <= LONGEST][:SAMPLE_EACH]
                kinds.append([k for k, *_ in base])
                texts.append([text[a:b] for _, a, b in base])
                free = [text[a:b] for (_, a, b), c in zip(graph.spans, graph.clamped, strict=True) if c < 0]
                others.append(free[:SAMPLE_EACH])
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("h"), *(pa.array(x, strings) for x in (kinds, texts, others))], names=["h", "kinds", "texts", "others"])

    own = docs.select(h.alias("h"), "text").where((F.col("h").bitwiseAND(2**62 - 1) < share) & F.col("text").rlike("[0-9@]"))
    rows = own.mapInArrow(run, "h long, kinds array<string>, texts array<string>, others array<string>").orderBy("h", F.to_json("texts"), F.to_json("others")).limit(SAMPLE_DOCS).collect()
    mentions = sorted({m for r in rows for m in zip(r["kinds"], r["texts"], strict=True)})
    random.Random(5).shuffle(mentions)
    others = sorted({x for r in rows for x in r["others"]})
    return train(*examples([*generated(), *mentions[:SAMPLE_MENTIONS]], others))


# --- the operator --------------------------------------------------------------------------------------------------


def find_all(texts: Sequence[str | None], model: Field) -> list[list[Span]]:
    """Spans of each text, in order of start and kind. A text's result doesn't depend on the others."""
    graph, out = Graph(), []
    for doc, text in enumerate(texts):
        text = text or ""
        if not _HIT.search(text):
            out.append([])
            continue
        out.append(base_spans(text))
        add_document(graph, doc, text, out[-1])
    if not any(c < 0 for c in graph.clamped):
        return out
    marginal = propagate(Layout(graph), model, pairs=False).node
    label = marginal.argmax(axis=1)
    sure = (np.array(graph.clamped) < 0) & (label != NONE) & (marginal[np.arange(len(label)), label] >= LEAST)
    follows = {b for a, b in graph.chain if sure[a] and sure[b] and label[a] == label[b]}
    changed = set()
    for i in np.flatnonzero(sure).tolist():
        doc, start, end = graph.spans[i]
        if i in follows:
            kind, start, _ = out[doc].pop()
            out[doc].append((kind, start, end))
        else:
            out[doc].append((KINDS[len(BASE) + label[i] - 1], start, end))
        changed.add(doc)
    for doc in changed:
        out[doc] = _ordered(out[doc])
    return out


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """Spans of every document, one row per input row."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in find_all(batch.column("text").to_pylist(), model)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans that ``scan`` gives."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans share the mark of the first."""
    model = model or fit(docs)

    def clean(text: str | None, spans: list[Span]) -> str | None:
        out, at = [], 0
        for kind, start, end in spans:
            if start >= at:
                out += [text[at:start], f"[{kind.removeprefix('link_').upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = batch.column("text").to_pylist()
            after = [clean(t, s) for t, s in zip(texts, find_all(texts, model), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(after, batch.schema.field("text").type))

    return docs.mapInArrow(run, docs.schema)
