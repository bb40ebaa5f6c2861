"""Online logistic context mixing over binary decisions.

A symbol (a byte, or a word of a prefix code) is a path of yes-or-no decisions. A bit predictor looks at a hashed
context and knows, for each decision below that context, how often each way was taken. These counts are exact 64-bit
integers: rows are sorted by context and path, so that a decision's occurrences lie side by side and are summed there.
There are no slots to share, and the model has as many contexts as the rows that train it.

The predictors' log-odds are combined by a weight vector that a gate chooses (the place of the decision in the path, and
how often the two most telling contexts were seen). Weights are learned online, block by block, each occurrence
predicted from all others but itself; an adaptive map of (gate, mixed log-odds), gathered from the same predictions,
refines the result. Scoring uses the same odds and weights, from all counts.
"""

from __future__ import annotations

import heapq
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from latticeworks.llm._text import mix64, odd_constants

_U = np.uint64
BUCKETS, REACH = 33, 12.0
#: Added to both counts of a decision; occurrences of each map cell before any was seen.
DELTA, PRIOR = 0.05, 4.0
#: Counts from which a context is trusted more: of the most telling predictor, and of the second.
FIRST_EDGES, SECOND_EDGES = (1, 2, 8, 64, 1024), (1, 16)
GATES = (len(FIRST_EDGES) + 1) * (len(SECOND_EDGES) + 1)
#: Rows of an online step, and its size.
BLOCK, RATE, BIAS = 4096, 0.02, 0.25
_C = odd_constants(8, 21)


class Counts:
    """Exact counts below one context a row. A row's path is the top bits of ``code``, of ``width`` bits in all; levels are asked for in order.

    ``edges`` are counts from which a context is trusted more. Rows that lie in order of context and code are ``sorted``.
    """

    def __init__(self, context: np.ndarray, code: np.ndarray, count: np.ndarray, width: int, edges: tuple[int, ...] = (), sorted: bool = False):
        self.order = None if sorted else np.lexsort((code, context))
        context, self.code, self.count = (x if sorted else x[self.order] for x in (context, code, count.astype(np.int64)))
        self.width, self.edges = width, edges
        self.edge = np.ones(len(code), bool)
        self.edge[1:] = context[1:] != context[:-1]

    def keep(self, stay: np.ndarray) -> None:
        """Goes on with some rows; a path that ended was a group of its own."""
        mine = stay if self.order is None else stay[self.order]
        if self.order is not None:
            self.order = (np.cumsum(stay) - 1)[self.order[mine]]
        self.code, self.count, self.edge = self.code[mine], self.count[mine], self.edge[mine]

    def level(self, j: int) -> tuple[np.ndarray, ...]:
        """Each row's log-odds at decision ``j``, from all occurrences and from all but its own, and the trust in both."""
        bit = (self.code >> (self.width - 1 - j)) & 1
        starts, group = np.flatnonzero(self.edge), np.cumsum(self.edge) - 1
        one, total = (np.add.reduceat(x, starts) for x in (self.count * bit, self.count))
        zero = total - one
        without = np.stack([_odds(one, zero - 1), _odds(one - 1, zero)], axis=1).ravel()
        found = [_odds(one, zero).take(group), without.take(group * 2 + bit)]
        found += [np.searchsorted(self.edges, n, side="right").astype(np.int8).take(group) for n in (total, total - 1)] if self.edges else []
        self.edge[1:] |= bit[1:] != bit[:-1]
        return tuple(found if self.order is None else (self._back(x) for x in found))

    def _back(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.order] = x
        return out


class Shared:
    """A predictor without context, of counts by symbol: row ``i`` has the symbol ``symbol[i]``."""

    def __init__(self, symbol: np.ndarray, code: np.ndarray, length: np.ndarray, count: np.ndarray, width: int):
        self.symbol, self.length, self.counts = symbol, length, Counts(np.zeros(len(code), np.int8), code, count, width)
        self.place = np.arange(len(code))

    def keep(self, stay: np.ndarray) -> None:
        self.symbol = self.symbol[stay]

    def level(self, j: int) -> tuple[np.ndarray, ...]:
        stay = self.length > j
        self.place, self.length = np.cumsum(stay)[self.place] - 1, self.length[stay]
        self.counts.keep(stay)
        return tuple(x[self.place[self.symbol]] for x in self.counts.level(j))


def _odds(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Log-odds of two counts. The ratio is taken first, so that large counts that lie close to each other keep their difference."""
    return np.log((np.maximum(one, 0) + DELTA) / (np.maximum(zero, 0) + DELTA)).astype(np.float32)


def _cells(gate: np.ndarray, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower cell of the adaptive map for each decision, and the share of the upper one."""
    x = (logit + np.float32(REACH)) * np.float32((BUCKETS - 1) / (2 * REACH) * (1 - 1e-6))
    low = x.astype(np.int64)
    return gate * BUCKETS + low, x - low.astype(np.float32)


class Mixer:
    """Weights by gate and the adaptive map of one decision of the path."""

    def __init__(self, inputs: int):
        self.weights = np.full((inputs + 1, GATES), 1.5 / inputs)
        self.squares = np.full((inputs + 1, GATES), 1e-6)
        prior = 1 / (1 + np.exp(-np.linspace(-REACH, REACH, BUCKETS)))
        self.cells = np.tile(np.stack([1 - prior, prior], axis=1) * PRIOR, (GATES, 1))

    def logit(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        weights = self.weights.astype(np.float32)
        out = weights[-1].take(gate) * np.float32(BIAS)
        for w, x in zip(weights, inputs, strict=False):
            out += w.take(gate) * x
        return np.clip(out, -REACH, REACH, out=out)

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, mass: np.ndarray) -> None:
        """One online step: predict, then correct the weights and the map."""
        logit = self.logit(inputs, gate)
        error = (bit - 1 / (1 + np.exp(-logit))) * mass
        slope = np.array([*(np.bincount(gate, error * x, GATES) for x in inputs), np.bincount(gate, error, GATES) * BIAS])
        slope /= np.maximum(np.bincount(gate, mass, GATES), 1e-9)
        self.squares = 0.98 * self.squares + 0.02 * slope**2
        self.weights += RATE * slope / np.sqrt(self.squares)
        low, share = _cells(gate, logit)
        for cell, part in ((low, 1 - share), (low + 1, share)):
            self.cells += np.bincount(cell * 2 + bit, mass * part, self.cells.size).reshape(self.cells.shape)

    def ones(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Probability that each decision is one."""
        logit = self.logit(inputs, gate)
        low, share = _cells(gate, logit)
        refined = (self.cells[:, 1] / self.cells.sum(axis=1)).astype(np.float32)
        under = refined.take(low)
        return (1 / (1 + np.exp(-logit)) + under + (refined.take(low + 1) - under) * share) * np.float32(0.5)


def log10_paths(predictors: list, code: np.ndarray, length: np.ndarray, mass: np.ndarray, width: int) -> np.ndarray:
    """log10 of each row's path; ``mass`` says how often a row was seen in training. The last two predictors, Counts with edges, choose the gate."""
    out = np.zeros(len(code))
    rows, second = np.arange(len(code)), len(predictors[-2].edges) + 1
    for j in range(int(length.max(initial=0))):
        stay = length[rows] > j
        if not stay.all():
            rows = rows[stay]
            for p in predictors:
                p.keep(stay)
        bit, own_mass = (code[rows] >> (width - 1 - j)) & 1, mass[rows].astype(np.float64)
        found = [p.level(j) for p in predictors]
        gates = [(found[-1][k] * second + found[-2][k]).astype(np.int64) for k in (2, 3)]
        mixer, known = Mixer(len(found)), np.flatnonzero(own_mass)
        whole = len(known) == len(rows)
        for at in range(0, len(known), BLOCK):
            x = slice(at, at + BLOCK) if whole else known[at : at + BLOCK]
            mixer.learn([f[1][x] for f in found], gates[1][x], bit[x], own_mass[x])
        for at in range(0, len(rows), 1 << 15):
            x = slice(at, at + (1 << 15))
            p = mixer.ones([f[0][x] for f in found], gates[0][x])
            out[rows[x]] += np.log10(np.where(bit[x] > 0, p, 1 - p))
    return out


# --- codes of words ------------------------------------------------------------------------------------------------


def huffman(masses: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """A prefix code with the shortest mean path: code (paths begin at the top bit), path length, and width."""
    heap = [(m, i) for i, m in enumerate(masses)]
    heapq.heapify(heap)
    up, n = {}, len(masses)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (n, 0), (n, 1)
        heapq.heappush(heap, (a + b, n))
        n += 1
    paths = {n - 1: (0, 0)}
    for node in range(n - 2, -1, -1):
        parent, bit = up[node]
        path, length = paths[parent]
        paths[node] = (path << 1 | bit, length + 1)
    width = max(paths[i][1] for i in range(len(masses)))
    code = np.array([paths[i][0] << (width - paths[i][1]) for i in range(len(masses))], np.int64)
    return code, np.array([paths[i][1] for i in range(len(masses))], np.int64), width


# --- spelling ------------------------------------------------------------------------------------------------------


def log10_spellings(tokens: pa.Array, mass: np.ndarray) -> np.ndarray:
    """log10 of each token's bytes and a space after them, learned from the tokens themselves, seen ``mass`` times each.

    Five predictors look at the last one, two, three and four bytes, and at the whole token so far. Tokens that begin
    alike share the rows of their beginning.
    """
    if not len(tokens):
        return np.empty(0)
    data, starts, bases = bytes_of(tokens)
    per_byte = np.repeat(mass, np.diff(np.append(starts, len(data))))
    _, first, row = np.unique(mix64(bases[-1] + (data.astype(_U) + _U(1)) * _C[5]), return_index=True, return_inverse=True)
    count = np.zeros(len(first), np.int64)
    np.add.at(count, row, per_byte)
    code, length = data[first].astype(np.int64), np.full(len(first), 8)
    edges = {2: SECOND_EDGES, 4: FIRST_EDGES}  # the whole token tells most, then three bytes
    logs = log10_paths([Counts(bases[k][first], code, count, 8, edges.get(k, ())) for k in (0, 1, 3, 2, 4)], code, length, count, 8)
    return np.add.reduceat(logs[row], starts)


def bytes_of(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bytes of the tokens, each with a space after it, where each token begins, and the context hashes of every byte."""
    closed = pc.binary_join_element_wise(tokens.cast(pa.large_binary()), pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    offsets = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset : closed.offset + len(closed) + 1]
    data = np.frombuffer(closed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets[:-1] - offsets[0]
    lengths = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    wide = data.astype(_U)
    back = []
    for k in range(1, 5):
        prev = np.full(len(data), 32, _U)
        prev[k:] = np.where(place[k:] >= k, wide[:-k], _U(32))
        back.append(prev)
    power = np.multiply.accumulate(np.full(len(data), _C[0], _U))
    inverse = np.multiply.accumulate(np.full(len(data) + 1, _U(pow(int(_C[0]), -1, 2**64)), _U))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((wide + _U(1)) * power, dtype=_U)])
    first = np.repeat(starts, lengths)
    prefix = (sums[:-1] - sums[first]) * inverse[first] + place.astype(_U)
    joint = back[0]
    bases = [joint]
    for k in (1, 2, 3):
        joint = joint << _U(8) | back[k]
        bases.append(joint)
    bases.append(mix64(prefix * _C[4]))
    return data, starts, bases
