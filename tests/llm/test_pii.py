"""Personal data: base spans against the patterns as they are stated, the field against enumeration, added spans on planted spellings."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from samples import messy_rows

from latticeworks.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number):
    doubled = [int(x) * 2 if i % 2 else int(x) for i, x in enumerate(number[::-1])]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def stated(text):
    """Base spans by the patterns of the contract, word for word."""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, least, most, fine in (("card", CARD, 14, 19, luhn), ("phone", PHONE, 10, 15, lambda d: True)):
        for m in pattern.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if least <= len(d) <= most and fine(d):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(0)
    pieces = ["@", ".", "a", "B9", "-", "%", "+", "1", "22", "255", "256", "0007", " ", "(", ")", "\n", "é", "x.y", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "10.0.0.1", "a@b.cd", "_", "１"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 24)))
        assert pii.base_spans(text) == stated(text), text


@pytest.fixture(scope="module")
def model():
    return pii.train(*pii.examples(pii.generated(), []))


def enumerated(g, f):
    """Marginals of the nodes by summing over all labellings."""
    n, total = g.n, np.zeros((g.n, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=n + g.hubs):
        if any(c >= 0 and y[i] != c for i, c in enumerate(g.clamped)):
            continue
        score = sum(f.unary[k, y[i]] for i, k in zip(g.at, g.feature, strict=True) if g.clamped[i] < 0)
        score += sum(f.step[pii.NONE, y[i]] for i in range(n) if g.first[i] and g.clamped[i] < 0) + sum(f.step[y[i], pii.NONE] for i in range(n) if g.last[i] and g.clamped[i] < 0)
        score += sum(f.step[y[a], y[b]] for a, b in g.chain) + sum(f.hub[y[n + h]] for h in range(g.hubs))
        score += sum(f.agree[k] * (y[i] == y[n + h]) for i, h, k in g.star)
        total[np.arange(n), y[:n]] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("text,exact", [("+1 (743) 555-3824 and 743-555-3824 there", True), ("bob.19 [at] mail5 [dot] example", True), ("no 7435553824 no 5553824 but +17435553824", False)])
def test_messages_agree_with_enumeration(model, text, exact):
    """Without loops marginals are exact; with them they are close."""
    graph = pii.Graph()
    pii.add_document(graph, 0, text, pii.base_spans(text))
    g = pii.Layout(graph)
    assert g.n > 1
    np.testing.assert_allclose(pii.propagate(g, model, rounds=40).node, enumerated(g, model), atol=1e-6 if exact else 0.1)


def test_gradient_is_the_slope(model):
    """On a graph without loops the gradient is that of the log likelihood, which enumeration gives."""
    graph = pii.Graph()
    text = "+1 (743) 555-3824 and 743-555-3824 or 12345678"
    pii.add_document(graph, 0, text, pii.base_spans(text))
    g = pii.Layout(graph)
    gold = np.where(g.clamped >= 0, g.clamped, 0)
    found = pii.gradient(g, model, gold, np.full(g.hubs, 4))
    free = np.flatnonzero(g.clamped < 0)
    marginal = enumerated(g, model)
    want = np.zeros_like(model.unary)
    for i, k in zip(g.at, g.feature, strict=True):
        if i in free:
            want[k] += np.eye(pii.LABELS)[gold[i]] - marginal[i]
    np.testing.assert_allclose(found[0], want, atol=1e-4)


def test_held_out_spellings(model):
    """Other spellings of mentions, made with other seeds, are found; spellings that nothing supports are left alone."""
    graph, gold = pii.examples(pii.generated(80, 99), [], 99)
    marginal, gold = pii.propagate(pii.Layout(graph), model).node, np.array(gold)
    free, label = np.array(graph.clamped) < 0, marginal.argmax(axis=1)
    sure = free & (label > 0) & (marginal.max(axis=1) >= pii.LEAST)
    assert (gold[sure] == label[sure]).mean() > 0.97
    assert (sure & (label == gold))[free & (gold > 0)].mean() > 0.93


PLANTED = [
    ("Call +1 (743) 555-3824 today. Later he said 743-555-3824 again.", ["743-555-3824"], "link_phone"),
    ("Card 4111 1111 1111 1111 was typed as 411111111111111 there.", ["411111111111111"], "link_card"),
    ("Host 10.20.30.40 is written 10-20-30-40 in the log.", ["10-20-30-40"], "link_ip"),
    ("Write to bob.19@mail5.example.com or bob.19[at]mail5[dot]example[dot]com now", ["bob.19[at]mail5[dot]example[dot]com"], "link_email"),
]


@pytest.mark.parametrize("text,found,kind", PLANTED)
def test_consistency_over_distance(model, text, found, kind):
    """The second spelling is reported beside the first, however far away, and not without it."""
    for gap in (" ", " words and words" * 4000 + " "):
        far = text.replace(" or ", " or" + gap).replace(" again", " again" + gap) if gap != " " else text
        spans = pii.find_all([far], model)[0]
        assert [far[a:b] for k, a, b in spans if k == kind] == found
        assert [s for s in spans if s[0] in pii.BASE] == pii.base_spans(far)
    if kind != "link_email":
        first = pii.base_spans(text)[0]
        alone = text[: first[1]] + "nothing" + text[first[2] :]
        assert pii.find_all([alone], model)[0] == []


def test_clean_texts_stay_clean(model):
    texts = ["In 2024 we sold 12,345 units at 19.99 each, up 4.5% on 2023-01-02.", "Call 911. See chapter 3.2.1, pages 100-120; meet at 10:30.", "Order 4929123412341234 shipped", "v1.2.3 [at] home", "1 2 3 4 5 6 7 8 9 10 " * 50, "ISBN 978-3-16-148410-0"]
    assert [pii.find_all([t], model)[0] for t in texts] == [[] for _ in texts]


def test_a_text_does_not_depend_on_others(model):
    texts = [t for t, *_ in PLANTED] + [None, "", "plain"]
    together = pii.find_all(texts, model)
    assert together == [pii.find_all([t], model)[0] for t in texts]


def test_time_is_in_proportion(model):
    n = 2_000_000
    hard = ["1" * n, "a" * n + "@", "@" * n, "a@" * (n // 2), "1." * (n // 2), "1 " * (n // 4), "+1(" + "(" * n, "1-" * (n // 2), "[at] " * (n // 20), "é" * n + "7", "a@b" * (n // 3), "12345678 " * (n // 40)]
    for text in hard:
        start = time.perf_counter()
        pii.find_all([text], model)
        assert time.perf_counter() - start < 30, text[:20]


def expected(rows, model):
    """Digest columns from the stated patterns and the spans of the field."""
    out = []
    for doc_id, text in rows:
        base = stated(text or "")
        own = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = [sum(k == b for k, *_ in base) for b in pii.BASE]
        out.append((doc_id, *counts, hashlib.sha256(own(base).encode()).hexdigest(), own(pii.find_all([text], model)[0])))
    return out


def test_query_on_messy_rows(spark, messy, nothing, tmp_path):
    extra = [(900 + i, t) for i, (t, *_) in enumerate(PLANTED)] + [(None, PLANTED[0][0]), (900, PLANTED[0][0])]
    rows = [r[:2] for r in messy_rows()] + extra
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, h int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_personal_data(spark, f"file://{tmp_path}").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected(rows, pii.fit(docs))))
    model = pii.fit(docs)
    assert all((a == b).all() for a, b in zip(model.parts(), pii.fit(docs.repartition(7)).parts(), strict=True))
    assert pii.scan(nothing).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).collect()}
    assert clean[900] == "Call [PHONE] today. Later he said [PHONE] again."
    assert pii.redact(docs, model).columns == docs.columns
