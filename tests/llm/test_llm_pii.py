import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub(r"\D", "", m[0])
            odd = sum(int(d) for d in digits[-1::-2])
            even = sum(int(d) * 2 - 9 * (int(d) > 4) for d in digits[-2::-2])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 16 <= len(digits) <= 19 and (odd + even) % 10 == 0,
                "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]
            if good():
                out.append((kind, *m.span()))
    return out


PARTS = [*"ab.@-+ ()0", "1.2.3.4", "+1 (743) 555-3824", "4111 1111 1111 1111", "a@b.co", "é", "256", "x%y"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans_are_those_of_the_rules(text):
    assert pii.base_spans(text) == plain(text)


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(3)
    ids = rng.integers(1, pii.CLASSES, (7, 3))
    tags = np.zeros((7, 3), np.int64)
    tags[2, 0], tags[3, 0] = 1, 2
    p = {k: (v + rng.standard_normal(v.shape) * 0.1).astype(np.float64) for k, v in pii.init().items()}
    _, grad = pii.gradients(p, ids, tags)
    for name in ("emb", "hf", "xb", "bf", "out", "trans", "bias"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        sides = []
        for step in (1e-3, -1e-3):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            sides.append(pii.gradients(q, ids, tags)[0])
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(grad[name][at], rel=2e-2, abs=1e-3)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(5)
    e, trans = rng.standard_normal((4, 1, 3)), rng.standard_normal((3, 3))
    paths = [(a, b, c, d) for a in range(3) for b in range(3) for c in range(3) for d in range(3)]
    total = lambda p: sum(e[i, 0, t] for i, t in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
    assert tuple(pii.viterbi(e, trans)[:, 0]) == max(paths, key=total)
    a, b, log = pii.marginals(e, trans)
    assert log[0] == pytest.approx(np.log(sum(np.exp(total(p)) for p in paths)))


def test_reconciliation_takes_the_best_disjoint_set():
    found = {("ip", 0, 10): 0.9, ("ip", 8, 20): 1.0, ("ip", 20, 25): 0.5, ("card", 18, 22): 0.98}
    assert pii.reconcile(found, []) == [("ip", 0, 10, 0.9), ("card", 18, 22, 0.98)]
    assert pii.reconcile(found, [("email", 3, 5)]) == [("ip", 8, 20, 1.0), ("ip", 20, 25, 0.5)]


def people(n):
    rng = np.random.default_rng(n)
    words = ["alpha", "beta", "gamma", "delta", "the", "and", "of"]
    for i in range(n):
        lead = " ".join(rng.choice(words, int(rng.integers(3, 30))))
        tail = " ".join(rng.choice(words, int(rng.integers(3, 60))))
        yield i, f"{lead} {rng.choice(words)}{i}@{rng.choice(words)}.com {tail}"


def test_the_network_adds_what_the_rules_miss(spark):
    docs = spark.createDataFrame(list(people(400)), "doc_id long, text string")
    params = pii.learn(docs)
    text = "gamma delta and the alpha beta77 @ gamma.com of the beta and delta alpha the gamma of"
    (spans,) = pii.spans_of([text], params)
    assert [text[s[1] : s[2]] for s in spans if not s[4]] == ["beta77 @ gamma.com"]
    rows = [(1, "mail a@b.co now", "x"), (2, None, "x"), (3, ""), (4, "é" * 99_999 + "a@b.co")]
    rows = [(*r, "x")[:3] for r in rows] + [(1, "mail a@b.co now", "x"), (None, "1.2.3.4", "x")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {}
    for r in pii.find_spans(odd, params, ["doc_id"]).collect():
        got.setdefault(r["doc_id"], []).append([(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]])
    assert got == {
        1: [[("email", 5, 11)]] * 2, 2: [[]], 3: [[]],
        4: [[("email", 99_999 - 99_999 + 99_999, 100_005)]], None: [[("ip", 0, 7)]],
    }


def test_windows_of_many_long_texts_teach_spaced_at_signs(spark):
    lead = " ".join(f"item {i} of the alpha and beta" for i in range(12))
    rows = [(i, f"{lead} {text} {lead}") for i, text in people(1200)]
    params = pii.learn(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    text = "gamma delta and the alpha beta77 @ gamma.com of the beta and delta alpha the gamma of"
    (spans,) = pii.spans_of([text], params)
    assert [text[s[1] : s[2]] for s in spans if not s[4]] == ["beta77 @ gamma.com"]


def test_without_labels_there_are_base_spans_only(spark):
    docs = spark.createDataFrame([(1, "no data"), (2, None)], "doc_id long, text string")
    assert pii.learn(docs) is None
    assert pii.learn(docs.where("false")) is None
    assert [r["spans"] for r in pii.find_spans(docs, None, ["doc_id"]).collect()] == [[], []]


def test_reconciling_is_linear_and_exact():
    rng = np.random.default_rng(9)
    starts = rng.integers(0, 4000, 600)
    base = [("ip", int(a), int(a + n)) for a, n in zip(starts[:200], rng.integers(1, 30, 200))]
    found = {("card", int(a), int(a + n)): float(s) for a, n, s in zip(starts[200:], rng.integers(1, 9, 400), rng.random(400))}
    got = pii.reconcile(found, base)
    assert all(b <= x or y <= a for _, a, b, _ in got for _, x, y in base)
    assert all(p[2] <= q[1] for p, q in zip(got, got[1:]))
    free = sorted((b, a, s) for (_, a, b), s in found.items() if all(b <= x or y <= a for _, x, y in base))
    best = {0: 0.0}
    for end in range(1, 4100):
        best[end] = max([best[end - 1], *(best[a] + s for b, a, s in free if b == end)])
    assert abs(sum(s for *_, s in got) - best[4099]) < 1e-9


def test_cut_spans_are_joined():
    rng = np.random.default_rng(3)
    for _ in range(60):
        spans, at, size = [], 0, int(rng.integers(300, 900))
        while True:
            a = at + int(rng.integers(0, 60))
            b = a + int(rng.choice([1, 9, 47, 48, 49, 96, 97, 200]))
            if b > size:
                break
            spans.append((str(rng.choice(pii.KINDS)), a, b))
            at = b + 1
        whole, cut = {}, []
        final = max(0, -(-(size - pii.WIDTH) // pii.STEP))
        for start in range(0, final * pii.STEP + 1, pii.STEP):
            for kind, s, e, begun in pii.stretches(pii.tags_of(spans, start)):
                left = s == 0 and start > 0
                right = e == pii.WIDTH and start + e < size
                assert begun or left
                if left or right:
                    cut.append((start + s, start + e, kind, 0.9, left, right))
                else:
                    whole[kind, start + s, start + e] = 0.9
        assert set(whole) | set(pii.joined(cut)) == set(spans)
    # What never ends, never begins, or is of another kind is none.
    open_end, no_begin = (10, 96, "ip", 0.9, False, True), (96, 130, "ip", 0.9, True, False)
    assert pii.joined([open_end, no_begin]) == {}
    assert pii.joined([open_end, (48, 120, "card", 0.9, True, False)]) == {}
    assert pii.joined([open_end, (48, 120, "ip", 0.7, True, False)]) == {("ip", 10, 120): 0.7}


def test_long_spans_come_whole_from_many_windows(monkeypatch):
    name = ".".join(["anna7", "maria8", "berg9"] * 8)
    address = f"{name} @ mail5.example6.host7.org"
    assert len(address) > pii.WIDTH + pii.STEP
    text = "word " * 7 + f"please write to {address} today or call 12"
    a = text.index(address)
    starts = pii.window_starts(text)

    def marked(p, windows):
        for w, start in enumerate(starts):
            row = pii.tags_of([("email", a, a + len(address))], start)
            for kind, s, e, begun in pii.stretches(row):
                yield w, kind, s, e, begun, 0.9

    monkeypatch.setattr(pii, "candidates", marked)
    (spans,) = pii.spans_of([text], {})
    assert ("email", a, a + len(address), 0.9, False) in spans
