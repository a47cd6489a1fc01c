import numpy as np
import pytest

from lodeseek.llm import qgram_decon as qd

RNG = np.random.default_rng(11)


def prose(n, rng=RNG):
    return " ".join("".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 8)))) for _ in range(n))


def fewest_edits(pattern, text):
    """Edits of the best alignment of a pattern with any part of a text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, start=1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, start=1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def plain(texts, items):
    found = set()
    for t, text in enumerate(texts):
        low = " ".join((text or "").lower().split())
        for b, item in enumerate(items):
            own = " ".join((item or "").lower().split())
            n = len(own)
            if n < qd.LEAST:
                continue
            starts = sorted({*range(0, max(1, n - qd.WINDOW + 1), qd.WINDOW // 2), max(0, n - qd.WINDOW)})
            for s in starts:
                w = own[s : s + qd.WINDOW]
                if fewest_edits(w, low) <= min(len(w) // 10, (len(w) - qd.Q) // qd.Q):
                    found.add((t, b))
    return found


def changed(text, n, rng):
    chars = list(text)
    for _ in range(n):
        at = int(rng.integers(len(chars)))
        kind = rng.integers(3)
        if kind == 0:
            chars[at] = "z"
        elif kind == 1:
            chars.insert(at, "y")
        else:
            del chars[at]
    return "".join(chars)


def test_found_are_all_that_alignment_finds():
    rng = np.random.default_rng(4)
    items = [prose(8, rng)[:40], prose(20, rng), prose(30, rng), "short", None, prose(20, rng)]
    texts = [prose(40, rng), None, ""]
    for edits in range(0, 14, 2):
        for b in (0, 1, 2):
            part = items[b][: 64 if b else None]
            texts.append(f"{prose(10, rng)} {changed(part.upper(), edits, rng)}\n{prose(10, rng)}")
    index = qd.build(list(enumerate(items)))
    got = {(t, index.ids[b]) for t, b, *_ in qd.find([x or "" for x in texts], index)}
    assert got == plain(texts, items)
    assert any(t > 3 for t, _ in got)


def test_regions_are_places_of_the_text():
    item = prose(30)
    text = f"ÄÖ  intro\n\n {item.replace(' ', chr(10) + '  ')} outro"
    index = qd.build([(9, item)])
    ((t, b, windows, edits, start, end),) = qd.find([text], index)
    assert " ".join(text[start:end].split()) == item and edits == 0 and windows == len(index.sizes)


def test_leaks_and_clean_texts(spark, monkeypatch):
    monkeypatch.setattr(qd, "BLOCK_CHARS", 400)
    items = [prose(30) for _ in range(8)]
    bench = spark.createDataFrame(
        [(i, x) for i, x in enumerate(items)] + [(50, None), (51, ""), (None, items[0])],
        "item_id long, text string",
    )
    rows = [(i, f"{prose(50)} {items[i]} {prose(50)}") for i in range(8)]
    rows += [(20 + i, prose(100)) for i in range(10)]
    rows += [(30, None), (31, ""), (None, items[2]), (0, rows[0][1]), (40, prose(60_000) + items[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS edits")
    got = sorted(((r["doc_id"], r["item_id"]) for r in qd.leaks(docs, bench).collect()), key=str)
    want = [(i, i) for i in range(8)] + [(0, 0), (0, None), (0, None), (None, 2), (40, 5)]
    assert got == sorted(want, key=str)
    left = qd.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [*range(20, 30), 30, 31]
    assert qd.leaks(docs.where("false"), bench).collect() == []
    assert qd.leaks(docs, bench.where("false")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9])
def test_grams_of_short_texts(n):
    assert len(qd.grams(np.arange(n, dtype=np.uint32))) == max(0, n - qd.Q + 1)


def found_in(texts, index, size):
    """Results of texts searched ``size`` at a time."""
    out = []
    for at in range(0, len(texts), size):
        out += [(t + at, *rest) for t, *rest in qd.find(texts[at : at + size], index)]
    return out


def test_texts_that_end_or_begin_in_a_window():
    rng = np.random.default_rng(8)
    items = [prose(40, rng) for _ in range(4)]
    texts = []
    for b, item in enumerate(items):
        for cut in range(9):
            texts += [f"{prose(12, rng)} {item[: qd.WINDOW - cut]}".strip(), prose(30, rng)]
            texts += [f"{item[-qd.WINDOW + cut :].strip()} {prose(12, rng)}", item[cut : qd.WINDOW].strip()]
    texts.append(items[0][: qd.WINDOW - 5].strip())
    index = qd.build(list(enumerate(items)))
    whole = qd.find(texts, index)
    assert {(t, b) for t, b, *_ in whole} == plain(texts, items)
    assert {t for t, *_ in whole} >= {0, len(texts) - 1}
    for size in (1, 2, 7):
        assert found_in(texts, index, size) == whole


def test_periodic_texts():
    items = ["-" * 80, "ab" * 50, "ha ha " * 20]
    index = qd.build(list(enumerate(items)))
    texts = ["-" * 200, "ab" * 100, "ha ha " * 20, "-" * 60, "", "-" * 20, "ba" * 31, "-" * 59]
    for order in (texts, texts[::-1]):
        assert {(t, b) for t, b, *_ in qd.find(order, index)} == plain(order, items)
        for size in (1, 3):
            assert found_in(order, index, size) == qd.find(order, index)


def test_short_items_by_choice():
    items = ["yes", "twelve chars", "a rather longer sentence than those"]
    index = qd.build(list(enumerate(items)), least=1)
    texts = ["no", "oh YES yes", "twelve  chars", "twelve charts", "twelve", "say yes"]
    got = {(t, index.ids[b]) for t, b, *_ in qd.find(texts, index)}
    assert got == {(1, 0), (2, 1), (5, 0)}
    assert qd.find(texts, qd.build(list(enumerate(items)))) == []


def test_columns_of_any_name_pass(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").selectExpr(
        "doc_id", "text", "'x' AS _scan_text", "'y' AS text_0"
    )
    bench = spark.createDataFrame([(1, prose(30))], "item_id long, text string")
    left = qd.clean(docs, bench)
    assert left.columns == docs.columns and left.count() == 2
