import numpy as np
import pytest

from lodeseek.llm import line_dedup as ld
from lodeseek.workspace import work_path

BLANK = " \t\r\x0b\x0c"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, start=1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, start=1):
            last, row[j] = row[j], min(last + (c != d), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def plain(rows):
    """Kept text and number of removed lines of each row, by comparing all lines."""
    order = []
    for r, (d, text) in enumerate(rows):
        for i, line in enumerate(text.split("\n") if text is not None else []):
            if line.strip(BLANK):
                order.append(((d is None, d or 0), i, r, line))
    gone = set()
    for a in order:
        for b in order:
            before = (b[0], b[1]) < (a[0], a[1])
            x, y = a[3], b[3]
            close = x == y or (min(len(x), len(y)) >= ld.LEAST and abs(len(x) - len(y)) < 2 and distance(x, y) < 2)
            if before and close:
                gone.add((a[2], a[1]))
                break
    out = []
    for r, (d, text) in enumerate(rows):
        if text is None:
            out.append((d, None, 0))
            continue
        lines = text.split("\n")
        kept = [x for i, x in enumerate(lines) if (r, i) not in gone]
        out.append((d, "\n".join(kept), len(lines) - len(kept)))
    return out


def lines(seed, n):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("ab é"), int(rng.integers(1, 16)))) for _ in range(25)]
    for i in range(n):
        own = []
        for _ in range(int(rng.integers(0, 6))):
            x = list(base[int(rng.integers(25))])
            for _ in range(int(rng.integers(0, 3))):
                at = int(rng.integers(len(x) + 1))
                x[at : at + int(rng.integers(0, 2))] = rng.choice(["", "a", "b"])
            own.append("".join(x))
        yield i, "\n".join(own)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_are_removed_as_by_comparing_all(spark, seed):
    rows = list(lines(seed, 60))
    rows += [(100, None), (101, ""), (102, " \n\t\n"), (None, rows[5][1] + "\nlast one of all"), (103, rows[7][1])]
    rows += [(200 + i, f"a very common line of text\nown line number {i} here") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS removed", "2 AS name", "3 AS id", "4 AS _line_id", "5 AS _line_mark", "6 AS row", "7 AS lines"
    )
    out = ld.dedup_lines(docs.repartition(5), work_path(spark, "ld"))
    assert out.columns == [*docs.columns, "_removed"]
    got = [(r["doc_id"], r["text"], r["_removed"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_repeated_rows_and_ids_and_long_lines(spark):
    long = "é" * 40_000
    rows = [(1, "same text here"), (1, "same text here"), (1, "another text here"), (2, "same text hers")]
    rows += [(3, long + "x"), (4, long + "y"), (5, "y" + long), (6, long + "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], (r["text"] or "")[-12:], r["_removed"]) for r in ld.dedup_lines(docs, work_path(spark, "ld")).collect()]
    tail = "é" * 11
    assert sorted(got) == sorted(
        [(1, "me text here", 0), (1, "me text here", 0), (1, "er text here", 0), (2, "", 1),
         (3, tail + "x", 0), (4, "", 1), (5, tail + "é", 0), (6, "", 1)]
    )


def test_documents_left_empty_can_go(spark):
    rows = [(1, "first line of text\nsecond line of text"), (2, "first line of text\n\n"), (3, ""), (4, None), (5, "second line of text\nnew and other line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS _removed")
    out = ld.dedup_lines(docs, work_path(spark, "ld"), drop_empty=True)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {
        1: rows[0][1], 3: "", 4: None, 5: "new and other line",
    }
    assert ld.dedup_lines(docs.where("false"), work_path(spark, "ld")).collect() == []


def test_a_count_beside_a_column_of_its_name(spark):
    docs = spark.createDataFrame([(1, "a line of text\na line of text")], "doc_id long, text string")
    out = ld.dedup_lines(docs.selectExpr("*", "'x' AS _removed"), work_path(spark, "ld"))
    assert [tuple(r) for r in out.collect()] == [(1, "a line of text", "x", 1)]
    assert out.columns == ["doc_id", "text", "_removed", "_removed_"]
