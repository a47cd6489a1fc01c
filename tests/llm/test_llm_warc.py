import base64
import hashlib
import io
import struct

import pytest
import zstandard

from lodeseek.llm import warc
from lodeseek.workspace import work_path


def test_pages_round_trip(spark):
    rows = [(i, f"http://e.x/{i}?a b", f"<p>{i % 4}</p>" * (i % 4)) for i in range(40)]
    rows += [(100, None, None), (101, "u\n", ""), (None, "no id", "<p>1</p>"), (5, "again", "<p>new</p>")]
    rows += [(200, "big", "é" * 300_000), (201, "big", "é" * 300_000), (7, rows[7][1], rows[7][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'x' AS payload", "1 AS digest"
    )
    folder = work_path(spark, "warc")
    got = warc.read_archives(spark, folder, warc.write_archives(pages, folder)).collect()
    top = {}
    for page, _, html in rows:
        if page is not None:
            top[html or ""] = max(page, top.get(html or "", page))
    want = []
    for page, _, html in rows:
        data, first = (html or "").encode(), top[html or ""]
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        kind = "response" if page == first else "revisit"
        want.append((page, len(data), sha, kind, None if kind == "response" else first))
    key = lambda r: tuple(str(x) for x in r)
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted(want, key=key)
    assert {bytes(r["payload"]).decode() for r in got if r["page_id"] == 201} == {"é" * 300_000}
    assert {r["url"] for r in got if r["page_id"] == 3} == {"http://e.x/3?a%20b"}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = work_path(spark, "warc")
    assert warc.read_archives(spark, folder, warc.write_archives(pages, folder)).collect() == []


def archive(records, dictionary=b""):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    codec, out = zstandard.ZstdCompressor(dict_data=d), b""
    if dictionary:
        out = struct.pack("<II", warc.DICT_FRAME, len(dictionary)) + dictionary
    return out + b"".join(codec.compress(r) for r in records)


@pytest.mark.parametrize("packed", [False, True])
def test_the_dictionary_leads(packed):
    samples = [b"<html><body>page %d</body></html>" % i * 5 for i in range(500)]
    raw = zstandard.train_dictionary(2000, samples).as_bytes()
    data = archive([warc.record(i, None, s, None, False) for i, s in enumerate(samples)], raw)
    if packed:
        small = zstandard.ZstdCompressor().compress(raw)
        data = struct.pack("<II", warc.DICT_FRAME, len(small)) + small + data[8 + len(raw) :]
    got = list(warc.read_records(io.BytesIO(data)))
    assert [r["payload"] for r in got] == samples
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data[8 + len(raw) :] if not packed else data[:-3])))


@pytest.mark.parametrize(
    "old, new",
    [
        (b"WARC/1.1", b"WARC/9.9"),
        (b"WARC-Record-ID", b"Other-Record"),
        (b"WARC-Date: ", b"WARC-Date  "),
        (b"<p>text</p>", b"<p>tent</p>"),
        (b"Content-Length: 11", b"Content-Length: 12"),
        (b"</p>\r\n\r\n", b"</p>"),
        (b"response\r", b"metadata\r"),
        (b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:X"),
    ],
)
def test_faults_are_found(old, new):
    good = warc.record(1, "u", b"<p>text</p>", None, False)
    assert warc.parse(good)["payload"] == b"<p>text</p>"
    assert old in good
    with pytest.raises(warc.WarcError):
        warc.parse(good.replace(old, new, 1))


def test_a_cut_frame_is_found():
    data = archive([warc.record(1, "u", b"x" * 1000, None, False)])
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data[:-5])))
