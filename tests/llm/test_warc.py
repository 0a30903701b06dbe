"""WARC archives: exact round trips, revisits, segments and framing."""

import base64
import gzip
import hashlib
import random

import pytest

from forgelens.llm import warc
from forgelens.llm.store import shared_path

BETWEEN = "\r\n\r\nWARC/1.1\r\n"
SCHEMA = "page_id bigint, url string, html string, block string, segment string, value string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_chunked_framing():
    rng = random.Random(1)
    for n in (0, 1, 9, 10, 11, 100):
        data = rng.randbytes(n)
        assert warc.decode_chunked(warc.encode_chunked(data, 10)) == data
    nasty = BETWEEN.encode() * 3 + warc.VERSION * 2 + b"\r\n0\r\n\r\n" + warc.VERSION
    for size in (3, 12, 1000):
        framed = warc.encode_chunked(nasty, size)
        assert warc.decode_chunked(framed) == nasty
    assert warc.decode_chunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.decode_chunked(b"3\r\nabcd\r\n0\r\n\r\n")


def rows():
    rng = random.Random(4)
    nasty = BETWEEN * 2 + "WARC-Segment-Number: 3\r\n" + "\r\n\r\n0\r\n\r\n"
    texts = [None, "", "a", "é" * 50, nasty, nasty * 40, "x" * 5000, "line\r\n\r\n" * 600, "WARC/1.1\r\n" * 500,
             "".join(chr(rng.randrange(1, 0x2000)) for _ in range(3000)), "copy", "\r\n", "\r\n\r\n", "0\r\n\r\n"]
    made = [(i, f"http://h/{i}?q=a b\r\nX: y" if i % 3 else None, t) for i, t in enumerate(texts)]
    made += [(100 + i, "u", "copy") for i in range(50)] + [(10, "again", "copy"), (7, "u", "other"), (7, "u", "x" * 5000)]
    made += [(None, "u", "copy"), (None, "u", "alone with null")]
    rng.shuffle(made)
    return made


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("split", ["128m", "2k"])
@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, least, split, compression):
    made = rows()
    frame = spark.createDataFrame([(*r, "b", "s", "v") for r in made], SCHEMA).repartition(3)
    path = shared_path(spark, "test-warc")
    warc.write_warc(frame, path, revisit_bytes=least, segment=700, chunk=150, compression=compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.reassembled(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first: dict = {}
    for key, _, text in made:
        if len((text or "").encode()) >= least:
            keys = first.setdefault(text or "", [])
            keys.append(key)
    expected = []
    for key, _, text in made:
        ids = [k for k in first.get(text or "", []) if k is not None]
        revisit = bool(ids) and key != min(ids)
        n = len((text or "").encode())
        expected.append((str(key), n, digest(text), "revisit" if revisit else "response", str(min(ids)) if revisit else None))
    page = lambda uri: uri and uri.removeprefix("<urn:x-page:").split(":")[0]
    assert all(r.complete for r in got)
    assert max(r.n_segments for r in got) > 5
    assert sorted(
        ((page(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, page(r.refers_to)) for r in got), key=str
    ) == sorted(expected, key=str)
    texts = {page(r.record_id) + r.payload_digest: r.payload for r in got if r.payload is not None}
    for key, _, text in made:
        if str(key) + digest(text) in texts:
            assert bytes(texts[str(key) + digest(text)]) == (text or "").encode()


def test_missing_and_repeated_segments(spark):
    """A record that lacks a segment, has one twice or another length is not complete."""
    path = shared_path(spark, "test-warc-broken")
    records = []
    for page in range(4):
        own = list(warc.page_records(page, None, b"y" * 3000, None, "0.1", 700, 100))
        if page == 1:
            del own[2]
        if page == 2:
            own.append(own[1])
        if page == 3:
            own[-1] = own[-1].replace(b"Total-Length: 3", b"Total-Length: 4")
        records += own
    random.Random(0).shuffle(records)
    rows = spark.createDataFrame([(r.decode(),) for r in records], "value string")
    rows.write.option("lineSep", "\r\n\r\n").text(path)
    got = {r.record_id[12]: r for r in warc.reassembled(spark, path).collect()}
    assert [got[str(i)].complete for i in range(4)] == [True, False, False, False]
    assert [got[str(i)].payload_bytes for i in range(4)] == [3000, None, None, None]


def record(version, kind, name, block, *more, length=None):
    head = [version, f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *more, f"Content-Length: {len(block) if length is None else length}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def cut(data, size):
    reader, found = warc.RecordReader(), []
    for at in range(0, len(data), size):
        found += reader.feed(data[at : at + size])
    return found + list(reader.feed(b"", last=True))


NASTY = b"x\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_records_are_cut_by_their_length(size):
    good = [record("WARC/1.0", "response", f"r{i}", block) for i, block in enumerate([b"", NASTY, b"\n" * 9, b"z" * 3000, b"\x00\xff\r\n"])]
    found = cut(b"".join(good), size)
    assert [(f["warc-record-id"], e) for f, _, e in found] == [(f"<r{i}>", None) for i in range(5)]
    assert [b for _, b, _ in found] == [b"", NASTY, b"\n" * 9, b"z" * 3000, b"\x00\xff\r\n"]
    # lines that go on, line feeds alone, other 1.x versions
    folded = b"WARC/1.2\nwarc-type: metadata\nX-Long: a\n  b\n\tc\ncontent-length: 2\n\nok\n\n" + good[1]
    (one, block, _), (two, _, _) = cut(folded, size)
    assert (one["x-long"], block, two["warc-record-id"]) == ("a b c", b"ok", "<r1>")


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_bad_records_become_rows_and_reading_goes_on(size):
    good = record("WARC/1.1", "response", "good", b"block")
    bad = record("WARC/1.1", "response", "bad", b"lost bytes", length="ten")
    none = b"WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    found = cut(b"garbage at first\r\n" + good + bad + good + b"\r\nnoise\r\n" + good + none + good + good[:-7], size)
    errors = [e for _, _, e in found]
    assert [e is None for e in errors] == [False, True, False, False, True, False, True, False, True, False]
    assert errors[0] == "16 bytes that belong to no record"
    assert found[2][0]["warc-record-id"] == "<bad>" and "'ten'" in errors[2]
    assert errors[3] == "10 bytes that belong to no record" and errors[5] == "5 bytes that belong to no record"
    assert errors[7] == "no usable Content-Length: ''"
    assert found[9][1:] == (good[:-7].split(b"\r\n\r\n", 1)[1], "cut short")
    assert sum(f.get("warc-record-id") == "<good>" and e is None for f, _, e in found) == 4
    assert cut(b"", size) == [] and cut(b"no record at all", size)[0][2] == "16 bytes that belong to no record"


def test_a_header_without_an_end_is_bounded(monkeypatch):
    monkeypatch.setattr(warc, "LONGEST_HEADER", 1000)
    good = record("WARC/1.1", "response", "good", b"block")
    found = cut(b"WARC/1.1\r\n" + b"A: b\r\n" * 500 + good, 64)
    assert [e for _, _, e in found][0] == "a header that does not end"
    assert found[-1][0]["warc-record-id"] == "<good>" and found[-1][2] is None


@pytest.mark.parametrize("name", ["a.warc", "a.warc.gz", "b.txtz"])
def test_foreign_archives(spark, tmp_path, name):
    """Files of five records, one gzip member each; payloads that hold whole records; bad ones as rows."""
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    first = record("WARC/1.0", "warcinfo", "info", b"software: x\r\n")
    records = [first] + [record("WARC/1.0", "response", f"r{i}", http + NASTY * i) for i in range(1, 4)]
    records.append(record("WARC/1.0", "response", "chunked", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab"))
    bad = record("WARC/1.0", "response", "bad", b"", "WARC-Segment-Number: one")
    pack = gzip.compress if name.endswith(".gz") else bytes
    (tmp_path / name).write_bytes(b"".join(map(pack, records)))
    (tmp_path / f"x{name}").write_bytes(pack(bad) + pack(records[1])[:-20 if name.endswith("z") and not name.endswith(".gz") else None])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = warc.reassembled(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    good = {r.record_id: bytes(r.payload) for r in got if r.complete and r.record_type == "response" and r.payload}
    assert good == {f"<r{i}>": NASTY * i for i in range(1, 4)}
    assert sum(r.record_id == "<info>" for r in got) == 1
    errors = {r.record_id: r.error for r in got if r.error}
    assert errors["<bad>"] == "no usable WARC-Segment-Number: 'one'" and "chunked" in errors["<chunked>"]
    assert all(r.payload is None and not r.complete for r in got if r.error)


def test_empty_table(spark):
    path = shared_path(spark, "test-warc-empty")
    warc.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.reassembled(spark, path).count() == 0
