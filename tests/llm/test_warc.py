"""Archives against the pages they were written from, and chains against a plain reader."""

from __future__ import annotations

import gzip
import hashlib
import random
import tempfile

import numpy as np
import pytest

pytest.importorskip("tagloom.llm")

from tagloom.llm.warc import archive_pages, leave, reached, read_warc, write_warc  # noqa: E402

SCHEMA = "page_id bigint, url string, html string, digest string, bytes string, first_id int, members int, record_type string"
FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77777>\r\nContent-Length: 12\r\n\r\nnot a record\r\n\r\n"


def html(i: int) -> str:
    r = random.Random(i)
    return "<html>" + " ".join(r.choice(("WARC/1.1", "tha", "é", "𝛼", "\r\n\r\n", "WARC/1.", "x")) for _ in range(r.randint(30, 300))) + "</html>"


def rows():
    out = [(i, f"http://a.example/{i}", html(i)) for i in range(60)]
    out += [(100 + i, "http://b.example/x y\r\nz", html(3)) for i in range(40)] + [(99, None, html(3)), (99, None, html(3))]
    out += [(200, "u", None), (201, "u", ""), (202, "u", "short"), (203, "u", "short"), (None, "u", html(4)), (None, "u", "n" * 150), (None, "u", "n" * 150)]
    out += [(300, "u", FAKE), (301, "u", FAKE * 50 + "end"), (302, "u", "WARC/1."), (303, "u", FAKE + "y" * 300_000 + FAKE), (304, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 30)]
    return out


def plain(rows):
    first: dict = {}
    for i, _, text in rows:
        if i is not None and len((text or "").encode()) >= 100:
            first[text] = min(first.get(text, i), i)
    out = []
    for i, _, text in rows:
        b = (text or "").encode()
        f = first.get(text)
        revisit = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return out


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*r, "x", "x", 1, 1, "x") for r in rows()], SCHEMA).repartition(3)


@pytest.mark.parametrize("split", ["128m", "20011"])
def test_round_trip(spark, pages, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if split != "128m" else "4m")
    try:
        same(archive_pages(pages).collect(), plain(rows()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_parts_that_end_in_a_magic(spark):
    """Every way in which the end of a part can cut a magic, or what begins like one."""
    folder = tempfile.mkdtemp(prefix="warc-")
    blocks = [b"a" * n + b"WWAWARWARCWARC/WARC/1WARC/1.WWARC/1.W" + b"W" * (n % 9) for n in range(12)]
    data = b"".join(f"WARC/1.0\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, b in enumerate(blocks))
    with open(f"{folder}/a", "wb") as f:
        f.write(data)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for split in (101, 113):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            got = {r.record_id: r.digest for r in read_warc(spark, folder).collect()}
            assert got == {f"<{i}>": hashlib.sha256(b).hexdigest() for i, b in enumerate(blocks)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_compressed(pages):
    same(archive_pages(pages, compression="gzip").collect(), plain(rows()))


def test_empty(spark):
    got = archive_pages(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_written_files_are_archives(spark, pages):
    """A plain reader that goes from record to record finds the same pages."""
    path = tempfile.mkdtemp(prefix="warc-") + "/a"
    write_warc(pages, path, compression="gzip")
    import glob

    found = []
    for name in glob.glob(f"{path}/*.gz"):
        data, at = gzip.open(name).read(), 0
        while at < len(data):
            stop = data.index(b"\r\n\r\n", at)
            head = dict(line.split(b": ", 1) for line in data[at:stop].split(b"\r\n")[1:])
            n = int(head[b"Content-Length"])
            block = data[stop + 4 : stop + 4 + n]
            assert data[stop + 4 + n : stop + 8 + n] == b"\r\n\r\n"
            if head[b"WARC-Type"] == b"response":
                payload = block.split(b"\r\n\r\n", 1)[1]
                assert head[b"WARC-Payload-Digest"] == b"sha256:" + hashlib.sha256(payload).hexdigest().encode()
            found.append(head[b"WARC-Type"].decode())
            at = stop + 8 + n
    assert sorted(found) == sorted(r[3] for r in plain(rows()))


def test_foreign_and_broken_files(spark):
    """Records of any version and case; a file without a first record, one that is cut off, one with rubbish in between."""
    folder = tempfile.mkdtemp(prefix="warc-")

    def record(block: bytes, name: str, version: str = "1.0") -> bytes:
        return f"WARC/{version}\r\nwarc-type: resource\r\nWARC-Record-ID: <{name}>\r\ncontent-length:  {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    files = {
        "good": record(b"\xff\xfe WARC/1.0\r\n", "a") + record(b"", "b", "1.1"),
        "late": b"x" + record(b"1", "c"),
        "cut": record(b"12345", "d") + record(b"12345", "e")[:-6],
        "rubbish": record(b"1", "f") + b"??" + record(b"2", "g"),
        "empty": b"",
    }
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    got = {(r.record_id, r.bytes, r.digest) for r in read_warc(spark, folder).collect()}
    want = {"a": b"\xff\xfe WARC/1.0\r\n", "b": b"", "d": b"12345", "f": b"1"}
    assert got == {(f"<{k}>", len(v), hashlib.sha256(v).hexdigest()) for k, v in want.items()}


def test_jumps_against_walks():
    r = random.Random(1)
    for _ in range(200):
        start = np.array(sorted(r.sample(range(100), r.randint(1, 30))))
        after = np.array([r.randint(s + 1, 130) if r.random() < 0.3 else int(r.choice([*start[start > s], 120])) for s in start])
        walk = {}
        for s, a in zip(start, after, strict=True):
            walk[s] = a
        ends = []
        for s in start:
            while s in walk:
                s = walk[s]
            ends.append(s)
        assert leave(start, after).tolist() == ends
        entries = np.array(r.sample(list(start), min(2, len(start))))
        seen = set()
        for s in entries:
            while s in walk:
                seen.add(int(s))
                s = walk[s]
        assert set(start[reached(start, after, entries)].tolist()) == seen
