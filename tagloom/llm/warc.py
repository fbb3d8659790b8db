"""WARC archives: written by Spark's text sink, read back with boundary-chain verification.

A record is one string that ends with two line breaks, the separator of the written "lines", so archives are
committed as any table is and lie wherever Spark can write. Of pages with equal payloads the one with the smallest id is a
response, the others are revisits that refer to it.

Reading cuts the files at the magic ``WARC/1.`` with Spark's splitting text reader, on any file system and over any number
of tasks. Each cut is only a candidate: a payload can hold the magic, and whole records. A task tells for its part of a file
where each candidate begins and, by its header and Content-Length, where the record after it would. Pointer jumping from the
start of the file then keeps what a chain of records reaches: inside a part in one step, from part to part by
doubling, so the number of rounds is the logarithm of a file's parts. Candidates inside payloads are never reached. A record
without a magic inside (nearly all) is hashed where it is cut; the pieces of the others meet by record.

Edge cases: null or empty html is an empty payload. Payloads of under ``min_bytes`` are always responses. Repeated
pages: those with the smallest id of their payload are all responses. A page with a null id refers to the smallest id
of its payload, or is a response where all ids are null or the payload is short. A null url has no target header; control
characters and blanks in one are escaped. Long payloads are read whole. Empty tables and files give no rows. A file that does not begin with a record has none; after a
broken or cut off record its file's rest is left out, as nothing says where the next one begins. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, join_spread, lean, pick, utf8_length

MAGIC = "WARC/1."
END = "\r\n\r\n"
MIN_BYTES = 100
PAGE_TYPES = {"page_id": "bigint", "url": "string", "html": "string"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, html (no null), bytes, digest."""
    html = F.coalesce("html", F.lit(""))
    rows = pick(pages, "page_id", "url", "html", types=PAGE_TYPES)
    return rows.select("page_id", "url", html.alias("html"), utf8_length("html").alias("bytes"), F.sha2(html.cast("binary"), 256).alias("digest"))


def repeated_payloads(rows: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """digest, first_id, members of the payloads that several pages have: sums of each task meet, not pages."""
    long = rows.where(F.col("bytes") >= min_bytes)
    return long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("members")).where("members > 1")


def _header(*fields: tuple[str, Column | None]) -> Column:
    lines = [F.lit(f"{MAGIC}1\r\n")]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("\r\n"))


def _uri(url: Column) -> Column:
    """The url without what would end its line."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "[\r]", "%0D"), "[\n]", "%0A"), r"[\x00-\x20\x7F]", "%20")


def _urn(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit(f"<{ID}"), F.coalesce(page_id.cast("string"), F.concat(F.lit("none:"), digest)), F.lit(">"))


def write_warc(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", min_bytes: int = MIN_BYTES, compression: str = "none", ws: Workspace | None = None) -> None:
    """Write a response or revisit record for each page to WARC 1.1 files under ``path``, one a task."""
    ws = ws or Workspace(pages.sparkSession, "warc")
    rows = payloads(pages)
    repeats = ws.keep(repeated_payloads(rows, min_bytes), "repeats")
    members = repeats.agg(F.sum("members")).first()[0]
    if members:
        # payloads stay where they are while the repeated digests can be broadcast
        rows = join_spread(rows, repeats, ["digest"], "members", members, "left")
    else:
        rows = rows.withColumn("first_id", F.lit(None).cast("bigint"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    record = F.concat(
        _header(
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", _uri(F.col("url"))),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(revisit, _urn(F.col("first_id"), F.col("digest")))),
            ("WARC-Profile", F.when(revisit, REVISIT)),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length(block).cast("string")),
        ),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*$")
_FIELDS = {b"warc-type": "kind", b"warc-record-id": "record_id", b"warc-target-uri": "uri", b"warc-payload-digest": "told", b"warc-refers-to": "refers_to", b"content-length": "length", b"content-type": "content_type"}
_SPLIT = END.encode()


def parse_header(piece: bytes) -> tuple[dict[str, str], int] | None:
    """(fields, bytes up to the block) of what follows the magic, or None if that is no record's header."""
    stop = piece.find(_SPLIT)
    if stop < 0 or piece[1:3] != b"\r\n" or not piece[:1].isdigit():
        return None
    found: dict[str, str] = {}
    for line in piece[3:stop].split(b"\r\n"):
        m = _FIELD.match(line)
        if m and (name := _FIELDS.get(m.group(1).lower())):
            found.setdefault(name, m.group(2).decode("utf-8", "replace"))
    length = found.get("length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 16):
        return None
    return found, stop + len(_SPLIT)


def payload_of(block: bytes, content_type: str | None) -> tuple[int, str]:
    """(bytes, sha256) of a block's payload: what follows the HTTP header, if it has one."""
    if (content_type or "").lower().startswith("application/http"):
        at = block.find(_SPLIT)
        block = block[at + len(_SPLIT) :] if at >= 0 else b""
    return len(block), hashlib.sha256(block).hexdigest()


_CANDIDATES = {
    "file": pa.string(), "part": pa.int64(), "part_end": pa.int64(), "turn": pa.int64(), "at": pa.int64(), "piece": pa.int64(), "after": pa.int64(),
    "kind": pa.string(), "record_id": pa.string(), "uri": pa.string(), "refers_to": pa.string(), "told": pa.string(), "content_type": pa.string(), "bytes": pa.int64(), "digest": pa.string(),
}
_CANDIDATES_SQL = (
    "file string, part bigint, part_end bigint, turn bigint, at bigint, piece bigint, after bigint, kind string, record_id string, uri string, "
    "refers_to string, told string, content_type string, bytes bigint, digest string"
)


def _cut(spark: SparkSession, path: str) -> DataFrame:
    """file, part (its first byte), part_end, value: what lies between magics, in order in each part."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length")).alias("part_end"), F.col("value").cast("binary").alias("value"),
    )


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cut: its turn and first byte in its part, its length, and what its header says.

    ``at`` counts from the first cut of the part; ``after`` is the distance from there to the next record.
    """
    own, at, turn = None, 0, 0
    for batch in batches:
        out: dict[str, list] = {c: [] for c in _CANDIDATES}
        for file, part, end, value in zip(*[batch.column(c).to_pylist() for c in range(3)], batch.column(3), strict=True):
            if own != (file, part):
                own, at, turn = (file, part), 0, 0
            piece = value.as_py()
            head = parse_header(piece) if part or turn else None  # a file's first cut is what lies before its first magic
            after, size_of, digest, fields = None, None, None, {}
            if head is not None:
                fields, begin = head
                stop = begin + int(fields["length"])
                after = at + stop + len(_SPLIT)
                if stop + len(_SPLIT) == len(piece):
                    size_of, digest = payload_of(piece[begin:stop], fields.get("content_type"))
            values = (file, part, end, turn, at, len(piece), after, *[fields.get(c) for c in ("kind", "record_id", "uri", "refers_to", "told", "content_type")], size_of, digest)
            for column, v in zip(out.values(), values, strict=True):
                column.append(v)
            at, turn = at + len(piece) + len(MAGIC), turn + 1
        yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in _CANDIDATES.items()], names=list(_CANDIDATES))


def _jumps(start: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Index of each candidate's successor, or the number of candidates if there is none here."""
    to = np.searchsorted(start, after)
    hit = to < len(start)
    hit[hit] = start[to[hit]] == after[hit]
    return np.where(hit, to, len(start))


def leave(start: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where the chain from each candidate leaves its part, by pointer jumping."""
    n = len(start)
    jump = _jumps(start, after)
    last = np.where(jump < n, jump, np.arange(n))
    while (last[last] != last).any():
        last = last[last]
    return after[last]


def reached(start: np.ndarray, after: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which candidates the chains from the entries reach, by pointer jumping."""
    n = len(start)
    jump = np.append(_jumps(start, after), n)
    seen = np.append(np.isin(start, entries), False)
    while True:
        before = seen.sum()
        hit = jump[seen]
        seen[hit[hit < n]] = True
        jump = jump[jump]
        if (jump == n).all() and seen.sum() == before:
            return seen[:n]


def _leaves_part(table: pa.Table) -> pa.Table:
    table = table.sort_by("start")
    start, after = (np.asarray(table.column(c).combine_chunks()) for c in ("start", "after"))
    return pa.table({"file": table.column("file"), "part": table.column("part"), "start": pa.array(start), "out": pa.array(leave(start, after))})


def _reached_in_part(table: pa.Table) -> pa.Table:
    """The candidates of one part that chains reach; entries are rows without ``after``."""
    table = table.sort_by("start")
    entry = np.asarray(table.column("after").is_null())
    start = np.asarray(table.column("start").combine_chunks())
    own = table.filter(pa.array(~entry))
    after = np.asarray(own.column("after").combine_chunks())
    kept = reached(start[~entry], after, start[entry])
    return own.filter(pa.array(kept)).select(["file", "part", "start"])


def verified(ws: Workspace, candidates: DataFrame) -> DataFrame:
    """file, part, start of the candidates (file, part, start, after) that the chain from their file's start reaches."""
    links = candidates.select("file", "part", "start", "after")
    # a group holds the candidates of one part of a file, which the reader's split size bounds
    out = ws.keep(links.groupBy("file", "part").applyInArrow(_leaves_part, "file string, part bigint, start bigint, out bigint"), "exits")
    # where a chain can enter a part: at the start of the file, or where a chain leaves another
    doors = out.select("file", F.col("out").alias("start")).union(out.where("start = 0").select("file", "start")).distinct()
    entries = jump = ws.keep(out.join(doors, ["file", "start"], "left_semi").select("file", "start", "out"), "jump-0")
    seen = ws.keep(jump.where("start = 0").select("file", "start"), "seen-0")
    count, turn = seen.count(), 0
    while True:
        step = jump.select("file", F.col("out").alias("mid"), F.col("start").alias("from"))
        hit = seen.join(jump, ["file", "start"]).select("file", F.col("out").alias("start"))
        turn += 1
        more = ws.keep(seen.union(hit.join(entries, ["file", "start"], "left_semi")).distinct(), f"seen-{turn}")
        now = more.count()
        if now == count:
            break
        seen, count = more, now
        far = jump.select("file", F.col("start").alias("mid"), "out")
        jump = ws.keep(step.join(far, ["file", "mid"]).select("file", F.col("from").alias("start"), "out"), f"jump-{turn}")
    # an entry is a candidate like any other, so its part is known
    inside = out.join(seen, ["file", "start"], "left_semi").select("file", "part", "start", F.lit(None).cast("bigint").alias("after"))
    return links.unionByName(inside).groupBy("file", "part").applyInArrow(_reached_in_part, "file string, part bigint, start bigint")


def _place_parts(parts: pd.DataFrame) -> pd.DataFrame:
    """Where each part's first cut begins, and which of its cuts is foreign.

    A cut belongs to the part that its magic begins in. A reader whose part ends in what could be the beginning of a magic also reads
    the cut after, even if it was none, and so does the reader of the next part.
    """
    parts = parts.sort_values("part")
    base, out = 0, []
    for i, p in enumerate(parts.itertuples()):
        last = base + p.last["at"] - len(MAGIC)
        foreign = i + 1 < len(parts) and last >= p.part_end
        out.append((p.file, p.part, base, p.last["turn"] if foreign else None))
        base = last + len(MAGIC) if foreign else base + p.long
    frame = pd.DataFrame(out, columns=["file", "part", "base", "foreign"]).astype({"foreign": "Int64"})
    return frame.assign(file_size=base - len(MAGIC))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, part, turn, value of the cuts."""
    own, turn = None, 0
    for batch in batches:
        turns = []
        for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own, turn = key, turn + 1 if key == own else 0
            turns.append(turn)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(turns, pa.int64()), batch.column(3)], names=["file", "part", "turn", "value"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bytes and digest of records given as all their bytes after the magic."""
    for batch in batches:
        out = []
        for value, kind in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            piece = value.as_py()
            fields, begin = parse_header(piece)
            out.append(payload_of(piece[begin : begin + int(fields["length"])], kind))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["file", "start", "bytes", "digest"]
        )


def read_warc(spark: SparkSession, path: str, ws: Workspace | None = None) -> DataFrame:
    """file, start, kind, record_id, uri, refers_to, told (digest header), bytes and digest (payload) of the verified records."""
    ws = ws or Workspace(spark, "warc")
    cuts = ws.keep(_cut(spark, path).mapInArrow(lean(_candidates), _CANDIDATES_SQL), "cuts")
    bases = cuts.groupBy("file", "part", "part_end").agg(
        F.sum(F.col("piece") + len(MAGIC)).alias("long"), F.max(F.struct("turn", "at")).alias("last")
    )
    # a row for each part of a file
    bases = bases.groupBy("file").applyInPandas(_place_parts, "file string, part bigint, base bigint, foreign bigint, file_size bigint")
    placed = cuts.drop("part_end").join(bases, ["file", "part"]).where("foreign IS NULL OR turn < foreign")
    placed = placed.withColumn("start", F.col("base") + F.col("at") - len(MAGIC)).withColumn("after", F.col("base") + F.col("after"))
    candidates = placed.where((F.col("start") >= 0) & (F.col("after") <= F.col("file_size")))
    good = ws.keep(verified(ws, candidates), "verified")
    records = candidates.join(good, ["file", "part", "start"], "left_semi")
    # records with a magic inside: their cuts, and those up to their end, meet by record
    parted = ws.keep(records.where("digest IS NULL").select("file", F.col("start").alias("of"), F.col("after").alias("until"), "content_type"), "parted")
    if not parted.isEmpty():
        # records follow each other, so a cut is of the last record that begins before it; numbers only, in files that hold such records
        some = placed.join(parted.select("file").distinct(), "file", "left_semi").join(good.withColumn("begins", F.col("start")), ["file", "part", "start"], "left")
        last = F.last("begins", ignorenulls=True).over(Window.partitionBy("file").orderBy("start"))
        own = some.select("file", "part", "turn", "start", last.alias("of")).join(parted, ["file", "of"]).where("start < until")
        own = ws.keep(own.select("file", "part", "turn", "start", "of", "content_type"), "own")
        pieces = _cut(spark, path).mapInArrow(lean(_pieces), "file string, part bigint, turn bigint, value binary").join(own, ["file", "part", "turn"])
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda s: s["value"].cast("string")), MAGIC)
        joined = pieces.groupBy("file", "of", "content_type").agg(text.cast("binary").alias("value")).select("file", "of", "value", "content_type")
        hashed = joined.mapInArrow(lean(_whole), "file string, start bigint, bytes bigint, digest string")
        hashed = ws.keep(hashed.withColumnsRenamed({"bytes": "all_bytes", "digest": "all_digest"}), "hashed")
        records = records.join(hashed, ["file", "start"], "left").withColumn("bytes", F.coalesce("bytes", "all_bytes")).withColumn("digest", F.coalesce("digest", "all_digest"))
    return ws.keep(records.select("file", "start", "kind", "record_id", "uri", "refers_to", "told", "bytes", "digest"), "records")


def _page_id(urn: Column) -> Column:
    return F.regexp_extract(urn, f"^<{ID}(-?[0-9]+)>$", 1).try_cast("bigint")


def archive_pages(pages: DataFrame, compression: str = "none") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records read back from the pages' archives.

    A revisit holds no payload: its size and digest are those of the response it refers to, and null if that one is
    not there or has another digest than the revisit tells.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "archives")
    write_warc(pages, f"{ws.root}/archive", compression=compression, ws=ws)
    ws.adopt("archive")
    records = read_warc(spark, f"{ws.root}/archive", ws)
    responses = records.where("kind = 'response'")
    revisits = records.where("kind = 'revisit'").select("record_id", F.col("refers_to").alias("of"), "told")
    asked = revisits.groupBy("of").agg(F.count(F.lit(1)).alias("members"))
    # repeated pages share an id and a payload
    given = responses.groupBy(F.col("record_id").alias("of")).agg(F.first("bytes").alias("bytes"), F.first("digest").alias("digest"))
    facts = ws.keep(asked.join(given, "of"), "referred")
    met = join_spread(revisits, facts, ["of"], "members", revisits.count(), "left")
    same = F.concat(F.lit("sha256:"), F.col("digest")) == F.col("told")
    out = responses.select("record_id", "bytes", "digest", "kind", F.lit(None).cast("string").alias("of")).unionByName(
        met.select("record_id", F.when(same, F.col("bytes")).alias("bytes"), F.when(same, F.col("digest")).alias("digest"), F.lit("revisit").alias("kind"), "of")
    )
    return ws.result(
        out.select(
            _page_id(F.col("record_id")).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
            F.col("kind").alias("record_type"), _page_id(F.col("of")).alias("refers_to"),
        )
    )
