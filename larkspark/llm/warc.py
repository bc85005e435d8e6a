"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Writing is native: a record is one string, and Spark's text sink ends it with the two line ends that WARC asks
for. Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest id is a response,
the others are revisit records that hold no payload.

Reading splits files at the magic line wherever it stands, so large files are read by many tasks, and each
candidate's offset follows from the lengths of the pieces before it. Each candidate with a header that can be
read points to its successor, the offset after its declared length. Within a split each candidate's pointer
is followed to the first offset beyond the split; between splits pointer jumping from the files' starts
doubles the distance each round. Only candidates reached that way are records, so a magic line (or a whole
record) inside a payload isn't taken for one; its pieces go back into the record that holds them.

Ids are percent-encoded in the records, so an id of any characters comes back as it was. Archives are plain
files, not compressed members. A record is one string of the engine, so a payload has to be under 2 GB and fit
into a task; a file may be of any size, and no task holds more of it than a split and the records that begin there.

Defined results: a null payload is the empty payload. A row with a null id is always a response. Rows with the
same id and payload are all responses if theirs is the smallest id. An empty table gives archives without
records. A file that breaks off, or bytes that no chain reaches, raise an error in read_warc. Line ends in an
address are left out. Of equal payloads the smallest id is the response. Other columns, whatever their names, are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_path

MAGIC = b"WARC/1.1\r\n"
#: Two line ends close a record, and a header.
END = b"\r\n\r\n"
MIN_REVISIT = 100
#: Revisits are matched by broadcast up to this counted number of rows (an id, a digest and an id each).
BROADCAST_ROWS = 200_000
_ID, _NO_ID = "urn:larkspark:page:", "urn:larkspark:none"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record for each row of pages to files under path."""
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    src = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(uri_col).cast("string"), F.lit("")).alias("uri"), text.alias("payload"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    narrow = src.filter(f"id is not null and size >= {MIN_REVISIT}").select("id", "digest")
    first = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").drop("last")
    copies = cut(narrow.join(first, "digest").filter("id <> first").distinct(), "revisits")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    full = src.join(copies, ["id", "digest"], "left")
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <"), F.coalesce(F.concat(F.lit(_ID), F.url_encode(F.col("id").cast("string"))), F.lit(_NO_ID)), F.lit(">")),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("uri", "[\\r\\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" + f"WARC-Refers-To: <{_ID}"), F.url_encode(F.col("first").cast("string")), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", F.lit(MAGIC.decode().strip()), *lines), F.lit(END.decode()), F.col("block"))
    full.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END.decode()).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magic lines, with the file and the split that it was read in."""
    rows = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("body"))


def parse_header(body: bytes) -> tuple[int, int, dict[str, str]] | None:
    """(length of the header with its end, declared length, fields), or None if there is no such header."""
    at = body.find(END)
    if at < 0:
        return None
    fields = {}
    for line in body[:at].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    return (at + len(END), int(length), fields) if length.isascii() and length.isdigit() else None


def split_payload(block: bytes) -> bytes:
    """An HTTP message's payload."""
    return block[block.find(END) + len(END) :] if block.startswith(b"HTTP/") and END in block else block


_FIELDS = "record_type string, id string, refers_to string, uri string, declared_digest string, payload_bytes long, payload_digest string"
_CANDIDATE = f"file string, split long, ord int, at long, size long, goes long, {_FIELDS}"


def _named(said: str | None) -> str | None:
    """The id that a record's name stands for; other writers' names are ids as they are."""
    name = (said or "").strip("<>")
    return unquote_plus(name[len(_ID) :]) if name.startswith(_ID) else None if name in ("", _NO_ID) else name


def _described(fields: dict[str, str], block: bytes | None) -> tuple:
    payload = split_payload(block) if block is not None else None
    return (fields.get("warc-type"), _named(fields.get("warc-record-id")), _named(fields.get("warc-refers-to")), fields.get("warc-target-uri"), (fields.get("warc-payload-digest") or "").removeprefix("sha256:") or None, None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest())


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, split, number in the split, offset from the split's first piece, body); a split's pieces come in order."""
    here, k, at = None, 0, 0
    for b in batches:
        for file, split, body in zip(b["file"], b["split"], b["body"], strict=True):
            if (file, split) != here:
                here, k, at = (file, split), 0, 0
            yield file, split, k, at, body
            k, at = k + 1, at + len(body) + len(MAGIC)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """goes: the successor's offset from the split's first piece; null if the header can't be read or the piece is before a file's first magic line."""
    rows: list[tuple] = []
    columns = [x.split()[0] for x in _CANDIDATE.split(", ")]
    frame = lambda: pd.DataFrame(rows, columns=columns).astype({"goes": "Int64", "payload_bytes": "Int64"})
    for file, split, k, at, body in _numbered(batches):
        head = None if k == 0 and split == 0 else parse_header(body)
        goes, said = None, (None,) * 7
        if head:
            start, length, fields = head
            goes = at + start + length + len(END) + len(MAGIC)
            said = _described(fields, body[start : start + length] if start + length + len(END) == len(body) and body.endswith(END) else None)
        rows.append((file, split, k, at, len(body), goes, *said))
        if len(rows) >= 1000:
            yield frame()
            rows.clear()
    yield frame()


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split, the first offset beyond the split that its chain leads to (null: the chain breaks)."""
    rows = rows.sort_values("ord")
    end = int((rows["size"] + len(MAGIC)).sum())
    known: dict[int, int | None] = {}
    out = []
    for at, goes in zip(rows["at"][::-1], rows["goes"][::-1], strict=True):
        to = None if pd.isna(goes) else int(goes)
        known[at] = to if to is None or to >= end else known.get(to)
        out.append(known[at])
    return pd.DataFrame({"file": rows["file"], "split": rows["split"], "at": rows["at"], "out": pd.array(out[::-1], "Int64")})


def _reached(key: tuple, rows: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that the chain from the file's start passes."""
    next_of = dict(zip(rows["at"], rows["goes"], strict=True))
    on = set()
    for at in entries["at"]:
        while at in next_of and at not in on:
            on.add(at)
            at = next_of[at]
    rows = rows[rows["at"].isin(on)]
    return rows[["file", "split", "at"]]


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records under path: file, offset, record_type, id, refers_to, uri, declared_digest, payload_bytes, payload_digest and, if asked for, payload."""
    found = cut(_pieces(spark, path).mapInPandas(_candidates, _CANDIDATE), "candidates")
    total = found.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"), F.max(F.struct("ord", "size")).alias("last"))
    order = Window.partitionBy("file").orderBy("split")
    # Offsets are those of a piece's first byte after its magic line; base is that of a split's first piece.
    base = cut(total.select("file", "split", (F.sum("bytes").over(order) - F.col("bytes")).alias("base"), F.sum("bytes").over(Window.partitionBy("file")).alias("end")), "splits")
    exits = found.select("file", "split", "ord", "at", "size", "goes").groupBy("file", "split").applyInPandas(_exits, "file string, split long, at long, out long")
    hop = exits.filter("out is not null").join(base, ["file", "split"]).select("file", (F.col("at") + F.col("base")).alias("here"), (F.col("out") + F.col("base")).alias("there"), "end")
    hop = cut(hop, "hops")
    starts = base.filter("split = 0").select("file", F.lit(len(MAGIC)).cast("long").alias("here"))
    jump = cut(hop.join(hop.select("file", F.col("there").alias("here")).union(starts).distinct(), ["file", "here"], "left_semi").select("file", "here", "there"), "jumps")
    reached, n = cut(starts, "reached"), -1
    while (now := reached.count()) != n:  # the distance of a jump doubles each round
        n = now
        reached = cut(reached.union(reached.join(jump, ["file", "here"]).select("file", F.col("there").alias("here"))).distinct(), "reached")
        jump = cut(jump.join(jump.select("file", F.col("here").alias("there"), F.col("there").alias("beyond")), ["file", "there"], "left").select("file", "here", F.coalesce("beyond", "there").alias("there")), "jumps")
    entries = reached.join(base, "file").filter("here >= base").join(total.select("file", "split", "bytes"), ["file", "split"]).filter("here < base + bytes").select("file", "split", (F.col("here") - F.col("base")).alias("at"))
    narrow = found.filter("goes is not null").select("file", "split", "at", "goes")
    on = cut(narrow.groupBy("file", "split").cogroup(entries.groupBy("file", "split")).applyInPandas(_reached, "file string, split long, at long"), "records")
    kept = found.join(on, ["file", "split", "at"]).join(base, ["file", "split"]).withColumn("offset", F.col("at") + F.col("base") - len(MAGIC))
    kept = cut(kept, "kept")
    # Each file's chain has to end where the file ends: the last record's successor is beyond the last piece.
    tail = kept.groupBy("file").agg(F.max(F.col("goes") + F.col("base")).alias("to"), F.max("end").alias("end"))
    broken = base.filter("split = 0 and end > 10").select("file", F.col("end").alias("full")).join(tail, "file", "left").filter("to is null or to <> full")
    if not broken.isEmpty():
        raise ValueError(f"the chain of records breaks off in {broken.first()['file']}")
    out = ["file", "offset", "record_type", "id", "refers_to", "uri", "declared_digest", "payload_bytes", "payload_digest"]
    whole = kept.filter("payload_digest is not null")
    if not payloads and kept.filter("payload_digest is null").isEmpty():
        return whole.select(*out)
    return _assembled(spark, path, found, base, kept, payloads).select(*out, *["payload"] * payloads)


def _assembled(spark: SparkSession, path: str, found: DataFrame, base: DataFrame, kept: DataFrame, payloads: bool) -> DataFrame:
    """Reads the files again: for records that hold magic lines, whose pieces are joined, and if asked for all payloads."""
    # The record that a piece belongs to begins in its split, or else it is the last one of the splits before.
    marks = kept.select("file", "split", "ord", F.col("offset").alias("own"), F.col("payload_digest").isNull().alias("open"))
    inside = Window.partitionBy("file", "split").orderBy("ord")
    begun = found.select("file", "split", "ord", "at").join(marks, ["file", "split", "ord"], "left")
    begun = begun.select("file", "split", "ord", "at", F.last(F.when(F.col("own").isNotNull(), F.struct("own", "open")), True).over(inside).alias("here"))
    last = marks.groupBy("file", "split").agg(F.max(F.struct("own", "open")).alias("mark"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = base.join(last, ["file", "split"], "left").select("file", "split", "base", F.last("mark", True).over(earlier).alias("before"))
    owner = begun.join(before, ["file", "split"]).withColumn("mark", F.coalesce("here", "before"))
    owner = owner.filter("mark is not null and mark.open").select("file", "split", "ord", (F.col("at") + F.col("base") - len(MAGIC)).alias("offset"), F.col("mark.own").alias("own"))

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for file, split, k, _, body in _numbered(batches):
            rows.append((file, split, k, body))
            if len(rows) >= 256:
                yield pd.DataFrame(rows, columns=["file", "split", "ord", "body"])
                rows.clear()
        yield pd.DataFrame(rows, columns=["file", "split", "ord", "body"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        body = MAGIC.join(rows["body"])
        start, length, fields = parse_header(body)
        payload = split_payload(body[start : start + length])
        return pd.DataFrame([(rows["file"].iloc[0], rows["own"].iloc[0], *_described(fields, body[start : start + length]), payload)], columns=["file", "offset", *(x.split()[0] for x in _FIELDS.split(", ")), "payload"])

    pieces = _pieces(spark, path).mapInPandas(bodies, "file string, split long, ord int, body binary")
    made = pieces.join(owner, ["file", "split", "ord"]).groupBy("file", "own").applyInPandas(join, f"file string, offset long, {_FIELDS}, payload binary")
    whole = kept.filter("payload_digest is not null")
    if not payloads:
        return made.drop("payload").unionByName(whole.select(*made.drop("payload").columns))

    @F.pandas_udf("binary")
    def payload(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda body: split_payload(body[(head := parse_header(body))[0] : head[0] + head[1]]))

    # A record that is one piece needs no other one, so its body goes straight to its payload.
    return pieces.join(whole, ["file", "split", "ord"]).withColumn("payload", payload("body")).select(*made.columns).unionByName(made)


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes pages as WARC records, reads them back and returns for each: id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's payload is that of the response it refers to; its declared digest has to be that one's.
    """
    path = path or shared_path(pages.sparkSession, "warc")
    kind = dict(pages.select(id_col).dtypes)[id_col]
    write_warc(pages, path, id_col, uri_col, payload_col)
    got = cut(read_warc(pages.sparkSession, path, payloads=False), "warc-records")
    of = got.filter(f"record_type = 'response' and payload_bytes >= {MIN_REVISIT}").groupBy(F.col("payload_digest").alias("declared_digest"), F.col("id").alias("refers_to")).agg(F.max("payload_bytes").alias("full_bytes"))
    read = lambda df: df.select(F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
    again = got.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(of, ["declared_digest", "refers_to"], "left")
    again = again.withColumn("payload_bytes", F.coalesce("full_bytes", F.raise_error(F.lit("a revisit refers to no such response")).cast("long"))).withColumn("payload_digest", F.col("declared_digest"))
    return read(got.filter("record_type = 'response'")).unionByName(read(again))
