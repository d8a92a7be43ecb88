"""WARC archives: revisit resolution, and deduplicated archives with fresh headers.

Records are rows (``SCHEMA``).  Only header columns are shuffled, by payload digest: within a digest the
first response (by date, then record id) is the original; later responses with the same payload become
revisits of it, and revisits are joined to it.  Payloads stay where they are.  The ids whose payloads go
are joined back by broadcast up to 32 MB, by a shuffle of ids and payloads beyond that.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brindle.llm.common import hinted, shared_dir, written

SCHEMA = "record_id string, kind string, uri string, date string, digest string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_TRACKED = "([?#]|/$)"
READ_BYTES = 1 << 27
#: A row of 16 bytes in a broadcast table takes about 190 (measured).
_KEY_BYTES = 192


def resolve(records: DataFrame) -> DataFrame:
    """Headers after resolution: (record_id, kind, uri, date, digest, original_id, original_uri,
    original_date, state), one row per row of ``records``.

    state is "original" (first response of its digest), "duplicate" (a later response: it is written as
    a revisit), "resolved" (a revisit whose original is here), "unresolved" (a revisit without an
    original here, or whose digest is null), "other" (any other kind, and responses without a digest:
    written as they are).  A revisit may precede its original in date.  Ties in date go to the lower
    record id; null dates come last, null ids after all others; rows that are equal in all of these are
    originals alike (``write_archives`` takes equal rows as one).  Only "original" and "duplicate" rows need a payload.  Empty tables give no
    rows; other columns are ignored.
    """
    head = records.select("record_id", "kind", "uri", "date", "digest")
    plain = F.col("digest").isNull() | ~F.coalesce("kind", F.lit("")).isin("response", "revisit")
    rest = head.where(plain).select("*", *(F.lit(None).cast("string").alias(f"original_{c}") for c in ("id", "uri", "date")), F.when(F.col("kind") == "revisit", "unresolved").otherwise("other").alias("state"))
    nulls_last = [x for c in ("date", "record_id", "uri") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    own = head.where(~plain).withColumn("_order", F.struct(*nulls_last))
    # the least response of a digest: combined before the shuffle, and joined back, so a digest that
    # half of the archive has is no single task
    least = own.where("kind = 'response'").groupBy("digest").agg(F.min("_order").alias("_first"))
    both = own.join(least, "digest", "left")
    state = F.when(F.col("_first").isNull(), "unresolved").when(F.col("kind") == "revisit", "resolved").when(F.col("_order").eqNullSafe(F.col("_first")), "original").otherwise("duplicate")
    both = both.withColumn("state", state)
    blank = lambda c, x: F.when(F.col("state") != "original", F.col(f"_first.{x}")).alias(f"original_{c}")
    first = both.select("record_id", "kind", "uri", "date", "digest", blank("id", "record_id"), blank("uri", "uri"), blank("date", "date"), "state")
    return first.unionByName(rest)


def with_headers(resolved: DataFrame) -> DataFrame:
    """Adds fresh WARC headers: the text of each record's header block without its length fields, which
    are known only where the payload is."""
    kind = F.when(F.col("state").isin("duplicate", "resolved", "unresolved"), F.lit("revisit")).otherwise(F.coalesce("kind", F.lit("metadata")))
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))).otherwise(F.lit(""))
    refers = F.col("state").isin("duplicate", "resolved")
    return resolved.withColumn("out_kind", kind).withColumn("header", F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("out_kind")), line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Target-URI", F.col("uri")), line("WARC-Date", F.col("date")), line("WARC-Payload-Digest", F.col("digest")),
        line("WARC-Profile", F.when(F.col("out_kind") == "revisit", F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(refers, F.concat(F.lit("<"), F.col("original_id"), F.lit(">")))),
        line("WARC-Refers-To-Target-URI", F.when(refers, F.col("original_uri"))), line("WARC-Refers-To-Date", F.when(refers, F.col("original_date")))))


def captures(pages: DataFrame) -> DataFrame:
    """Pages as an archive (``SCHEMA``): the capture of each page, and one of server-side "not
    modified" (a revisit) for each page whose URL was also fetched under a tracked form (a query, a
    fragment or a trailing slash).

    Dates follow page ids.  Ids are urn:page:N and urn:again:N.  Null html counts as empty.
    """
    digest = F.concat(F.lit("sha1:"), F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    date = lambda shift: F.date_format(F.timestamp_seconds(F.lit(1_577_836_800) + F.coalesce(F.col("page_id"), F.lit(0)) * 60 + shift), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    again = F.coalesce(F.col("url").rlike(_TRACKED), F.lit(False))
    kinds = F.when(again, F.array(F.lit("response"), F.lit("revisit"))).otherwise(F.array(F.lit("response")))
    base = pages.select("page_id", "url", digest.alias("digest"), date(0).alias("d0"), date(30).alias("d1"), F.explode(kinds).alias("kind"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    first = F.col("kind") == "response"
    return base.select(
        F.concat(F.when(first, F.lit("urn:page:")).otherwise(F.lit("urn:again:")), F.col("page_id").cast("string")).alias("record_id"), "kind",
        F.when(first, F.col("url")).otherwise(F.regexp_replace("url", "(/?)([?#].*)?$", "")).alias("uri"), F.when(first, F.col("d0")).otherwise(F.col("d1")).alias("date"), "digest", F.when(first, F.col("html")).alias("payload"))


WARC_SQL = """
WITH base AS (
  SELECT page_id, url, coalesce(html, '') AS html, 'sha1:' || sha1(coalesce(html, '')) AS digest, coalesce(page_id, 0) AS p FROM pages),
caps AS (
  SELECT 'urn:page:' || page_id AS record_id, 'response' AS kind, url AS uri,
    strftime(TIMESTAMP '2020-01-01' + to_seconds(CAST(p * 60 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS date, digest, strlen(html) AS bytes FROM base
  UNION ALL
  SELECT 'urn:again:' || page_id, 'revisit', regexp_replace(url, '(/?)([?#].*)?$', ''),
    strftime(TIMESTAMP '2020-01-01' + to_seconds(CAST(p * 60 + 30 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ'), digest, 0
  FROM base WHERE regexp_matches(url, '([?#]|/$)')),
ranked AS (
  SELECT *, row_number() OVER w AS n, first_value(kind) OVER w AS k0, first_value(record_id) OVER w AS id0
  FROM caps WINDOW w AS (PARTITION BY digest ORDER BY kind <> 'response', date NULLS LAST, record_id NULLS LAST, uri NULLS LAST)),
stated AS (SELECT *, kind = 'response' AND n = 1 AS original FROM ranked)
SELECT record_id, CASE WHEN original THEN 'response' ELSE 'revisit' END AS kind, uri, date, digest,
  CASE WHEN NOT original AND k0 = 'response' THEN id0 END AS original_id, CAST(CASE WHEN original THEN bytes ELSE 0 END AS BIGINT) AS payload_bytes FROM stated
"""


def record_bytes(header: str, payload: bytes | None) -> bytes:
    """One record: header, lengths, payload, two line ends."""
    body = payload or b""
    block = "sha1:" + hashlib.sha1(body).hexdigest()  # noqa: S324
    return header.encode() + f"WARC-Block-Digest: {block}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def _key() -> Column:
    """What identifies a record: all its header columns, nulls apart from empty strings."""
    return F.unhex(F.md5(F.to_json(F.struct("record_id", "kind", "uri", "date", "digest")).cast("binary")))


def write_archives(records: DataFrame, path: str, member_bytes: int = 1 << 30) -> DataFrame:
    """Writes ``records`` (``SCHEMA``) as deduplicated .warc.gz files below ``path``, a folder that all
    executors share, and returns (file, records, bytes), one row per file.

    An empty table gives no file.  Rows that are equal in all header columns are one record.  A null record id is replaced by one made
    of the other header columns.  Payloads of duplicates aren't written.  Each task writes its own files
    under fresh names, one gzip member a record, so a task that runs again leaves at most a file that no
    row names.  Files are written as the rows are computed: write the result once and use that.
    """
    fresh_id = F.coalesce("record_id", F.concat(F.lit("urn:sha1:"), F.sha1(F.to_json(F.struct("record_id", "kind", "uri", "date", "digest")).cast("binary"))))
    named = records.select(fresh_id.alias("record_id"), "kind", "uri", "date", "digest", "payload")
    keyed = named.withColumn("_key", _key())
    heads = written(resolve(named.drop("payload").distinct()), "warc-heads")
    moved = with_headers(heads.where("state not in ('original', 'other')")).select("header", F.lit(None).cast("binary").alias("payload"))
    gone = written(heads.where("state not in ('original', 'other')").select(_key().alias("_key")), "warc-moved")
    kept = keyed.join(hinted(gone, _KEY_BYTES), "_key", "left_anti")
    again = written(keyed.groupBy("_key").count().where("count > 1").select("_key"), "warc-again")
    if again.take(1):
        once = kept.join(hinted(again, _KEY_BYTES), "_key", "left_semi").dropDuplicates(["_key"])
        kept = kept.join(hinted(again, _KEY_BYTES), "_key", "left_anti").unionByName(once)
    blank = [F.lit(None).cast("string").alias(f"original_{c}") for c in ("id", "uri", "date")]
    whole = with_headers(kept.select("record_id", "kind", "uri", "date", "digest", *blank, F.lit("other").alias("state"), "payload")).select("header", "payload")

    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder)
        out, name, n, size = None, None, 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])
        for b in batches:
            for h, p in zip(b.column(0), b.column(1)):
                if out is None:
                    base = f"part-{uuid.uuid4().hex}.warc.gz"
                    name, n, size = f"{path.rstrip('/')}/{base}", 0, 0
                    out = fs.open_output_stream(f"{folder.rstrip('/')}/{base}", compression=None)
                data = gzip.compress(record_bytes(h.as_py(), p.as_py()), 6)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= member_bytes:
                    out.close()
                    yield row()
                    out = None
        if out is not None:
            out.close()
            yield row()

    return whole.unionByName(moved).mapInArrow(run, "file string, records long, bytes long")


def parse(stream: BinaryIO) -> Iterator[dict]:
    """Records of an uncompressed WARC stream, one at a time; a truncated last record is left out."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b":")
            head[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        length = head.get("content-length", "")
        size = int(length) if length.isdecimal() else 0
        body = stream.read(size)
        if len(body) < size:
            return
        yield {"record_id": head.get("warc-record-id", "").strip("<>") or None, "kind": head.get("warc-type"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "digest": head.get("warc-payload-digest"), "payload": body,
               "original_id": head.get("warc-refers-to", "").strip("<>") or None}


def opened(raw: BinaryIO) -> BinaryIO:
    """The stream as it is, or uncompressed if it begins like a gzip file."""
    raw = io.BufferedReader(raw, 1 << 20)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def read_archives(files: DataFrame, file_col: str = "file") -> DataFrame:
    """(``SCHEMA``, original_id) of the archives that ``files`` names: read as streams, so a file may be
    of any size.  A null name gives no record."""
    kind = pa.schema([*((c, pa.string()) for c in ("record_id", "kind", "uri", "date", "digest")), ("payload", pa.binary()), ("original_id", pa.string())])

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                if name is None:
                    continue
                fs, at = pafs.FileSystem.from_uri(name)
                rows, held = [], 0
                with fs.open_input_stream(at, compression=None) as raw:
                    for r in parse(opened(_Raw(raw))):
                        rows.append(r)
                        held += len(r["payload"])
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_pylist(rows, kind)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return files.select(file_col).mapInArrow(run, f"{SCHEMA}, original_id string")


class _Raw(io.RawIOBase):
    """A stream of pyarrow as Python's raw stream."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self):
        return True

    def readinto(self, into):
        data = self.stream.read(len(into))
        into[: len(data)] = data
        return len(data)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of all archives below ``path``; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{warc,warc.gz}").load(path).select(F.col("path").alias("file"))


def deduplicated(records: DataFrame) -> DataFrame:
    """(record_id, kind, uri, date, digest, original_id, payload_bytes): what is in the deduplicated
    archives of ``records``, written below the shared folder and read from there."""
    folder = f"{shared_dir(records.sparkSession)}/archive-{uuid.uuid4().hex}"
    files = written(write_archives(records, folder if "://" in folder or folder[0] == "/" else f"file://{folder}"), "warc-files")
    # a task for every ``READ_BYTES`` of archives; files are at most about 1 GB each
    n = files.agg(F.count("*"), F.sum("bytes")).first()
    tasks = max(1, min(n[0], max(records.sparkSession.sparkContext.defaultParallelism, -(-(n[1] or 0) // READ_BYTES))))
    read = read_archives(files.repartition(tasks, "file"))
    return read.select("record_id", "kind", "uri", "date", "digest", "original_id", F.length("payload").cast("long").alias("payload_bytes"))
