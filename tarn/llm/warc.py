"""WARC archives: records in segments written by tasks, read back, put together again and decoded."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tarn.llm.common import attach, packed, remove, settled, shared_folder, ship

#: Bytes of a record's block before it is continued in another record; of a chunk of the body; of an archive; of records
#: that a reader hands on at a time.
SEGMENT, CHUNK, ARCHIVE, BATCH = 16 << 10, 4 << 10, 64 << 20, 4 << 20
_SPACE = uuid.UUID("5b0c7a54-6d0b-5e35-9a0e-6f3a4c1d2e7f")
_DATE = "2026-01-01T00:00:00Z"
#: From the WARC 1.1 standard: fixed value.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest_of(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, repr(of))}>"


def record(kind: str, identifier: str, block: bytes, **fields: object) -> bytes:
    """One record as a gzip member; fields that are None are left out."""
    named = {"WARC-Type": kind, "WARC-Record-ID": identifier, "WARC-Date": _DATE} | {k.replace("_", "-"): v for k, v in fields.items() if v is not None}
    head = "".join(f"{k}: {v}\r\n" for k, v in named.items())
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", 6, mtime=0)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[a : a + size] for a in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def _uri(url: str | None) -> str | None:
    """The address as a header can hold it: spaces, control and other characters are percent-encoded."""
    return None if url is None else urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def response(page: int | None, url: str | None, payload: bytes, segment: int = SEGMENT) -> list[bytes]:
    """A response and, if its block is longer than a segment, the records that continue it."""
    sha1 = hashlib.sha1(payload).digest()
    block, identifier = HEAD + chunked(payload), record_id(page, url, sha1)
    parts = [block[a : a + segment] for a in range(0, len(block), segment)]
    many = len(parts) > 1
    fields = {"WARC_Target_URI": _uri(url), "Page_ID": page, "WARC_Payload_Digest": f"sha1:{digest_of(sha1)}", "Content_Type": "application/http; msgtype=response"}
    out = [record("response", identifier, parts[0], **fields, WARC_Segment_Number=1 if many else None)]
    for k, part in enumerate(parts[1:], 2):
        last = {"WARC_Segment_Total_Length": len(block)} if k == len(parts) else {}
        out.append(record("continuation", record_id(identifier, k), part, WARC_Target_URI=_uri(url), WARC_Segment_Origin_ID=identifier, WARC_Segment_Number=k, **last))
    return out


def revisit(page: int | None, url: str | None, copy: int, sha1: bytes, first_page: int | None, first_url: str | None) -> bytes:
    """A record without a payload that refers to the response with the same one."""
    return record(
        "revisit", record_id(page, url, sha1, copy), HEAD, WARC_Target_URI=_uri(url), Page_ID=page, WARC_Profile=PROFILE, WARC_Payload_Digest=f"sha1:{digest_of(sha1)}",
        WARC_Refers_To=record_id(first_page, first_url, sha1), WARC_Refers_To_Target_URI=_uri(first_url), WARC_Refers_To_Date=_DATE, Content_Type="application/http; msgtype=response",
    )


class Body:
    """An HTTP message that comes in pieces: its head, then the body, plain or in chunked framing.

    Nothing is held but a line that isn't whole yet, and the payload if it is wanted. `error` says what is wrong first.
    """

    def __init__(self, keep: bool = False):
        self.held, self.state, self.left, self.coded = b"", "status", 0, False
        self.size, self.sha1, self.error = 0, hashlib.sha1(), None
        self.parts: list[bytes] | None = [] if keep else None

    def _take(self, piece: bytes) -> None:
        self.size += len(piece)
        self.sha1.update(piece)
        if self.parts is not None:
            self.parts.append(piece)

    def feed(self, piece: bytes) -> None:
        data, at = self.held + piece, 0
        while at < len(data) and self.state != "done":
            if self.state == "plain":
                self._take(data[at:])
                at = len(data)
            elif self.state == "chunk":
                part = data[at : at + self.left]
                self._take(part)
                at, self.left = at + len(part), self.left - len(part)
                if not self.left:
                    self.state = "after"
            else:
                end = data.find(b"\n", at)
                if end < 0:
                    break
                line, at = data[at:end].rstrip(b"\r"), end + 1
                self._line(line)
        self.held = b"" if self.state == "done" else data[at:]

    def _line(self, line: bytes) -> None:
        if self.state == "status":
            if not line.startswith(b"HTTP/"):
                self._fail("no HTTP message")
            else:
                self.state = "head"
        elif self.state == "head":
            if not line:
                self.state = "size" if self.coded else "plain"
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"transfer-encoding" and value.split(b",")[-1].strip().lower() == b"chunked":
                self.coded = True
        elif self.state == "size":
            number = line.split(b";")[0].strip()  # extensions follow a semicolon
            if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", number):
                self._fail("broken chunk")
            else:
                self.left = int(number, 16)
                self.state = "chunk" if self.left else "trailer"
        elif self.state == "after":
            if line:
                self._fail("broken chunk")
            else:
                self.state = "size"
        elif not line:  # trailers end with an empty line
            self.state = "done"

    def _fail(self, why: str) -> None:
        self.error, self.state = self.error or why, "done"

    def end(self) -> None:
        if self.state not in ("done", "plain"):
            self._fail("the message ends early")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields (names in lower case), block and error of each record; what can't be read ends the archive."""
    while True:
        try:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                yield {}, b"", "no record"
                return
            fields: dict[str, str] = {}
            name = ""
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                text = line.rstrip(b"\r\n").decode("utf-8", "replace")
                if text[:1] in " \t" and name:  # a folded line
                    fields[name] += " " + text.strip()
                else:
                    name, _, value = text.partition(":")
                    name = name.strip().lower()
                    fields[name] = value.strip()
            length = fields.get("content-length", "")
            if not length.isdigit():
                yield fields, b"", "no length"
                return
            block = stream.read(int(length))
            yield fields, block, None if len(block) == int(length) else "the record ends early"
            if len(block) < int(length):
                return
        except (EOFError, OSError) as broken:
            yield {}, b"", f"the archive can't be read: {type(broken).__name__}"
            return


RECORDS = "archive string, number long, fields map<string, string>, block binary, error string"
_ARROW = pa.schema([("archive", pa.string()), ("number", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("error", pa.string())])


@dataclass
class _Archive(InputPartition):
    path: str

    def __post_init__(self):
        super().__init__(self.path)


@dataclass
class _Wrote(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.which = options["path"], options.get("segments", "all")

    def partitions(self) -> list[_Archive]:
        store, path = pa.fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(pa.fs.FileSelector(path, recursive=True)) if store.get_file_info(path).type == pa.fs.FileType.Directory else [store.get_file_info(path)]
        names = sorted(f.path for f in found if re.search(r"\.warc(\.gz)?$", f.path) and "/_" not in f.path[len(path) :])
        return [_Archive(x) for x in names] or [_Archive("")]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:  # a folder without archives, or none
            return
        store, _ = pa.fs.FileSystem.from_uri(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

        with store.open_input_stream(partition.path, compression=None) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw
            for k, (fields, block, error) in enumerate(parse(io.BufferedReader(stream, 1 << 18))):
                if self.which != "all" and ("warc-segment-number" in fields) != (self.which == "only"):
                    continue
                rows.append((partition.path.rsplit("/", 1)[-1], k, list(fields.items()), block, error))
                size += len(block) + 500
                if size > BATCH:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class _Writer(DataSourceArrowWriter):
    """Tasks write archives of gzip members beside the folder's own; the driver only renames them once all are whole."""

    def __init__(self, options: dict):
        self.path, self.job, self.most = options["path"], uuid.uuid4().hex, int(options.get("archive", ARCHIVE))

    def _store(self) -> tuple[pa.fs.FileSystem, str, str]:
        store, path = pa.fs.FileSystem.from_uri(self.path)
        return store, path, f"{path}/_writing-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Wrote:
        store, _, room = self._store()
        store.create_dir(room)
        done, out, size = _Wrote(), None, 0
        for batch in iterator:
            for data in batch.column(0):
                if out is None or size > self.most:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"  # another attempt has another name
                    done.files.append(name)
                    out, size = store.open_output_stream(f"{room}/{name}", compression=None), 0
                    info = record("warcinfo", record_id(name), b"software: tarn\r\nformat: WARC File Format 1.1\r\n", Content_Type="application/warc-fields", WARC_Filename=name)
                    out.write(info)
                out.write(data.as_buffer())
                size += len(data.as_buffer())
        if out is not None:
            out.close()
        return done

    def commit(self, messages: list[_Wrote | None]) -> None:
        store, path, room = self._store()
        for message in messages:
            for name in message.files if message else []:
                store.move(f"{room}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[_Wrote | None]) -> None:
        store, _, room = self._store()
        if store.get_file_info(room).type == pa.fs.FileType.Directory:
            store.delete_dir(room)


class WarcSource(DataSource):
    """spark.read.format("tarn_warc").load(folder): a partition for each archive, records one by one; and a writer of
    gzip members (one binary column). Any store that pyarrow opens by URI."""

    @classmethod
    def name(cls) -> str:
        return "tarn_warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def records(spark: SparkSession, folder: str, segments: str = "all") -> DataFrame:
    """archive, number, fields, block, error of all records; "only" those of several segments, or "none" of them."""
    ship(spark)
    spark.dataSource.register(WarcSource)
    return spark.read.format("tarn_warc").option("segments", segments).load(folder)


def write(pages: DataFrame, folder: str, segment: int = SEGMENT, least: int = 0, archive: int = ARCHIVE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record for each page: of equal payloads of `least` bytes or more the page of smallest id is a response,
    the others revisit it.

    Responses are made, compressed, before they are shuffled, and of those with one payload a task hands on one, so a
    payload that a third of the pages share costs no more than another. Blocks longer than `segment` go on in
    continuation records. Tasks write archives of about `archive` bytes; nothing but their names passes the driver.

    A null html is an empty payload. A null id counts as larger than any and has no Page-ID field; a null address has
    no target. Of rows equal in all but one is the response. An empty table gives no archive.
    """
    if least > segment:
        raise ValueError("payloads that aren't compared must fit into one segment")
    spark = pages.sparkSession
    ship(spark)
    spark.dataSource.register(WarcSource)
    order = lambda p, u: F.struct(p.isNull().alias("no_id"), p.alias("page"), u.isNull().alias("no_url"), u.alias("url"))
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = [response(p, u, d.as_py(), segment) for p, u, d in zip(part.column("page").to_pylist(), part.column("url").to_pylist(), part.column("payload"), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("sha1"), part.column("page"), part.column("url"), pa.array(made, pa.list_(pa.binary()))], names=["sha1", "page", "url", "records"])

    sha1 = F.unhex(F.sha1("payload")).alias("sha1")
    respond_to = lambda df: df.select("page", "url", "payload", sha1).mapInArrow(respond, "sha1 binary, page long, url string, records array<binary>")
    large = F.octet_length("payload") >= least
    first = respond_to(rows.where(large)).groupBy("sha1").agg(F.min_by("records", order(F.col("page"), F.col("url"))).alias("records"))
    responses = first.select("records").unionAll(respond_to(rows.where(~large)).select("records"))

    each = settled(rows.where(large).select("page", "url", sha1).groupBy("sha1", "page", "url").agg(F.count(F.lit(1)).alias("times")))
    of = each.groupBy("sha1").agg(F.min(order(F.col("page"), F.col("url"))).alias("first"), F.sum("times").alias("all")).where("all > 1").select("sha1", "first")
    again = attach(each, settled(of), ["sha1"])
    again = again.withColumn("times", F.col("times") - (order(F.col("page"), F.col("url")) == F.col("first")).cast("int")).where("times > 0")
    again = again.select("page", "url", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"), "sha1", F.col("first.page").alias("first_page"), F.col("first.url").alias("first_url"))

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[revisit(*r)] for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.binary()))], names=["records"])

    both = responses.unionAll(again.mapInArrow(refer, "records array<binary>"))
    both.select(F.explode("records").alias("data")).write.format("tarn_warc").option("archive", archive).mode("append").save(folder)


_DECODED = "record_id string, type string, page_id long, target string, refers_id string, payload_bytes long, payload_digest string, segments int, payload binary, error string"


class _Decoder:
    """One capture after the other, from records that come in order of their segments."""

    def __init__(self, keep: bool):
        self.keep, self.rows = keep, []
        self.key: str | None = None

    def begin(self, key: str | None) -> None:
        self.key, self.fields, self.error = key, {}, None
        self.body, self.count, self.length, self.total = Body(self.keep), 0, 0, None
        self.before: tuple[int, bytes] | None = None

    def add(self, fields: dict[str, str], block: bytes, error: str | None, number: int) -> None:
        """The next segment; one that comes twice counts once."""
        self.error = self.error or error
        if number == self.count and self.before is not None:
            if self.before != (len(block), hashlib.sha1(block).digest()):
                self.error = self.error or f"segment {number} comes twice"
            return
        if number != self.count + 1:
            self.error = self.error or f"segment {self.count + 1} is missing"
        if number == 1:
            self.fields = fields
        self.before, self.count = (len(block), hashlib.sha1(block).digest()), number
        self.length += len(block)
        if (total := fields.get("warc-segment-total-length", "")).isdigit():
            self.total = int(total)
        if not self.error:
            self.body.feed(block)

    def end(self) -> None:
        f, kind = self.fields, self.fields.get("warc-type")
        error = self.error
        if not error and "warc-segment-number" in f and self.length != self.total:
            error = "the last segment is missing" if self.total is None else "the segments' lengths don't add up"
        named = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
        size, digest, payload = None, named, None
        if kind != "revisit" and not error:
            self.body.end()
            error, size, digest = self.body.error, self.body.size, digest_of(self.body.sha1.digest())
            payload = b"".join(self.body.parts) if self.keep and not error else None
            error = error or ("the digest differs" if named and named != digest else None)
        page = f.get("page-id", "")
        self.rows.append((f.get("warc-record-id", self.key), kind, int(page) if re.fullmatch(r"-?\d{1,19}", page) else None, f.get("warc-target-uri"), f.get("warc-refers-to"), size, digest, self.count, payload, error))

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string()]
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * len(kinds)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _DECODED.split(", ")])


def captures(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each response and revisit of the archives: record_id, type, page_id, target, refers_id, payload_bytes,
    payload_digest, segments, payload (null unless wanted) and error.

    Records of one segment are decoded where they are read. Segments are grouped by the identifier of the record that they
    continue, sorted by their number and fed one by one to a decoder that holds no more than the payload, if that
    is wanted; so only they are shuffled. A missing segment, a total length that differs, broken chunked framing or a
    digest that isn't the payload's is told in `error`; a segment that comes twice counts once.
    """
    rows = records(spark, folder, "none").where(F.col("fields")["warc-type"].isin("response", "revisit") | F.col("error").isNotNull())
    parts = records(spark, folder, "only")
    origin = F.coalesce(F.col("fields")["warc-segment-origin-id"], F.col("fields")["warc-record-id"])
    parts = parts.select(origin.alias("origin"), F.expr("try_cast(fields['warc-segment-number'] AS int)").alias("part"), "fields", "block", "error")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _Decoder(payloads)
        for batch in batches:
            for fields, block, error in zip(batch.column("fields").to_pylist(), batch.column("block"), batch.column("error").to_pylist(), strict=True):
                d.begin(None)
                d.add(dict(fields or []), block.as_py(), error, 1)
                d.end()
            yield d.batch()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, open_ = _Decoder(payloads), False
        for batch in batches:
            for key, part, fields, block, error in zip(*(batch.column(c).to_pylist() for c in ("origin", "part", "fields")), batch.column("block"), batch.column("error").to_pylist(), strict=True):
                if not open_ or key != d.key:
                    if open_:
                        d.end()
                    d.begin(key)
                    open_ = True
                d.add(dict(fields or []), block.as_py(), error, part or 0)
            yield d.batch()
        if open_:
            d.end()
            yield d.batch()

    ordered = parts.repartition("origin").sortWithinPartitions("origin", "part")
    return rows.select("fields", "block", "error").mapInArrow(whole, _DECODED).unionAll(ordered.mapInArrow(joined, _DECODED))


def resolve(found: DataFrame) -> DataFrame:
    """The captures with refers_to, the page_id that a revisit refers to, and its payload_bytes, from the response.

    A response that a third of all revisits refer to is joined without a shuffle of theirs. A revisit whose response isn't
    there keeps NULL for both.
    """
    revisits = found.where("type = 'revisit'").drop("payload_bytes")
    known = found.where("type = 'response' AND record_id IS NOT NULL").groupBy(F.col("record_id").alias("refers_id")).agg(F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("payload_bytes"))
    names = [*found.columns, "refers_to"]
    others = found.where("type IS NULL OR type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    return others.select(names).unionAll(attach(revisits, known, ["refers_id"], "left").select(names))


def op11_warc_segments(spark, sf_dir: str) -> DataFrame:
    """The pages as archives in the shared folder and back; the archives go once they are decoded."""
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = settled(captures(spark, folder, payloads=False).drop("payload"))
    remove(spark, folder)
    out = resolve(found).select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
    return packed(out)


OP11_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, row_number() OVER w AS k, first_value(page_id) OVER w AS first
  FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST)),
d AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(sha1(t), 5 * i + 1, 5) AS INTEGER)) AS groups FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(groups, lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to
FROM d
"""
