"""WARC archives in seekable Zstandard bundles: written, indexed, read back and looked into."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import Scratch, join_groups, keep

#: Uncompressed bytes of records that share a frame, and compressed bytes of frames that share a bundle.
FRAME, BUNDLE = 1 << 18, 1 << 24
LEVEL = 3

# Fixed values of the seekable format: a skippable frame with the seek table ends in the number of
# frames, a descriptor byte and a magic number; another skippable frame before it holds our record map.
_SKIPPABLE, _MAP, _SEEKABLE = 0x184D2A5E, 0x184D2A51, 0x8F92EAB1
#: The last bytes of each bundle. Spark's text writer ends each row, here a bundle, with them.
_TAIL = struct.pack("<BI", 0, _SEEKABLE)

_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, bundle string, frame int, frame_start long, frame_bytes long, place long, size long"


# -- records ------------------------------------------------------------------------------------

def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str | None) -> bytes:
    """A header's value on one line."""
    return " ".join((value or "").split()).encode("utf-8", "surrogatepass")


def record_bytes(record_id: str, kind: str, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit whose block ends with the HTTP header."""
    block = _HEAD % size + (payload if kind == "response" else b"")
    lines = [
        b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + record_id.encode() + b">",
        b"WARC-Target-URI: " + _safe(url), b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        lines += [b"WARC-Profile: " + _PROFILE, b"WARC-Refers-To: <" + (refers_to or "").encode() + b">"]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers, payload, end) of the record at `at`; the headers of its HTTP block are among them as http-*."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(line.split(b": ", 1) for line in lines[1:])
    head = {k.decode().lower(): v.decode("utf-8", "surrogatepass") for k, v in head.items()}
    begin = stop + 4
    block = data[begin:begin + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n")
    for line in block[:cut].split(b"\r\n")[1:]:
        k, v = line.split(b": ", 1)
        head[f"http-{k.decode().lower()}"] = v.decode()
    return head, block[cut + 4:], begin + len(block) + 4


# -- bundles ------------------------------------------------------------------------------------

class Bundle:
    """Frames of one bundle as they grow, each independent of the others."""

    def __init__(self, frame: int):
        self.most, self.frames, self.places = frame, [], []
        self.open, self.size, self.packed = [], 0, 0
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)

    def add(self, record_id: str, record: bytes) -> None:
        if self.open and self.size + len(record) > self.most:
            self.close_frame()
        self.places.append((record_id, len(self.frames), self.size, len(record)))
        self.open.append(record)
        self.size += len(record)

    def close_frame(self) -> None:
        if self.open:
            packed = self.press.compress(b"".join(self.open))
            self.frames.append((packed, self.size))
            self.packed += len(packed)
            self.open, self.size = [], 0

    def body(self) -> bytes:
        """The whole bundle but for _TAIL: frames, record map, seek table."""
        self.close_frame()
        ids, frame, place, size = zip(*self.places, strict=True)
        sink = pa.BufferOutputStream()
        table = pa.record_batch({"record_id": pa.array(ids), "frame": pa.array(frame, pa.int32()),
                                 "place": pa.array(place, pa.int64()), "size": pa.array(size, pa.int64())})
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_batch(table)
        names = zstandard.ZstdCompressor(level=LEVEL).compress(sink.getvalue().to_pybytes())
        seek = b"".join(struct.pack("<II", len(p), n) for p, n in self.frames) + struct.pack("<I", len(self.frames))
        return b"".join([
            *(p for p, _ in self.frames),
            struct.pack("<II", _MAP, len(names) + 4), names, struct.pack("<I", len(names)),
            struct.pack("<II", _SKIPPABLE, len(seek) + len(_TAIL)), seek])


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the footer."""
    if bundle[-len(_TAIL):] != _TAIL:
        raise ValueError("not a seekable bundle")
    count = struct.unpack_from("<I", bundle, len(bundle) - 9)[0]
    first = len(bundle) - 9 - 8 * count
    if struct.unpack_from("<II", bundle, first - 8) != (_SKIPPABLE, 8 * count + 9):
        raise ValueError("damaged seek table")
    out, at = [], 0
    for k in range(count):
        packed, size = struct.unpack_from("<II", bundle, first + 8 * k)
        out.append((at, packed, size))
        at += packed
    return out


def record_map(bundle: bytes) -> pa.RecordBatch:
    """(record_id, frame, place, size) of a bundle's records, without opening its frames."""
    stop = len(bundle) - 9 - 8 * struct.unpack_from("<I", bundle, len(bundle) - 9)[0] - 8
    size = struct.unpack_from("<I", bundle, stop - 4)[0]
    raw = zstandard.ZstdDecompressor().decompress(bundle[stop - 4 - size:stop - 4])
    return pa.ipc.open_stream(raw).read_next_batch()


def frame_bytes(bundle: bytes, start: int, packed: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bundle[start:start + packed])


# -- Spark --------------------------------------------------------------------------------------

def record_id(page_id: str, digest: str = "_digest", url: str = "url") -> Column:
    """`urn:page:` and the id, or for a null id a digest of the row."""
    c = F.col(page_id).cast("string")
    row = F.md5(F.concat_ws(" ", digest, F.col(url)))
    return F.concat(F.lit("urn:page:"), F.coalesce(c, F.concat(F.lit("none-"), row)))


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """The pages with what their records will be: (_id, _url, _payload, _kind, _refers).

    Of equal payloads of `least` bytes or more the largest id is the response. Payloads are told
    apart by a 256-bit digest; only digests and ids are shuffled to find the largest, and pages of
    often repeated payloads meet it by a bounded broadcast.
    """
    own = pages.select(F.col(page_id).alias("_id"), F.col(url).cast("string").alias("url"),
                       F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("_payload"))
    own = own.withColumn("_digest", F.sha2("_payload", 256))
    groups = own.groupBy("_digest").agg(F.count("*").alias("_copies"), F.max("_id").alias("_last"))
    repeated = keep(groups.where("_copies > 1"))
    revisits = (F.octet_length("_payload") >= least) & F.col("_last").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_last"))
    marked = join_groups(own, repeated, ["_digest"], "_copies")
    return marked.select(
        record_id("_id").alias("_record"), F.col("url").alias("_url"), "_payload",
        F.when(F.coalesce(revisits, F.lit(False)), "revisit").otherwise("response").alias("_kind"),
        F.when(F.coalesce(revisits, F.lit(False)), F.concat(F.lit("urn:page:"), F.col("_last").cast("string"))).alias("_refers"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, frame: int = FRAME, bundle: int = BUNDLE,
                   page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """A WARC record for each page, in seekable bundles `folder`/bundle=<name>/.

    Records gather in frames of about `frame` bytes that open independently, frames in bundles of
    about `bundle` compressed bytes; a page larger than that has one of its own. A bundle ends with
    a map from record ids to (frame, place in the frame) and the seek table of the seekable
    Zstandard format, both in skippable frames, so that any Zstandard reader sees only records.
    Spark's own writer stores bundles, one a file, so lost tasks leave nothing behind.

    Null html is an empty payload, a null url an empty one. A page whose id is null is named by a
    digest and never referred to; where all equal payloads have null ids all are responses. Rows
    equal in id and payload are each a record of the same kind. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Bundle(frame)

        def done(b: Bundle) -> pa.RecordBatch:
            body = b.body()
            name = f"b{hashlib.md5(body).hexdigest()}"  # never read as a number
            return pa.record_batch({"bundle": pa.array([name]), "value": pa.array([body], pa.binary())})

        for batch in batches:
            for name, uri, payload, kind, refers in zip(*(batch[c] for c in ("_record", "_url", "_payload", "_kind", "_refers")), strict=True):
                payload = payload.as_py()
                held.add(name.as_py(), record_bytes(name.as_py(), kind.as_py(), uri.as_py(), payload, len(payload),
                                                    payload_digest(payload), refers.as_py()))
                if held.packed >= bundle:
                    yield done(held)
                    held = Bundle(frame)
        if held.places:
            yield done(held)

    bundles = planned(pages, page_id, url, html, least).mapInArrow(run, "bundle string, value binary")
    (bundles.select("bundle", F.col("value").cast("string").alias("value")).write.partitionBy("bundle")
     .option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", _TAIL.decode("latin-1")).text(folder))


def _bundles(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").load(folder)
    if "bundle" not in found.columns:  # no pages, no bundles
        found = found.withColumn("bundle", F.lit(None).cast("string"))
    return found.select("bundle", "content")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, bundle, frame, frame_start, frame_bytes, place, size): where each record is, from the footers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["bundle"], batch["content"], strict=True):
                body = content.as_py()
                places, frames = record_map(body), seek_table(body)
                at = places["frame"].to_pylist()
                yield pa.record_batch({
                    "record_id": places["record_id"], "bundle": pa.array([name.as_py()] * len(at)), "frame": places["frame"],
                    "frame_start": pa.array([frames[f][0] for f in at], pa.int64()),
                    "frame_bytes": pa.array([frames[f][1] for f in at], pa.int64()), "place": places["place"], "size": places["size"]})

    return _bundles(spark, folder).mapInArrow(run, INDEX)


def _described(head: dict, payload: bytes) -> dict:
    kind = head["warc-type"]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"damaged payload of {head['warc-record-id']}")
    return {"record_id": head["warc-record-id"][1:-1], "url": head["warc-target-uri"], "record_type": kind,
            "refers_to": head["warc-refers-to"][1:-1] if "warc-refers-to" in head else None, "payload_digest": digest,
            "payload_bytes": len(payload) if kind == "response" else int(head["http-content-length"]),
            "payload": payload if kind == "response" else None}


_READ = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                   ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_READ_SQL = ("record_id string, url string, record_type string, refers_to string, payload_digest string, "
             "payload_bytes long, payload binary")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records: (record_id, url, record_type, refers_to, payload_digest, payload_bytes, payload).

    Frames are opened one by one by the seek table. A response's payload is measured and held
    against its digest; a revisit has none and states those of the payload it repeats. Without
    `payloads` they are checked, not returned.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                body = content.as_py()
                for start, packed, size in seek_table(body):
                    data, at, rows = frame_bytes(body, start, packed), 0, []
                    if len(data) != size:
                        raise ValueError("a frame differs from the seek table")
                    while at < size:
                        head, payload, at = read_record(data, at)
                        rows.append(_described(head, payload) | ({} if payloads else {"payload": None}))
                    yield pa.RecordBatch.from_pylist(rows, _READ)

    return _bundles(spark, folder).mapInArrow(run, _READ_SQL)


def fetch(spark: SparkSession, folder: str, record_ids: DataFrame) -> DataFrame:
    """The records named by `record_ids` (record_id): only the frames that hold them are opened."""
    wanted = read_index(spark, folder).join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    places = wanted.groupBy("bundle").agg(F.collect_list(F.struct("frame_start", "frame_bytes", "place")).alias("places"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body, own in zip(batch["content"], batch["places"], strict=True):
                rows, opened, data = [], None, b""
                for start, packed, place in sorted((p["frame_start"], p["frame_bytes"], p["place"]) for p in own):
                    if start != opened:
                        opened, data = start, frame_bytes(bytes(body), start, packed)
                    rows.append(_described(*read_record(data, place)[:2]))
                yield pd.DataFrame(rows, columns=_READ.names)

    return _bundles(spark, folder).join(places, "bundle").select("content", "places").mapInPandas(run, _READ_SQL)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): each page as the archives give it back.

    Archives go to the shared folder and are dropped once read. A page with a null id has a null one here.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    write_archives(pages, f"{scratch.folder}/warc", least)
    kind = pages.schema["page_id"].dataType.simpleString()
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS {kind})")
    result = keep(read_archives(spark, f"{scratch.folder}/warc", payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")))
    scratch.drop()
    return result
