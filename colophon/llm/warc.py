"""WARC archives: writing, normalising whole-file gzip streams, and reading back by index.

``write_archives`` lets Spark write the records as gzip files, each one monolithic stream.  ``normalise`` inflates
each stream once, rewrites every record as a gzip member of its own, and puts a tab-separated index (file, offset,
length, record id) beside the file.  ``read_records`` goes by the index and inflates single members.  Archives and
records pass through tasks in pieces of a megabyte, so neither has to fit in memory.

An archive's output is named by its path below the source folder and a hash of that path, so no two archives meet.
Data is written under a name of its own attempt; the index, which tells that name, is published by one rename.  A
task that runs again finds the index and leaves it, or publishes its own pair: never a data file with an index of
another attempt.  All files lie in the shared folder.

Defined results: a null html is an empty payload; a null url is written as about:blank, white space and control
characters in a url as %XX; a null page_id reads back as null and never stands for others; rows that repeat the
smallest page_id and payload are all responses.  Archives in subfolders are read; zero bytes behind a member are
padding; a stream that is cut off, a record without Content-Length or a head above HEAD_LIMIT ends the job with the
archive's name.  A target that holds files already is refused.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, materialize, new_path

#: Payloads below so many bytes are never replaced by a revisit.
LEAST_REVISIT = 100
#: Records of a written file at most, and payload bytes of one on average at most.
RECORDS_PER_FILE, FILE_BYTES = 5_000, 256 << 20
#: Bytes of a record's head at most.
HEAD_LIMIT = 1 << 20
_STEP = 1 << 20
END = "\r\n\r\n"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _payloads(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))


def payload_sizes(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest of each row, written: what types are decided by, without payloads."""
    return materialize(_payloads(pages).select("page_id", "payload_bytes", "payload_digest"), "payloads")


def with_types(pages: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Ids meet by digest, payloads only by (page_id, digest): however common a payload is, no task gathers its copies.
    """
    large = (payload_sizes(pages) if sizes is None else sizes).where(F.col("payload_bytes") >= LEAST_REVISIT).select("page_id", "payload_digest")
    firsts = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    # written first: a join of two plain shuffles is one whose skewed partitions Spark splits
    again = large.join(materialize(firsts, "firsts"), "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    # written, so that Spark knows its size: payloads are shuffled only if the revisits are too many to broadcast
    again = materialize(again.select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), "refers_to"), "revisits")
    rows = _payloads(pages).join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest")), "left")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _escaped(url: Column) -> Column:
    """White space and control characters as %XX, byte by byte."""
    bad = r"[\x00-\x20\x7F-\x9F]"
    parts = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(bad), F.regexp_replace(F.hex(c.cast("binary")), "(..)", "%$1")).otherwise(c))
    return F.when(url.rlike(bad), F.array_join(parts, "")).otherwise(url)


def record_text(date: str = "1970-01-01T00:00:00Z") -> Column:
    """A whole WARC record without the two line ends that close it."""
    revisit = F.col("record_type") == "revisit"
    url = _escaped(F.coalesce("url", F.lit("about:blank")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    fields = [
        (F.lit("WARC-Type"), F.col("record_type")),
        (F.lit("WARC-Record-ID"), _uri(F.col("page_id"))),
        (F.lit("WARC-Date"), F.lit(date)),
        (F.lit("WARC-Target-URI"), url),
        (F.lit("WARC-Payload-Digest"), F.concat(F.lit("sha256:"), "payload_digest")),
        (F.lit("Content-Type"), F.lit("application/http; msgtype=response")),
    ]
    parts = [F.lit("WARC/1.1\r\n")]
    for name, value in fields:
        parts += [name, F.lit(": "), value, F.lit("\r\n")]
    refers = F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("refers_to")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))
    parts += [F.when(revisit, refers).otherwise(""), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block]
    return F.concat(*parts)


def records_per_file(sizes: DataFrame) -> int:
    mean = sizes.agg(F.avg("payload_bytes")).first()[0] or 0
    return int(max(1, min(RECORDS_PER_FILE, FILE_BYTES // max(mean, 1))))


def write_archives(typed: DataFrame, path: str, most: int = RECORDS_PER_FILE) -> None:
    """Gzip files of at most ``most`` WARC records, each file one stream from end to end."""
    typed.select(record_text().alias("value")).write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", most).text(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def split_records(pieces):
    """(starts, bytes) pieces of all records from pieces of the stream; one that starts a record is its whole head."""
    buffer, left, end = bytearray(), 0, END.encode()
    for piece in pieces:
        buffer += piece
        while buffer:
            if left:
                some = bytes(buffer[:left])
                del buffer[: len(some)]
                left -= len(some)
                yield False, some
                continue
            at = buffer.find(end)
            if at > HEAD_LIMIT or at < 0 and len(buffer) > HEAD_LIMIT:
                raise ValueError(f"a record's head has more than {HEAD_LIMIT} bytes")
            if at < 0:
                break
            head = bytes(buffer[: at + 4])
            del buffer[: at + 4]
            length = _fields(head).get("content-length", "")
            if not length.isdecimal():
                raise ValueError("a record has no Content-Length")
            left = int(length) + 4
            yield True, head
    if buffer or left:
        raise ValueError("the stream ends inside a record")


def inflate(pieces):
    """The inflated bytes of a gzip stream of one or more members, from its pieces in pieces of a megabyte."""
    stream, open_member = zlib.decompressobj(31), False
    for piece in pieces:
        while piece:
            if not open_member:
                piece = piece.lstrip(b"\0")
                if not piece:
                    break
            open_member = True
            some = stream.decompress(piece, _STEP)
            if some:
                yield some
            piece = stream.unconsumed_tail
            if stream.eof:
                piece, stream, open_member = stream.unused_data, zlib.decompressobj(31), False
    if open_member:
        if some := stream.flush():
            yield some
        if not stream.eof:
            raise ValueError("the gzip stream is cut off")


def _pieces(file, left: int | None = None):
    while left is None or left > 0:
        some = file.read(_STEP if left is None else min(_STEP, left))
        if not some:
            return
        left = None if left is None else left - len(some)
        yield some


def _storage(uri: str):
    """pyarrow's file system and path of an address as Spark writes it (file:/x, s3a://x)."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri("s3" + uri.removeprefix("s3a") if uri.startswith("s3a:") else uri)


def output_name(path: str, root: str) -> str:
    """The name of an archive's output, without ending: its path below ``root`` and a hash of that."""
    below = path.removeprefix(root).lstrip("/")
    stem = below.removesuffix(".gz").removesuffix(".warc")
    return f"{stem.replace('/', '_')[-100:]}-{hashlib.blake2b(below.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


def rewrite(pieces, out, index, name: str) -> tuple[int, int]:
    """One member a record into ``out``, a line a record into ``index``; (records, bytes)."""
    start = offset = records = 0
    member, record_id = None, ""

    def close():
        nonlocal start, offset, records
        if member is not None:
            last = member.flush()
            out.write(last)
            offset += len(last)
            index.write(f"{name}\t{start}\t{offset - start}\t{record_id}\n".encode())
            start, records = offset, records + 1

    for starts, piece in split_records(inflate(pieces)):
        if starts:
            close()
            member, record_id = zlib.compressobj(6, zlib.DEFLATED, 31), " ".join(_fields(piece).get("warc-record-id", "").split())
        some = member.compress(piece)
        out.write(some)
        offset += len(some)
    close()
    return records, offset


def _normalise_one(path: str, root: str, store, target: str) -> tuple[str, int, int]:
    """Rewrite one archive, or tell what an earlier attempt published."""
    name = output_name(_storage(path)[1], root)
    published = f"{target}/{name}.idx"
    if store.get_file_info(published).is_file:
        with store.open_input_stream(published, compression=None) as f:
            lines = f.read().decode().splitlines()
        return (lines[-1].split("\t")[0], len(lines), sum(map(int, lines[-1].split("\t")[1:3]))) if lines else (name, 0, 0)
    own = f"{name}-{uuid.uuid4().hex[:12]}"
    drafts = [f"{target}/_{own}.warc.gz", f"{target}/_{own}.idx"]
    source, at = _storage(path)
    try:
        with source.open_input_stream(at, compression=None) as f, store.open_output_stream(drafts[0], compression=None) as out, store.open_output_stream(drafts[1], compression=None) as index:
            records, size = rewrite(_pieces(f), out, index, f"{own}.warc.gz")
        store.move(drafts[0], f"{target}/{own}.warc.gz")
        store.move(drafts[1], published)
    except Exception as e:
        for x in (*drafts, f"{target}/{own}.warc.gz"):
            if store.get_file_info(x).is_file:
                store.delete_file(x)
        raise ValueError(f"{path}: {e}") from e
    return f"{own}.warc.gz", records, size


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite each gzip stream below ``source``: one member a record, and an index.  (file, records, bytes) rows."""
    from pyarrow import fs

    store, to = _storage(target)
    if store.get_file_info(fs.FileSelector(to, allow_not_found=True)):
        raise ValueError(f"{target} is not empty")

    def run(batches):
        store, to = _storage(target)
        root = _storage(source)[1]
        store.create_dir(to)
        for pdf in batches:
            for path in pdf["path"]:
                yield pd.DataFrame([_normalise_one(path, root, store, to)], columns=["file", "records", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(source)
    return materialize(files.select("path").mapInPandas(run, "file string, records long, bytes long"), "normalised")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    schema = "file string, offset long, length long, record_id string"
    return spark.read.schema(schema).option("sep", "\t").option("pathGlobFilter", "*.idx").csv(target)


def read_record(pieces) -> tuple[dict[str, str], int, int, str]:
    """Fields of a record's head; the payload length its HTTP head states, the length found and its SHA-256."""
    fields, http, left, size, sha = {}, bytearray(), 0, 0, hashlib.sha256()
    inside = False
    for starts, piece in split_records(inflate(pieces)):
        if starts:
            fields = _fields(piece)
            left = int(fields["content-length"])
            continue
        piece, left = piece[:left], left - min(left, len(piece))
        if not inside:
            http += piece
            at = http.find(END.encode())
            if at < 0:
                continue
            inside, piece = True, bytes(http[at + 4 :])
            del http[at:]
        size += len(piece)
        sha.update(piece)
    return fields, int(_fields(bytes(http)).get("content-length", -1)), size, sha.hexdigest()


def read_records(spark: SparkSession, target: str) -> DataFrame:
    """Each record of the archives, read as a single member where the index says; digests are checked."""

    def run(batches):
        store, root = _storage(target)
        for pdf in batches:
            out = []
            for name, part in pdf.groupby("file", sort=False):
                with store.open_input_file(f"{root}/{name}") as archive:
                    for offset, length in zip(part["offset"], part["length"]):
                        archive.seek(offset)
                        fields, stated, size, sha = read_record(_pieces(archive, length))
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if fields["warc-type"] == "response" and (size != stated or sha != digest):
                            raise ValueError(f"{name} at {offset}: the payload differs from its digest")
                        ids = [fields.get(k, "null>").rsplit(":", 1)[-1][:-1] for k in ("warc-record-id", "warc-refers-to")]
                        out.append((*(None if x == "null" else int(x) for x in ids), stated, digest, fields["warc-type"]))
            frame = pd.DataFrame(out, columns=["page_id", "refers_to", "payload_bytes", "payload_digest", "record_type"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]]

    return read_index(spark, target).mapInPandas(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, normalise the archives and read them back."""
    spark = pages.sparkSession
    raw, tidy = new_path(spark, "warc-raw"), new_path(spark, "warc")
    sizes = payload_sizes(pages)
    write_archives(with_types(pages, sizes), raw, records_per_file(sizes))
    some = normalise(spark, raw, tidy).limit(1).count()
    delete(spark, raw)  # read for the last time
    return read_records(spark, tidy) if some else spark.createDataFrame([], READ)
