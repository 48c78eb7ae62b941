"""WARC archives written and read by Spark tasks, with payloads as rows of chunks.

Writing: a row becomes its chunk rows (chunk number, bytes) in its own partition, and each
task streams these into gzip members of files in a shared folder, hashing as it goes. It
returns a manifest row a file; only files of the manifest count, so a task that is run
again leaves nothing twice. Reading: a file is a stream, a payload comes as rows
(record, chunk number, bytes) with the length and the SHA-256 so far, so no payload is
held whole in Python and the last chunk's row has those of the whole payload. A record's
id is its own, so (record_id, chunk) is a key of the chunk rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matlink.llm.common import cut, prepare, shared_dir, with_likely

_END = b"\r\n\r\n"
_SLICE = 1 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """id, url, payload (bytes), payload_bytes, payload_digest, record_type, refers_to and refers_to_url.

    Of payloads of at least least_bytes that are equal, that of the smallest id is the
    response and the others revisit it; rows of that same id are responses, too. Rows with
    a null id revisit the response, or are responses where no equal payload has an id.
    Only rows whose digest may occur twice are joined, told by a bitmap of fixed size.
    """
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    key = F.when(F.col("payload_bytes") >= least_bytes, F.xxhash64("payload_digest"))
    first = rows.where(key.isNotNull()).groupBy("payload_digest").agg(F.count("*").alias("copies"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("first"))
    first = cut(first.where("copies > 1 and first is not null").select(F.col("payload_digest").alias("digest"), F.xxhash64("payload_digest").alias("mark"), F.col("first.id").alias("first"), F.col("first.url").alias("first_url")))
    rows = with_likely(rows, "__hit", key, first, "mark")
    alone = rows.where("not __hit").withColumns({"first": F.lit(None).cast("long"), "first_url": F.lit(None).cast("string")})
    joined = rows.where("__hit").join(first.drop("mark"), F.col("payload_digest") == F.col("digest"), "left").drop("digest")
    rows = alone.unionByName(joined)
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first")), "refers_to_url": F.when(again, F.col("first_url"))}).drop("__hit", "first", "first_url")


def chunks(records: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Rows of decide() as chunk rows in place: chunk, data and last instead of payload. A revisit has one, without data."""
    last = F.when(F.col("record_type") == "response", F.greatest(F.ceil(F.col("payload_bytes") / chunk_bytes) - 1, F.lit(0))).otherwise(0).cast("int")
    rows = records.withColumn("__last", last).withColumn("chunk", F.explode(F.sequence(F.lit(0), "__last")))
    data = F.when(F.col("record_type") == "response", F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return rows.withColumn("data", data).withColumn("last", F.col("chunk") == F.col("__last")).drop("payload", "__last")


def open_store(uri: str):
    """The file system of a URI or a local path, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", roll_bytes: int = 1 << 30, chunk_bytes: int = 1 << 20, store: Callable = open_store) -> DataFrame:
    """Writes rows of decide() into folder, chunk by chunk; the manifest: path, records and bytes of each file.

    A record's id is made from the file's name and the record's place in it. Revisits name
    the page and the URL of their response. folder and the manifest's paths are whole URIs (or
    local paths); store opens them in the tasks.
    """
    folder = folder.rstrip("/")

    def run(frames):
        files, base = store(folder)
        files.create_dir(base, recursive=True)
        out, path, count, done, gz, digest = None, "", 0, [], None, None
        line = lambda x: x.replace("\r", "%0D").replace("\n", "%0A")

        def close():
            nonlocal out
            if out is not None:
                size = out.tell()
                out.close()
                done.append((path, count, size))
                out = None

        columns = ("id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_url", "chunk", "data", "last")
        for frame in frames:
            frame = frame.astype({"id": "Int64", "refers_to": "Int64"})
            for key, url, size, sha, kind, refers, refers_url, chunk, data, last in zip(*(frame[c].tolist() for c in columns), strict=True):
                if chunk == 0:
                    if out is None:
                        path, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base.rstrip('/')}/{path.rpartition('/')[2]}", compression=None)
                    http = _HTTP.format(size).encode()
                    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{path}#{count}')}>", f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{sha}"]
                    if url is not None:
                        head.append(f"WARC-Target-URI: {line(url)}")
                    if not pd.isna(key):
                        head.append(f"X-Page-ID: {key}")
                    if kind == "revisit":
                        head += [f"X-Refers-To-Page: {refers}", f"WARC-Profile: {_PROFILE}"]
                        if refers_url is not None:
                            head += [f"WARC-Refers-To-Target-URI: {line(refers_url)}", f"WARC-Refers-To-Date: {date}"]
                    head.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
                    gz, digest = zlib.compressobj(1, wbits=31), hashlib.sha256()
                    out.write(gz.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + _END + http))
                if data is not None:
                    digest.update(data)
                    out.write(gz.compress(data))
                if last:
                    if kind == "response" and digest.hexdigest() != sha:
                        raise ValueError("the chunks of a payload are not the payload")
                    out.write(gz.compress(_END) + gz.flush())
                    count += 1
                    if out.tell() >= roll_bytes:
                        close()
        close()
        if done:
            yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return cut(chunks(records, chunk_bytes).mapInPandas(run, "path string, records long, bytes long"))


class _Stream:
    """The decompressed bytes of a file of gzip members, a slice at a time."""

    def __init__(self, raw):
        self.raw, self.held, self.gz, self.left = raw, b"", zlib.decompressobj(wbits=31), b""

    def more(self) -> bool:
        while True:
            data = self.left or self.raw.read(1 << 16)
            if not data:
                return False
            if self.gz.eof:
                self.gz = zlib.decompressobj(wbits=31)
            out = self.gz.decompress(data, _SLICE)
            self.left = self.gz.unconsumed_tail or self.gz.unused_data
            if out:
                self.held += out
                return True

    def head(self) -> bytes | None:
        while (at := self.held.find(_END)) < 0:
            if not self.more():
                if self.held:
                    raise ValueError("the archive ends inside a record")
                return None
        out, self.held = self.held[:at], self.held[at + 4 :]
        return out

    def take(self, most: int) -> bytes:
        if not self.held and not self.more():
            raise ValueError("the archive ends inside a record")
        out, self.held = self.held[:most], self.held[most:]
        return out


def read(files: DataFrame, chunk_bytes: int = 1 << 20, with_bytes: bool = True, store: Callable = open_store) -> DataFrame:
    """Chunk rows of the archives of a manifest (column path).

    record_id, page_id, url, record_type, refers_to, header_digest, chunk, data (if with_bytes),
    bytes_so_far, digest_so_far, last. A record without payload has one row, with no data.
    Revisits have the length and digest that their headers give for the full payload.
    """
    kind = "record_id string, page_id long, url string, record_type string, refers_to long, header_digest string, chunk int, data binary, bytes_so_far long, digest_so_far string, last boolean"

    def fields(block: bytes) -> dict:
        lines = block.decode("utf-8", "surrogatepass").split("\r\n")
        return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def run(frames):
        columns = [c.split()[0] for c in kind.split(", ")]
        rows, size = [], 0

        def frame():
            out = pd.DataFrame(rows, columns=columns)
            for c in ("page_id", "refers_to"):
                out[c] = out[c].astype("Int64")
            return out

        for files in frames:
            for path in files["path"].tolist():
                held, at = store(path)
                with held.open_input_stream(at, compression=None) as raw:
                    stream = _Stream(raw)
                    while (block := stream.head()) is not None:
                        h = fields(block)
                        http = stream.head()
                        left = int(h["content-length"]) - len(http) - 4
                        meta = (h["warc-record-id"], *(int(h[c]) if c in h else None for c in ("x-page-id",)), h.get("warc-target-uri"), h["warc-type"], int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None, h["warc-payload-digest"].removeprefix("sha256:"))
                        if h["warc-type"] == "revisit":
                            rows.append((*meta, 0, None, int(fields(http)["content-length"]), meta[-1], True))
                        else:
                            digest, done, n = hashlib.sha256(), 0, 0
                            while True:
                                data = []
                                room = min(chunk_bytes, left)
                                while room:
                                    data.append(part := stream.take(room))
                                    digest.update(part)
                                    room, left, done = room - len(part), left - len(part), done + len(part)
                                rows.append((*meta, n, b"".join(data) if with_bytes else None, done, digest.hexdigest(), not left))
                                size += chunk_bytes if with_bytes and left else 1000
                                n += 1
                                if size > 16 << 20:
                                    yield frame()
                                    rows, size = [], 0
                                if not left:
                                    break
                        if stream.head() != b"":
                            raise ValueError(f"no record end in {path}")
        if rows:
            yield frame()

    return files.select("path").mapInPandas(run, kind)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    back = read(write(decide(pages), folder)).where("last")
    intact = F.when(F.col("digest_so_far") == F.col("header_digest"), F.col("digest_so_far")).otherwise(F.raise_error(F.lit("a payload was damaged")))
    return back.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), intact.alias("payload_digest"), "record_type", "refers_to")
