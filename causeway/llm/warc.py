"""WARC archives, a Zstandard frame a record, the dictionary in a skippable frame at the head.

Records of equal payloads are written once as a response; the others revisit it. Archives are streamed: neither
the writer nor the reader holds more than a record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import Scratch, shared_path, small_batches

#: Payloads of fewer bytes are written whole each time.
LEAST = 100
#: The dictionary is made from the payloads of so many pages at most, those whose hashed ids come first; of each so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 65_536
#: An archive is closed when it has grown to this.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
SKIPPABLE = b"\x5d\x2a\x4d\x18"
ZSTD = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MAX_HEADER = 1 << 20


class Broken(ValueError):
    """An archive that doesn't hold what its headers say."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """A response, or a revisit of the response of page refers_to."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:uuid:{uuid.uuid5(_SPACE, str(i))}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; none (empty) if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


class Writer:
    def __init__(self, out: BinaryIO, trained: bytes):
        self.out, self.size = out, 0
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=1, write_checksum=1)
        self.zstd = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, compression_params=params)
        if trained:
            packed = zstandard.ZstdCompressor(level=19).compress(trained)
            self._put(SKIPPABLE + len(packed).to_bytes(4, "little") + packed)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.zstd.compress(data))


def frames(source: BinaryIO, step: int = 1 << 20) -> Iterator[bytes]:
    """The decoded records of an archive, one frame each."""
    trained, data = None, source.read(8)
    if data[:4] == SKIPPABLE:
        packed = source.read(int.from_bytes(data[4:8], "little"))
        if packed[:4] == ZSTD:
            packed = zstandard.ZstdDecompressor().decompress(packed)
        trained, data = zstandard.ZstdCompressionDict(packed), b""
    zstd = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while True:
        data = data or source.read(step)
        if not data:
            return
        frame, out = zstd.decompressobj(), []
        while True:
            try:
                out.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise Broken(f"a frame can't be decoded: {e}") from e
            data = frame.unused_data
            if frame.eof:
                break
            data = source.read(step)
            if not data:
                raise Broken("the archive ends inside a frame")
        yield b"".join(out)


def _headers(data: bytes, what: str) -> tuple[str, dict[str, str], bytes]:
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found or len(head) > _MAX_HEADER:
        raise Broken(f"{what} headers don't end")
    first, *lines = head.decode("utf-8").split("\r\n")
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken(f"{what} header without a colon: {line[:80]}")
        out[name.strip().lower()] = value.strip()
    return first, out, rest


def parse(data: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of a record; Broken if anything is amiss."""
    first, head, rest = _headers(data, "record")
    if first not in ("WARC/1.0", "WARC/1.1"):
        raise Broken(f"not a WARC record: {first[:40]}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise Broken(f"no {name}")
    size = int(head["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Broken(f"the block has {len(rest) - 4} bytes, its header says {size}")
    status, http, payload = _headers(rest[:size], "HTTP")
    if not status.startswith("HTTP/"):
        raise Broken("no HTTP status line")
    full, digest, kind = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
    if kind == "response":
        if len(payload) != full or hashlib.sha256(payload).hexdigest() != digest:
            raise Broken("the payload isn't the one its headers name")
    elif kind != "revisit" or payload or head.get("warc-profile") != PROFILE:
        raise Broken(f"a record of type {kind} that isn't a plain revisit")
    number = lambda k: int(head[k]) if k in head else None
    return {"page_id": number("warc-page-id"), "payload_bytes": full, "payload_digest": digest, "record_type": kind, "refers_to": number("warc-refers-to-page-id"), "url": head.get("warc-target-uri"), "payload": payload}


def _store(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri.removeprefix("file:"))


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """id, digest -> refers_to for what isn't a response: rows of equal payloads whose id isn't the smallest one."""
    rows = pages.select("id", "digest").where((F.col("size") >= least) & F.col("id").isNotNull())
    firsts = rows.groupBy("digest").agg(F.min("id").alias("first"))
    return rows.join(firsts, "digest").where("id <> first").select("id", "digest", F.col("first").alias("refers_to")).distinct()


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record a row to archives under root; returns (path, records).

    A null html is an empty payload. Of rows with equal payloads of at least `least` bytes, that with the
    smallest id is the response; rows that repeat its id are responses too, as rows without an id always are.
    A task that runs again writes under new names, and only what it returns counts.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    # ids first: no task sends more than SAMPLE_ROWS of them, and their pages are cut before they are sent
    ids = pages.where(F.col(html_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    cut = pages.where(F.col(html_col).isNotNull()).select(F.col(id_col).alias("id"), F.substring(html_col, 1, SAMPLE_BYTES).alias("s"))
    some = cut.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min("s").alias("s")).orderBy(F.xxhash64("id"), "id")
    samples = [r.s.encode()[:SAMPLE_BYTES] for r in some.collect()]  # SAMPLE_ROWS rows at most
    trained = dictionary(samples)
    scratch = Scratch(spark, "warc")
    revisits = scratch.write(plan(rows, least))
    full = rows.join(revisits, ["id", "digest"], "left").select(F.col("id").cast("string").alias("id"), "url", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit("")).alias("html"), "digest", "size", F.col("refers_to").cast("string").alias("refers_to"))

    def save(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        store.create_dir(base, recursive=True)
        scheme = root[: root.index("://") + 3] if "://" in root else ""
        writer, out, path, count = None, None, "", 0

        def close():
            out.close()
            return pd.DataFrame({"path": [scheme + path], "records": [count]})

        for part in parts:
            for page, url, html, digest, size, first in zip(part["id"], part["url"], part["html"], part["digest"], part["size"], part["refers_to"], strict=True):
                if writer is None:
                    path, count = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(path)
                    writer = Writer(out, trained)
                first = None if first is None else int(first)
                payload = html.encode() if first is None else bytes(size)
                writer.add(record(None if page is None else int(page), url, payload, digest, first))
                count += 1
                if writer.size >= archive_bytes:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return scratch.write(full.mapInPandas(save, "path string, records long"))


def read(spark: SparkSession, archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of archives (path, records), validated: page_id, payload_bytes, payload_digest, record_type, refers_to, url, and payload if asked for."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payloads
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string" + ", payload binary" * payloads

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(rows: list[dict]) -> pd.DataFrame:
            # ids travel as text: pandas would make doubles of longs with nulls among them
            told = lambda i: None if i is None else str(i)
            return pd.DataFrame([r | {"page_id": told(r["page_id"]), "refers_to": told(r["refers_to"])} for r in rows], columns=names)

        for part in parts:
            for path, records in zip(part["path"], part["records"], strict=True):
                store, name = _store(path)
                rows, n, held = [], 0, 0
                with store.open_input_stream(name) as source:
                    for frame in frames(source):
                        rows.append(parse(frame))
                        n, held = n + 1, held + len(frame) * payloads
                        if len(rows) >= 1000 or held >= 8 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if n != records:
                    raise Broken(f"{path} holds {n} records, not {records}")
                if rows:
                    yield table(rows)

    files = archives.repartition(max(1, min(archives.count(), 10_000)), "path")
    return files.mapInPandas(load, schema).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def digest(pages: DataFrame, **kw) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each input row, from archives written and read back; see write()."""
    spark = pages.sparkSession
    return read(spark, write(pages, shared_path(spark, "warc-files"), **kw)).drop("url")
