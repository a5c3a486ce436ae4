"""WARC archives in Zstandard form (.warc.zst): writer and reader.

An archive is a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one frame for
each record, so any record can be decoded alone. The reader loads the dictionary, decodes frame by
frame from bounded chunks, and validates the version line, the mandatory headers, Content-Length
against the block, the digests, and that a frame holds one record and nothing else.

The writer stores a payload once: of the rows whose payloads are equal and at least ``min_bytes``
long, the one with the largest page_id is a ``response`` and the others ``revisit`` it.

Defined cases: a null or empty html is an empty payload; a null url is written as ``urn:null``; a row
with a null page_id keeps null (it revisits like others, and is the response if no id is known);
rows that repeat the largest page_id with the same payload are each a response; an empty table gives
no archive and no record; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.store import new_path, written

DICT_MAGIC = 0x184D2A5D
DICT_BYTES = 16 << 10
#: Pages that train the dictionary, and the longest that counts; it changes the archive's size only.
DICT_PAGES, DICT_PAGE_BYTES = 400, 64 << 10
#: Uncompressed bytes after which a writer starts another archive.
ROLL_BYTES = 64 << 20
CHUNK = 1 << 18
DATE = "2020-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")


class WarcError(ValueError):
    """An archive that breaks the format."""


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that carries the id; the null id has a form of its own."""
    n = 0 if page_id is None else page_id & (1 << 64) - 1
    b = (0x706C756D6C << 88) | (0 if page_id is None else 1) << 80 | 8 << 76 | (n >> 62) << 64 | 2 << 62 | n & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=b)}>"


def page_id_of(urn: str) -> int | None:
    b = uuid.UUID(urn.removeprefix("<urn:uuid:").removesuffix(">")).int
    if not b >> 80 & 1:
        return None
    n = (b >> 64 & 3) << 62 | b & (1 << 62) - 1
    return n - (1 << 64) if n >> 63 else n


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, revisits: int | None, is_revisit: bool, refers_null: bool = False) -> bytes:
    """The bytes of one record. A revisit's block is the HTTP head alone, with the full payload's length in it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if is_revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    target = "".join(c if c not in "\r\n" else f"%{ord(c):02X}" for c in url) if url else "urn:null"
    lines.append(f"WARC-Target-URI: {target}")
    lines.append(f"WARC-Payload-Digest: sha1:{_base32(digest)}")
    lines.append(f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}")
    if is_revisit:
        lines += [f"WARC-Refers-To: {record_id(None if refers_null else revisits)}", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of the one record in raw; WarcError if it isn't valid."""
    if not raw.startswith(b"WARC/1."):
        raise WarcError("no WARC version line")
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("the headers don't end")
    headers: dict[str, str] = {}
    for line in raw[:end].decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {line[:60]!r}")
        headers.setdefault(name.strip().lower(), value.strip())
    for name in MANDATORY:
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    n = int(headers["content-length"])
    if len(raw) != end + 4 + n + 4 or raw[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}; the frame holds {len(raw) - end - 8} bytes of block")
    block = raw[end + 4 : end + 4 + n]
    want = headers.get("warc-block-digest")
    if want and want != f"sha1:{_base32(hashlib.sha1(block).hexdigest())}":
        raise WarcError("the block digest differs")
    return headers, block


def digest_row(headers: dict[str, str], block: bytes) -> dict:
    """What a response or revisit record says of its payload, checked against the payload where it is there."""
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"unexpected record type {kind}")
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("the HTTP head doesn't end")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}
    if not http.get("content-length", "").isdigit():
        raise WarcError("the HTTP head has no length")
    size, said = int(http["content-length"]), headers.get("warc-payload-digest", "")
    if not said.startswith("sha1:"):
        raise WarcError("no payload digest")
    digest = base64.b32decode(said[5:]).hex()
    if kind == "response":
        if len(payload) != size:
            raise WarcError("the payload's length differs from the HTTP head's")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError("the payload digest differs")
    elif payload or headers.get("warc-profile") != REVISIT or "warc-refers-to" not in headers:
        raise WarcError("a revisit without its profile, or with a payload")
    return {
        "page_id": page_id_of(headers["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": page_id_of(headers["warc-refers-to"]) if kind == "revisit" else None, "url": None if headers.get("warc-target-uri") == "urn:null" else headers.get("warc-target-uri"),
    }


def frames(read) -> Iterator[bytes]:
    """The decoded frames of an archive; read(n) gives its next bytes. Memory: one record and one chunk."""
    head = read(8)
    if len(head) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack("<II", head)
    data, dictionary = b"", None
    if magic == DICT_MAGIC:
        raw = b""
        while len(raw) < size and (more := read(size - len(raw))):
            raw += more
        if len(raw) != size:
            raise WarcError("the dictionary is cut off")
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be a frame
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        dictionary = zstandard.ZstdCompressionDict(raw)
    else:
        data = head
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while data or (data := read(CHUNK)):
        frame, parts = decoder.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise WarcError(f"a frame can't be decoded: {e}") from e
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := read(CHUNK)):
                raise WarcError("the last frame is cut off")
        yield b"".join(parts)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or raw content where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def _writer(folder: str, dictionary: bytes):
    """One or more archives for each task, under names no other attempt uses; a row for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        lead = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        out, name, count, size, done = None, "", 0, 0, []
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}")
                    out.write(lead)
                raw = record(row["page_id"], row["url"], row["payload"], row["digest"], row["size"], row["keeper"], row["revisit"], row["keeper"] is None)
                out.write(packer.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
                    done.append((name, count))
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["archive", "records"])

    return run


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string"


def _reader(folder: str):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, records in zip(b.column("archive").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, n = [], 0
                with fs.open_input_stream(f"{root}/{name}") as f:
                    for raw in frames(f.read):
                        rows.append(digest_row(*parse(raw)) | {"archive": name})
                        n += 1
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if n != records:
                    raise WarcError(f"{name} holds {n} records; {records} were written")
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def write_archives(pages: DataFrame, min_bytes: int = 1000) -> tuple[str, DataFrame]:
    """Writes a record for each row of pages (page_id long, url string, html string).

    Returns the archives' folder and the manifest (archive, records) of those that were committed:
    a task that is run again leaves an archive behind that no manifest row names, and no reader opens.
    """
    spark = pages.sparkSession
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.length("payload").cast("long")})
    # Written, so that the join below shuffles both sides and a digest that a third of the rows share is split.
    keepers = written(
        rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper"), "warc-keepers"
    )
    marked = rows.join(keepers.withColumn("repeated", F.lit(True)), "digest", "left").select(
        "page_id", "url", "digest", "size", "keeper", (F.col("repeated").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"), "payload"
    ).withColumn("payload", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")))
    folder = new_path(spark, "warc")
    jvm = spark._jvm.org.apache.hadoop.fs.Path(folder)
    jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm)
    short = pages.select(body.alias("b")).where(F.length("b").between(1, DICT_PAGE_BYTES)).withColumn("h", F.xxhash64("b"))
    least = short.select("h").distinct().orderBy("h").limit(DICT_PAGES).agg(F.max("h")).first()[0]  # hashes first: no page goes to the driver that isn't taken
    sample = [bytes(r["b"]) for r in short.where(F.col("h") <= least).groupBy("h").agg(F.min("b").alias("b")).orderBy("h").collect()] if least is not None else []
    manifest = written(marked.mapInArrow(_writer(folder, train_dictionary(sample)), "archive string, records long"), "warc-manifest")
    return folder, manifest


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives that the manifest names; raises WarcError for one that isn't valid."""
    n = max(1, min(manifest.count(), 10_000))
    return manifest.repartition(n).mapInArrow(_reader(folder), READ_SCHEMA)


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP1_SQL = """WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN n > 1 AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to, url FROM p LEFT JOIN k USING (payload_digest)"""
