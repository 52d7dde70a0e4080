"""WARC archives as seekable Zstandard bundles.

An archive file is a row of independent Zstandard frames, each holding whole WARC records of
about ``FRAME`` bytes, then a seek table in a skippable frame: for each frame its
compressed and raw size, closed by the number of frames, a descriptor and the magic number
of the seekable format. A record's index entry is (file, frame, offset in the frame's raw
bytes), so one record costs one frame of reading. Any Zstandard reader sees a plain WARC.

Of records with equal payloads of at least ``LEAST`` bytes, the one of the smallest id is a
response; the others become revisit records that name it. Digests are computed at the
scan; what meets by digest is only (digest, smallest id), aggregated before the exchange, and
only digests that occur more than once. Pages that a bit filter of these digests clears are written by
the task that reads them; the others travel once, to the task that writes them.

Files are written under a name of their own for each attempt, and the index, itself a table
written once, names those of successful attempts: a lost executor's leftovers are never
read. Each task writes files of at most ``FILE`` bytes and never holds more than a frame.

Defined cases: null payload is empty; payloads under ``LEAST`` bytes are always responses; of
repeated rows (same id and payload) each is written, and those of the response's own id are
all responses (a tie of ids is no revisit); a very long payload is one record in a frame of its own; a
null id counts as the largest; a null url becomes an empty target; an empty
table gives an archive of no file; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh_path, marked, materialize, table, trimming

FRAME = 1 << 18
FILE = 64 << 20
#: Frames that one task reads of a file, or its share of all: 16 MB of records.
RUN = 64
LEAST = 100
LEVEL = 3
_TABLE, _MAGIC = 0x184D2A5E, 0x8F92EAB1


def _store(folder: str):
    """A file system of any kind that pyarrow knows, and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class Bundle:
    """Writes records into frames; ``add`` returns (frame, offset in the frame)."""

    def __init__(self, sink, level: int = LEVEL):
        import zstandard

        self.sink, self.zstd = sink, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.held and self.held + len(record) > FRAME:
            self._flush()
        place = (len(self.frames), self.held)
        self.parts.append(record)
        self.held += len(record)
        return place

    def _flush(self) -> None:
        raw = b"".join(self.parts)
        out = self.zstd.compress(raw)
        self.sink.write(out)
        self.frames.append((len(out), len(raw)))
        self.written += len(out)
        self.parts, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _MAGIC)
        self.sink.write(struct.pack("<II", _TABLE, len(body)) + body)
        self.sink.close()


class Reader:
    """Random access to the frames of one bundle."""

    def __init__(self, source):
        import zstandard

        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _MAGIC:
            raise ValueError("no seek table at the end of the file")
        width = 12 if flags & 0x80 else 8
        source.seek(size - 9 - n * width)
        body = source.read(n * width)
        self.frames, at = [], 0
        for i in range(n):
            packed, raw = struct.unpack_from("<II", body, i * width)
            self.frames.append((at, packed, raw))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, raw = self.frames[k]
        self.source.seek(at)
        return self.zstd.decompress(self.source.read(packed), max_output_size=raw)


def record(kind: str, record_id: str, target: str, payload: bytes, digest: str, size: int, refers: str | None) -> bytes:
    """One WARC 1.1 record. A revisit has no block; the payload's size stands in its header."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head.append("WARC-Target-URI: " + " ".join(target.split()))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers is not None:
        head += [f"WARC-Refers-To: <{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Payload-Length: {size}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of a frame."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        yield at, head, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def urn(page_id) -> str:
    return f"urn:page:{page_id}"


def write(pages: DataFrame, folder: str | None = None, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """Archive ``pages`` and return the index: (id, record_id, record_type, file, frame, offset,
    length). ``folder`` is a URI that all executors can write, by default in the shared folder."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    none = F.lit(2**63 - 1)
    base = pages.select(
        F.coalesce(F.col(id_col).cast("long"), none).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    large = base.where(F.col("size") >= LEAST).select("id", "digest")
    again = large.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("digest", "first")
    # Rows whose digest a bit filter clears are responses and are written where they are read. The
    # others learn of which page they are a revisit: an equi-join whose large side adaptive execution splits.
    revisits = large.join(again, "digest").where("id <> first").select("id", "digest", F.col("first").alias("refers")).distinct()
    seen = marked(base, again, F.col("digest"), "maybe", "digest")
    asked = seen.where("maybe").join(revisits, ["id", "digest"], "left")
    rows = seen.where("NOT maybe").select("id", "url", "payload", "size", "digest", F.lit(None).cast("long").alias("refers")).unionByName(
        asked.select("id", "url", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers")
    )

    def run(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        bundle = name = None
        for pdf in batches:
            out = []
            for page, url, payload, size, digest, refers in pdf.itertuples(index=False, name=None):
                if bundle is None or bundle.written >= FILE:
                    if bundle is not None:
                        bundle.close()
                    name = f"part-{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(store.open_output_stream(f"{root}/{name}", compression=None))
                revisit = payload is None
                kind = "revisit" if revisit else "response"
                data = record(kind, urn(page), url, b"" if revisit else bytes(payload), digest, int(size), urn(int(refers)) if revisit else None)
                frame, offset = bundle.add(data)
                out.append((page, urn(page), kind, name, frame, offset, len(data)))
            yield pd.DataFrame(out, columns=["id", "record_id", "record_type", "file", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    index = materialize(rows.mapInPandas(trimming(run), "id long, record_id string, record_type string, file string, frame int, offset int, length int"), "warc-index")
    return index.select(F.nullif("id", none).alias(id_col), "record_id", "record_type", F.concat(F.lit(folder + "/"), "file").alias("file"), "frame", "offset", "length")


def read(index: DataFrame, id_col="page_id") -> DataFrame:
    """The records that an index names, read back from the archives: (id, target, payload, size,
    digest, record_type, refers_to). A revisit's payload is null; size and digest are those
    of the full payload. Frames are read once each and in order; a task gets runs of ``RUN`` frames of a
    file, and there are as many tasks as the records' bytes ask for, whatever the size of the index."""
    total = index.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0
    tasks = max(1, -(-total // (RUN * FRAME)))
    wanted = index.select("file", "frame", "offset", "record_id").repartition(tasks, F.col("file"), F.floor(F.col("frame") / RUN)).sortWithinPartitions("file", "frame", "offset")
    schema = f"{id_col} long, target string, payload binary, size long, digest string, record_type string, refers_to long"

    def number(ref: str | None):
        value = None if ref is None else int(ref.strip("<>").rsplit(":", 1)[1])
        return None if value == 2**63 - 1 else value

    def run(batches):
        at, reader, held = (None, None), None, {}
        source = None
        for pdf in batches:
            out = []
            for file, frame, offset, record_id in pdf.itertuples(index=False, name=None):
                if (file, frame) != at:
                    if file != at[0]:
                        if source is not None:
                            source.close()
                        store, path = _store(file)
                        source = store.open_input_file(path)
                        reader = Reader(source)
                    at = (file, frame)
                    held = {o: (h, b) for o, h, b in parse(reader.frame(frame))}
                head, block = held[offset]
                if head["WARC-Record-ID"] != f"<{record_id}>":
                    raise ValueError(f"{file} has another record at frame {frame}, offset {offset}")
                response = head["WARC-Type"] == "response"
                digest = head["WARC-Payload-Digest"].split(":", 1)[1]
                if response and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"the payload of {record_id} doesn't match its digest")
                size = len(block) if response else int(head["WARC-Payload-Length"])
                out.append((number(record_id), head["WARC-Target-URI"], block if response else None, size, digest, head["WARC-Type"], number(head.get("WARC-Refers-To"))))
            frame_out = pd.DataFrame(out, columns=["id", "target", "payload", "size", "digest", "record_type", "refers_to"])
            frame_out["id"], frame_out["refers_to"] = frame_out["id"].astype("Int64"), frame_out["refers_to"].astype("Int64")
            yield frame_out.rename(columns={"id": id_col})
        if source is not None:
            source.close()

    return wanted.mapInPandas(trimming(run), schema)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    back = read(write(table(spark, sf_dir, "pages")))
    return back.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN (SELECT payload_digest AS d, first FROM f) ON d = payload_digest AND payload_bytes >= 100
"""
