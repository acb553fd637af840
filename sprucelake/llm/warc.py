"""WARC archives of web pages, each record compressed alone with a dictionary built from records.

Method. A Zstandard dictionary is trained on a bounded sample of records. Every archive starts
with a skippable frame that holds the dictionary; each record that follows is a frame of its own,
so a reader takes the dictionary from the head and any record by its offset. A payload of
REVISIT_BYTES or more that several pages have is stored once, with the page of largest id; the
other pages get revisit records that refer to it. Who refers to whom is decided on SHA-256 digests,
with counts combined before the shuffle (a record's own digest is SHA-1, as its header says, and
equal ones alone make no revisit); payloads move once, to the task that writes them.

Archives are written below a folder in the shared place by tasks: an archive has at most
ARCHIVE_BYTES (unless one record is larger) and gets its name only when it is whole, and a task
that is run again writes the same bytes: what stands there whole stays. Tasks are as many
as the payloads' bytes ask for; rows that repeat a page and payload very often are dealt to several. Reading goes over the archives with Spark's binary file source, record
by record; it checks each payload against its digest, and each revisit's length and digest against
those of the response that it refers to.

Defined results: null html is an empty payload; a null url is written as `about:blank`; repeated
rows get a record each, of which one with a large payload is the response and the others revisit
it (their own page id, then); a row with a null id is below all others; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sprucelake.llm.common import discard, few_rows_a_batch, join_groups, shared_folder, small, small_batches, written

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 16_000_000
#: Payload bytes that a task writes, on average.
TASK_BYTES = 128_000_000
#: The dictionary's training: so many records, so many bytes of each, and its own size at most.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 16_384, 112_640
LEVEL = 3
#: Compressed bytes that the reader looks at at a time.
WINDOW = 16_384
#: Rows of one page and payload that a task writes, on average.
COPIES = 10_000
#: Fixed value: magic number of the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{copy}')}>"


def record(page_id: int | None, copy: int, url: str | None, payload: bytes, digest: str, refers_to: tuple[int | None, int] | None) -> bytes:
    """A WARC/1.1 record; with refers_to (page id, copy), a revisit without payload."""
    kind = "revisit" if refers_to else "response"
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id(page_id, copy), "WARC-Date": DATE, "WARC-Target-URI": (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")}
    head |= {"X-Page-ID": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload)), "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to:
        head |= {"WARC-Refers-To": record_id(*refers_to), "X-Refers-To-Page": "" if refers_to[0] is None else str(refers_to[0]), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    body = http if refers_to else http + payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an archive."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive starts with a dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(archive[8 : 8 + size]) if size else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    place, rest = 8 + size, memoryview(archive)
    while place < len(rest):
        one, parts = reader.decompressobj(), []
        while not one.eof:  # a window at a time, as what is left of the input is copied
            window = rest[place : place + WINDOW]
            if not window:
                raise ValueError("an archive ends inside a record")
            parts.append(one.decompress(window))
            place += len(window) - len(one.unused_data)
        raw = b"".join(parts)
        head, _, body = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = body[: int(headers["Content-Length"])]
        yield headers, block.partition(b"\r\n\r\n")[2]


def train(pages: DataFrame) -> bytes:
    """A dictionary from the records whose ids have the least hashes; empty where there are too few to train on."""
    chosen = F.broadcast(pages.select("page_id", F.xxhash64("page_id").alias("h")).distinct().orderBy("h", "page_id").limit(SAMPLE_RECORDS).select("page_id"))
    rows = pages.join(chosen, "page_id").groupBy("page_id").agg(F.min(F.substring("html", 1, SAMPLE_BYTES)).alias("html")).orderBy("page_id").collect()
    samples = [record(r["page_id"], 0, "", (r["html"] or "").encode("utf-8", "surrogatepass"), "", None) for r in rows]
    if len(samples) < 8 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES // 10:
        return b""
    return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 10), samples).as_bytes()


class _Writer:
    """Archives of one task: part-<task>-<number>.warc.zst, each given its name when it is whole."""

    def __init__(self, folder: str, task: int, dictionary: bytes) -> None:
        self.files, self.root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"/{folder}")
        self.task, self.number, self.head = task, 0, dictionary_frame(dictionary)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        self.open = io.BytesIO()

    def add(self, raw: bytes) -> tuple[str, int, int]:
        """(archive, offset, length) of a record."""
        frame = self.compress(raw)
        if self.open.tell() and self.open.tell() + len(frame) > ARCHIVE_BYTES:
            self.close()
        if not self.open.tell():
            self.open.write(self.head)
        at = self.open.tell()
        self.open.write(frame)
        return self.name(), at, len(frame)

    def name(self) -> str:
        return f"part-{self.task:06d}-{self.number:05d}.warc.zst"

    def close(self) -> None:
        if self.open.tell():
            self.files.create_dir(self.root, recursive=True)
            part = f"{self.root}/.{uuid.uuid4().hex}"
            with self.files.open_output_stream(part) as out:
                out.write(self.open.getbuffer())
            self._put(part, f"{self.root}/{self.name()}")
            self.number += 1
            self.open = io.BytesIO()

    def _put(self, part: str, name: str) -> None:
        """Give a whole file its name. Another attempt may have given it to the same bytes, which then stay where they are."""
        if self.files.get_file_info(name).type == pyarrow.fs.FileType.File and self._same(part, name):
            self.files.delete_file(part)
            return
        try:
            self.files.move(part, name)
        except OSError:  # some stores refuse to move over a file that came meanwhile
            if self.files.get_file_info(name).type != pyarrow.fs.FileType.File:
                raise
            if not self._same(part, name):
                self.files.delete_file(name)
                self.files.move(part, name)
            else:
                self.files.delete_file(part)

    def _same(self, *names: str) -> bool:
        """Whether two files have the same length and digest."""
        if len({self.files.get_file_info(n).size for n in names}) > 1:
            return False
        digests = set()
        for n in names:
            with self.files.open_input_stream(n) as f:
                digests.add(hashlib.sha256(f.read()).digest())
        return len(digests) == 1


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as archives into folder; returns the index (page_id, archive, offset, length), written already."""
    spark = pages.sparkSession
    few_rows_a_batch(spark)
    html = F.coalesce(F.col(html_col), F.lit(""))
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    dictionary = spark.sparkContext.broadcast(train(pages))
    named = pages.select("page_id", F.unhex(F.sha2("html", 256)).alias("digest"), F.octet_length("html").alias("bytes"))
    # One row for each page and payload, then the largest page of each payload that several have.
    once = written(named.groupBy("page_id", "digest", "bytes").agg(F.count("*").alias("n")), "payloads")
    first = written(once.where(f"bytes >= {REVISIT_BYTES}").groupBy("digest").agg(F.max("page_id").alias("first"), F.sum("n").alias("all")).where("all > 1"), "first")
    plan = written(join_groups(once, first, ["digest"], "all", once.count()).select(F.col("page_id").alias("id"), F.col("digest").alias("own"), F.struct("first").alias("plan")), "revisits")
    # Of a page's rows with one payload the first is numbered 0. One task gets them all, or, if they are many, each of several a lot.
    placed = pages.withColumn("digest", F.unhex(F.sha2("html", 256))).join(small(plan), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("own")), "left")
    size = once.agg(F.sum(F.col("bytes").cast("long") * F.col("n"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))
    many = once.where(F.col("n") > COPIES)
    many = written(many, "many") if many.limit(1).count() else None
    discard(once, first)
    if many is None:
        placed = placed.withColumn("lot", F.lit(0))
    else:
        lots = many.select(F.col("page_id").alias("many_id"), F.col("digest").alias("many_own"), F.ceil(F.col("n") / COPIES).cast("int").alias("lots"))
        placed = placed.join(small(lots), F.col("page_id").eqNullSafe(F.col("many_id")) & (F.col("digest") == F.col("many_own")), "left")
        placed = placed.withColumn("lot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("lots", F.lit(1))).cast("int"))
    dealt = placed.select("page_id", "url", "digest", "plan", "lot", "html").repartition(tasks, F.coalesce("page_id", F.lit(-1)), "digest", "lot").sortWithinPartitions("page_id", "digest", "lot", "url")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = _Writer(folder, TaskContext.get().partitionId(), dictionary.value)
        before, copy = None, 0
        for batch in small_batches(batches, "html"):
            rows = []
            for r in batch.to_pylist():
                key = (r["page_id"], r["digest"], r["lot"])
                before, copy = key, copy + 1 if key == before else r["lot"] << 32
                payload = r["html"].encode("utf-8", "surrogatepass")
                refers = None
                if r["plan"] is not None and (r["plan"]["first"] != r["page_id"] or copy):
                    refers = (r["plan"]["first"], 0)
                rows.append((r["page_id"], *writer.add(record(r["page_id"], copy, r["url"], payload, hashlib.sha1(payload).hexdigest(), refers))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["page_id", "archive", "offset", "length"])
        writer.close()

    return written(dealt.mapInArrow(work, "page_id long, archive string, offset long, length long"), "warc-index")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives in folder; a revisit's length and digest are those of the response that it refers to."""

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive in frame["content"]:
                rows = []
                for head, payload in read_records(archive):
                    kind, stated = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != stated:
                        raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
                    number = lambda key, head=head: int(head[key]) if head.get(key) else None
                    rows.append((number("X-Page-ID"), head["WARC-Target-URI"], len(payload) if kind == "response" else int(head["X-Payload-Length"]), stated, kind, number("X-Refers-To-Page"), head["WARC-Record-ID"], head.get("WARC-Refers-To")))
                yield pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record", "response"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    records = written(files.mapInPandas(work, RESULT + ", record string, response string"), "records")
    revisits = records.where("response is not null")
    # Responses that are referred to, with what revisits say of their payload: one row for each, whatever the number of revisits.
    said = revisits.groupBy("response").agg(F.min("payload_bytes").alias("least"), F.max("payload_bytes").alias("most"), F.min("payload_digest").alias("first"), F.max("payload_digest").alias("last"))
    answer = records.where("record_type = 'response'").select(F.col("record").alias("response"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    wrong = said.join(answer, "response", "left").where("digest is null or least <> bytes or most <> bytes or first <> digest or last <> digest").limit(1).collect()
    if wrong:
        raise ValueError(f"revisits that don't fit {wrong[0]['response']}")
    return records.drop("record", "response")


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages as archives, read the archives back: (page_id, url, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    if not write_archives(pages, folder).limit(1).count():
        return spark.createDataFrame([], RESULT)
    return read_archives(spark, folder)


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
b AS (SELECT page_id, n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to
FROM b"""
