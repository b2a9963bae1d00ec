"""WARC archives: a deduplicating writer and a splittable reader.

Every record is a gzip member of its own. The reader deals out byte ranges of files. A task looks for the gzip magic
from the start of its range on, takes a place for a member's start only if it decodes to a record header and on to the
member's end, and owns the records that start inside its range, reading beyond its end where the last one needs it.

Payloads are equal if their SHA-1 digests are. Of equal payloads of at least ``least_bytes`` the one with the smallest
page_id is written whole, the others as revisits that name it.

Defined results: a null html is an empty payload; a null url is left out of the header; a null page_id is written as
such and is the smallest; rows that share the smallest page_id are all responses, as no row tells them apart; an empty
table gives no files; columns besides page_id, url and html are not written.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkplane.llm.common import shared_dir, stored

MAGIC, START = b"\x1f\x8b\x08", b"WARC/1."
#: Bytes of payload of a file at about most, and of a split.
FILE_BYTES, SPLIT_BYTES = 64 << 20, 4 << 20
#: Tasks that splits are dealt to at most; below that, there is one for each split.
MOST_TASKS = 100_000
#: Bytes read at a time.
STEP = 1 << 20
#: The date of every record; a crawl would give its own.
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A gzip member. refers_to: the response's page_id as text if this is a revisit."""
    block = HTTP if refers_to is not None else HTTP + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else " ".join(url.split()), "WARC-Payload-Digest": f"sha1:{digest(payload)}", "X-Payload-Length": str(len(payload)),
        "WARC-Refers-To": None if refers_to is None else f"<urn:page:{refers_to}>", "WARC-Profile": None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode("utf-8", "replace") + block + b"\r\n\r\n") + squeeze.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of a decoded member; ValueError if it is no record."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}
    if not sep or not lines[0].startswith("WARC/1.") or not fields.get("content-length", "").isdigit():
        raise ValueError("no record header")
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length is wrong")
    return fields, rest[:size]


class Source:
    """Bytes of a file that are read as they are asked for and dropped once they are behind."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data, self.over = file, start, b"", False
        file.seek(start)

    def upto(self, end: int) -> None:
        """Hold the bytes up to ``end`` of the file, or to its end."""
        while not self.over and self.start + len(self.data) < end:
            more = self.file.read(max(STEP, end - self.start - len(self.data)))
            self.data, self.over = self.data + more, not more

    def drop(self, start: int) -> None:
        self.data, self.start = self.data[start - self.start :], start


def member_at(source: Source, at: int) -> tuple[bytes, int] | None:
    """The member that starts at ``at``, decoded, and where it ends; None if there is none."""
    squeeze, out, end = zlib.decompressobj(31), b"", at
    parts = []
    try:
        while not squeeze.eof:
            source.upto(end + 1)
            piece = source.data[end - source.start : end - source.start + STEP]
            if not piece:
                return None
            parts.append(squeeze.decompress(piece))
            if not out and (out := parts[0][: len(START)]) != START[: len(out)]:
                return None  # most false starts end here
            end += len(piece) - len(squeeze.unused_data)
    except zlib.error:
        return None
    return b"".join(parts), end


def records(file, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records that start in [start, stop) of a file."""
    source, at = Source(file, start), start
    while at < stop:
        source.upto(min(at + STEP, stop + len(MAGIC) - 1))
        found = source.data.find(MAGIC, at - source.start)
        if found < 0:
            at = max(at, source.start + len(source.data) - len(MAGIC) + 1)
            if source.over or at >= stop:
                return
            source.drop(at)
            continue
        at = source.start + found
        if at >= stop:
            return
        source.drop(at)
        try:
            member = member_at(source, at)
            if member is not None:
                yield parse(member[0])
        except ValueError:
            member = None
        at = at + 1 if member is None else member[1]
        source.drop(min(at, source.start + len(source.data)))


def classified(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with refers, the page_id as text of the response that the row repeats, else null."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_sha", F.sha1(F.col("html").cast("binary")))
    order = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("id"))
    # One row a digest leaves each task; a digest of a third of all rows is a skewed side of the join, which is split.
    first = rows.groupBy("_sha").agg(F.min(order).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = stored(first.select("_sha", F.col("m.id").alias("_first")), "repeated")
    rows = rows.join(first, "_sha", "left")
    large = F.octet_length("html") >= least_bytes
    again = F.col("_first").isNotNull() & large & (F.coalesce(F.col("page_id"), F.lit(-(1 << 63))) != F.col("_first"))
    name = F.when(F.col("_first") == -(1 << 63), F.lit("")).otherwise(F.col("_first").cast("string"))
    return rows.select("page_id", "url", "html", F.when(again, name).alias("refers"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write archives below ``path``, which all executors reach; (file, n_bytes) of each.

    A file is written under a name of its own and renamed, so a task that runs again replaces what it wrote before.
    """

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from pyarrow import fs

        task = TaskContext.get()
        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        out, size, n = None, 0, 0

        def close():
            out.close()
            name = f"{top}/part-{task.partitionId():06d}-{n:05d}.warc.gz"
            store.move(draft, name)
            return pd.DataFrame({"file": [name], "n_bytes": [size]})

        for batch in batches:
            for page_id, url, html, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["refers"], strict=True):
                if out is None:
                    draft = f"{top}/_draft-{task.taskAttemptId()}-{os.getpid()}-{n}"
                    out, size = store.open_output_stream(draft), 0
                size += out.write(data := record(None if page_id == "" else int(page_id), url, html.encode("utf-8", "replace"), refers)) or len(data)
                if size >= FILE_BYTES:
                    yield close()
                    out, n = None, n + 1
        if out is not None:
            yield close()

    rows = classified(pages, least_bytes).withColumn("page_id", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    return stored(rows.mapInPandas(files, "file string, n_bytes long"), "archives")


def splits(archives: DataFrame, size: int = SPLIT_BYTES) -> DataFrame:
    """(file, start, stop) of the byte ranges of archives(file, n_bytes)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(size).cast("long"))
    out = archives.select("file", "n_bytes", F.explode(starts).alias("start"))
    return out.select("file", "start", F.least(F.col("start") + size, F.col("n_bytes")).alias("stop"))


def read(archives: DataFrame, path: str, size: int = SPLIT_BYTES) -> DataFrame:
    """RECORDS of archives(file, n_bytes), by splits.

    Ranges are dealt out by a hash to a stated number of tasks, as Spark, which sees the few bytes of the ranges and not
    those of the archives, would put them in one. The archives' bytes go to no shuffle.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(path)[0]

        def page(name: str | None) -> int | None:
            number = (name or "").removeprefix("<urn:page:").rstrip(">")
            return int(number) if number else None

        for batch in batches:
            for file, start, stop in zip(batch["file"], batch["start"], batch["stop"], strict=True):
                out = []
                with store.open_input_file(file) as f:
                    for head, block in records(f, int(start), int(stop)):
                        kind = head["warc-type"]
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        size_, sha = (len(payload), digest(payload)) if payload is not None else (int(head["x-payload-length"]), head["warc-payload-digest"].removeprefix("sha1:"))
                        if head["warc-payload-digest"] != f"sha1:{sha}":
                            raise ValueError(f"{file}: a payload does not have its digest")
                        out.append((page(head["warc-record-id"]), size_, sha, kind, page(head.get("warc-refers-to"))))
                if out:
                    table = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                    ids = {c: pd.array([x[k] for x in out], dtype="Int64") for c, k in (("page_id", 0), ("refers_to", 4))}  # not by way of floats
                    yield table.assign(**ids)

    tasks = archives.select(F.sum(F.ceil(F.col("n_bytes") / size))).first()[0] or 1
    return splits(archives, size).repartition(min(int(tasks), MOST_TASKS), "file", "start").mapInPandas(rows, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    path = shared_dir(spark, "warc")
    return read(write(pages, path, least_bytes), path)
