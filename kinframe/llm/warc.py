"""WARC archives of pages, and their capture index (operator 3).

Archives are written by Spark's own text sink: a record is text that ends in one
line break fewer than the format asks, and the line separator adds that one. Files
are read back as bytes and parsed record by record, by Content-Length. Each file gives a
run of index entries sorted by (URL key, timestamp, page id); runs are dealt once by
range, Spark's own sort, which spills, puts the slices of a range's runs in order, and a
loser tree merges them. Ranges hold about ``RANGE`` entries, so that a task's share is
bounded whatever the size of the table.

Defined cases: null html is an empty payload; null url gives the key ``-``; equal
payloads of at least ``min_revisit`` bytes have one response, that of the least page
id. A page without an id has a record too: it revisits
the page of least id with its payload, or is a response where none has an id.
Rows of one id are records of their own, with record ids of their own; if they are equal and have the least id of
their payload, all are responses. An empty table gives an empty result; columns other
than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, work_dir

END = "\r\n"
EPOCH = 1_700_000_000
#: Index entries that a range is meant to hold, and bytes of records a file is.
RANGE, FILE_BYTES = 100_000, 64 << 20


def digest_of(payload: Column) -> Column:
    """The bare base32 SHA-1 of UTF-8 text: 5 bytes are 8 digits of base 32, in the alphabet of RFC 4648."""
    sha = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(sha, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_digest(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest); null html is empty."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return plain.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": digest_of(F.col("html"))})


def responses(found: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Distinct (page_id, payload_digest) of ``found`` with refers_to: null for responses, the response's page_id for revisits.

    The least id per digest is a combinable aggregate; the join back has no payloads in it
    and may be split by adaptive execution where one payload is very common.
    """
    rows = found.groupBy("page_id", "payload_digest").agg(F.min("payload_bytes").alias("payload_bytes"))
    first = found.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first_id")
    refers = F.when((F.col("payload_bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(first, "payload_digest", "left").select("page_id", "payload_digest", refers.alias("refers_to"))


def stamp(page_id: Column) -> Column:
    """The capture time of a page: these tables have none, so a second per id from a fixed start."""
    return F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def record_id(page_id: Column, digest: Column, turn: Column) -> Column:
    """A URN in the shape of a UUID, from the page's id, its payload's digest and its turn among pages that share both."""
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest, turn.cast("string")))
    piece = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-8"), piece(14, 3), F.lit("-a"), piece(18, 3), F.lit("-"), piece(21, 12), F.lit(">"))


def record(payload: Column) -> Column:
    """The text of a record, without its last line break; of (page_id, url, payload_bytes, payload_digest, refers_to, turn)."""
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c, turn: record_id(c, F.col("payload_digest"), turn)
    body = F.when(revisit, F.lit("")).otherwise(payload)
    head = [
        F.lit("WARC/1.1" + END + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(END + "WARC-Record-ID: "), urn(F.col("page_id"), F.col("turn")),
        F.lit(END + "WARC-Date: "), stamp(F.col("page_id")),
        F.lit(END + "WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("url"), F.lit("-")), r"[\r\n]", "%0A"),
        F.lit(END + "WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(END + "X-Page-Id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("-")),
        F.lit(END + "X-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(END + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + END + "WARC-Refers-To: "), urn(F.col("refers_to"), F.lit(0)), F.lit(END + "X-Refers-To-Page: "), F.col("refers_to").cast("string"))).otherwise(F.lit("")),
        F.lit(END + "Content-Type: text/html; charset=utf-8" + END + "Content-Length: "), F.octet_length(body).cast("string"),
        F.lit(END + END), body, F.lit(END),
    ]
    return F.concat(*head)


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, records_per_file: int = 2000) -> None:
    """Write ``pages(page_id, url, html)`` as gzipped WARC files below ``folder``.

    A file has up to ``records_per_file`` records, fewer where their mean size asks so for ``FILE_BYTES``.
    The payloads are exchanged once, by page and digest.
    """
    own = with_digest(pages)
    sized = stash(own.select("page_id", "payload_bytes", "payload_digest"), f"{folder}-sizes")
    mean = sized.agg(F.avg("payload_bytes")).first()[0] or 0
    decided = responses(sized, min_revisit).toDF("id", "digest", "refers_to")
    both = own.join(decided, own["page_id"].eqNullSafe(decided["id"]) & (own["payload_digest"] == decided["digest"]))
    # pages of one id and payload are told apart by a turn; most tables have none, and then nothing is dealt for it
    several = sized.groupBy(F.col("page_id").alias("id2"), F.col("payload_digest").alias("digest2")).count().where("count > 1").select("id2", "digest2")
    several = stash(several, f"{folder}-several")
    if several.take(1):
        met = both.join(several, both["page_id"].eqNullSafe(several["id2"]) & (both["payload_digest"] == several["digest2"]), "left")
        turn = F.row_number().over(Window.partitionBy("page_id", "payload_digest").orderBy(F.lit(0))) - 1
        both = met.where("digest2 is null").withColumn("turn", F.lit(0)).unionByName(met.where("digest2 is not null").withColumn("turn", turn))
    else:
        both = both.withColumn("turn", F.lit(0))
    per_file = max(1, min(records_per_file, int(FILE_BYTES / (mean + 1000))))
    both.select(record(F.col("html")).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def url_key(url: str) -> str:
    """Host labels reversed, without ``www.`` and default ports, then path and query; lower case."""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port and (u.scheme, u.port) not in (("http", 80), ("https", 443)) else ""
    except ValueError:
        return url.lower() or "-"
    if not host:
        return url.lower() or "-"
    return f"{','.join(reversed(host.split('.')))}{port}){u.path or '/'}{'?' + u.query if u.query else ''}".lower()


def parse(archive: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, payload) of each record of an uncompressed archive; one record is held at a time."""
    at = 0
    while first := archive.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        head, length = {}, len(first)
        while (line := archive.readline()) not in (b"\r\n", b""):
            length += len(line)
            name, _, value = line.decode("utf-8").rstrip(END).partition(": ")
            head[name] = value
        size = int(head["Content-Length"])
        body = archive.read(size)
        if len(body) != size or archive.read(4) != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield at, head, body
        at += length + 2 + size + 4


RUN = "url_key string, capture_ts string, page_id long, run string, at long, record_offset long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark, folder: str) -> DataFrame:
    """Index entries of every record below ``folder``: a sorted run for each file.

    Payload lengths and digests of responses are computed from the bytes read; a
    revisit has no bytes of its own and keeps what its header says of the payload.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                rows = []
                name = path.as_py().rsplit("/", 1)[-1]
                for offset, head, body in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())), 1 << 20)):
                    kind, page = head["WARC-Type"], None if head["X-Page-Id"] == "-" else int(head["X-Page-Id"])
                    if kind == "response":
                        size, digest, refers = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), None
                        if "sha1:" + digest != head["WARC-Payload-Digest"]:
                            raise ValueError(f"payload of page {page} does not fit its digest")
                    else:
                        size, digest, refers = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Refers-To-Page"])
                    rows.append((url_key(head["WARC-Target-URI"]), head["WARC-Date"], page, offset, size, digest, kind, refers))
                rows.sort(key=lambda r: sort_key(*r[:4]))
                c = list(zip(*rows, strict=True)) if rows else [()] * 8
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int64()), pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()), pa.array(c[5], pa.string()), pa.array(c[6], pa.string()), pa.array(c[7], pa.int64())],
                    names=["url_key", "capture_ts", "page_id", "run", "at", "record_offset", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return files.mapInArrow(run, RUN)


def loser_tree_merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted lists: each inner node keeps the loser of its last match, the winner moves up.

    Taking the winner and replaying its path costs log2(k) comparisons an entry.
    """
    k = len(runs)
    if k < 2:
        yield from (runs[0] if runs else ())
        return
    at = [0] * k
    beats = lambda a, b: at[a] < len(runs[a]) and (at[b] >= len(runs[b]) or (runs[a][at[a]], a) < (runs[b][at[b]], b))
    winner, loser = [0] * (2 * k), [0] * k
    winner[k:] = range(k)
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1]
    while at[top] < len(runs[top]):
        yield runs[top][at[top]]
        at[top] += 1
        node = (top + k) // 2
        while node:
            if beats(loser[node], top):
                top, loser[node] = loser[node], top
            node //= 2


def sort_key(url: str, ts: str, page: int | None, offset: int) -> tuple:
    """Spark's order: a missing id comes first."""
    return url, ts, page is not None, page or 0, offset


def capture_histories(entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """All entries in global order: by (part, seq), with the page captured before at the same URL key.

    One exchange by range of (url key, timestamp, page id), so a URL with very many
    captures spreads over tasks, and its history goes on from range to range: the last entry of
    each (one row a range) is handed to the next. previous_page is null for a URL's first capture.
    """
    spark = entries.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), entries.count() // RANGE + 1)
    names = [x.split()[0] for x in RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import islice

        from pyspark import TaskContext

        slices: dict[str, list[tuple]] = {}  # rows come sorted by run and place
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                slices.setdefault(row[3], []).append((sort_key(row[0], row[1], row[2], row[5]), row))
        part, seq, before = TaskContext.get().partitionId(), 0, (None, None)
        merged = loser_tree_merge(list(slices.values()))
        while chunk := list(islice(merged, 10_000)):
            rows, more = [], []
            for _, r in chunk:
                rows.append(r)
                more.append((part, seq, before[1] if before[0] == r[0] else None))
                before, seq = (r[0], r[2]), seq + 1
            columns = [pa.array(c, b_type) for c, b_type in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)]
            extra = [pa.array(c, t) for c, t in zip(zip(*more, strict=True), [pa.int32(), pa.int64(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, "part", "seq", "previous_page"])

    dealt = entries.repartitionByRange(n, "url_key", "capture_ts", "page_id").sortWithinPartitions("run", "at")
    merged = stash(dealt.mapInArrow(run, RUN + ", part int, seq long, previous_page long"), work_dir(spark, "histories"))
    last = merged.groupBy("part").agg(F.max_by(F.struct("url_key", "page_id"), "seq").alias("last"))
    passed = last.select("part", F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("part")).alias("before")).where("before is not null")
    goes_on = (F.col("seq") == 0) & (F.col("url_key") == F.col("before.url_key"))
    return merged.join(F.broadcast(passed), "part", "left").select(*names, "part", "seq", F.when(goes_on, F.col("before.page_id")).otherwise(F.col("previous_page")).alias("previous_page"))


def archive_and_index(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back, and order the captures."""
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    write_archives(pages, f"{folder}/archives", min_revisit)
    return capture_histories(stash(read_archives(spark, f"{folder}/archives"), f"{folder}/runs"))
