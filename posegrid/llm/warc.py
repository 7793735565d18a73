"""WARC archives with revisit resolution.

Writing: every page's payload is hashed; only the headers (id, digest, length) are shuffled by
digest, reduced to the smallest id of each digest before the shuffle, and joined back. The first
page of a digest becomes a ``response`` with its payload, every other page of it a ``revisit``
without one, with a fresh header that refers to the response. Payloads are never shuffled: each task
meets the list of revisits by a broadcast, and where that list exceeds ``limit`` bytes the files of
the pages are written in several rounds, each with the revisits of its own files (see ``_rounds``).
Archives are plain WARC/1.1 files, written by Spark's committed writer: a record is one text row and
the row separator is the two line ends that close a record. So a lost task leaves no half archive,
and any store will do.

Reading: the archives are split into records by their Content-Length, payloads are hashed and
measured anew, and revisits get digest and length by a join to the response they refer to.

Defined results
  * a null payload is empty; payloads shorter than ``min_bytes`` are always responses;
  * every row is one record; rows that repeat the smallest page id of a payload are all responses,
    with one record id between them; a page id with several payloads has a record for each;
  * a null url is written as ``urn:page:<id>``; control characters and spaces in a url are
    percent-encoded, everything else stays as it is;
  * page ids may be of any type that has an order; a null one has no header and sorts after every other;
  * an archive holds up to ``archive_bytes`` at the pages' mean size; it is read whole;
  * no pages give an archive without records and an empty result;
  * further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posegrid.llm._common import BROADCAST_BYTES, Scratch, broadcast_bytes

#: Groups of one payload with at least this many rows are joined by broadcast (see ``resolve``).
HOT_ROWS = 1000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def _file(pages: DataFrame) -> F.Column:
    """A hash of the file that a row is read from; 0 where rows come from no files."""
    try:
        pages.select("_metadata.file_path")
    except AnalysisException:
        return F.lit(0).cast("long")
    return F.xxhash64("_metadata.file_path")


def headers(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(page_id, digest, bytes, file): what is shuffled instead of payloads."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_col).alias("page_id"), F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("long").alias("bytes"), _file(pages).alias("file")
    )


def resolve(heads: DataFrame, scratch: Scratch, min_bytes: int) -> DataFrame:
    """(page_id, digest, file, first): the response of each record that is a revisit."""
    long = heads.where(F.col("bytes") >= min_bytes).select("page_id", "digest", "file")
    groups = scratch.table(
        long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "groups"
    )
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, total // 1000)  # so at most 1000 groups are hot
    hot, cold = groups.where(F.col("n") >= limit).drop("n"), groups.where(F.col("n") < limit).drop("n")
    marked = long.join(F.broadcast(hot), "digest", "left")
    found = marked.where("first is not null").unionByName(marked.where("first is null").drop("first").join(cold, "digest"))
    found = found.where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "file", "first")
    return scratch.table(found, "revisits")


def _rounds(revisits: DataFrame, limit: int) -> list[int]:
    """How often the files of each group of files are read, so that no round's list of revisits exceeds ``limit`` bytes.

    Round j of group i takes the files whose hash is i and, of groups that are read m > 1 times, the
    digests whose hash is j. That is for a file with a longer list and for pages that come from no files.
    """
    rows = max(1, revisits.count())
    width = max(1, -(-broadcast_bytes(revisits) // rows))
    most = max(1, limit // width)  # rows of a round
    if rows <= most:
        return [1]
    files = revisits.groupBy("file").agg(F.count("*").alias("rows"))
    n = min(2 * -(-rows // most), files.count())
    each = files.groupBy(F.pmod("file", F.lit(n)).cast("int").alias("r")).agg(F.sum("rows").alias("rows"))
    each = {r["r"]: r["rows"] for r in each.collect()}  # a number a round
    return [max(1, -(-each.get(i, 0) // most)) for i in range(n)]


def _record_id(page, digest) -> F.Column:
    """A urn:uuid made of page id and payload digest, so that a second try writes the same."""
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), F.hex(digest)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def safe_url(url: F.Column) -> F.Column:
    """The url with control characters and spaces, which would break a header, as %XX."""
    one = lambda c: F.when(c.rlike(BREAKS), F.concat(F.lit("%"), F.lpad(F.hex(c), 2, "0"))).otherwise(c)
    return F.when(url.rlike(BREAKS), F.array_join(F.transform(F.split(url, ""), one), "")).otherwise(url)


BREAKS = r"[\x00-\x20\x7F]"


def write(
    pages: DataFrame, path: str, scratch: Scratch, id_col="page_id", url_col="url", payload_col="html", min_bytes=100, date=DATE,
    archive_bytes=32 << 20, limit=BROADCAST_BYTES,
) -> None:
    """Write deduplicated archives below ``path``."""
    heads = scratch.table(headers(pages, id_col, payload_col), "headers")
    revisits = resolve(heads, scratch, min_bytes)
    times = _rounds(revisits, limit)
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), _file(pages).alias("file"),
    )
    # readers take an archive as a whole, so its size is bounded by the mean size of a record
    mean = heads.agg(F.avg("bytes")).first()[0]
    each = max(1, int(archive_bytes / ((mean or 0) + 600)))
    out = lambda df: df.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", each).text(path)
    for i, m in enumerate(times):
        for j in range(m):
            mine = F.lit(True) if len(times) == 1 else F.pmod("file", F.lit(len(times))) == i
            mine = mine if m == 1 else mine & (F.pmod(F.xxhash64("digest"), F.lit(m)) == j)
            out(rows_of_records(rows.where(mine), revisits.where(mine), date))


def rows_of_records(rows: DataFrame, revisits: DataFrame, date: str) -> DataFrame:
    """(value): the record of each row. ``revisits`` is of a size that ``_rounds`` has checked."""
    few = F.broadcast(revisits.drop("file").distinct())  # a page may stand in several files
    same = rows["page_id"].eqNullSafe(few["page_id"]) & (rows["digest"] == few["digest"])
    rows = rows.join(few, same, "left").select(rows["*"], few["first"], few["digest"].isNotNull().alias("again"))
    nl = "\r\n"
    url = F.when(F.col("url").isNull(), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    url = url.otherwise(safe_url(F.col("url")))
    size = F.octet_length("body").cast("string")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=UTF-8{nl}Content-Length: "), size, F.lit(END)
    )
    block = F.when(F.col("again"), F.lit("")).otherwise(F.concat(http, F.col("body")))
    digest = F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))
    name = lambda key, value: F.concat(F.lit(f"{nl}{key}: "), value)
    head = F.concat(
        F.lit("WARC/1.1"),
        name("WARC-Type", F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))),
        name("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        name("WARC-Date", F.lit(date)),
        name("WARC-Target-URI", url),
        F.coalesce(name("WARC-Page-ID", F.url_encode(F.col("page_id").cast("string"))), F.lit("")),
        name("WARC-Payload-Digest", digest),
        F.when(
            F.col("again"),
            F.concat(
                name("WARC-Refers-To", _record_id(F.col("first"), F.col("digest"))),
                name("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(F.lit("")),
        F.when(F.col("again"), F.lit("")).otherwise(F.lit(f"{nl}Content-Type: application/http; msgtype=response")),
        F.lit(f"{nl}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return rows.select(F.concat(head, block).alias("value"))


def records(data: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """The records of one archive: header fields, and where the block starts and ends."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start = head + 4
        end = start + int(fields["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, start, end
        at = end + 4


def _parse(batches):
    import pyarrow as pa

    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            rows = []
            for fields, start, end in records(data):
                if fields["WARC-Type"] == "response":
                    body = data.index(b"\r\n\r\n", start, end) + 4
                    digest, size = hashlib.sha256(memoryview(data)[body:end]).hexdigest(), end - body
                    if "sha256:" + digest != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
                else:
                    digest, size = None, None
                page = fields.get("WARC-Page-ID")
                rows.append((None if page is None else unquote_plus(page), fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"), fields["WARC-Target-URI"], digest, size))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [*[pa.string()] * 6, pa.int64()]
            names = ["page_id", "record_id", "record_type", "refers_to_record", "url", "payload_digest", "payload_bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


RECORD = "page_id string, record_id string, record_type string, refers_to_record string, url string, payload_digest string, payload_bytes long"


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The archives' records; digest and length are null for revisits."""
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, RECORD)
    return found.withColumn("page_id", F.col("page_id").cast(id_type))


def read_resolved(spark: SparkSession, path: str, scratch: Scratch, id_type: str = "long") -> DataFrame:
    """The archives' records, revisits with digest, length and page of the response they refer to."""
    found = scratch.table(read(spark, path, id_type), "records")
    again = found.where("record_type = 'revisit'")
    # one row per response that is referred to: a hot response is joined by broadcast
    wanted = scratch.table(again.groupBy("refers_to_record").agg(F.count("*").alias("n")), "wanted")
    origin = found.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")
    )
    # responses that repeat a page share their record id
    origin = scratch.table(wanted.join(origin, "refers_to_record").distinct(), "origins")
    limit = max(HOT_ROWS, (wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // 1000)
    hot, cold = origin.where(F.col("n") >= limit).drop("n"), origin.where(F.col("n") < limit).drop("n")
    marked = again.join(F.broadcast(hot), "refers_to_record", "left")
    joined = marked.where("d is not null").unionByName(
        marked.where("d is null").drop("refers_to", "d", "b").join(cold, "refers_to_record", "left")
    )
    cols = ["page_id", "record_id", "url", "record_type"]
    return found.where("record_type = 'response'").select(
        *cols, "payload_bytes", "payload_digest", F.lit(None).cast(id_type).alias("refers_to")
    ).unionByName(joined.select(*cols, F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest"), "refers_to"))
