"""WARC archives written with an index, and read back by coalesced byte ranges.

Writing yields the index: one row per record with file, offset, length, URL and payload digest. A reader selects index rows
first; the selected records are then fetched in (file, offset) order, neighbours in one read. Every record is a gzip member
of its own, so any of them can be read alone. Payloads that repeat are stored once: of equal payloads of at least
``revisit_bytes`` the record with the largest page_id is the response and the others are revisit records that name it.

Results for odd input: null html is an empty payload; a null url is an empty URI; a null page_id stands below all others,
and records of a group in which all are null stay responses; rows that repeat the largest page_id of a group are each a
response; an empty table gives no archive; columns besides page_id, url and html are not read.
"""
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codestrata.llm.common import cut_lineage, file_system, new_file, shared_folder, utf8, utf8_slices

FILE_BYTES = 64 << 20          # an archive is closed after this many bytes
READ_BYTES = 8 << 20           # most bytes of one coalesced read, if no record is larger
GAP_BYTES = 64 << 10           # unselected bytes that are read over rather than sought over
DATE = "1970-01-01T00:00:00Z"

INDEX = "uri string, offset long, length long, url string, payload_digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


@F.pandas_udf(StringType())
def sha1_hex(payloads: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha1(p).hexdigest() for p in payloads], dtype="object")


def _record(page_id: int | None, url: str, digest: str, refers_to: int | None, payload: bytes) -> bytes:
    safe = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"
    gzip = zlib.compressobj(1, wbits=31)
    return gzip.compress(raw) + gzip.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one gzip member."""
    raw = zlib.decompress(data, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, folder: str, revisit_bytes: int = 1000) -> DataFrame:
    """Write one record per row; returns the index as a table that Spark has committed."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), utf8("html").alias("html"))
    rows = rows.withColumn("digest", sha1_hex("html"))
    known = cut_lineage(rows.select("page_id", "digest", F.length("html").alias("size")))
    groups = known.filter(F.col("size") >= revisit_bytes).groupBy("digest", "size").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to"))
    groups = groups.filter("n > 1 AND refers_to IS NOT NULL").select(F.col("digest").alias("d"), F.col("size").alias("s"), "refers_to")
    # Only what is a revisit leaves its payload behind before the rows move.
    marked = rows.join(groups, (rows["digest"] == groups["d"]) & (F.length("html") == groups["s"]), "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to"))
    marked = marked.select("page_id", "url", "digest", other.alias("refers_to"), F.when(other.isNull(), F.col("html")).otherwise(F.lit("").cast("binary")).alias("html"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at = None, None, 0
        for some in utf8_slices(batches):
            index = []
            for row in some.to_pylist():
                if out is None:
                    uri, out = new_file(folder, f"pages-{TaskContext.get().partitionId():06d}")
                    at = 0
                data = _record(row["page_id"], row["url"], row["digest"], row["refers_to"], row["html"])
                out.write(data)
                index.append((uri, at, len(data), row["url"], row["digest"], row["page_id"], "response" if row["refers_to"] is None else "revisit"))
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)],
                                             ["uri", "offset", "length", "url", "payload_digest", "page_id", "record_type"])
        if out is not None:
            out.close()
    return cut_lineage(marked.mapInArrow(archive, INDEX))


def _spans(offsets: list[int], lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs [first, past) of sorted records that are read at once."""
    first = 0
    for at in range(1, len(offsets) + 1):
        if at == len(offsets) or offsets[at] - offsets[at - 1] - lengths[at - 1] > GAP_BYTES or offsets[at] + lengths[at] - offsets[first] > READ_BYTES:
            yield first, at
            first = at


def read(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the selected index rows, from the archives; a response's length and digest are those of what was read.

    A revisit record holds no payload: its length is null here, its digest the header's. Without ``payloads`` they stay behind.
    """
    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, some in frame.groupby("uri", sort=False):
                system, path = file_system(uri)
                offsets, lengths, urls = some["offset"].tolist(), some["length"].tolist(), some["url"].tolist()
                with system.open_input_file(path) as file:
                    for first, past in _spans(offsets, lengths):
                        begin = offsets[first]
                        data, rows = file.read_at(offsets[past - 1] + lengths[past - 1] - begin, begin), []
                        for at in range(first, past):
                            fields, payload = parse(data[offsets[at] - begin:offsets[at] - begin + lengths[at]])
                            ids = [fields.get(k, "").removeprefix("<urn:page:").rstrip(">") for k in ("WARC-Record-ID", "WARC-Refers-To")]
                            page, other = (int(x) if x not in ("", "None") else None for x in ids)
                            response = fields["WARC-Type"] == "response"
                            digest = hashlib.sha1(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            rows.append((page, urls[at], len(payload) if response else None, digest, fields["WARC-Type"], other, payload if payloads else None))
                        found = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"], dtype="object")
                        yield found.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})
    # As many tasks as archives: the index is small, but its rows stand for their records.
    archives = max(1, selected.agg(F.count_distinct("uri")).first()[0])
    tasks = selected.select("uri", "offset", "length", "url").repartition(archives, "uri").sortWithinPartitions("uri", "offset")
    return tasks.mapInPandas(fetch, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Write all pages, then read every record; a revisit takes its payload's length from the response it names."""
    records = cut_lineage(read(write(pages, shared_folder(spark, "warc"), revisit_bytes), payloads=False).drop("payload", "url"))
    named = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("r"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("bytes"))
    revisits = records.filter("record_type = 'revisit'").alias("x").join(
        named, (F.col("x.refers_to") == F.col("r")) & (F.col("x.payload_digest") == F.col("d")), "left")
    full = revisits.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return records.filter("record_type = 'response'").select(full.columns).unionByName(full)
