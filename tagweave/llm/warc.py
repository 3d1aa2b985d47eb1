"""WARC archives: captures written by tasks, read back, and merged into capture histories.

Payloads are digested first; of equal payloads only the capture with the smallest
id is stored whole, the others are revisit records that name it. Each task writes
one archive of gzip members, one per record, so a record can be read from its
offset alone. Each archive gives a run of index entries sorted by URL key and
time. Runs are merged by ranges of the key: a task takes the slices of all runs
that fall into its range and merges them with a loser tree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.errors import CurationError
from tagweave.llm.common import ascii_lower, shuffle_partitions, stored
from tagweave.llm.files import open_file, write_whole

VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page long, url string, url_key string, time string, record_type string, refers_to long, archive string, offset long, length long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page: int | None, url: str | None, time: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One response or revisit record. The HTTP head of a revisit stays, its body goes."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page is None else page}>"),
        ("WARC-Date", time),
        ("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_records(source) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(fields, block, offset, length) of each gzip member; a broken one raises."""
    data, start = b"", 0
    while True:
        unpack, parts = zlib.decompressobj(31), []
        used = 0
        while not unpack.eof:
            if not data:
                data = source.read(1 << 20)
                if not data:
                    break
            parts.append(unpack.decompress(data))
            used += len(data) - len(unpack.unused_data)
            data = unpack.unused_data
        if not used and not unpack.eof:
            return
        if not unpack.eof:
            raise CurationError(f"archive cut short at {start}")
        yield (*parse_record(b"".join(parts)), start, used)
        start += used


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    if first + "\r\n" != VERSION.decode() or rest[length:] != b"\r\n\r\n":
        raise CurationError("not a WARC record")
    return fields, rest[:length]


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed and joined by commas, then ``)`` and the rest."""
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.when(url.contains("://"), key).otherwise(F.coalesce(url, F.lit("")))


def with_references(pages: DataFrame, page: str, url: str, html: str, time: Column, min_bytes: int) -> DataFrame:
    """Captures with digest and, where an equal payload has a smaller id, that id."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(page).cast("long").alias("page"), F.col(url).alias("url"), url_key(F.col(url)).alias("url_key"),
        F.coalesce(time.cast("string"), F.lit("")).alias("time"), payload.alias("payload"), F.sha1(payload).alias("sha1"),
    )
    digests = rows.where((F.octet_length("payload") >= min_bytes) & F.col("page").isNotNull())
    first = digests.groupBy("sha1").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    joined = rows.join(first, "sha1", "left")
    long_enough = F.octet_length("payload") >= min_bytes
    refers_to = F.when(long_enough & (F.col("first") < F.col("page")), F.col("first"))
    return joined.select("page", "url", "url_key", "time", "payload", refers_to.alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, *, page: str = "page_id", url: str = "url", html: str = "html", time: Column | None = None,
    min_bytes: int = 0,
) -> DataFrame:
    """Write one archive per task; returns the index runs, a row per record.

    A row has the fields of ``RECORD`` and stands in its archive's run in order of
    (url_key, time, page). Null html is an empty payload, a null URL an empty one. Rows of a null
    id are responses that nothing refers to. Of rows that share id and payload all are
    responses, if the id is the smallest. An empty table gives no records.
    """
    time = F.lit("2024-01-01T00:00:00Z") if time is None else time
    rows = with_references(pages, page, url, html, time, min_bytes)
    # one sort per task makes its archive, and so the index of its records, a sorted run
    rows = rows.sortWithinPartitions("url_key", "time", "page", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = f"{folder}/{TaskContext.get().partitionId():06d}.warc.gz"
        entries = {k: [] for k in ("page", "url", "url_key", "time", "record_type", "refers_to", "archive", "offset", "length")}

        def fill(out) -> None:
            at = 0
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch[name][i].as_py() for name in batch.schema.names}
                    raw = record_bytes(row["page"], row["url"], row["time"], row["payload"], digest_of(row["payload"]), row["refers_to"])
                    packed = gzip.compress(raw, 6, mtime=0)
                    out.write(packed)
                    entry = (row["page"], row["url"], row["url_key"], row["time"], "response" if row["refers_to"] is None else "revisit", row["refers_to"], archive, at, len(packed))
                    for name, value in zip(entries, entry):
                        entries[name].append(value)
                    at += len(packed)

        write_whole(archive, fill)
        kinds = {"page": pa.int64(), "refers_to": pa.int64(), "offset": pa.int64(), "length": pa.int64()}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.string())) for k, v in entries.items()})

    return stored(rows.mapInArrow(write, RECORD))


class LoserTree:
    """Merge sorted iterators: a match is replayed along one path per item."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.size = runs, key, len(runs)
        self.heads = [next(run, None) for run in runs]
        self.losers = [-1] * max(1, self.size)
        for leaf in range(self.size):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether the head of run a comes before that of run b; ended runs come last."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[a] is not None
        return (self.key(self.heads[a]), a) < (self.key(self.heads[b]), b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.size) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0:
                self.losers[node] = winner
                return
            if self._before(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.size and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


def capture_histories(index: DataFrame, ranges: int | None = None) -> DataFrame:
    """Index entries in global order of (url_key, time, page): ``part`` then ``place``.

    ``capture`` numbers the captures of a URL key within its part. Ranges are cut at (key, time, page), so a key
    with very many captures spreads over parts. A task holds one range of the index.
    """
    spark = index.sparkSession
    order = ["url_key", "time", "page"]
    dealt = index.repartitionByRange(ranges or shuffle_partitions(spark), *order).sortWithinPartitions("archive", "offset")
    names = index.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = TaskContext.get().partitionId(), {}
        for batch in batches:
            for row in zip(*[batch[name].to_pylist() for name in names]):
                runs.setdefault(row[names.index("archive")], []).append(row)
        at = [names.index(name) for name in order]
        key = lambda row: (row[at[0]], row[at[1]], row[at[2]] is not None, row[at[2]] or 0)
        merged, place, capture, last = [], 0, 0, None
        for row in LoserTree([iter(run) for run in runs.values()], key):
            capture = capture + 1 if row[at[0]] == last else 1
            last = row[at[0]]
            merged.append((*row, part, place, capture))
            place += 1
            if len(merged) == 10_000:
                yield _batch(merged)
                merged = []
        if merged:
            yield _batch(merged)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"page": pa.int64(), "refers_to": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "part": pa.int64(), "place": pa.int64(), "capture": pa.int64()}
        columns = [*names, "part", "place", "capture"]
        return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], kinds.get(c, pa.string())) for i, c in enumerate(columns)})

    return dealt.mapInArrow(merge, f"{RECORD}, part long, place long, capture long")


def read_archives(spark, archives: DataFrame) -> DataFrame:
    """Records of the archives named in the column ``archive``, in (archive, offset) order per task.

    Rows (page, record_type, refers_to, block_payload, digest, archive, offset). A payload is
    digested again and must match its header. Revisits have no payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                with open_file(archive) as source:
                    rows = []
                    for fields, block, offset, _ in read_records(source):
                        rows.append(_record_row(fields, block, archive, offset))
                        if len(rows) == 200:
                            yield _rows_batch(rows)
                            rows = []
                    if rows:
                        yield _rows_batch(rows)

    # one name per writing task; a task of its own each
    names = [(r["archive"],) for r in archives.select("archive").distinct().collect()]
    return spark.createDataFrame(names, "archive string").repartition(max(1, len(names))).mapInArrow(
        read, "page long, record_type string, refers_to long, payload binary, digest string, archive string, offset long"
    )


def _record_row(fields: dict[str, str], block: bytes, archive: str, offset: int) -> tuple:
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest_of(payload) != digest:
            raise CurationError(f"payload at {offset} of {archive} does not match its digest")
    return number("WARC-Record-ID"), fields["WARC-Type"], number("WARC-Refers-To"), payload, digest, archive, offset


def _rows_batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    page, kind, refers, payload, digest, archive, offset = zip(*rows)
    return pa.RecordBatch.from_pydict({
        "page": pa.array(page, pa.int64()), "record_type": pa.array(kind), "refers_to": pa.array(refers, pa.int64()),
        "payload": pa.array(payload, pa.binary()), "digest": pa.array(digest), "archive": pa.array(archive), "offset": pa.array(offset, pa.int64()),
    })


def payload_facts(records: DataFrame) -> DataFrame:
    """Size of every record's full payload; a revisit takes it from the response that it names."""
    sizes = records.select("archive", "offset", "page", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"))
    sizes = stored(sizes)
    whole = sizes.where("record_type = 'response' AND page IS NOT NULL").groupBy(F.col("page").alias("refers_to"), "digest").agg(F.max("bytes").alias("whole"))
    joined = sizes.join(whole, ["refers_to", "digest"], "left")
    return joined.select("archive", "offset", "page", F.coalesce("bytes", "whole").alias("payload_bytes"), "digest", "record_type", "refers_to")
