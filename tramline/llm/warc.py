"""WARC archives with a merged external index.

Writing: each task writes its captures as gzip-per-record WARC files in the shared folder, and returns
the index entries of a file as one locally sorted run (URL key, timestamp). A retried task writes files
of new names; only those in the index it returned are ever read, so a lost executor leaves no half.

Merging: entries are dealt by ranges of (URL key, timestamp, page), so the ranges follow each other and
a popular URL spans several; inside a range, of about RANGE_ENTRIES at most, the runs are merged by a loser tree. Output rows are
numbered (range, position): the capture history of every URL, in global order.

Equal payloads of at least `min_bytes` are stored once: the page with the largest id is the response,
the others revisit it. Null html: empty payload. Null url: empty key. Repeated rows are rows; of equal
rows with the largest id each is a response. A null page id never wins over another id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, shuffle_partitions, stage

INDEX = "run string, pos int, url_key string, ts string, page_id long, file string, offset long, length long"
EPOCH, FILE_BYTES, RUN_ENTRIES, RANGE_ENTRIES, HOT = datetime(2024, 1, 1, tzinfo=UTC), 64 << 20, 100_000, 200_000, 1000
NO_PAGE = "ffffffff"


def url_key(url: str) -> str:
    """Host labels reversed and comma-joined, then path and query, lower case (sort-friendly)."""
    try:
        parts = urlsplit(url.lower())
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None) -> str:
    """A urn:uuid that holds the page id in its first 16 digits."""
    p = f"{(page_id or 0) & (2**64 - 1):016x}"
    return f"<urn:uuid:{p[:8]}-{p[8:12]}-{p[12:16]}-8000-0000{NO_PAGE if page_id is None else '00000000'}>"


def page_of(record: str | None) -> int | None:
    m = re.fullmatch(r"<urn:uuid:(\w{8})-(\w{4})-(\w{4})-8000-0000(\w{8})>", record or "")
    if not m or m[4] == NO_PAGE:
        return None
    p = int(m[1] + m[2] + m[3], 16)
    return p - 2**64 if p >= 2**63 else p


def make_record(page_id: int | None, url: str, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool, when: datetime) -> bytes:
    """One record, a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + pack.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one gzip member; lengths are obeyed, never searched for."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}, payload


class LoserTree:
    """k-way merge: the root is the least head, each inner node the loser of its match; log2 k compares a step."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.node = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) if x is None or y is None else (x, a) < (y, b)

    def _play(self, i: int) -> None:
        at, winner = (i + self.k) // 2, i
        while at > 0:
            if self.node[at] == -1:
                self.node[at] = winner
                return
            if self._less(self.node[at], winner):
                self.node[at], winner = winner, self.node[at]
            at //= 2
        self.node[0] = winner

    def __iter__(self):
        while self.k and self.heads[w := self.node[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            at, winner = (w + self.k) // 2, w
            while at > 0:
                if self._less(self.node[at], winner):
                    self.node[at], winner = winner, self.node[at]
                at //= 2
            self.node[0] = winner


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, digest (binary), refers_to, revisit.

    Winners are decided on digests and ids alone. A payload that a share of 1 / HOT of all pages has is one of HOT
    at most: those winners go to every task, so that no task gets all copies; the others are joined by digest.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.unhex(F.sha1("html")))
    large = F.octet_length("html") >= min_bytes
    winners = p.filter(large).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1 and winner is not null")
    winners, every = stage(winners, "warc-winners"), p.count()
    hot = winners.filter(F.col("n") * HOT >= every)
    p = p.join(F.broadcast(hot.select("digest", F.col("winner").alias("hot"))), "digest", "left")
    # 8 bytes never equal a digest: what needs no join is spread evenly
    key = F.when(F.col("hot").isNull() & large, F.col("digest")).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64("page_id", "url")), 16, "0")))
    rare = winners.filter(F.col("n") * HOT < every).select(F.col("digest").alias("key"), F.col("winner").alias("rare"))
    p = p.withColumn("key", key).join(rare, "key", "left").withColumn("winner", F.coalesce("hot", "rare"))
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return p.select("page_id", "url", "html", "digest", F.when(revisit, F.col("winner")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(captures: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the captures under folder; the INDEX entries, a run for each file and RUN_ENTRIES entries."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, entries = None, "", 0, []

        def close():
            out.close()
            entries.sort()
            rows = [(name, i, k, t, None if p == -(2**63) else p, name, o, n) for i, (k, t, p, o, n) in enumerate(entries)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for page_id, url, html, digest, refers_to, revisit in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None:
                    name, at, entries = f"capture-{uuid.uuid4().hex}.warc.gz", 0, []
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                when = EPOCH + timedelta(seconds=(page_id or 0) % (10**9))
                record = make_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, revisit, when)
                out.write(record)
                entries.append((url_key(url), f"{when:%Y%m%d%H%M%S}", -(2**63) if page_id is None else page_id, at, len(record)))
                at += len(record)
                if at >= file_bytes or len(entries) >= RUN_ENTRIES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return captures.select("page_id", "url", "html", "digest", "refers_to", "revisit").mapInArrow(run, INDEX)


def merge_index(index: DataFrame) -> DataFrame:
    """range, seq, url_key, ts, page_id, file, offset, length in global order of (url_key, ts, page_id)."""
    schema = "range int, seq long, url_key string, ts string, page_id long, file string, offset long, length long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        from pyspark import TaskContext

        runs: list[list] = []
        last = None
        for batch in batches:
            for r, key, ts, page, *where in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if r != last:
                    runs.append([])
                    last = r
                runs[-1].append((key, ts, -(2**63) if page is None else page, *where))
        part, rows = TaskContext.get().partitionId(), []
        for seq, (key, ts, page, *where) in enumerate(LoserTree(runs)):
            rows.append((part, seq, key, ts, None if page == -(2**63) else page, *where))
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ranges = max(shuffle_partitions(index.sparkSession), -(-index.count() // RANGE_ENTRIES))  # bounds what a task merges
    dealt = index.repartitionByRange(ranges, "url_key", "ts", "page_id").sortWithinPartitions("run", "pos")
    return dealt.select("run", "url_key", "ts", "page_id", "file", "offset", "length").mapInArrow(run, schema)


def read_captures(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of each entry; files are read forward."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        source, opened = None, ""
        for batch in batches:
            rows, held = [], 0
            for name, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name != opened:
                    if source is not None:
                        source.close()
                    source, opened = fs.open_input_file(f"{root}/{name}"), name
                source.seek(offset)
                warc, http, payload = parse_record(source.read(length))
                stored = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                kind = warc["warc-type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != stored:
                    raise ValueError(f"damaged payload in {name} at {offset}")
                rows.append((page_of(warc["warc-record-id"]), int(http["content-length"]), stored, kind, page_of(warc.get("warc-refers-to")), payload if kind == "response" else None))
                held += len(payload)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if source is not None:
            source.close()

    return index.repartition("file").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame, DataFrame]:
    """(folder, staged runs of the index, merged index) of pages (page_id, url, html)."""
    folder = folder or new_path(pages.sparkSession, "warc")
    runs = stage(write_archives(with_revisits(pages), folder), "warc-index")
    return folder, runs, merge_index(runs)
