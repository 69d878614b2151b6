"""WARC archives with a capture index that is merged from locally sorted runs."""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, keep, new_path, partitions, skewed_lookup
from .kernels import bytes_of, ids_of

LAST = 2**63 - 1
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
INDEX = "urlkey string, ts long, page_id long, archive string, offset long, length long, record_type string, payload_digest string"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then port, path and query; no scheme, www or fragment."""
    m = re.match(r"(?:([a-zA-Z][\w+.-]*)://)?(?:[^/?#@]*@)?([^/:?#]*)(?::(\d+))?([^#]*)", url or "")
    scheme, host, port, rest = m.groups()
    host = re.sub(r"^www\d*\.", "", host.lower())
    port = "" if not port or (scheme, port) in {("http", "80"), ("https", "443")} else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{port}){(rest or '/').lower()}"


def header_safe(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", value)


def record(page_id: int | None, url: str | None, ts: int, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """One gzip member holding a response, or a revisit without its payload; and the digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    when = (EPOCH + datetime.timedelta(seconds=ts)).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {when}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {header_safe(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    else:
        http += payload
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n") + z.flush(), digest


def write_archives(batches, path: str, archive_bytes: int):
    """Write archives of about archive_bytes; per archive, its sorted capture run."""
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    sink = name = None
    run: list[tuple] = []
    at = 0

    def close():
        sink.close()
        run.sort(key=lambda r: r[:3])
        return pa.record_batch([pa.array(c) for c in zip(*run, strict=True)], schema=schema)

    schema = pa.schema([("urlkey", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string())])
    for batch in batches:
        buf, offs = bytes_of(batch.column("html"))
        data = memoryview(buf)
        ids, refers, ts = ids_of(batch.column("_id"), LAST), batch.column("refers_to").to_pylist(), ids_of(batch.column("ts"), 0)
        urls = batch.column("url").to_pylist()
        for i in range(batch.num_rows):
            if sink is None:
                # a repeated task writes files of its own; only those that its rows name count
                name, at, run = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, []
                sink = fs.open_output_stream(f"{root}/{name}", compression=None)
            body, digest = record(None if ids[i] == LAST else int(ids[i]), urls[i], int(ts[i]), bytes(data[offs[i] : offs[i + 1]]), refers[i])
            sink.write(body)
            run.append((url_key(urls[i]), int(ts[i]), int(ids[i]), name, at, len(body), "response" if refers[i] is None else "revisit", digest))
            at += len(body)
            if at >= archive_bytes:
                yield close()
                sink = None
    if sink is not None:
        yield close()


def loser_tree_merge(runs: list[list[tuple]]):
    """Merge sorted runs: inner nodes hold the loser of their match, so each step replays one path."""
    k = len(runs)
    at = [0] * k
    head = [(0, r[0]) if r else (1, ()) for r in runs]

    def beats(a: int, b: int) -> bool:
        return (head[a], a) < (head[b], b)

    tree = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        win, tree[node] = (a, b) if beats(a, b) else (b, a)
        return win

    if not k:
        return
    winner = play(1) if k > 1 else 0
    while head[winner][0] == 0:
        yield runs[winner][at[winner]]
        at[winner] += 1
        head[winner] = (0, runs[winner][at[winner]]) if at[winner] < len(runs[winner]) else (1, ())
        node = (winner + k) // 2
        while node >= 1 and k > 1:
            if beats(tree[node], winner):
                tree[node], winner = winner, tree[node]
            node //= 2


def merge_runs(batches):
    """Merge the runs' slices in one key range; rows come run by run, each in order.

    place counts a URL's captures in merged order, so far as this range holds them.
    """
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    table = pa.concat_tables(tables)
    rows = list(zip(*[table.column(c).to_pylist() for c in ("urlkey", "ts", "page_id")], range(table.num_rows), strict=True))
    names = table.column("archive").to_pylist()
    cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
    order = [r[3] for r in loser_tree_merge([rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])]
    out = table.take(pa.array(order))
    n = out.num_rows
    keys = np.array([rows[i][0] for i in order], dtype=object)
    new = np.append(True, keys[1:] != keys[:-1])
    place = np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1]
    out = out.append_column("place", pa.array(place)).append_column("part", pa.array(np.full(n, TaskContext.get().partitionId(), np.int32))).append_column("at", pa.array(np.arange(n, dtype=np.int64)))
    yield from out.to_batches(max_chunksize=10_000)


def histories(merged: DataFrame) -> DataFrame:
    """`capture`: a capture's place (from 1) in its URL's history, which may go on over several ranges.

    Only the first URL of a range can have begun in ranges before. Its captures there are counted
    on a table of two rows for each range.
    """
    edges = merged.groupBy("part").agg(
        F.min_by("urlkey", "at").alias("head"), F.max_by("urlkey", "at").alias("tail"), F.max_by("place", "at").alias("place")
    )
    ends = edges.select("part", F.col("tail").alias("urlkey"), (F.col("place") + 1).alias("n"))
    before = Window.partitionBy("urlkey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a range's tail counts for the ranges after it; a head row asks and counts nothing
    asks = edges.select((F.col("part") - 0.5).alias("part"), F.col("head").alias("urlkey"), F.lit(0).alias("n"))
    carried = ends.withColumn("part", F.col("part").cast("double")).unionByName(asks).withColumn("carry", F.coalesce(F.sum("n").over(before), F.lit(0)))
    carried = carried.filter("part <> floor(part) and carry > 0").select(F.ceil("part").cast("int").alias("_part"), F.col("urlkey").alias("_key"), "carry")
    out = merged.join(carried, (F.col("part") == F.col("_part")) & (F.col("urlkey") == F.col("_key")), "left")
    return out.withColumn("capture", F.col("place") + 1 + F.coalesce("carry", F.lit(0))).drop("place", "carry", "_part", "_key")


def read_records(table: pa.Table, path: str) -> pa.Table:
    """Read the records of one archive at their indexed places, and check them against the index."""
    fs, root = pafs.FileSystem.from_uri(path)
    table = table.sort_by("offset")
    out = {"page_id": [], "url": [], "ts": [], "record_type": [], "refers_to": [], "payload_bytes": [], "payload_digest": [], "capture": []}
    with fs.open_input_file(f"{root}/{table.column('archive')[0].as_py()}") as source:
        for offset, length, key_digest, ts, capture in zip(*[table.column(c).to_pylist() for c in ("offset", "length", "payload_digest", "ts", "capture")], strict=True):
            raw = zlib.decompress(source.read_at(length, offset), 31)
            head, _, block = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            block = block[: int(fields["Content-Length"])]
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response":
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if len(payload) != size:
                    raise ValueError("a record's payload is cut")
            if digest != key_digest:
                raise ValueError("a record differs from its index entry")
            number = lambda f: None if f not in fields or "none" in fields[f] else int(fields[f][len("<urn:page:") : -1])
            for c, v in zip(out, (number("WARC-Record-ID"), fields.get("WARC-Target-URI"), ts, fields["WARC-Type"], number("WARC-Refers-To"), size, digest, capture), strict=True):
                out[c].append(v)
    types = {"url": pa.string(), "record_type": pa.string(), "payload_digest": pa.string()}
    return pa.table({c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()})


def write_warc(pages: DataFrame, path: str | None = None, min_bytes: int = 0, ts: str | None = None, archive_bytes: int = 32 << 20, range_rows: int = 200_000) -> tuple[DataFrame, str]:
    """Write pages (page_id, url, html) as WARC archives; returns their merged index and the folder.

    Of equal payloads (html in UTF-8) of at least min_bytes, the one with the smallest page_id
    is a response and the others are revisits that refer to it. Each task writes archives under
    names of its own and hands back their capture runs, sorted by URL key, time and page. The
    runs' slices in each key range are merged by a loser tree: part and at order all captures.
    A hot URL spreads over ranges, since ranges are cut by time and page as well, and capture
    counts its history (from 1) across them. Ranges hold about range_rows captures each.

    ts names a column with seconds since 2024-01-01; without it a page's time is its id.
    Defined cases: a null html is an empty payload; a null url has no target header and an empty
    key; a null page_id is above all others; rows that share the smallest page_id of their payload
    are all responses, and records of repeated page_ids share a WARC-Record-ID; a long payload is
    one record; other columns are not archived; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    when = F.coalesce(F.col(ts).cast("long"), F.lit(0)) if ts else F.coalesce(F.col("page_id"), F.lit(0))
    rows = pages.select(F.coalesce("page_id", F.lit(LAST)).alias("_id"), "url", html.alias("html"), when.cast("long").alias("ts"), F.sha1(html.cast("binary")).alias("_sha"))
    narrow = keep(rows.filter(F.octet_length("html") >= min_bytes).select("_id", "_sha"), "warc-digests")
    first = narrow.groupBy("_sha").agg(F.min("_id").alias("refers_to"), F.count("*").alias("_n")).filter("_n > 1")
    again = skewed_lookup(narrow, keep(first, "warc-first"), ["_sha"], "_n").filter("_id > refers_to").select("_id", "_sha", "refers_to").distinct()
    typed = rows.join(again, ["_id", "_sha"], "left").select("_id", "url", "html", "ts", "refers_to")
    runs = keep(typed.mapInArrow(lambda it: write_archives(it, path, archive_bytes), INDEX), "warc-runs")
    key = ["urlkey", "ts", "page_id"]
    ranges = max(partitions(spark), -(-runs.count() // range_rows))
    ranged = runs.repartitionByRange(ranges, *key).sortWithinPartitions("archive", *key)
    merged = keep(ranged.mapInArrow(merge_runs, INDEX + ", place long, part int, at long"), "warc-merged")
    index = keep(histories(merged), "warc-index")
    drop(narrow, runs, merged)
    return index, path


def read_warc(index: DataFrame, path: str) -> DataFrame:
    """The indexed records: page_id, url, ts, record_type, refers_to, payload_bytes, payload_digest, capture.

    Each archive is read front to back by one task, and a record takes its capture number from the
    merged index.

    A response's payload is read and its digest computed anew; a revisit's size and digest are
    those of the payload that it refers to, as its headers give them.
    """
    schema = "page_id long, url string, ts long, record_type string, refers_to long, payload_bytes long, payload_digest string, capture long"
    return index.groupBy("archive").applyInArrow(lambda t: read_records(t, path), schema)
