"""WARC archives: a writer, and a PySpark Python data source that reads them.

Writing is a plan of built-in functions: each row becomes the bytes of one WARC/1.1 record,
and Spark's text writer, with the record's closing blank lines as the line separator, puts
them into (gzipped) files through its commit protocol, so a lost executor leaves no halves.

Reading: ``spark.read.format("millrace_warc").load(path)`` plans partitions from groups of
whole files of about ``groupBytes`` bytes.  Filters on ``record_type``, ``record_id``,
``target_uri``, ``refers_to`` and ``payload_digest`` are pushed down: the headers of a record
are read first, and the payload of a record that doesn't match, or of any record with the
option ``payload`` set to ``false``, is skipped without being copied or decoded.

Payloads that occur again become ``revisit`` records without a body.  They name the record
with the smallest id of those with the same payload.

Edge cases: a null html is an empty payload; a null url leaves out the target header; line
breaks and percent signs in it are percent-encoded; a null page_id comes after all others
among records with the same payload, so it is a revisit unless every id is null; rows that
repeat the smallest page_id of a payload are all responses; record ids are made of page_ids, so
null or repeated page_ids give records with one id; an empty table makes an archive
without records, which reads as an empty table; further columns are not read.
"""

from __future__ import annotations

import gzip
import importlib
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from millrace.llm._common import flagged, ready, scratch, table, written

NAME = "millrace_warc"
END = "\r\n\r\n"
SALTS = 32  # a payload that a third of all rows share meets its first record in so many tasks
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, content_length long, headers map<string,string>, payload binary"
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")]
    + [("payload_length", pa.int64()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)
#: Columns that filters can be pushed down for, and the header each stands for.
PUSHED = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: 40 hexadecimal digits are four times 40 bits, eight characters each."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _escaped(url: Column) -> Column:
    return F.replace(F.replace(F.replace(url, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def with_first(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, payload) with digest, and ``first``: the id a row revisits, else null.

    Only digests and ids cross the network to find payloads that occur again.  Rows whose digest
    isn't one of these stay where they are; the others meet their first record under a salt that
    comes from the partition they are read in, so a payload that holds a third of all rows is
    spread out.
    """
    rows = pages.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    found = rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("smallest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = written(found.select("digest", "bytes", "smallest"), "repeated")
    marked = flagged(rows, "digest", groups.select("digest"), "again")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = marked.where("again").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(salted, ["digest", "bytes", "salt"], "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("smallest")), F.col("smallest"))
    own = ["page_id", "url", "payload", "digest", "bytes"]
    alone = marked.where("NOT again").select(*own, F.lit(None).cast(dict(rows.dtypes)["page_id"]).alias("first"))
    return alone.unionByName(met.select(*own, first.alias("first")))


def records(rows: DataFrame) -> DataFrame:
    """One string of bytes per record, without its closing blank lines."""
    revisit = F.col("first").isNotNull()
    header = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", _id(F.col("page_id"))),
        header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        header("WARC-Target-URI", _escaped(F.col("url"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        header("WARC-Refers-To", F.when(revisit, _id(F.col("first")))),
        header("X-Payload-Length", F.col("bytes").cast("string")),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return rows.select(F.concat(head.cast("binary"), body).cast("string").alias("value"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """``pages`` (page_id, url, payload binary) as gzipped archives in the folder ``path``."""
    records(with_first(pages, min_bytes)).write.option("lineSep", END).option("compression", "gzip").text(path)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


#: Schemes that Spark's connectors use, by the name that pyarrow knows the store by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _place(path: str, resolver: str = "") -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it.

    ``resolver`` ("module:function") names a function from a path to both, for stores that
    pyarrow doesn't know by their scheme; it must be importable on the executors.
    """
    if resolver:
        module, _, name = resolver.partition(":")
        return getattr(importlib.import_module(module), name)(path)
    scheme, colon, rest = path.partition("://")
    if colon:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.FileSystem.from_uri(path) if path.startswith("file:") else (fs.LocalFileSystem(), path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return (PushingReader if str(self.options.get("pushdown", "true")).lower() == "true" else WarcReader)(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.resolver = options.get("resolver", "")
        self.group_bytes = int(options.get("groupBytes", 64 << 20))
        self.with_payload = str(options.get("payload", "true")).lower() != "false"
        self.wanted: list[tuple[str, frozenset | None]] = []

    def partitions(self) -> Sequence[Files]:
        where, path = _place(self.path, self.resolver)
        # Schemes survive in the paths that executors open.
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        info = where.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        groups: list[list[str]] = []
        size = self.group_bytes
        for name, n in files:
            if size + n > self.group_bytes or not groups:
                groups.append([])
                size = 0
            groups[-1].append(prefix + name)
            size += n
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def _keep(self, headers: dict[str, str]) -> bool:
        return all(headers.get(name) is not None if values is None else _plain(name, headers) in values for name, values in self.wanted)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.paths:
            where, inner = _place(path, self.resolver)
            with where.open_input_stream(inner, compression=None) as raw:
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20)
                for headers, payload in _records(stream, self._keep, self.with_payload):
                    rows.append((headers, payload))
                    size += len(payload or b"") + 500
                    if size > 16 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


class PushingReader(WarcReader):
    """The reader for sessions that push filters down to Python data sources (Spark refuses it in others)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Keep what headers can decide; hand the rest back."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in PUSHED and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.wanted.append((PUSHED[column], frozenset([f.value])))
            elif column in PUSHED and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.wanted.append((PUSHED[column], frozenset(f.value)))
            elif column in PUSHED and isinstance(f, IsNotNull):
                self.wanted.append((PUSHED[column], None))
            else:
                yield f


def _plain(name: str, headers: dict[str, str]) -> str | None:
    value = headers.get(name)
    if value is not None and name == "warc-payload-digest":
        return value.removeprefix("sha1:")
    return value


def _records(stream, keep, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        n = int(headers.get("content-length", 0))
        wanted = keep(headers)
        if wanted and with_payload:
            payload = stream.read(n)
            if len(payload) != n:
                raise ValueError("the archive ends within a record")
        else:
            payload = None
            while n:
                n -= len(skipped := stream.read(min(n, 1 << 20)))
                if not skipped:
                    raise ValueError("the archive ends within a record")
        if wanted:
            yield headers, payload


def _batch(rows: list[tuple[dict[str, str], bytes | None]]) -> pa.RecordBatch:
    heads = [h for h, _ in rows]
    number = lambda h, k: int(h[k]) if k in h else None
    cols = [[_plain(PUSHED[c], h) for h in heads] for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")]
    cols += [[number(h, "x-payload-length") for h in heads], [number(h, "content-length") for h in heads], [list(h.items()) for h in heads], [p for _, p in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def read_warc(spark: SparkSession, path: str, payload: bool = True, resolver: str = "") -> DataFrame:
    """Records of the archives under ``path``; filters are pushed down where the session's
    ``spark.sql.python.filterPushdown.enabled`` is on, and applied by Spark where it isn't."""
    ready(spark)
    spark.dataSource.register(WarcSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(NAME).options(payload=str(payload).lower(), resolver=resolver, pushdown=pushdown).load(path)


def page_of(record: Column) -> Column:
    """The page_id within a record id of this writer."""
    return F.regexp_extract(record, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written and read back; sizes and digests of responses are taken from the bytes read."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    path = scratch(spark, "warc")
    write_warc(pages, path)
    rows = read_warc(spark, path)
    response = F.col("record_type") == "response"
    return rows.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )


def op6_sql() -> str:
    """Digests in base 32 are spelled from SHA-1's hexadecimal digits, five (20 bits, four letters) at a time."""
    group = "CAST('0x' || substr(h, 1 + 5 * {i}, 5) AS BIGINT)"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({group.format(i=i)} >> {s}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages
), d AS (SELECT page_id, payload_bytes, {letters} AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m"""
