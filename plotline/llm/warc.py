"""WARC archives: a deterministic sharded writer, and its reader.

Records are ordered by page id, then payload, and dealt over shards of even payload: the shards' borders are quantiles
of a sample that hashes choose, so the same rows and the same number of shards give the same files byte for byte,
however the input lies. A shard is one task's work. It writes gzip members, one for each record, and begins a new file
before a file would pass max_bytes compressed. Record ids, digests and lengths are made from the page, whatever the
page came with.

Files are written under temporary names that hold the attempt. What an attempt has written it tells in rows that Spark
commits as the pending manifest; a second job moves those files to their names, and the manifest it writes is the sign
that all are there. A file of a lost or second attempt is in no manifest and never read.

Of records with equal payloads of at least `least` bytes that with the largest page id is the response, the others are
revisits of it without payload; payloads are compared by SHA-256, the digest in the record is SHA-1. Null html is an
empty payload. A null page id sorts first and is read back as null; if a group has no id at all, its first record is the
response and the others refer to null. Rows that repeat page id and payload: the first by url is the response if the
group's response is that page. Line breaks in a url become %0A and %0D, a null url is left out. An empty table gives no file and no rows.
"""

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, partitions, stash

MAX_BYTES, SHARD_BYTES = 64 << 20, 256 << 20
#: Most shards, and rows of the sample for each; together they bound what comes to the driver.
MAX_SHARDS, SAMPLE = 50_000, 16
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "shard int, seq int, name string, temporary string, bytes long, records long, sha1 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(x, _KINDS[k]) for x, k in zip(zip(*rows), kinds)], names)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, sha: bytes, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{sha.hex()}:{copy}'.encode()).digest()[:16], version=5)}>"


def record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record with its lengths and digests, compressed as a gzip member of its own."""
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", len(block))]
    text = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(f"WARC/1.1\r\n{text}\r\n".encode() + block + b"\r\n\r\n") + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, sha: bytes, copy: int, source: tuple[int | None, str] | None) -> bytes:
    """source: of a revisit the page and the record that it refers to."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", record_id(page_id, sha, copy)),
        ("WARC-Target-URI", url and url.replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("Page-ID", page_id),
    ]
    if source is None:
        return record("response", fields, block + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", source[1]), ("Refers-To-Page-ID", source[0])]
    return record("revisit", fields, block)


def _keys(page_id: np.ndarray, sha: list[bytes]) -> np.ndarray:
    """Page id (its lowest value for null), then the start of the digest, as bytes that compare like them."""
    high = (page_id.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
    low = np.frombuffer(b"".join(x[:8] for x in sha), ">u8")
    return np.ascontiguousarray(np.stack([high, low], 1)).view("S16").ravel()


def _shard_of(narrow: DataFrame, shards: int, rows: int):
    """A function of page_id and sha to the shard. Borders: quantiles by payload of the rows whose hashes come first."""
    share = min(1.0, shards * SAMPLE / max(rows, 1))
    chosen = narrow.where(F.pmod(F.xxhash64("page_id", "sha"), F.lit(1 << 31)) < int(share * (1 << 31)))
    sample = chosen.select(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page_id"), F.substring("sha", 1, 8).alias("sha"), "size").toArrow()
    keys = _keys(sample.column("page_id").to_numpy(), sample.column("sha").to_pylist()) if len(sample) else np.zeros(0, "S16")
    order = np.argsort(keys, kind="stable")
    weight = np.cumsum(sample.column("size").to_numpy()[order] + 512)
    at = np.searchsorted(weight, weight[-1] * np.arange(1, shards) / shards) if len(weight) else np.zeros(0, int)
    borders = np.unique(keys[order][at])

    @F.pandas_udf("int")
    def shard(page_id: pd.Series, sha: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, _keys(page_id.to_numpy(np.int64), sha.to_list()), side="right").astype(np.int32))

    return shard(F.coalesce("page_id", F.lit(-(1 << 63))), F.substring("sha", 1, 8)), len(borders) + 1


class _Files:
    """The files of one shard, one after the other; rows for the manifest as they close."""

    def __init__(self, folder: str, prefix: str, shard: int, attempt: int, max_bytes: int):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(f"{self.path}/temporary", recursive=True)
        self.prefix, self.shard, self.attempt, self.max_bytes = prefix, shard, attempt, max_bytes
        self.seq, self.out, self.closed = 0, None, []

    def write(self, member: bytes) -> None:
        if self.out and self.records and self.bytes + len(member) > self.max_bytes:
            self.close()
        if not self.out:
            self.name = f"{self.prefix}-{self.shard:05d}-{self.seq:05d}.warc.gz"
            self.temporary = f"temporary/{self.name}.{self.attempt}"
            self.out = self.fs.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
            self.bytes = self.records = 0
            self.sha1 = hashlib.sha1()
            info = b"software: plotline\r\nformat: WARC File Format 1.1\r\n"
            self._put(record("warcinfo", [("WARC-Record-ID", record_id(None, self.name.encode(), 0)), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(member)
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.closed.append((self.shard, self.seq, self.name, self.temporary, self.bytes, self.records, self.sha1.hexdigest()))
            self.seq, self.out = self.seq + 1, None


def write_archives(pages: DataFrame, folder: str, shards: int | None = None, max_bytes: int = MAX_BYTES, least: int = 0, prefix: str = "pages", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives and gives their manifest, which stands in folder/manifest.

    shards: None takes one for each SHARD_BYTES of payload, and as many as the session's shuffles have partitions at least.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    narrow = stash(rows.select("page_id", "sha", F.octet_length("payload").alias("size")), "payloads")
    n, total = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    shards = max(1, min(MAX_SHARDS, shards or max(partitions(spark), -(-total // SHARD_BYTES))))
    groups = narrow.where(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("sha", "keep")
    notes = narrow.join(groups, "sha").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "sha", "keep", F.lit(0).alias("kind")).distinct()
    shard, count = _shard_of(narrow, shards, n)
    every = notes.unionByName(rows.withColumns({"keep": F.lit(None).cast("long"), "kind": F.lit(1)})).withColumn("shard", shard)
    # a note of its group comes before the rows of a page id and payload
    dealt = every.repartitionById(count, "shard").sortWithinPartitions("shard", "page_id", "sha", "kind", "url")

    def write(batches):
        attempt, files, last, copy, noted = TaskContext.get().taskAttemptId(), None, None, 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "page_id", "sha", "kind", "keep", "url")), batch.column("payload").cast(pa.binary()).to_pylist()):
                number, page_id, sha, kind, keep, url, payload = row
                if files is None or files.shard != number:
                    if files:
                        files.close()
                        yield from told(files)
                    files = _Files(folder, prefix, number, attempt, max_bytes)
                if (page_id, sha) != last:
                    last, copy, noted = (page_id, sha), 0, None
                if kind == 0:
                    noted = (keep,)
                    continue
                source = None
                if noted and (noted[0] != page_id or copy):
                    source = noted[0], record_id(noted[0], sha, 0)
                files.write(page_record(page_id, url, payload, sha, copy, source))
                copy += 1
        if files:
            files.close()
            yield from told(files)

    def told(files: _Files):
        if files.closed:
            yield batch_of(files.closed, MANIFEST)

    if n:
        dealt.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/pending")
    else:
        spark.createDataFrame([], MANIFEST).write.parquet(f"{folder}/pending")

    def commit(batches):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                held, final = fs.get_file_info([f"{path}/{row['temporary']}", f"{path}/{row['name']}"])
                if held.type == pyarrow.fs.FileType.File:
                    fs.move(held.path, final.path)
                elif final.size != row["bytes"]:  # neither this attempt nor an earlier one of this job has it
                    raise FileNotFoundError(row["temporary"])
            yield batch

    spark.read.schema(MANIFEST).parquet(f"{folder}/pending").mapInArrow(commit, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(stream, size: int = 1 << 20):
    """The records of a compressed archive, one gzip member at a time."""
    data, out, inflate = b"", [], zlib.decompressobj(31)
    while True:
        data = data or stream.read(size)
        if not data:
            break
        out.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            out, inflate = [], zlib.decompressobj(31)
    if any(out):
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/1.") or fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits) of all files in the manifest.

    Each record's block digest and each response's payload digest are verified.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    schema = RECORDS + (", payload binary" if with_payload else "")
    number = lambda x: None if x is None else int(x)

    def read(batches):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(head.rpartition(b"Content-Length: ")[2])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        whole = fields["WARC-Type"] == "response"
                        if whole and (len(payload) != length or base32_sha1(payload) != digest):
                            raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
                        row = (number(fields.get("Page-ID")), fields.get("WARC-Target-URI"), length, digest, fields["WARC-Type"], number(fields.get("Refers-To-Page-ID")))
                        held.append((*row, payload if whole else None) if with_payload else row)
                        size += len(payload) if with_payload else 200
                        if size > 8 << 20:
                            yield batch_of(held, schema)
                            held, size = [], 0
                if held:
                    yield batch_of(held, schema)

    return manifest.select("name").repartition(max(1, min(partitions(spark) * 4, manifest.count())), "name").mapInArrow(read, schema)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from the archives."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder, least=least)
    return read_archives(spark, folder).drop("url")
