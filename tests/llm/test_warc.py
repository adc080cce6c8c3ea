import base64
import gzip
import hashlib
import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plotline.llm.common import new_folder
from plotline.llm.warc import archive, read_archives, write_archives

from .helpers import CLASHING, SMALL, rows

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
PAGES = [
    (5, "http://a.example/\r\nX: y", "<p>same</p>"),
    (1, "http://a.example/1", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (9, "http://a.example/9", "<p>same</p>"),
    (2, "http://a.example/2", None),
    (3, "http://a.example/3", ""),
    (4, "http://a.example/4", "żółć 🎉\r\n\r\nContent-Length: 3\r\n\r\n"),
    (4, "http://a.example/4", "other text of the same id"),
    (None, "http://a.example/none", "<p>same</p>"),
    (None, None, None),
    (None, None, "without an id"),
    (None, "http://b.example", "without an id"),
    (6, "http://a.example/long", "x" * 3_000_000),
    (-7, "http://a.example/-7", "<p>below zero</p>"),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in (*CLASHING, "keep", "kind", "shard", "payload")})


def brute(found, least=0):
    groups = defaultdict(list)
    for i, _, html in found:
        groups[(html or "").encode()].append(i)
    out = []
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        known = [i for i in ids if i is not None]
        keep, taken = max(known) if known else None, False
        for i in ids:
            response = len(payload) < least or len(ids) == 1 or (i == keep and not taken)
            taken = taken or (i == keep and response)
            out.append((i, len(payload), digest, "response" if response else "revisit", None if response else keep))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 1, 12, 1 << 40])
def test_edges(spark, least):
    assert sorted(str(tuple(r)) for r in archive(pages(spark), least).select(*COLUMNS).collect()) == brute(PAGES, least)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    df = df.union(df.where("page_id % 3 = 0").selectExpr("page_id + 100000", "url", "html"))
    assert sorted(str(tuple(r)) for r in archive(df).select(*COLUMNS).collect()) == brute([tuple(r) for r in df.collect()])


def files(folder):
    path = folder.removeprefix("file://")
    return {x: open(f"{path}/{x}", "rb").read() for x in sorted(os.listdir(path)) if x.endswith(".warc.gz")}


def test_same_files_however_the_input_lies(spark):
    df = spark.read.parquet(f"{SMALL}/pages.parquet")
    made = []
    for way in (df, df.orderBy(F.desc("url")).repartition(7)):
        folder = new_folder(spark, "warc-test")
        write_archives(way, folder, shards=3, max_bytes=12_000)
        made.append(files(folder))
        manifest = spark.read.parquet(f"{folder}/manifest").collect()
        assert {r.name: (r.bytes, r.sha1) for r in manifest} == {k: (len(v), hashlib.sha1(v).hexdigest()) for k, v in made[-1].items()}
        assert all(r.bytes <= 12_000 or r.records == 1 for r in manifest) and len(manifest) > 3
        assert sum(r.records for r in manifest) == df.count()
    assert made[0] == made[1]
    ids = [int(x.split()[1]) for data in made[0].values() for x in gzip.decompress(data).decode().split("\r\n") if x.startswith("Page-ID: ")]
    assert ids == sorted(ids)  # over all files in the order of their names


def test_payloads_come_back(spark):
    folder = new_folder(spark, "warc-test")
    write_archives(pages(spark), folder, shards=4)
    got = read_archives(spark, folder, with_payload=True).where("record_type = 'response'").collect()
    want = {(html or "").encode() for _, _, html in PAGES}
    assert {bytes(r.payload) for r in got} == want
    assert {r.url for r in got if r.page_id == 6} == {"http://a.example/long"}


def test_what_is_in_no_manifest_is_not_read(spark):
    folder = new_folder(spark, "warc-test")
    write_archives(pages(spark), folder, shards=2)
    before = rows(read_archives(spark, folder))
    path = folder.removeprefix("file://")
    data = files(folder)
    for k, x in enumerate(data.values()):  # as an attempt that was lost leaves them
        for name in (f"{path}/temporary/pages-00000-{k:05d}.warc.gz.99", f"{path}/pages-00009-{k:05d}.warc.gz"):
            with open(name, "wb") as f:
                f.write(x[: len(x) // 2])
    assert rows(read_archives(spark, folder)) == before
    name = f"{path}/{next(iter(data))}"
    with open(name, "wb") as f:
        f.write(data[next(iter(data))][:-20])
    with pytest.raises(Exception, match="ends within a record"):
        read_archives(spark, folder).collect()


def test_empty_table(spark):
    assert rows(archive(pages(spark).where("false"))) == []
