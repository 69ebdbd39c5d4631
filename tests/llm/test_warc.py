import gzip
import hashlib
import random

from lectern.llm import warc
from lectern.llm.common import scratch

SCHEMA = "page_id bigint, url string, html string, digest string, chunk int"


def rows():
    rnd = random.Random(2)
    long = "".join(chr(rnd.randrange(0x20, 0x2000)) for _ in range(700_000))
    body = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 100
    out = [(i, f"http://e/{i}", f"<html>{i % 7}" + "y" * (95 + i % 9), "d", 1) for i in range(60)]
    out += [(100, None, None, None, None), (101, "http://a\r\nb", "", "d", 1), (102, "u", long, "d", 1), (90, "u", long, "d", 1), (103, "u", body, "d", 1), (104, "u", body, "d", 1)]
    return [*out, (None, "u", body, "d", 1), (104, "u", body, "d", 1), (105, "u", "short", "d", 1), (106, "u", "short", "d", 1), (None, "u", "only null " * 20, "d", 1)]


def plain(data):
    first = {}
    for p, _, h, *_ in data:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    out = []
    for p, _, h, *_ in data:
        b = (h or "").encode()
        again = len(b) >= 100 and first.get(h or "") is not None and p != first[h or ""]
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=repr)


def test_written_and_read_back(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert sorted((tuple(r) for r in warc.op9_archives(df).collect()), key=repr) == plain(rows())
    assert warc.op9_archives(df.limit(0)).collect() == []


def test_chunks_make_the_payloads(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    folder = scratch(spark, "warc-test")
    manifest = warc.write(warc.chunked(df.repartition(3), chunk=1000), folder, 20_000)
    assert sum(r.n_records for r in manifest.collect()) == len(rows())
    back = warc.read(manifest, folder, chunk=700).collect()
    whole, digests = {}, {}
    for r in sorted(back, key=lambda r: (r.archive, r.record, r.chunk)):
        whole.setdefault((r.archive, r.record), bytearray()).extend(r.data)
        assert len(r.data) <= 700
        if r.last:
            digests[r.archive, r.record] = r
    for at, r in digests.items():
        if r.record_type == "response":
            assert hashlib.sha256(whole[at]).hexdigest() == r.digest_so_far and len(whole[at]) == r.length_so_far
        else:
            assert not whole[at]
    path = manifest.collect()[0].path
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_default_chunks_and_ids_of_records(spark):
    import re

    big = "é" * 1_200_000
    df = spark.createDataFrame([(1, "u", big, "d", 1), (2, "u", "z" * 200, "d", 1), (2, "u", "z" * 200, "d", 1), (3, "u", "z" * 200, "d", 1)], SCHEMA)
    manifest, folder = warc.archived(df)
    rows = warc.read(manifest, folder).collect()
    assert sorted(len(r.data) for r in rows if r.page_id == "1") == [2_400_000 - 2 * (1 << 20), 1 << 20, 1 << 20]
    assert [r.digest_so_far for r in rows if r.page_id == "1" and r.last] == [hashlib.sha256(big.encode()).hexdigest()]
    whole = b"".join(gzip.open(r.path).read() for r in manifest.collect())
    ids = re.findall(rb"WARC-Record-ID: (\S+)", whole)
    assert len(ids) == len(set(ids)) == 4 + manifest.count() and whole.count(b"HTTP/1.1 200 OK") == 4
    assert set(re.findall(rb"WARC-Refers-To: (\S+)", whole)) <= set(ids)
