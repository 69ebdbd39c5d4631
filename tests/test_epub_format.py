import time
import zipfile

import pytest

from lectern.sources import epub, epub_format
from test_books import book


@pytest.fixture(scope="module")
def shelf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("shelf")
    for n in ("a", "b"):
        book(at / f"{n}.epub")
    (at / "c.epub").write_bytes(b"no archive")
    (at / "notes.txt").write_text("not taken")
    epub_format.register(spark)
    return at


def shown(df, under):
    return [(r.epub.rsplit("/", 1)[-1], r.spine, r.href, r.media_type, r.content and bytes(r.content), r.protected) for r in df.collect() if under in r.epub]


def key(rows):
    return sorted(rows, key=repr)


def test_the_rows_of_the_batch_reader(spark, shelf):
    for path in (str(shelf), f"file://{shelf}"):
        got = spark.read.format("epub").load(path)
        assert got.rdd.getNumPartitions() == 3
        assert key(shown(got, "shelf")) == key(shown(epub.read(spark, str(shelf)), "shelf"))
    assert spark.read.format("epub").load(str(shelf / "a.epub")).where("spine >= 0").count() == 3
    assert [r.href for r in epub.documents(spark.read.format("epub").load(str(shelf / "a.epub"))).orderBy("spine").collect()] == ["OEBPS/intro.xhtml", "OEBPS/a b.xhtml", "OEBPS/c.html"]


def test_filters_are_held_before_content_is_read(spark, shelf):
    df = spark.read.format("epub").load(str(shelf))
    for where, n in (("media_type = 'text/css'", 2), ("spine = 1", 2), ("spine IS NULL", 2), ("href LIKE 'OEBPS/c%'", 2), ("spine IN (0, 2) AND epub LIKE '%a.epub'", 2), ("protected IS NULL", 1), ("length(content) > 0 AND spine = 0", 2)):
        assert df.where(where).count() == n, where
    read = []

    class Watched(zipfile.ZipFile):
        def read(self, name, *a):
            read.append(name)
            return super().read(name, *a)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(epub.zipfile, "ZipFile", Watched)
        reader = epub_format.Reader(str(shelf / "a.epub"))
        left = list(reader.pushFilters([epub_format.EqualTo(("media_type",), "text/css")]))
        rows = list(reader.read(reader.partitions()[0]))
    assert left == [] and [r[2] for r in rows] == ["OEBPS/s.css"]
    assert read == ["META-INF/container.xml", "OEBPS/content.opf", "OEBPS/s.css"]


def test_missing_path(spark, shelf):
    with pytest.raises(Exception, match="FileNotFound|No such|nothing"):
        spark.read.format("epub").load(str(shelf / "nothing")).collect()


def test_stream_takes_each_file_once(spark, shelf, tmp_path):
    at = tmp_path / "in"
    at.mkdir()

    def run():
        stream = spark.readStream.format("epub").option("maxFilesPerTrigger", 1).load(str(at))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((r.epub.rsplit("/", 1)[-1], r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).groupBy("epub").count().collect())

    book(at / "one.epub")
    time.sleep(0.05)
    book(at / "two.epub")
    assert run() == [("one.epub", 5), ("two.epub", 5)]
    time.sleep(0.05)
    book(at / "three.epub")
    assert run() == [("one.epub", 5), ("three.epub", 5), ("two.epub", 5)]
