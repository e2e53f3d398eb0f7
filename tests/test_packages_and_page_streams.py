"""The data source of package members, and pages streamed with state."""

import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from sheafspark.sources import members
from sheafspark.streaming import paged


@pytest.fixture
def packages(spark, tmp_path):
    members.register(spark)
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"small{k}.docx", "w") as z:
            z.writestr("word/document.xml", f"<p>{k}</p>")
            z.writestr("media/", "")
            z.writestr("media/i.PNG", bytes(1000 * (k + 1)))
    with zipfile.ZipFile(tmp_path / "large.zip", "w") as z:
        for k in range(50):
            z.writestr(f"part{k}.bin", os.urandom(4000))
    (tmp_path / "broken.xlsx").write_bytes(b"PK no package")
    (tmp_path / "other.txt").write_text("x")
    (tmp_path / "_hidden.zip").write_bytes(b"")
    return str(tmp_path)


def test_members_of_small_and_large_packages(spark, packages):
    got = spark.read.format("members").option("splitBytes", 30_000).load(packages)
    rows = got.collect()
    good = [r for r in rows if r.error is None]
    assert len(good) == 56 and {r.suffix for r in good} == {"xml", "png", "bin"}
    assert all(len(r.content) == r.size_bytes and r.crc32 == zipfile.crc32(r.content) for r in good)
    assert [(os.path.basename(r.path), r.name) for r in rows if r.error] == [("broken.xlsx", None)]
    assert got.rdd.getNumPartitions() > 5  # the large package alone is seven splits
    assert spark.read.format("members").load(f"{packages}/large.zip").count() == 50


def test_filters_and_columns_reach_the_reader(spark, packages, monkeypatch):
    found = spark.read.format("members").schema("name string, suffix string, size_bytes long").load(packages).filter("suffix = 'png' and size_bytes > 1000 and name like 'media%'")
    assert sorted(r.size_bytes for r in found.collect()) == [2000, 3000]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # what the reader takes isn't filtered again
    assert "suffix" not in "".join(x for x in plan.splitlines() if x.strip().lstrip("*(1)+- ").startswith("Filter"))
    # nothing is read of a member whose content isn't asked for, or that the filters leave out
    read = []
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, m, pwd=None: read.append(m.filename) or b"")
    split = members.splits([(p, n) for p, n, _ in members.listed(packages, (".docx",))])[0]
    assert len(list(members.rows_of(split, ["name"], []))) == 6 and read == []
    list(members.rows_of(split, ["name", "content"], [(members.EqualTo, "suffix", "xml")]))
    assert read == ["word/document.xml"] * 3


def test_splits():
    found = [s.stretches for s in members.splits([("a", 10), ("b", 250), ("c", 5), ("d", 100)], 100)]
    assert [("b", 0, 83)] in found and [("b", 83, 166)] in found and [("b", 166, 250)] in found
    assert sorted(p for s in found for p, _, _ in s) == ["a", "b", "b", "b", "c", "d"]
    # small files share a split, each counting FILE_BYTES at least
    many = members.splits([(str(k), 10) for k in range(130)], 64 << 20)
    assert [len(s.stretches) for s in many] == [64, 64, 2]


def test_directories_that_splits_read_grow_with_a_package(spark, tmp_path):
    """Every split of a package reads its directory: together about a package's size, however small splits are to be."""
    members.register(spark)
    for n in (200, 2000):
        at = str(tmp_path / f"{n}.zip")
        with zipfile.ZipFile(at, "w") as z:
            z.comment = b"c" * 5000
            for k in range(n):
                z.writestr(f"m{k}", f"{k}" * 20)
        size = os.path.getsize(at)
        with zipfile.ZipFile(at) as z:
            own = size - z.start_dir - 22 - 5000
        assert members.directory_bytes(at, size) == own
        found = spark.read.format("members").option("splitBytes", 1000).load(at)
        parts = found.rdd.getNumPartitions()
        assert 1 < parts and (parts - 1) * own < size
        assert {r.name: bytes(r.content) for r in found.select("name", "content").collect()} == {f"m{k}": (f"{k}" * 20).encode() for k in range(n)}
    (tmp_path / "no.zip").write_bytes(b"x" * 90_000)
    assert members.directory_bytes(str(tmp_path / "no.zip"), 90_000) == 0 == members.directory_bytes(str(tmp_path / "gone.zip"), 5)


def test_written_packages_come_back(spark, tmp_path):
    members.register(spark)
    at = str(tmp_path / "out")
    rows = spark.range(40).select(F.concat(F.lit("n"), "id").alias("name"), F.encode(F.repeat(F.lit("é"), F.col("id").cast("int")), "UTF-8").alias("content"))
    rows.repartition(3).write.format("members").mode("append").option("path", at).save()
    assert len(os.listdir(at)) == 3 and all(n.startswith("part-") for n in os.listdir(at))
    assert {r.name: len(r.content) for r in spark.read.format("members").load(at).collect()} == {f"n{i}": 2 * i for i in range(40)}
    with pytest.raises(Exception, match="two members"):
        rows.select(F.lit("same").alias("name"), "content").coalesce(1).write.format("members").mode("append").option("path", at).save()
    assert spark.read.format("members").load(at).count() == 40  # a failed job shows nothing


def test_stream_of_packages_goes_on_where_it_was(spark, tmp_path):
    members.register(spark)
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    os.mkdir(source)

    def put(k):
        with zipfile.ZipFile(f"{source}/.{k}", "w") as z:
            z.writestr(f"m{k}", "x")
        os.rename(f"{source}/.{k}", f"{source}/{k}.zip")

    def run():
        q = spark.readStream.format("members").schema("name string").load(source).writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.name for r in spark.read.parquet(target).collect())

    put(1), put(2)
    assert run() == ["m1", "m2"]
    put(3)
    assert run() == ["m1", "m2", "m3"] == run()


def test_a_source_can_be_added(spark):
    class Numbers(members.DataSource):
        @classmethod
        def name(cls):
            return "numbers"

        def schema(self):
            return "n int"

        def reader(self, schema):
            class One(members.DataSourceReader):
                def read(self, partition):
                    yield from ((k,) for k in range(3))

            return One()

    members.add(Numbers)
    members.register(spark)
    assert [r.n for r in spark.read.format("numbers").load().collect()] == [0, 1, 2]
    del members.SOURCES["numbers"]


SCHEMA = "doc string, place long, content string, n_pages long"


def stream_of(spark, folder, **options):
    return paged.page_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), "doc", "place", "content", "n_pages", **options)


def put(spark, folder, rows, at):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.02)


def test_pages_in_order_over_batches_and_a_restart(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    put(spark, source, [("a", 1, "a1", 4), ("b", 0, "b0", 2), ("a", 1, "a1", 4), (None, 0, "lost", 1), ("c", None, "lost", 1)], 0)
    put(spark, source, [("a", 0, "a0", 4), ("c", 0, "c0", 1)], 1)
    first = paged.run(stream_of(spark, source), target, mark)
    assert len([b for b in first if b["rows"]]) == 2
    rows = lambda: sorted((r.doc, r.page_id or 99, r.content, r.is_end, r.n_pages, r.timed_out, r.late) for r in spark.read.parquet(target).collect())
    page = lambda d, k, c, late=False: (d, k, c, False, None, False, late)
    assert rows() == [page("a", 1, "a0"), page("a", 2, "a1"), page("b", 1, "b0"), page("c", 1, "c0"), ("c", 99, None, True, 1, False, False)]
    # another process goes on from the checkpoint: places with a gap, and a page after the end
    put(spark, source, [("a", 9, "a9", 4), ("b", 1, "b1", 2)], 2)
    put(spark, source, [("a", 7, "a7", 4), ("c", 5, "again", 1)], 3)
    paged.run(stream_of(spark, source), target, mark)
    assert rows() == sorted([page("a", 1, "a0"), page("a", 2, "a1"), page("a", 3, "a7"), page("a", 4, "a9"), ("a", 99, None, True, 4, False, False), page("b", 1, "b0"), page("b", 2, "b1"), ("b", 99, None, True, 2, False, False), page("c", 1, "c0"), ("c", 99, None, True, 1, False, False), page("c", 2, "again", True)])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != paged.ROCKSDB


def test_a_document_without_an_end_times_out(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    put(spark, source, [("a", 0, "a0", None), ("a", 2, "a2", None)], 0)
    paged.run(stream_of(spark, source, timeout_ms=1), target, mark)
    put(spark, source, [("b", 0, "b0", 1)], 1)
    time.sleep(0.1)
    paged.run(stream_of(spark, source, timeout_ms=1), target, mark)
    got = sorted((r.page_id or 99, r.content, r.is_end, r.n_pages, r.timed_out) for r in spark.read.parquet(target).filter("doc = 'a'").collect())
    assert got == [(1, "a0", False, None, False), (2, "a2", False, None, False), (99, None, True, 2, True)]
