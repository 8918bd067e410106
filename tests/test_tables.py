"""Given tables as folders of files, and pages that share one URL."""

import glob

import pytest
from pyspark.sql import functions as F

from crawlframe.plans import state_queries, stream_queries
from crawlframe.sources.events import RECORD
from crawlframe.streaming.runtime import run_available
from crawlframe.streaming.stages import Work

HTML = '<html lang="{}"><head><title>{}</title></head><body><a href="/x">x</a></body></html>'


@pytest.fixture(params=[1, 3])
def folder(spark, tmp_path, request):
    data = [(i, f"http://h.example.com/{i % 7}", HTML.format("en" if i % 7 < 4 else "es", f"t{i}")) for i in range(20)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    if request.param == 1:
        pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    else:
        pages.repartition(request.param).write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def test_streams_read_folders_and_files(spark, folder):
    rows = stream_queries.stream_upsert_pages(spark, folder).select("id", "title", "link_count").collect()
    assert sorted((int(r.id), r.title, r.link_count) for r in rows) == [(k, f"t{max(range(k, 20, 7))}", 1) for k in range(7)]


def test_one_row_a_url(spark, folder):
    rows = state_queries.upsert_pages(spark, folder).select("url_id", "title", F.substring("created_at", 6, 2).alias("month"))
    assert sorted((r.title, r.month) for r in rows.collect()) == sorted((f"t{max(range(k, 20, 7))}", "01" if k < 4 else "02") for k in range(7))
    assert rows.select("url_id").distinct().count() == 7


def test_few_records_of_many_partitions_are_few_files_and_tasks(spark, tmp_path):
    """A stage bounds its batches in files, so a batch in many partitions must not become as many files."""
    work = Work(spark, str(tmp_path / "work"))
    rows = spark.range(0, 400, 1, 40)
    records = rows.select(*[F.col("id").cast("string").cast(f.dataType).alias(f.name) if f.name == "key" else F.lit(None).cast(f.dataType).alias(f.name)
                            for f in RECORD.fields])
    work.publish(records, "url.discovered", "t", 0)
    folder = f"{work.topic('url.discovered')}/t-0"
    assert len(glob.glob(f"{folder}/*.parquet")) == 1
    assert spark.read.parquet(folder).select("key").distinct().count() == 400

    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        run_available(work.records("url.discovered"), str(tmp_path / "ck"),
                      lambda batch, _: seen.append(batch.groupBy("key").count().rdd.getNumPartitions()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen == [1]
