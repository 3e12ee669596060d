import pathlib

from pyspark.sql import functions as F

from doctree.functions import tables
from doctree.operators import convert, extract


def on_disk(folder):
    return sum(x.stat().st_size for x in pathlib.Path(folder).rglob("*") if x.is_file())


def in_small_slices(spark, monkeypatch, folder, slices=3):
    """From now on work tables go to the folder, in slices of some KB; the bytes of disk after each table."""
    monkeypatch.setattr(tables, "SLICE_BYTES", 1)
    monkeypatch.setattr(tables, "SLICES", slices)
    monkeypatch.setattr(tables, "shared_dir", lambda spark: "file://" + str(folder))
    sizes, write = [], tables._write
    monkeypatch.setattr(tables, "_write", lambda *a, **b: (write(*a, **b), sizes.append(on_disk(folder)))[0])
    return sizes


def pages_of(spark, n):
    text = F.concat_ws(" ", *[F.sha2(F.concat("id", F.lit(i)), 256) for i in range(40)])
    body = F.concat(F.lit("<p>"), text, F.lit("</p><p><b>"), text, F.lit("</b></p><ac:structured-macro ac:name='info'><ac:rich-text-body><p>"), text, F.lit("</p></ac:rich-text-body></ac:structured-macro>"))
    rows = spark.range(0, n, 1, 4).withColumn("page_id", F.when(F.col("id") > 0, F.col("id").cast("string")))
    return rows.select(F.lit("s").alias("scope_id"), "page_id", F.lit(1).alias("version"), body.alias("body"))


def test_conversion_in_slices(spark, monkeypatch, tmp_path):
    pages = pages_of(spark, 240).where("page_id is not null")
    paths = pages.select("scope_id", "page_id", F.concat(F.lit("docs/"), "page_id", F.lit(".md")).alias("path"))
    tree = pages.select("scope_id", "page_id", F.lit("t").alias("title"))
    of = lambda: convert.storage_to_markdown(pages, tree, tree.select("scope_id", "page_id", F.lit(0).alias("bfs_ord")), paths)
    whole = sorted(map(tuple, of().collect()))
    sizes = in_small_slices(spark, monkeypatch, tmp_path)
    assert sorted(map(tuple, of().collect())) == whole and len(whole) == 239
    assert len(list(tmp_path.glob("bodies-*"))) > 2  # the slices' results, nothing else but narrow tables
    assert {x.name.split("-")[0] for x in tmp_path.iterdir()} == {"bodies", "titles", "order", "paths"}
    body = len(pages.first()["body"]) * 239
    assert max(sizes) < 2 * body, (max(sizes), body)


def test_blocks_in_slices(spark, monkeypatch, tmp_path):
    pages = pages_of(spark, 60)
    whole = sorted(map(repr, extract.extract_blocks(pages).collect()))
    sizes = in_small_slices(spark, monkeypatch, tmp_path)
    assert sorted(map(repr, extract.extract_blocks(pages).collect())) == whole and len(whole) == 180
    assert {x.name.split("-")[0] for x in tmp_path.iterdir()} == {"bodies"}
    assert max(sizes) < 2 * len(pages.first()["body"]) * 60


def test_a_long_file_comes_in_parts_and_an_empty_table_in_one(spark, monkeypatch, tmp_path):
    sizes = in_small_slices(spark, monkeypatch, tmp_path, 8)
    seen = []
    rows = spark.range(0, 2000, 1, 1).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    found = tables.in_slices(rows, ["k"], "t", lambda some: (seen.append(some.count()), some)[1])
    assert found.count() == found.distinct().count() == 2000 and len(seen) > 3 and max(seen) < 1000 and sizes
    assert tables.in_slices(rows.limit(0), ["k"], "t", lambda some: some).count() == 0
