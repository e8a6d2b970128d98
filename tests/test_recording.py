import pytest
from pyspark.sql import functions as F

from weftline.operators import recording
from weftline.sources import readers


def test_record(spark, tmp_path):
    rows = [("http://a.b/", 200, None, "text/html", "<p>Hello there friend</p>"), ("http://a.b/x", 404, None, "text/html", "gone"), ("http://c", 200, "broken", None, None)]
    d = recording.record(spark.createDataFrame(rows, "url string, status_code int, error string, content_type string, content string"))
    assert sorted((r.slug, r.success) for r in d.collect()) == [("a_b", True), ("a_b_x", False), ("c", False)]
    assert tuple(recording.totals(d).collect()[0])[:3] == (3, 1, 2)
    recording.write(d, "2026-01-01", str(tmp_path / "r"))
    files = readers.manifest_files(spark.read.schema(readers.MANIFEST).json(str(tmp_path / "r" / "manifest"))).collect()
    assert [(f.slug, f.original_status, f.obfuscated) for f in files] == [("a_b", 200, True)]
    assert "Hello" not in spark.read.text(str(tmp_path / "r" / "pages")).agg(F.concat_ws("", F.collect_list("value"))).collect()[0][0]
    assert recording.totals(d.limit(0)).collect()[0].bytes == 0


def test_pages_share_files(spark, tmp_path):
    """Files don't grow in number with the sites; pages come back as they were, two of a slug as two."""
    path = str(tmp_path / "pages")
    rows = [(f"site_{i}", f"<p>{i}</p>\r\n\n") for i in range(300)] + [("007", ""), ("twice", "a"), ("twice", "b\n"), ("none", None)]
    readers.write_pages(spark.createDataFrame(rows, "slug string, html string").coalesce(2), path)
    assert len(list((tmp_path / "pages").rglob("part-*"))) <= 32
    assert sorted(map(repr, map(tuple, readers.recorded_pages(spark, path).collect()))) == sorted(map(repr, rows))
    some = readers.recorded_pages(spark, path, ["007", "twice", "absent"])
    assert sorted(map(tuple, some.collect())) == [("007", ""), ("twice", "a"), ("twice", "b\n")] and len(some.inputFiles()) <= 32
    assert readers.recorded_pages(spark, path, []).count() == 0


def test_pages_and_manifest_agree(spark, tmp_path):
    """Both come from one run of what makes the pages, though it may differ from run to run; files don't grow with sites."""
    d = spark.range(300).select(F.concat(F.lit("s"), "id").alias("slug"), F.concat(F.lit("http://s"), "id").alias("url"), F.concat(F.lit("s"), "id", F.lit("/index.html")).alias("path"), F.lit("text/html").alias("content_type"), F.lit(200).alias("status_code"), F.lit(True).alias("success"))
    d = d.withColumn("html", F.repeat(F.lit("x"), (F.rand() * 900).cast("int"))).withColumn("size_bytes", F.octet_length("html"))
    path = str(tmp_path / "r")
    recording.write(d, "2026-01-01", path)
    sizes = {f.slug: f.size_bytes for f in readers.manifest_files(spark.read.schema(readers.MANIFEST).json(f"{path}/manifest")).collect()}
    assert {r.slug: len(r.html) for r in readers.recorded_pages(spark, f"{path}/pages").collect()} == sizes and len(sizes) == 300
    assert len(list((tmp_path / "r").rglob("part-*"))) < 150


def test_reports_and_options(spark):
    one = spark.createDataFrame([("load", 5)], "mode string, consumers int")
    assert recording.simulation_report(one, one).collect()[0].report == '{"config":{"mode":"load","consumers":5},"result":{"mode":"load","consumers":5}}'
    recording.check_options(1.0, 0.0, 4000)
    for bad in ({"timeout": 0}, {"delay": -1}, {"max_chars": 3999}):
        with pytest.raises(ValueError):
            recording.check_options(**bad)
