"""Files of many tasks, shown by their commit."""

import csv
import hashlib
import io
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkwell.sources import sink


def shown(at: Path) -> list[str]:
    return sorted(p.name for p in at.iterdir() if p.name[0] not in "._") if at.exists() else []


def test_csv_of_many_tasks(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('a,"b"\n'), "id")).alias("x.y"), (F.col("id") / 8).alias("z"))
    sink.write_parts(sink.csv_parts(rows, "all.csv"), f"file://{tmp_path}/out")
    assert shown(tmp_path / "out") == ["all.csv"] and (tmp_path / "out" / "_SUCCESS").exists() and not list((tmp_path / "out" / "_drafts").iterdir())
    got = list(csv.reader(io.StringIO((tmp_path / "out" / "all.csv").read_bytes().decode(), newline="")))
    want = [[str(r[0]), r[1] or "", str(r[2])] for r in rows.collect()]
    assert got == [["id", "x.y", "z"], *want]
    with pytest.raises(Exception, match="all.csv"):
        sink.write_parts(sink.csv_parts(rows.limit(1), "all.csv"), f"file://{tmp_path}/out")
    assert len((tmp_path / "out" / "all.csv").read_bytes()) > 5000
    sink.write_parts(sink.csv_parts(rows.filter("false"), "all.csv"), f"file://{tmp_path}/out", overwrite=True)
    assert (tmp_path / "out" / "all.csv").read_text() == "id,x.y,z\n"


def test_zip_of_many_crops(spark, tmp_path, monkeypatch):
    """100,000 files of a page, more than the plain format counts, and two smaller pages."""
    named = spark.range(100_030).select(F.when(F.col("id") < 100_000, 1).otherwise(F.col("id") % 2 + 2).alias("page_id"), F.format_string("eq_%06d.png", "id").alias("name"), F.encode(F.sha2(F.col("id").cast("string"), 512), "utf-8").alias("png"))
    sink.write_parts(sink.zip_parts(named), f"file://{tmp_path}/out")
    assert shown(tmp_path / "out") == ["1.zip", "2.zip", "3.zip"]
    with zipfile.ZipFile(tmp_path / "out" / "1.zip") as archive:
        names = archive.namelist()
        assert len(names) == 100_000 and names == sorted(names)
        assert all(archive.read(f"eq_{k:06d}.png").decode() == hashlib.sha512(str(k).encode()).hexdigest() for k in (0, 77, 65_536, 99_999))
    assert len(zipfile.ZipFile(tmp_path / "out" / "2.zip").namelist()) == 15 and zipfile.ZipFile(tmp_path / "out" / "3.zip").testzip() is None


def test_failed_job(spark, tmp_path):
    """A task that fails after others have written: nothing is shown, no draft stays."""
    parts = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.struct(F.lit(0).cast("long").alias("task"), F.lit(0).cast("long").alias("seq")).alias("part"), F.encode(F.when(F.col("id") == 33, F.raise_error(F.lit("stopped"))).otherwise("x"), "utf-8").alias("data"))
    with pytest.raises(Exception, match="stopped"):
        sink.write_parts(parts, f"file://{tmp_path}/out")
    assert shown(tmp_path / "out") == [] and not list((tmp_path / "out").glob("_drafts/*"))
    bad = parts.filter("name = 'f1'").withColumn("name", F.lit("../f1"))
    with pytest.raises(Exception, match="no name of a file"):
        sink.write_parts(bad, f"file://{tmp_path}/out")


def test_no_parts(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, name string, png binary")
    sink.write_parts(sink.zip_parts(none), f"file://{tmp_path}/out")
    assert shown(tmp_path / "out") == [] and (tmp_path / "out" / "_SUCCESS").exists()
