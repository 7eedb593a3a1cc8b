"""Writers for reports and snapshots."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.counts import hide_zeros
from ..operators.reports import jvm_line

_LINE = "\n"


def jvm_details(report: DataFrame) -> DataFrame:
    """One text per JVM: the report line, then environment and system properties in key order."""
    empty = F.lit("")

    def section(title: str, column: str):
        listing = X.map_listing(F.col(column))
        return F.concat(F.lit(title + _LINE), F.when(F.size(column) > 0, F.concat(listing, F.lit(_LINE))).otherwise(empty))

    value = F.concat(
        F.col("line"), F.lit(_LINE),
        section("JVM Environment Variables : ", "env"), section("JVM System Properties : ", "sysprops"),
    )
    return jvm_line(report).select("host", "component_type", "pid", value.alias("value"))


def write_jvm_details(report: DataFrame, path: str) -> None:
    """A JSON row per JVM (host, component type, pid, text), in that order over the files of the folder."""
    # the text goes without its last line end; rows instead of a folder per JVM keep the number of files bounded
    rows = jvm_details(report).withColumn("value", F.regexp_replace("value", r"\n\z", ""))
    rows.orderBy("host", "component_type", "pid", "value").write.json(path)


def write_dump_reports(reports: DataFrame, path: str) -> None:
    reports.write.option("ignoreNullFields", "true").json(path)


def snapshot_json(counts: DataFrame, with_zeros: bool = True) -> DataFrame:
    """One JSON object per counter, so that a PU with very many keys never becomes one string."""
    kept = counts if with_zeros else hide_zeros(counts, "total")
    return kept.select(
        "pu", "partition_id", "axis", "key",
        F.to_json(F.struct("pu", "partition_id", "axis", "key", "total", "primary", "backup")).alias("json"),
    )


def write_snapshot(counts: DataFrame, path: str, with_zeros: bool = True) -> None:
    """JSON lines in (pu, partition, axis, key) order over the files of the folder."""
    order = ["pu", "partition_id", "axis", "key"]
    snapshot_json(counts, with_zeros).orderBy(*order).select("json").write.text(path)


def write_texts(rows: DataFrame, folder: str) -> None:
    """One file per row (directory, file_name, text) below ``folder``; a line feed closes each text.

    Tasks write the texts under names of Spark's choosing and the driver renames them, one call a file: it is meant for
    configuration files. The pair of directory and file name must be unique.
    """
    spark = rows.sparkSession
    staging = f"{folder}/_staging"
    rows.select("directory", "file_name", "text").write.partitionBy("directory", "file_name").text(staging)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    files = path_of(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(path_of(f"{staging}/directory=*/file_name=*/part-*")) or []:
        written_to = status.getPath()
        name, directory = (unquote(p.getName().split("=", 1)[1]) for p in (written_to.getParent(), written_to.getParent().getParent()))
        files.mkdirs(path_of(f"{folder}/{directory}"))
        if not files.rename(written_to, path_of(f"{folder}/{directory}/{name}")):
            raise FileExistsError(f"{folder}/{directory}/{name}")
