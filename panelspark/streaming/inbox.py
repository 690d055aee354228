"""Folders that files come into: new ones read as a stream and put away when they are done, old ones put away by age."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.files import aged

_FILE = "path string, modificationTime timestamp, length long, content binary"


def inbox(spark: SparkSession, path: str, pattern: str = "*.pdf", archive: str | None = None, files_a_trigger: int = 1000) -> DataFrame:
    """A stream of new files below a folder (path, modificationTime, length, content). With ``archive`` a batch's files are moved there once the next one is planned."""
    reader = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def archived(spark: SparkSession, folder: str, archive: str, now: datetime, days: int = 1, pattern: str = "*.json") -> int:
    """Moves files of a folder that are older than so many days into a folder of the archive named after the time, under the paths they had; how many.

    Spark lists the files and picks the old ones; a rename is one call to the file system each, made as they come from the list.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    due = aged(files.select("path", F.col("modificationTime").alias("modified")), now, days)
    target = f"{archive.rstrip('/')}/{now:%Y%m%d_%H%M%S}"
    fs, n = place(target).getFileSystem(spark._jsc.hadoopConfiguration()), 0
    root = fs.makeQualified(place(folder)).toUri().getPath()
    for row in due.select("path").toLocalIterator():
        old = place(row.path)
        new = place(target, old.toUri().getPath()[len(root) :].lstrip("/"))
        fs.mkdirs(new.getParent())
        if not fs.rename(old, new):
            raise OSError(f"cannot move {old} to {new}")
        n += 1
    return n
