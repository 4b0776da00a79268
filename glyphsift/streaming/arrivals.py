"""Files that arrive in a directory, analysed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphsift import schemas
from glyphsift.plans import pipeline
from glyphsift.sources.config import Config


def arriving(spark: SparkSession, path: str, pattern: str = "*", files_a_trigger: int = 1000) -> DataFrame:
    """New files under ``path`` as a stream of binaries."""
    return spark.readStream.format("binaryFile").schema(schemas.BINARIES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_trigger).load(path)


def start(stream: DataFrame, target: str, checkpoint: str, config: Config = Config(), once: bool = True):
    """Writes the found strings of each batch of files to Parquet; equal strings join within their file.

    Each batch is an ordinary plan, so whole-file operators hold; batch ids name the folders, so that a
    batch that is repeated after a failure replaces what it had written.
    """

    def batch(files: DataFrame, number: int) -> None:
        found = pipeline.found_strings(pipeline.strings_of_files(files, config), config)
        pipeline.public(found).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
