"""Readers and writers of reads, statistics, FASTQ, manifests and summaries."""

from __future__ import annotations

import warnings

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.operators.nested import nest
from tidewater.storage import stored

from .fastq import FastqSource, opened, parse_fastq  # noqa: F401

READS = "read_id string, adc array<smallint>, offset_adc double, scale double, read_sample_rate double, run_sample_rate double"
STATS = (
    "name string, barcode string, read_length string, qstart string, qend string, acc string, coverage string, "
    "mean_quality string, ref string, rstart string, rend string"
)


def read_files(spark: SparkSession, root: str, subdirs: tuple[str, ...] = (".",), files: tuple[str, ...] = ()) -> list[str]:
    """The Parquet files of a split: an explicit list wins, else all below ``subdirs`` of ``root``, of which missing ones are skipped."""
    # a pattern that matches in part is no error to Spark, a path that is missing is
    names = [s.strip("/") for s in subdirs]
    below = root if "." in names else f"{root.rstrip('/')}/{{{','.join(names)}}}"  # the root holds all its subdirs
    where = list(files) or [below]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    try:
        found = reader.load(where).inputFiles()
    except AnalysisException as e:
        raise FileNotFoundError(f"no read files in {where}") from e
    if not found:
        raise FileNotFoundError(f"no read files in {where}")
    return sorted(found)


#: What a damaged file's error says, by the reason that is recorded; any other error is raised.
DAMAGE = {
    "no parquet file": ("magic bytes not found", "file size is 0 bytes", "smaller than the minimum"),
    "damaged footer": ("deserialize thrift", "footer", "Corrupt"),
}


def probe(path: str) -> str | None:
    """The reason why a Parquet file can't be read, None if its footer can; errors of other kinds are raised."""
    fs, where = opened(path)
    try:
        with fs.open_input_file(where) as file:
            pq.ParquetFile(file)
    except (pa.ArrowInvalid, OSError) as e:
        text = str(e)
        reason = next((r for r, marks in DAMAGE.items() if any(m in text for m in marks)), None)
        if reason is None or isinstance(e, FileNotFoundError):
            raise
        return reason
    return None


def quarantined(spark: SparkSession, quarantine: str) -> DataFrame:
    """path, reason of the files that earlier scans found damaged."""
    try:
        return spark.read.schema("path string, reason string").json(quarantine)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, reason string")


def scan_reads(
    spark: SparkSession, root: str, subdirs: tuple[str, ...] = (".",), files: tuple[str, ...] = (),
    schema: StructType | str = READS, skip_corrupt: bool = False, quarantine: str | None = None,
) -> DataFrame:
    """Reads of the Parquet files of a split (`read_files`), with their file as ``path``. No file at all is an error.

    ``skip_corrupt`` passes over damaged files for good: a job opens the footers of those not known yet, the damaged ones are
    written with the reason to the table at ``quarantine`` (``_quarantine`` below the root) with one warning, and no
    later scan opens them. Errors of any other kind are raised, as is damage that a footer doesn't show.
    """
    found = read_files(spark, root, subdirs, files)
    if skip_corrupt:
        quarantine = quarantine or f"{root.rstrip('/')}/_quarantine"
        paths = spark.createDataFrame([(f,) for f in found], "path string")
        new = paths.join(quarantined(spark, quarantine), "path", "left_anti")
        checked = F.pandas_udf(lambda names: names.map(probe), "string")("path")
        tasks = min(len(found), 8 * spark.sparkContext.defaultParallelism)
        checked = stored(new.repartition(tasks).select("path", checked.alias("reason")), "probed")
        bad = checked.where("reason is not null")
        n = bad.count()
        if n:
            bad.coalesce(1).write.mode("append").json(quarantine)
            warnings.warn(f"{n} damaged read files are passed over, see {quarantine}", stacklevel=2)
        found = [r.path for r in checked.where("reason is null").collect()]  # the files of the scan, as Spark itself lists them
        if not found:
            return spark.createDataFrame([], schema).withColumn("path", F.lit(None).cast("string"))
    return spark.read.schema(schema).parquet(*found).withColumn("path", F.col("_metadata.file_path"))


def write_bytes(path: str, content: bytes) -> None:
    fs, where = opened(path)
    with fs.open_output_stream(where) as file:
        file.write(content)


def write_reads(reads: DataFrame, path: str) -> None:
    """Replace what is at ``path``; one folder per source file."""
    reads.write.mode("overwrite").partitionBy("source_file").parquet(path)


def scan_stats(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """Tab-separated statistics with a header, gzip or plain; a gzip file is one task, so it is dealt out after reading."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=STATS)
    return rows.repartition(parts) if parts else rows


def scan_fastq(spark: SparkSession, *paths: str, split: int = 64 << 20) -> DataFrame:
    """read_id, seq, qual of FASTQ files or folders, gzip by content whatever the suffix; of a repeated id the last record counts.

    A large file is read by several tasks, which find their own first record (`sources.fastq`); only records are shuffled.
    """
    spark.dataSource.register(FastqSource)
    rows = spark.read.format(FastqSource.name()).option("split", split).load("\n".join(paths))
    last = rows.groupBy("read_id").agg(F.max_by(F.struct("seq", "qual"), F.struct("path", "at")).alias("r"))
    return last.select("read_id", "r.seq", "r.qual")


def write_fastq(calls: DataFrame, path: str) -> None:
    text = F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id").cast("string")), "seq", F.lit("+"), "qual")
    calls.select(text.alias("value")).write.mode("overwrite").text(path, compression="gzip")


def scan_manifest(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The selected reads of a manifest document."""
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return doc.select(F.explode("selected_reads").alias("r")).select("r.source_file", "r.read_id", "r.raw_length")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A one-row document; columns with dots in their names (`nested.nest`) become its branches."""
    nest(summary).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_history(results: DataFrame, path: str, evaluation: str = "evaluation") -> None:
    """Add documents to a history, by the id of their evaluation in the column ``evaluation``.

    An evaluation is a folder of its own that is replaced as a whole, so a write that is repeated adds nothing, and writers of
    different evaluations don't meet. Documents may be of any form: results, or ``failures``.
    """
    writer = results.write.mode("overwrite").partitionBy(evaluation).option("partitionOverwriteMode", "dynamic")
    writer.option("ignoreNullFields", False).json(path)


def failures(evaluations: DataFrame) -> DataFrame:
    """evaluation, step, status, checkpoint_path: the documents of evaluations that failed."""
    return evaluations.select("evaluation", "step", F.lit("failed").alias("status"), "checkpoint_path")


def read_history(spark: SparkSession, path: str, schema: str, evaluation: str = "evaluation") -> DataFrame:
    """All documents of a history, the id of the evaluation first; what a document lacks is null."""
    rows = spark.read.schema(schema).json(path)
    return rows.select(evaluation, *[c for c in rows.columns if c != evaluation])
