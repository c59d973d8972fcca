"""FASTA and FASTQ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.sources.lines import numbered_lines, numbered_records


def _records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """read_id and value: the text of each record, without its mark. Records are cut at line starts by the text reader
    itself, so a plain file is split between tasks at records; they are numbered by file and by the byte of their split."""
    raw = spark.read.option("lineSep", f"\n{mark}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    raw = raw.where("value <> ''").withColumn("at", F.monotonically_increasing_id())
    splits = raw.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", (before - F.col("first")).alias("shift"))
    return raw.join(splits, ["file", "split"]).select((F.col("at") + F.col("shift")).alias("read_id"), F.regexp_replace("value", f"^{mark}", "").alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """read_id, name, seq (upper case, lines joined)."""
    r = _records(spark, path, ">")
    lines = F.split("value", "\r?\n")
    return r.select("read_id", F.regexp_extract(F.get(lines, F.lit(0)), r"^(\S*)", 1).alias("name"), F.upper(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "")).alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_id, name, comment, seq, qual of records of four lines.

    Lines are grouped by their number in their file, so a quality line that starts with @ is no record, and a broken record
    at the end of a file is dropped without harm to the next file. read_id counts over the files in order of their names.
    """
    lines = numbered_lines(spark, path, F.col("value") != "")
    rec = lines.groupBy("file", F.floor(F.col("line") / 4).alias("line")).agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("l")).where("size(l) = 4")
    rec = numbered_records(rec, "read_id")
    v = [F.expr(f"l[{i}].value") for i in range(4)]
    head = F.substr(v[0], F.lit(2))
    return rec.select("read_id", F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("comment"), F.upper(v[1]).alias("seq"), v[3].alias("qual"))


def chunk(reads: DataFrame, first: int, n: int = 0) -> DataFrame:
    """The reads first .. first + n - 1 (n = 0: all from first on)."""
    return reads.where(F.col("read_id") >= first) if n == 0 else reads.where(F.col("read_id").between(first, first + n - 1))


def write_sequences(reads: DataFrame, path: str, kind: str | None = None) -> None:
    """plain, fasta or fastq text (by extension where kind is not given); name, seq and, for fastq, qual."""
    ext = path.rsplit(".", 1)[-1].lower()
    kind = kind or {"fa": "fasta", "fasta": "fasta", "fq": "fastq", "fastq": "fastq"}.get(ext, "plain")
    if kind not in ("plain", "fasta", "fastq"):
        raise ValueError(f"unsupported output format {kind}")
    text = {
        "plain": F.col("seq"),
        "fasta": F.concat(F.lit(">"), F.col("name"), F.lit("\n"), F.col("seq")),
        "fastq": F.concat(F.lit("@"), F.col("name"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("qual") if "qual" in reads.columns else F.repeat(F.lit("I"), F.length("seq"))),
    }[kind]
    reads.select(text.alias("value")).write.mode("overwrite").text(path)
