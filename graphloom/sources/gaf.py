"""GAF alignment records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.lines import numbered_lines

FIELDS = ("q_name", "q_len", "q_start", "q_end", "q_fwd", "path", "p_len", "p_start", "p_end", "match", "block", "qual")
_TEXT = ("q_name", "path")


def _tags(kinds: str, cast: str) -> Column:
    """A map of the tags of some kinds; a value that is no number drops its tag."""
    own = F.filter("tags", lambda x: x.rlike(f"^[A-Za-z0-9]{{2}}:[{kinds}]:"))
    pairs = F.transform(own, lambda x: F.struct(F.left(x, F.lit(2)).alias("key"), F.substr(x, F.lit(6)).try_cast(cast).alias("value")))
    known = F.filter(pairs, lambda p: p["value"].isNotNull())
    # of repeated tags the last one counts
    last = F.filter(known, lambda p, i: ~F.exists(F.slice(known, i + 2, F.size(known)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def parse(lines: DataFrame) -> DataFrame:
    """lines (line, value) as records. `*` stands for a field's default (0, an empty text, or null for orientation).

    A line with fewer than 12 fields is an error; tags that cannot be read are left out.
    """
    f = lines.withColumn("f", F.split("value", "\t"))
    f = f.withColumn("f", F.when(F.size("f") >= 12, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("GAF record with fewer than 12 fields: "), F.col("value")))))
    f = f.withColumn("tags", F.slice("f", F.lit(13), F.size("f")))
    cols = []
    for i, name in enumerate(FIELDS):
        x = F.get("f", F.lit(i))
        if name == "q_fwd":
            cols.append(F.when(x == "*", None).otherwise(x == "+").alias(name))
        elif name in _TEXT:
            cols.append((x if name == "path" else F.when(x == "*", "").otherwise(x)).alias(name))
        else:
            cols.append(F.when(x == "*", 0).otherwise(x.try_cast("long")).cast("long").alias(name))
    return f.select(*["file"] * ("file" in lines.columns), "line", *cols, _tags("AZ", "string").alias("tag_az"), _tags("i", "int").alias("tag_i"), _tags("f", "float").alias("tag_f"))


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Records with file and line, their number in the file, ascending by one."""
    return parse(numbered_lines(spark, path, (F.col("value") != "") & ~F.col("value").startswith("#")))


def as_lines(records: DataFrame) -> DataFrame:
    """value: the mandatory fields of each record as text."""
    cols = [F.when(F.col("q_fwd").isNull(), "*").when(F.col("q_fwd"), "+").otherwise("-") if c == "q_fwd" else F.col(c).cast("string") for c in FIELDS]
    return records.select(F.concat_ws("\t", *cols).alias("value"))
