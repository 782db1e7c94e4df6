"""Records of large JSON files: one file with many records is read by several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SPLIT = ["file", "block"]
#: What stands before a record's opening brace, escapes masked: strings, signs (also closing ones) and flat objects, but not the object at the
#: end of the text. In a file that is an object its own brace comes first.
PLAIN = r'((?:[^"{]++|"[^"]*+"|\{(?:[^"{}]++|"[^"]*+")*+\}(?!$))*+)\{'
HEADER = r"(?s)^(\s*\{)" + PLAIN
#: The name of the array that a header opens.
NAME = r'(?s)"((?:[^"\\]|\\.)*+)"\s*:\s*\[\s*$'


def _before(df: DataFrame, value: Column) -> DataFrame:
    """For each split of a file the sum of value over the file's splits before it. One row a split is gathered."""
    sums = df.groupBy(*SPLIT).agg(F.sum(value).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*SPLIT, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def _running(df: DataFrame, value: Column, to: str, inclusive: bool) -> DataFrame:
    """df with the sum of value over the file up to each piece: the splits before its own, and its own by order."""
    within = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = F.coalesce(F.sum(value).over(within), F.lit(0))
    return df.join(_before(df, value), SPLIT).withColumn(to, own + F.col("before")).drop("before")


def json_records(spark: SparkSession, glob: str) -> DataFrame:
    """(file, name, record, outer): the objects in the arrays of JSON files, each as its own JSON text.

    A file is a list of objects (name is empty) or an object whose fields are arrays of objects (name is the field), scalars
    or other objects; outer is the file's text beside the records. Files are cut at closing braces, so that Spark reads
    the splits of a file at once. Whether a piece begins inside a string, how deep it ends and to which record it belongs
    follow from prefix sums over pieces: within a split by one task, over splits from one row each. A record's
    pieces then meet by its number. Files without records give no rows; what isn't JSON gives none or odd records.
    """
    scratch = Scratch(spark)
    raw = spark.read.text(glob, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    quoted = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)

    def depth(parity: int) -> Column:
        """How much deeper a piece ends, begun outside (0) or inside (1) a string; its closing brace is the cut itself."""
        outside = F.array_join(F.filter("quoted", lambda x, i: i % 2 == parity), "")
        closing = F.when((F.size("quoted") - 1 + parity) % 2 == 0, 1).otherwise(0)
        return F.regexp_count(outside, F.lit(r"[\[{]")) - F.regexp_count(outside, F.lit(r"[\]}]")) - closing

    pieces = raw.withColumn("quoted", quoted).select(*SPLIT, "at", "value", (F.size("quoted") - 1).alias("quotes"), depth(0).alias("d0"), depth(1).alias("d1"))
    pieces = _running(scratch.write(pieces), F.col("quotes"), "inside", inclusive=False)
    closes = ((F.col("inside") + F.col("quotes")) % 2 == 0).alias("closes")
    pieces = scratch.write(pieces.select(*SPLIT, "at", "value", closes, F.when(F.col("inside") % 2 == 0, F.col("d0")).otherwise(F.col("d1")).alias("d")))
    firsts = pieces.filter("block = 0").groupBy("file").agg(F.min_by(F.substring(F.ltrim("value"), 1, 1), "at").alias("first"))
    level = F.when(F.col("first") == "[", 1).otherwise(2)
    pieces = _running(pieces, F.col("d"), "depth", inclusive=True).join(firsts, "file").withColumn("ends", (F.col("closes") & (F.col("depth") == level)).cast("int"))
    pieces = scratch.write(pieces.select(*SPLIT, "at", "value", "first", "ends"))
    numbered = _running(pieces, F.col("ends"), "number", inclusive=False)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*SPLIT[1:], "at", "value"))), lambda x: F.concat(x.value, F.lit("}"))), "")
    texts = scratch.write(numbered.groupBy("file", "number").agg(text.alias("text"), F.max("ends").alias("whole"), F.first("first").alias("first")))
    masked = F.regexp_replace("text", r"(?s)\\.", "__")
    size = lambda p, *groups: sum((F.char_length(F.regexp_extract("masked", p, g)) for g in groups), F.lit(0))
    own = (F.col("first") == "{") & (F.col("number") == 0)
    rows = texts.filter("whole = 1").withColumn("masked", masked).withColumn("n", F.when(own, size(HEADER, 1, 2)).otherwise(size("(?s)^" + PLAIN, 1)))
    rows = rows.select("file", "number", "first", F.expr("substr(text, 1, n)").alias("header"), F.expr("substr(text, n + 1)").alias("record"))
    rows = scratch.write(rows)
    name = F.when((F.col("first") == "[") & (F.col("number") == 0), F.lit("")).otherwise(F.nullif(F.regexp_extract("header", NAME, 1), F.lit("")))
    # a header of more than a comma opens another array, or none: then what follows are no records
    starts = rows.filter(~F.col("header").rlike(r"^[\s,]*$")).select("file", F.col("number").alias("start"), name.alias("name"))
    starts = starts.withColumn("stop", F.lead("start").over(Window.partitionBy("file").orderBy("start"))).filter("name IS NOT NULL")
    # the rest of a file: headers and what comes after the last record
    headers = rows.filter(~F.col("header").rlike(r"^[\s,]*$")).select("file", "number", F.col("header").alias("value"))
    rest = headers.unionByName(texts.filter("whole = 0").select("file", "number", F.col("text").alias("value")))
    outer = rest.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "value"))), lambda x: x.value), "").alias("outer"))
    made = rows.join(starts, "file").filter("number >= start AND (stop IS NULL OR number < stop)").join(outer, "file", "left")
    return scratch.last(made.select("file", "name", "record", "outer"))
