"""Files that grow, read on from a mark: whole new lines, and the marks to go on from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = "path string, mark long"


def tail(spark: SparkSession, path: str, marks: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, marks): (path, at, line) of what files have gained since ``marks``, and (path, mark) after it.

    A mark is a byte of a file. Only lines that have ended are read; the start of a last line is left
    for the next time. With ``most``, a file's tail is its last ``most`` bytes, and the line that the
    cut falls into is left out. A file that is now shorter than its mark has been written anew and is
    read from the start. Files are read side by side; those that have not grown are listed only.
    """
    marks = marks if marks is not None else spark.createDataFrame([], MARKS)
    files = spark.read.format("binaryFile").load(path)
    known = files.select("path", "length").join(marks, "path", "left")
    start = F.when(F.col("mark") <= F.col("length"), F.col("mark")).otherwise(F.lit(0).cast("long"))
    known = known.select("path", "length", F.coalesce(start, F.lit(0).cast("long")).alias("start"))
    grown = files.select("path", "content").join(known.filter("length > start"), "path")
    from_ = F.greatest(F.col("start"), F.col("length") - F.lit(most)) if most else F.col("start")
    cut = from_ > F.col("start")
    body = F.expr("substring(content, cast(`from` + 1 as int), cast(length - `from` as int))")
    parts = grown.withColumn("from", from_).withColumns({"cut": cut, "body": body.cast("string")})
    rest = F.octet_length(F.substring_index("body", "\n", -1))
    ended = parts.withColumns({"mark": F.col("length") - rest, "all": F.split(F.expr("left(body, length(body) - length(substring_index(body, '\n', -1)))"), "\n")})
    whole = F.slice("all", F.when(F.col("cut"), 2).otherwise(1), F.greatest(F.size("all") - F.when(F.col("cut"), 2).otherwise(1), F.lit(0)))
    lines = ended.select("path", F.posexplode(whole).alias("at", "line"))
    after = known.select("path", "start").join(ended.select("path", F.col("mark").alias("now")), "path", "left").select("path", F.coalesce("now", "start").alias("mark"))
    gone = marks.join(known.select("path"), "path", "left_anti")
    return lines, after.unionByName(gone.select("path", "mark"))
