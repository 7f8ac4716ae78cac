"""CSV text as a matrix of doubles: literal separators, no quoting, strict fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.errors import ReadingError
from weftline.frame import small


def read_matrix(spark: SparkSession, path: str, header_rows: int = 1, sep: str = ",", prefix: str = "f") -> DataFrame:
    """Columns ``f0 ..`` of doubles; the width is that of the first line after the header.

    A line of another width, or a field that is no number, raises an error as the
    rows are read. Header lines are skipped at the start of each file. Lines are
    split in Spark, so files may be of any size.
    """
    try:
        lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"))
        if header_rows:
            # A file's first block starts at byte 0, and its lines are numbered without gaps.
            first = lines.where("block = 0").groupBy("file").agg((F.min("at") + header_rows).alias("from"))
            lines = lines.join(small(first), "file", "left").where((F.col("block") > 0) | (F.col("at") >= F.col("from")))
        head = lines.where(F.trim("value") != "").orderBy("file", "block", "at").limit(1).collect()
    except Exception as e:
        if type(e).__name__ == "AnalysisException":
            raise ReadingError("CouldNotReadFileSystem", str(e)) from e
        raise
    if not head:
        raise ReadingError("NoRowsProvided", "The source has no rows after the header")
    n = len(head[0]["value"].split(sep))
    parts = F.split("value", f"\\Q{sep}\\E", -1)
    fields = F.when(F.size("p") == n, F.col("p")).otherwise(F.raise_error(F.concat(F.lit(f"InvalidRow: expected {n} fields in: "), F.col("value"))).cast("array<string>"))
    number = lambda j: F.coalesce(F.expr(f"try_cast(trim(q[{j}]) as double)"), F.raise_error(F.concat(F.lit("InvalidField: "), F.col("q")[j], F.lit(f" in column {j}"))).cast("double"))
    rows = lines.where(F.trim("value") != "").select("value", parts.alias("p")).select(fields.alias("q"))
    return rows.select(*(number(j).alias(f"{prefix}{j}") for j in range(n)))


def write_matrix(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.csv(path, sep=sep, header=header)
