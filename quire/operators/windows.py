"""Window forms of logic that is sequential in a text: the same results as the folds in
``quire.functions``, as plans over exploded characters and lines. Use them where one text is too
long for a fold, which a single task must walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def characters(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """A row for each character: key, pos from 0, ch."""
    return df.select(*key, F.posexplode(T.chars(F.coalesce(text, F.lit("")))).alias("pos", "ch"))


def circle_pair_rows(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, pos, ch, mark: each mark with the last Han character before it, two for a character value at most."""
    is_mark = lambda x: F.lit(T.CIRCLE_MARKS).contains(x["ch"])
    # of a text's characters only marks, and the Han ones that a mark comes next to but for others, go through the windows
    every = F.transform(T.chars(F.coalesce(text, F.lit(""))), lambda ch, i: F.struct(i.alias("pos"), ch.alias("ch")))
    told = df.select(*key, F.filter(every, lambda x: T.is_han(x["ch"]) | is_mark(x)).alias("_told"))
    kept = told.select(*key, F.explode(F.filter("_told", lambda x, i: is_mark(x) | is_mark(F.get("_told", i + 1)))).alias("_c")).select(*key, "_c.pos", "_c.ch")
    order = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    seen = kept.withColumn("last", F.last(F.when(T.is_han(F.col("ch")), F.col("ch")), ignorenulls=True).over(order))
    marks = seen.filter(F.lit(T.CIRCLE_MARKS).contains(F.col("ch")) & F.col("last").isNotNull())
    place = F.row_number().over(Window.partitionBy(*key, "last").orderBy("pos"))
    return marks.withColumn("place", place).filter("place <= 2").select(*key, "pos", F.col("last").alias("ch"), T.same_mark(F.col("ch")).alias("mark"))


def multiset_overlap(left: DataFrame, right: DataFrame, key: list[str], item: list[str]) -> DataFrame:
    """key and overlap: the size of the intersection of two multisets."""
    a = left.groupBy(*key, *item).agg(F.count("*").alias("n"))
    b = right.groupBy(*key, *item).agg(F.count("*").alias("m"))
    return a.join(b, [*key, *item]).groupBy(*key).agg(F.sum(F.least("n", "m")).alias("overlap"))


def line_runs(lines: DataFrame, key: list[str]) -> DataFrame:
    """From key, pos, line: the longest run of equal lines (gaps and islands), the number of
    lines, and how often the most frequent one occurs."""
    order = Window.partitionBy(*key).orderBy("pos")
    changed = F.when(F.col("line") == F.lag("line").over(order), 0).otherwise(1)
    islands = lines.withColumn("island", F.sum(changed).over(order))
    runs = islands.groupBy(*key, "island", "line").agg(F.count("*").alias("n"))
    frequent = runs.groupBy(*key, "line").agg(F.sum("n").alias("times"), F.max("n").alias("run"))
    return frequent.groupBy(*key).agg(F.max("run").alias("longest_run"), F.sum("times").alias("n_lines"), F.max("times").alias("most_frequent"))


def derived_widths(columns: DataFrame, key: list[str]) -> DataFrame:
    """From key, x: width as the distance to the next column on the left, the last one's from the spread."""
    falling = Window.partitionBy(*key).orderBy(F.desc("x"))
    whole = Window.partitionBy(*key)
    return columns.withColumn("w", F.coalesce(F.col("x") - F.lead("x").over(falling), F.max("x").over(whole) - F.min("x").over(whole)))


def cell_positions(tokens: DataFrame, key: list[str]) -> DataFrame:
    """From key, pos, width: the cell at which each token starts, a running sum of the widths before it."""
    before = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("cell", F.coalesce(F.sum("width").over(before), F.lit(0)))
