"""Level lines of a table over a grid: the segments of each cell, joined to lines by the points they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from infospan.operators.graphs import components
from infospan.sources.store import written


def segments(heat: DataFrame, level: float, x: str = "lag", y: str = "window", value: str = "mi") -> DataFrame:
    """(a, b): the pieces of the level's lines in each cell of a grid (x, y, value), by linear interpolation along the cell's sides.

    a and b are points struct<at, x, y>: `at` names the side (h or v and its lower end), so that neighbouring cells share their
    points exactly. A corner counts as above if its value is over the level. In a cell with two opposite corners above, the mean
    of the four decides which two are connected. Cells with a missing, null or NaN corner have none. The cell (x, y) stands once.
    """
    cells = heat.select(F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0"), F.when(~F.isnan(value), F.col(value)).alias("z"))
    right = Window.partitionBy("y0").orderBy("x0")
    rows = cells.select("*", F.lead("x0").over(right).alias("x1"), F.lead("z").over(right).alias("zr"))
    up = F.lead(F.struct("y0", "z", "x1", "zr")).over(Window.partitionBy("x0").orderBy("y0"))
    quads = rows.withColumn("u", up).where("u.x1 = x1").select("x0", "x1", "y0", F.col("u.y0").alias("y1"), F.col("z").alias("z00"), F.col("zr").alias("z10"), F.col("u.z").alias("z01"), F.col("u.zr").alias("z11"))
    quads = quads.where("z00 + z10 + z01 + z11 IS NOT NULL")

    def point(kind: str, x0: str, y0: str, end: str, low: str, high: str) -> F.Column:
        """Where the level crosses the side from (x0, y0) along x (h) or y (v)."""
        start = F.col(x0 if kind == "h" else y0)
        share = start + (F.lit(level) - F.col(low)) / F.nullif(F.col(high) - F.col(low), F.lit(0.0)) * (F.col(end) - start)
        at = F.concat_ws(":", F.lit(kind), F.col(x0).cast("string"), F.col(y0).cast("string"))
        return F.struct(at.alias("at"), (share if kind == "h" else F.col(x0)).alias("x"), (F.col(y0) if kind == "h" else share).alias("y"))

    above = {c: F.col(c) > level for c in ("z00", "z10", "z01", "z11")}
    bottom, top = point("h", "x0", "y0", "x1", "z00", "z10"), point("h", "x0", "y1", "x1", "z01", "z11")
    left, right_ = point("v", "x0", "y0", "y1", "z00", "z01"), point("v", "x1", "y0", "y1", "z10", "z11")
    crossed = [(above["z00"] != above["z10"], bottom), (above["z10"] != above["z11"], right_), (above["z01"] != above["z11"], top), (above["z00"] != above["z01"], left)]
    points = F.filter(F.array(*[F.when(c, p) for c, p in crossed]), lambda p: p.isNotNull())
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    middle = (F.col("z00") + F.col("z10") + F.col("z01") + F.col("z11")) / 4 > level
    saddle = F.when(above["z00"] != middle, F.array(pair(bottom, left), pair(right_, top))).otherwise(F.array(pair(bottom, right_), pair(left, top)))
    found = quads.withColumn("p", points)
    pieces = F.when(F.size("p") == 4, saddle).when(F.size("p") == 2, F.array(pair(F.get("p", F.lit(0)), F.get("p", F.lit(1)))))
    return found.select(F.explode(pieces).alias("s")).select("s.a", "s.b")


def contour_lines(heat: DataFrame, level: float, x: str = "lag", y: str = "window", value: str = "mi") -> DataFrame:
    """(line, x, y, segments, length): every point of every level line; line is the least name of its points, length the sum of its segments."""
    pieces = written(segments(heat, level, x, y, value), "segments")
    edges = pieces.select(F.col("a.at").alias("src"), F.col("b.at").alias("dst"))
    named = components(edges)
    points = pieces.select(F.explode(F.array("a", "b")).alias("p")).groupBy("p.at").agg(F.min("p.x").alias(x), F.min("p.y").alias(y)).withColumnRenamed("at", "node")
    measured = pieces.select(F.col("a.at").alias("node"), F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")).alias("d")).join(named, "node")
    sizes = measured.groupBy("component").agg(F.count("*").alias("segments"), F.sum("d").alias("length"))
    return named.join(points, "node").join(sizes, "component").select(F.col("component").alias("line"), x, y, "segments", "length")


def longest_line(lines: DataFrame) -> DataFrame:
    """The points of the line with the most segments, of equals the longest, then the first by name."""
    best = lines.agg(F.min_by("line", F.struct(-F.col("segments"), -F.col("length"), F.col("line"))).alias("line"))
    return lines.join(F.broadcast(best), "line")  # one row
