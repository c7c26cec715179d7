"""Removal of repeated passages by overlapping windows of consecutive lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infospan.llm.shared import spread_join, written


def windows(docs: DataFrame, id_col: str, text_col: str, lines: int = 3) -> DataFrame:
    """(id, version, pos, k1, k2): the 128-bit hash of the `lines` lines from each position; a shorter text has none."""
    parts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.split(text_col, "\n").alias("l")).where(F.size("l") >= lines)
    at = [f"l[i + {k}]" for k in range(lines)]
    hashed = F.expr(f"transform(sequence(0, size(l) - {lines}), i -> struct(xxhash64({', '.join(at)}) AS k1, xxhash64(1, {', '.join(at)}) AS k2))")
    return parts.select("id", "version", F.posexplode(hashed).alias("pos", "k")).select("id", "version", "pos", "k.k1", "k.k2")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = 3) -> DataFrame:
    """docs with text_col cut and, before it, n_lines and n_removed (int).

    A window of `lines` consecutive lines that occurs again, anywhere in the table, loses its later occurrences, the
    order being id (null first) and position; lines covered by any of them go and the others are joined again by line
    ends. A text of fewer lines stays; null stays null with 0 lines; a text may become empty. Rows that agree in id and
    text count as one document and get the same result. Texts of any length are cut whole. All other columns are kept,
    but for an input's own n_lines and n_removed, which the new ones replace.
    """
    found = written(windows(docs, id_col, text_col, lines), "line-windows")
    firsts = found.groupBy("k1", "k2").agg(F.min(F.struct("id", "version", "pos")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    firsts = written(firsts, "repeated-windows")
    later = spread_join(found, firsts.drop("rows"), ["k1", "k2"], F.xxhash64("id", "pos"), counts=firsts.select("k1", "k2", "rows")).where(~F.struct("id", "version", "pos").eqNullSafe(F.col("first")))
    covered = later.groupBy("id", "version").agg(F.sort_array(F.collect_set("pos")).alias("c"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_version"))
    joined = keyed.join(covered, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_version") == F.col("version")), "left")
    text = F.col(f"row.`{text_col}`")
    cut = joined.select("row", "c", F.split(text, "\n").alias("l")).select("row", "c", "l", F.when(F.col("c").isNotNull(), F.struct(*[F.expr(x) for x in (
        f"filter(c, (p, i) -> i = 0 OR p > get(c, i - 1) + {lines}) AS s",
        f"transform(filter(c, (p, i) -> i = size(c) - 1 OR get(c, i + 1) > p + {lines}), p -> p + {lines}) AS e",
    )])).alias("z"))
    segments = "transform(sequence(0, size(z.s)), j -> slice(l, coalesce(get(z.e, j - 1), 0) + 1, coalesce(get(z.s, j), size(l)) - coalesce(get(z.e, j - 1), 0)))"
    cut = cut.withColumn("kept", F.when(F.col("z").isNotNull(), F.expr(f"flatten({segments})")))
    n = F.coalesce(F.when(text.isNotNull(), F.size("l")), F.lit(0))
    new_text = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(text)
    removed = F.when(F.col("kept").isNotNull(), n - F.size("kept")).otherwise(F.lit(0))
    others = [(new_text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut.select(n.alias("n_lines"), removed.alias("n_removed"), *others)
