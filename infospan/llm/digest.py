"""Canonical exact fingerprints of documents, in DataFrame functions only.

A text's canonical form is its NFKC form with full case folding and every run of white space made one space. Its
fingerprint is a 128-bit xxhash of that form; canonical forms that share a hash are compared byte by
byte, and where they differ the fingerprints get a number, so equal fingerprints mean equal forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from infospan.llm.shared import shuffle_partitions, spread_join, written

#: White space that NFKC leaves; only runs that aren't one plain space are replaced.
_SPACES = "\\t-\\r\\x{85}\\x{1680}\\x{2028}\\x{2029}"
FOLDED = f"[{_SPACES}][ {_SPACES}]*| [ {_SPACES}]+"


def _java(cls: str, method: str, *args: Column) -> Column:
    """A static method of the ICU library that Spark itself brings along."""
    return F.call_function("java_method", F.lit(f"com.ibm.icu.{cls}"), F.lit(method), *args)


def canonical(text: Column) -> Column:
    nfkc = lambda c: _java("text.Normalizer", "compose", c, F.lit(True))
    folded = nfkc(_java("lang.UCharacter", "foldCase", nfkc(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, FOLDED, " "))


def wide_hash(form: Column) -> tuple[Column, Column]:
    """Two XXH64 sums of different seeds."""
    return F.xxhash64(form), F.xxhash64(F.lit(1), form)


Hash = Callable[[Column], tuple[Column, Column]]


def _hex(k1: Column, k2: Column, number: Column | None = None) -> Column:
    digits = F.lower(F.concat(F.lpad(F.hex(k1), 16, "0"), F.lpad(F.hex(k2), 16, "0")))
    return digits if number is None else F.when(number > 0, F.concat(digits, F.lit("-"), number)).otherwise(digits)


def clashes(hashed: DataFrame) -> DataFrame:
    """(k1, k2, form, number) of the hashes that stand for different forms; hashed has (id, text, k1, k2).

    Only texts whose hash occurs again are compared, by their forms; copies combine before the shuffle, so a hot hash costs a row a task.
    """
    counts = written(hashed.groupBy("k1", "k2").agg(F.count("*").alias("rows")).where("rows > 1"), "repeated-hashes")
    again = spread_join(hashed.select("id", "text", "k1", "k2"), counts.drop("rows"), ["k1", "k2"], F.xxhash64("id"), counts=counts)
    forms = again.select("k1", "k2", canonical(F.col("text")).alias("form"))
    ends = forms.groupBy("k1", "k2").agg(F.min("form").alias("low"), F.max("form").alias("high"))
    mixed = written(ends.where("low <> high").select("k1", "k2"), "clashes")
    if mixed.isEmpty():
        return mixed.select("k1", "k2", F.lit("").alias("form"), F.lit(0).alias("number"))
    different = forms.join(mixed, ["k1", "k2"], "left_semi").distinct()
    number = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("form")) - 1
    return written(different.withColumn("number", number), "clashes")


def _hashed(docs: DataFrame, id_col: str, text_col: str, hashes: Hash) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("form", canonical(F.col("text")))
    k1, k2 = hashes(F.col("form"))
    return written(rows.withColumns({"k1": k1, "k2": k2}).drop("form"), "hashed")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: Hash = wide_hash) -> DataFrame:
    """(id_col, text, fingerprint) for every row; null counts as empty, texts of any length are read whole.

    A fingerprint is 32 hexadecimal digits; where different forms share them, all but the first form by code
    point get a number behind. Repeated rows and empty texts are rows like any other.
    """
    hashed = _hashed(docs, id_col, text_col, hashes)
    number, hashed = _numbered(hashed)
    return hashed.select(F.col("id").alias(id_col), "text", _hex(F.col("k1"), F.col("k2"), number).alias("fingerprint"))


def _numbered(hashed: DataFrame) -> tuple[Column | None, DataFrame]:
    found = clashes(hashed)
    if found.isEmpty():
        return None, hashed
    return F.coalesce("number", F.lit(0)), hashed.withColumn("form", canonical(F.col("text"))).join(found, ["k1", "k2", "form"], "left")


def _bounds(ids: DataFrame, buckets: int) -> list:
    cuts = [i / buckets for i in range(1, buckets)]
    found = ids.agg(F.percentile_approx("id", cuts, 20 * buckets).alias("b")).first()["b"] if cuts else None
    return sorted(set(found or ()))


def _bucket(bounds: list) -> Column:
    """How many bounds are below the id, by binary search; ids that are equal share a bucket, null is in the lowest."""
    if not bounds:
        return F.lit(0)
    listed, steps = F.array(*map(F.lit, bounds)), [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) < F.col("id"), at + step).otherwise(at))


def with_next(rows: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """rows with next_<column>: the values of the next row in descending `id`, after the last those of the first.

    Rows go to ranges of ids of about equal size; each range also gets a copy of the row that follows it. Equal ids
    follow each other in the order of (k1, k2).
    """
    bucket = _bucket(_bounds(rows.select("id"), buckets))
    rows = rows.withColumn("bucket", bucket)
    heads = rows.select("bucket", "id").groupBy("bucket").agg(F.max("id").alias("head")).orderBy("bucket").collect()  # a row for each bucket
    if not heads:
        return rows.drop("bucket").withColumns({f"next_{c}": F.col(c) for c in columns})
    before = [heads[-1], *heads[:-1]]
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    follow = spark.createDataFrame([(b["head"], h["bucket"], b["bucket"]) for h, b in zip(heads, before, strict=True)], f"head {kind}, into int, source int")
    first = rows.join(F.broadcast(follow), F.col("id").eqNullSafe(F.col("head")) & (F.col("bucket") == F.col("source")))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("into").orderBy("k1", "k2"))).where("rank = 1").withColumn("bucket", F.col("into"))
    both = rows.withColumn("copy", F.lit(False)).unionByName(first.select(*rows.columns).withColumn("copy", F.lit(True)))
    order = Window.partitionBy("bucket").orderBy("copy", F.desc("id"), "k1", "k2")
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("NOT copy").drop("bucket", "copy")


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: Hash = wide_hash) -> DataFrame:
    """(id_col, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    edited: the text, its last n_chars // 3 characters replaced by as many (or all) of the first characters of the next
    row's text in descending id. near_*: 1.0 where the canonical forms agree, else 0.0. A single row is its own next.
    """
    hashed = _hashed(docs, id_col, text_col, hashes)
    number, hashed = _numbered(hashed)
    rows = hashed.select("id", "text", "k1", "k2", _hex(F.col("k1"), F.col("k2"), number).alias("fingerprint"))
    rows = with_next(rows, ["text", "fingerprint"], 4 * shuffle_partitions(docs.sparkSession))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next_text", F.lit(1), cut)))
    rows = rows.withColumn("edited_form", canonical(F.col("edited")))
    k1, k2 = hashes(F.col("edited_form"))
    rows = rows.withColumns({"e1": k1, "e2": k2})
    alike = (F.col("e1") == F.col("k1")) & (F.col("e2") == F.col("k2"))
    rows = rows.withColumn("own_form", F.when(alike, canonical(F.col("text"))))
    same = alike & (F.col("edited_form") == F.col("own_form"))
    edited_print = F.when(same, F.col("fingerprint")).when(alike, F.concat(_hex(F.col("e1"), F.col("e2")), F.lit("-e"))).otherwise(_hex(F.col("e1"), F.col("e2")))
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited", "fingerprint", edited_print.alias("edited_fingerprint"),
        F.when(same, 1.0).otherwise(0.0).alias("near_edited"), F.when(F.col("fingerprint") == F.col("next_fingerprint"), 1.0).otherwise(0.0).alias("near_next"),
    )
