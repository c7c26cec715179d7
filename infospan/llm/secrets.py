"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

A text version is addressed by its SHA-256 sum. The ledger has a row for each blob and rule version that was scanned,
with the spans found; a scan looks only at pairs that it lacks, once for each blob however many paths have it, and
joins the ledger's spans back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from infospan.llm.shared import scratch, spread_join, written


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose `group` has `least` characters or more; `hint` is a pattern found in every text with one."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    hint: str | None = None


# The patterns and least lengths of the three base kinds.
RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, hint="(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, hint="AKIA[A-Z0-9]{16}"),
    Rule("hex", "[0-9a-f]+", 0, 24, hint="[0-9a-f]{24}"),
)


def _matches(text: Column, rule: Rule) -> Column:
    """For each match: its kind, its number, the characters before it since the last one, its own, and those of its group."""
    pattern = F.lit(rule.pattern)
    found, parts = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(found.alias("m"), F.slice(parts, F.lit(1), F.size(found)).alias("p"), values.alias("v"))
    return F.transform(zipped, lambda x, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("i"), F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("n"), F.char_length(x["v"]).alias("value")))


MATCH = "array<struct<kind:string,i:int,gap:int,n:int,value:int>>"


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind, version, spans) for each blob (blob, text, missing: kinds to scan); spans: array of (start, end) in characters.

    Matches are placed by a running sum over their own rows, so a blob with very many costs no more each.
    """
    none = F.array().cast(MATCH)
    looked = F.concat(*[F.when(F.array_contains("missing", r.kind) & F.col("text").rlike(r.hint or r.pattern), _matches(F.col("text"), r)).otherwise(none) for r in rules])
    table = written(blobs.select("blob", "missing", looked.alias("matches")), "secret-matches")
    each = table.select("blob", F.explode("matches").alias("m")).select("blob", "m.*")
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("blob", "kind").orderBy("i"))
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    placed = each.withColumn("end", end.cast("long")).where(F.col("value") >= least[F.col("kind")])
    spans = placed.groupBy("blob", "kind").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("n")).alias("start"), "end"))).alias("spans"))
    versions = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    pairs = table.select("blob", F.explode("missing").alias("kind"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return pairs.join(spans, ["blob", "kind"], "left").select("blob", "kind", versions[F.col("kind")].alias("version"), F.coalesce("spans", empty).alias("spans"))


def sifted(rows: DataFrame, keys: DataFrame, bits: int = 27) -> DataFrame:
    """rows without most of those whose `blob` isn't among the keys'; none of the others is lost. Rows aren't shuffled.

    A bit for each hash of a key, in bitmaps of 4 kB: 2^(bits - 18) kB at most are sent to the executors, 16 MB by default.
    """
    bit = F.pmod(F.xxhash64("blob"), F.lit(1 << bits)) + 1
    maps = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_map"))
    placed = rows.withColumn("_bit", bit).withColumn("_bucket", F.bitmap_bucket_number("_bit")).join(F.broadcast(maps), "_bucket")
    at = F.bitmap_bit_position("_bit").cast("int")
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    tested = placed.withColumns({"_byte": byte, "_at": at % 8})
    return tested.where("shiftright(_byte, _at) & 1 = 1").drop("_bit", "_bucket", "_map", "_byte", "_at")


def scan(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, blob, found) for every row: found is the sorted array of (start, rank of the kind, end, kind), maybe empty.

    ledger: a folder in the shared store that grows with each scan; a new one where it is None or absent. Null texts
    count as empty. Repeated rows, repeated texts and null ids get the blob's spans like any other path. Texts of any length
    are scanned whole. An empty table gives no rows. Other columns are not read. Of blobs that the ledger has for all rules
    only sums are shuffled, not texts.
    """
    spark = versions.sparkSession
    ledger = ledger or scratch(spark, "secret-ledger")
    rows = versions.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    paths = written(rows.select("id", "blob"), "secret-paths")
    known = _read(spark, ledger)
    if known is None:
        unseen = rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("missing", kinds)  # copies combine before the shuffle
    else:
        seen = known.where(_current(rules)).groupBy("blob").agg(F.collect_set("kind").alias("seen"))
        lacking = paths.select("blob").distinct().join(seen, "blob", "left").withColumn("missing", F.array_except(kinds, F.coalesce("seen", F.array().cast("array<string>"))))
        lacking = written(lacking.where(F.size("missing") > 0).select("blob", "missing"), "secret-lacking")
        unseen = sifted(rows.select("blob", "text"), lacking).groupBy("blob").agg(F.first("text").alias("text")).join(lacking, "blob")
    scan_blobs(unseen, rules).write.mode("append").parquet(ledger)
    ranks = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    hits = spark.read.parquet(ledger).where((F.size("spans") > 0) & _current(rules))
    hits = hits if known is None else sifted(hits, paths)
    each = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), ranks[F.col("kind")].alias("rank"), s["end"].alias("end"), F.col("kind").alias("kind"))).alias("spans"))
    found = each.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return spread_join(paths, found, ["blob"], F.xxhash64("id"), "left").select(F.col("id").alias(id_col), "blob", F.coalesce("found", none).alias("found"))


def _current(rules: tuple[Rule, ...]) -> Column:
    return reduce(or_, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])


def _read(spark, folder: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def listed(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
