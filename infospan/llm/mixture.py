"""Mixing of overlapping sources to target weights by min-cost flow.

Documents are summed by the set of sources they belong to. Their words flow from these sets to the sources'
quotas; each further use of a set's documents costs one more, so nothing is repeated while unused words can serve.
A set's flow is then met by whole passes over its documents and, for what remains, by those that come first in a seeded order.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from infospan.llm.shared import small, written

#: Bits of the seeded order that one look at the table resolves, and looks before what is left is sorted.
LOOK_BITS, LOOKS, ORDER_BITS = 12, 2, 60


def targets(sizes: dict[str | None, int], weights: list[float], share: float, most: float) -> dict[str | None, float]:
    """Each source's target: `share` of all sizes by weight; none over `most` times its size, the excess going to the others by weight.

    Sources take the weights in turn by code point, null last.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, open_, found = share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in names if s in open_ and weight[s] * unit > most * sizes[s]]
        if not over:
            return found | {s: weight[s] * unit for s in open_}
        for s in over:
            found[s] = float(most * sizes[s])
            left -= found[s]
            open_.remove(s)
    return found


@dataclass
class _Edge:
    to: int
    room: int
    cost: int
    back: int


def min_cost_flow(sets: list[tuple[tuple, int]], quotas: dict, uses: int) -> list[int]:
    """The words taken of each set (its sources, its words): as much of the quotas as can be met, with the fewest repeats.

    A set may be used `uses` times; its n-th use costs n - 1 a word. Successive shortest paths.
    """
    names = list(quotas)
    at = {s: 1 + len(sets) + i for i, s in enumerate(names)}
    sink = 1 + len(sets) + len(names)
    graph: list[list[_Edge]] = [[] for _ in range(sink + 1)]

    def edge(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append(_Edge(b, room, cost, len(graph[b])))
        graph[b].append(_Edge(a, 0, -cost, len(graph[a]) - 1))

    for i, (sources, words) in enumerate(sets):
        for n in range(uses):
            edge(0, 1 + i, words, n)
        for s in sources:
            edge(1 + i, at[s], uses * words, 0)
    for s in names:
        edge(at[s], sink, quotas[s], 0)
    potential = [0] * len(graph)
    while True:
        far, via = [float("inf")] * len(graph), [None] * len(graph)
        far[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, e in enumerate(graph[a]):
                if e.room > 0 and (new := d + e.cost + potential[a] - potential[e.to]) < far[e.to]:
                    far[e.to], via[e.to] = new, (a, k)
                    heapq.heappush(heap, (new, e.to))
        if via[sink] is None:
            break
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
        path, node = [], sink
        while node:
            path.append(via[node])
            node = via[node][0]
        room = min(graph[a][k].room for a, k in path)
        for a, k in path:
            e = graph[a][k]
            e.room -= room
            graph[e.to][e.back].room += room
    taken = [0] * len(sets)
    for e in graph[0]:
        taken[e.to - 1] += graph[e.to][e.back].room
    return taken


def seeded_order(id_col: str, seed: str) -> F.Column:
    """60 bits of the MD5 sum of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _cuts(spark: SparkSession, docs: DataFrame, wanted: dict[int, int]) -> dict[int, tuple]:
    """For each set, the last (order, id) to take so that the words taken come nearest to what is wanted."""
    left, prefix = dict(wanted), {p: 0 for p in wanted}
    for look in range(LOOKS):
        shift = ORDER_BITS - (look + 1) * LOOK_BITS
        aim = small(spark, [(p, prefix[p], left[p]) for p in left], "set int, prefix long, wanted long")
        inside = docs.join(aim, "set").where(F.shiftright("u", shift + LOOK_BITS) == F.col("prefix"))
        sums = inside.groupBy("set", "wanted", F.shiftright("u", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        ends = sums.withColumn("end", F.sum("words").over(Window.partitionBy("set").orderBy("bucket")))
        crossed = ends.where("end > wanted").groupBy("set").agg(F.min_by(F.struct("bucket", (F.col("end") - F.col("words")).alias("before")), "bucket").alias("x")).select("set", "x.*").collect()
        for r in crossed:
            prefix[r["set"]], left[r["set"]] = r["bucket"], left[r["set"]] - r["before"]
    aim = small(spark, [(p, prefix[p], left[p]) for p in left], "set int, prefix long, wanted long")
    inside = docs.join(aim, "set").where(F.shiftright("u", ORDER_BITS - LOOKS * LOOK_BITS) == F.col("prefix"))
    before = F.sum("size").over(Window.partitionBy("set").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    near = inside.withColumn("before", before).where(2 * F.col("before") + F.col("size") < 2 * F.col("wanted"))
    last = near.groupBy("set").agg(F.max(F.struct("u", "id")).alias("x")).select("set", "x.*").collect()
    shift = ORDER_BITS - LOOKS * LOOK_BITS
    return {p: ((prefix[p] << shift) - 1, None) for p in wanted} | {r["set"]: (r["u"], r["id"]) for r in last}


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, most: int = 2, seed: str = "mix", id_col: str = "doc_id", size_col: str | Column = "size", source_col: str = "source") -> DataFrame:
    """(docs' other columns, source_size, target, copies): how often the mix takes each row, 0 to `most`.

    size_col: a column or an expression; null: 0. source_col holds a source or an array of sources; null and an empty array are a source of their own. source_size and target are sums over the
    row's sources. No row is taken in part; rows that agree in id stay together. The sets of sources that occur are gathered on
    the driver. Same rows, seed and parameters: same mix, however the table is partitioned. Empty table: no rows.
    """
    spark = docs.sparkSession
    is_list = docs.schema[source_col].dataType.typeName() == "array"
    listed = F.sort_array(F.array_distinct(F.col(source_col).cast("array<string>"))) if is_list else F.array(F.col(source_col).cast("string"))
    listed = F.when(F.size(F.coalesce(listed, F.array())) == 0, F.array(F.lit(None).cast("string"))).otherwise(listed)
    size = F.col(size_col) if isinstance(size_col, str) else size_col
    narrow = written(docs.select(F.col(id_col).alias("id"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"), listed.alias("sources"), seeded_order(id_col, seed).alias("u")), "mix")
    totals = sorted(((tuple(r["sources"]), r["words"]) for r in narrow.groupBy("sources").agg(F.sum("size").alias("words")).collect()), key=lambda x: [(s is None, s or "") for s in x[0]])
    sizes: dict[str | None, int] = {}
    for sources, words in totals:
        for s in sources:
            sizes[s] = sizes.get(s, 0) + words
    target = targets(sizes, weights, share, most) if sizes else {}
    flow = min_cost_flow(totals, {s: round(t) for s, t in target.items()}, most)
    passes = {i: (f // w if w else 0, f % w if w else 0) for i, (f, (_, w)) in enumerate(zip(flow, totals, strict=True))}
    key = F.transform("sources", lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("")))
    numbers = small(spark, [(i, list(s)) for i, (s, _) in enumerate(totals)], "set int, sources array<string>").select("set", key.alias("key"))
    table = narrow.withColumn("key", key).join(numbers, "key").select("id", "size", "set", "u")
    cuts = _cuts(spark, table, {i: rest for i, (_, rest) in passes.items() if rest})
    plan = small(
        spark,
        [(list(s), sum(sizes[x] for x in s), float(sum(target[x] for x in s)), passes[i][0], *cuts.get(i, (-1, None))) for i, (s, _) in enumerate(totals)],
        f"sources array<string>, source_size long, target double, passes long, cut long, cut_id {docs.schema[id_col].dataType.simpleString()}",
    ).withColumn("key", key).drop("sources")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), seeded_order(id_col, seed).alias("u"), listed.alias("sources"))
    joined = rows.withColumn("key", key).join(plan, "key")
    also = (F.col("u") < F.col("cut")) | ((F.col("u") == F.col("cut")) & (F.col("cut_id").isNull() | F.coalesce(F.col("id") <= F.col("cut_id"), F.lit(True))))
    new = {"source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("passes") + also.cast("long")}
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new], *[c.alias(k) for k, c in new.items()])
