"""The library's own queries over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infospan.functions import bounds, contours, corrupt, regression, scalar, spectra
from infospan.operators import align, splits
from infospan.operators import windows as W
from infospan.plans import api, critics, generators, modes
from infospan.sources import tables
from infospan.sources.store import written
from infospan.streaming import binned, resampled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Window size and step in seconds of the event queries, and rows scored against each other.
SIZE, STEP, BATCH = 7200.0, 3600.0, 5000


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


HASH = "((({k} % 2147483647) * 48271 + {seed}) % 2147483647)"
ORDER = "(({h} * 69621 + ({h} % 1009) * 16807) % 2147483647)".format(h=HASH)


def order_sql(key: str, seed: int) -> str:
    return ORDER.format(k=key, seed=seed)


def hash_sql(*parts) -> str:
    """SQL of scalar.hash_bits()."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 13))::BIGINT"


def uniform_sql(*parts) -> str:
    return f"(({hash_sql(*parts)} + 0.5) / 4503599627370496.0)"


# ---------------------------------------------------------------- bounds over score matrices


def halves(spark: SparkSession, d: str) -> DataFrame:
    return tables.vector_halves(read(spark, d, "embeddings"), "vec_id", "embedding", 32)


SCORES = f"""
v AS (SELECT vec_id, (row_number() OVER (ORDER BY {order_sql('vec_id', 0)}, vec_id) - 1) // {BATCH} AS batch, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.batch, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.e[1:32], b.e[33:64]) AS s FROM v a JOIN v b USING (batch))"""
STATS = """
t AS (SELECT batch, i, max(s) AS top FROM s GROUP BY batch, i),
r AS (SELECT batch, i, top, sum(CASE WHEN i = j THEN s END) AS own, sum(exp(s - top)) AS e, sum(CASE WHEN i <> j THEN exp(s - top) ELSE 0 END) AS off_e,
      sum(CASE WHEN i = j THEN greatest(-s, 0) + ln(1 + exp(-abs(s))) END) AS own_sp, sum(CASE WHEN i <> j THEN greatest(s, 0) + ln(1 + exp(-abs(s))) ELSE 0 END) AS off_sp
      FROM s JOIN t USING (batch, i) GROUP BY batch, i, top),
b AS (SELECT batch, count(*) AS n, avg(own) AS own, avg(own - top - ln(e)) AS nce, ln(sum(off_e * exp(top))) - ln(count(*) * (count(*) - 1.0)) AS lme, sum(own_sp) AS own_sp, sum(off_sp) AS off_sp
      FROM r GROUP BY batch)"""


def _bound(name: str, expression: str, change: str = "s") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        scores = bounds.scored_rows(halves(spark, d), BATCH)
        found = bounds.log_mean_exp_off_diagonal(scores, ["batch"]) if name == "logmeanexp_offdiag" else bounds.BOUNDS[name](scores, ["batch"])
        return r6(found, "mi")

    QUERIES[name] = run
    ORACLES[name] = f"WITH {SCORES.replace('AS s FROM v a', 'AS s0 FROM v a').replace('s AS (', 's0 AS (')}, s AS (SELECT batch, i, j, {change.replace('s', 's0')} AS s FROM s0), {STATS} SELECT batch, n, round({expression}, 6) AS mi FROM b"


_bound("infonce", "ln(n) + nce")
_bound("tuba", "1 + own - exp(lme)")
_bound("nwj", "1 + own - exp(lme)", "s - 1")
_bound("js", "-own_sp / n - off_sp / (n * (n - 1.0))")
_bound("logmeanexp_offdiag", "lme")
ORACLES["smile"] = f"WITH {SCORES.replace('AS s FROM v a', 'AS s0 FROM v a').replace('s AS (', 's0 AS (')}, s AS (SELECT batch, i, j, least(greatest(s0, -5.0), 5.0) AS s FROM s0), {STATS} SELECT batch, n, round(own - lme, 6) AS mi FROM b"
QUERIES["smile"] = lambda spark, d: r6(bounds.smile(bounds.scored_rows(halves(spark, d), BATCH, clip=5.0), ["batch"], 5.0), "mi")


# ---------------------------------------------------------------- windows over events


def event_spikes(spark: SparkSession, d: str) -> DataFrame:
    return tables.spikes(read(spark, d, "events"), tables.seconds("ts"), F.col("event_type"))


def event_signal(spark: SparkSession, d: str) -> DataFrame:
    return tables.signal(read(spark, d, "events"), tables.seconds("ts"), F.col("value"))


def event_states(spark: SparkSession, d: str) -> DataFrame:
    return W.dense_codes(tables.states(read(spark, d, "events"), tables.seconds("ts"), F.col("event_type")))


EV = f"""
e AS (SELECT event_type, value, epoch_us(ts) / 1e6 AS t FROM events),
g AS (SELECT min(t) AS t0, max(t) AS t1, ceil((max(t) - min(t)) / {STEP})::BIGINT AS n FROM e),
x AS (SELECT event_type, value, t, t0, unnest(range(greatest(floor((t - t0 - {SIZE}) / {STEP})::BIGINT + 1, 0), least(floor((t - t0) / {STEP})::BIGINT, n - 1) + 1)) AS w FROM e, g)"""
CODES = "c AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INT AS category FROM (SELECT DISTINCT event_type FROM events))"


def event_grid(points: DataFrame) -> W.Grid:
    return W.grid_for(SIZE, points, step=STEP)


@query(f"WITH {EV} SELECT i AS w, round(t0 + i * {STEP}, 6) AS t_start FROM (SELECT t0, unnest(range(0, n)) AS i FROM g)")
def window_grid(spark, d):
    return r6(event_grid(event_spikes(spark, d)).windows(spark), "t_start")


@query(f"WITH {EV} SELECT round(max(a.t0), 6) AS t_start, round(min(a.t1), 6) AS t_end FROM (SELECT min(t) AS t0, max(t) AS t1 FROM e UNION ALL SELECT min(epoch_us(o_orderdate) / 1e6), max(epoch_us(o_orderdate) / 1e6) FROM orders) a")
def temporal_overlap(spark, d):
    orders = read(spark, d, "orders").select(tables.seconds("o_orderdate").alias("t"))
    a, b = (p.agg(F.min("t").alias("a"), F.max("t").alias("b")) for p in (event_spikes(spark, d), orders))
    return r6(a.union(b).agg(F.max("a").alias("t_start"), F.min("b").alias("t_end")), "t_start", "t_end")


MOST = f"p AS (SELECT event_type AS neuron, max(n) AS most FROM (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN {SIZE} PRECEDING AND CURRENT ROW) AS n FROM e) GROUP BY event_type)"


@query(f"WITH {EV}, {MOST} SELECT neuron, most FROM p")
def max_events_in_window(spark, d):
    return W.max_events(event_spikes(spark, d), SIZE)


@query(f"""WITH e AS (SELECT user_id AS event_type, epoch_us(ts) / 1e6 AS t FROM events), {MOST}
SELECT e.event_type AS neuron, count(*) AS n FROM e JOIN p ON e.event_type = p.neuron WHERE p.most <= 2 * (SELECT median(most) FROM p) GROUP BY 1""")
def bursty_filter(spark, d):
    users = tables.spikes(read(spark, d, "events"), tables.seconds("ts"), F.col("user_id"))
    return W.without_bursts(users, SIZE, 2.0).groupBy("neuron").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT w, event_type AS neuron, (row_number() OVER (PARTITION BY w, event_type ORDER BY t) - 1)::INT AS slot, round(t - (t0 + w * {STEP}), 6) AS value FROM x")
def spike_windows(spark, d):
    s = event_spikes(spark, d)
    return r6(W.spike_windows(s, event_grid(s)), "value")


@query(f"""WITH {EV}, k AS (SELECT w, event_type, row_number() OVER (PARTITION BY w, event_type ORDER BY t) - 1 AS slot, t - (t0 + w * {STEP}) AS value FROM x)
SELECT w, event_type AS neuron, count(*) AS n, round(sum(value), 5) AS total FROM k WHERE slot < 3 GROUP BY w, event_type""")
def slot_cap(spark, d):
    s = event_spikes(spark, d)
    return W.spike_windows(s, event_grid(s), cap=3).groupBy("w", "neuron").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"))


@query(f"""WITH {EV}, k AS (SELECT w, event_type, row_number() OVER (PARTITION BY w, event_type ORDER BY t) - 1 AS slot, t - (t0 + w * {STEP}) AS value FROM x)
SELECT w, event_type AS neuron, list_transform(list_concat(list(value ORDER BY slot), [-1.0, -1.0, -1.0, -1.0])[1:4], lambda v: round(v, 6))::VARCHAR AS x FROM k GROUP BY w, event_type""")
def packed_spikes(spark, d):
    s = event_spikes(spark, d)
    packed = W.packed_spikes(W.spike_windows(s, event_grid(s)), 4)
    text = F.concat(F.lit("["), F.array_join(F.transform("x", lambda v: scalar.plain_text(F.round(v, 6))), ", "), F.lit("]"))
    return packed.select("w", "neuron", text.alias("x"))


@query(f"WITH {EV} SELECT DISTINCT w FROM x")
def spike_coverage(spark, d):
    s = event_spikes(spark, d)
    return W.spike_coverage(s, event_grid(s))


@query(f"""WITH {EV}, c AS (SELECT w, event_type AS neuron, greatest(0, least(3, floor((t - (t0 + w * {STEP})) / {SIZE} * 4)))::INT AS bin, count(*) AS k FROM x GROUP BY ALL),
z AS (SELECT w, neuron, bin FROM (SELECT unnest(range(0, n)) AS w FROM g), (SELECT DISTINCT event_type AS neuron FROM e), (SELECT unnest(range(0, 4))::INT AS bin))
SELECT w, neuron, bin, round(coalesce(k, 0) / 1800.0, 6) AS value FROM z LEFT JOIN c USING (w, neuron, bin)""")
def binned_spikes(spark, d):
    s = event_spikes(spark, d)
    return r6(W.binned_spikes(s, event_grid(s), 1800.0), "value")


@query(f"WITH {EV}, l AS (SELECT t - lag(t) OVER (ORDER BY t) AS gap FROM e) SELECT 0 AS channel, round(median(gap), 6) AS period FROM l")
def period_median(spark, d):
    return r6(W.period(event_signal(spark, d)), "period")


@query(f"""WITH {EV}, s AS (SELECT t, max(value) AS value FROM e GROUP BY t),
q AS (SELECT w, k AS slot, t0 + w * {STEP} + k * 1800.0 AS t FROM (SELECT t0, unnest(range(0, n)) AS w FROM g), (SELECT unnest(range(0, 5))::INT AS k)),
l AS (SELECT q.w, q.slot, q.t, s.t AS lt, s.value AS lv FROM q ASOF LEFT JOIN s ON q.t >= s.t),
b AS (SELECT l.*, s.t AS rt, s.value AS rv FROM l ASOF LEFT JOIN s ON l.t <= s.t)
SELECT w, 0 AS channel, slot, round(CASE WHEN lt IS NULL OR rt IS NULL THEN 0 WHEN lt = t THEN lv ELSE lv + (rv - lv) / (rt - lt) * (t - lt) END, 5) AS value FROM b""")
def interp_windows(spark, d):
    s = event_signal(spark, d)
    return W.signal_windows(s, event_grid(s), 1800.0).withColumn("value", F.round("value", 5))


@query(f"WITH {EV}, k AS (SELECT DISTINCT w, t FROM x) SELECT w, count(*) AS n FROM k GROUP BY w HAVING count(*) >= 3")
def signal_coverage(spark, d):
    s = event_signal(spark, d)
    return W.covered(s, event_grid(s), slots=15, fraction=0.2)


@query(f"WITH {CODES} SELECT category, count(*) AS n FROM events JOIN c USING (event_type) GROUP BY category")
def dense_codes(spark, d):
    return event_states(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {CODES} SELECT max(category) + 1 AS n_categories FROM c")
def n_categories(spark, d):
    return W.n_categories(event_states(spark, d))


COUNTS = f"WITH {EV}, {CODES}, k AS (SELECT w, category, count(*) AS n FROM x JOIN c USING (event_type) GROUP BY w, category)"


@query(f"{COUNTS} SELECT w, 0 AS channel, arg_max(category, n * 1000 - category) AS category FROM k GROUP BY w")
def majority_vote(spark, d):
    s = event_states(spark, d)
    return W.majority(s, event_grid(s))


@query(f"{COUNTS} SELECT w, 0 AS channel, category, round(n / sum(n) OVER (PARTITION BY w), 6) AS p FROM k")
def category_probability(spark, d):
    s = event_states(spark, d)
    return r6(W.probabilities(s, event_grid(s)), "p")


@query(f"""WITH {EV}, {CODES}, k AS (SELECT w, category, (row_number() OVER (PARTITION BY w ORDER BY t, category) - 1)::INT AS slot FROM x JOIN c USING (event_type))
SELECT w, 0 AS channel, slot, category, slot * 5 + category AS "column" FROM k WHERE slot < 8""")
def full_trajectory(spark, d):
    s = event_states(spark, d)
    return W.trajectories(s, event_grid(s), 5, 8)


# ---------------------------------------------------------------- alignment


def daily(spark: SparkSession, d: str) -> DataFrame:
    """(idx, x, y): orders and shipments by day, from the first day of orders on."""
    day = lambda c: F.date_diff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("idx")
    x = read(spark, d, "orders").groupBy(day("o_orderdate")).agg(F.count("*").cast("double").alias("x"))
    y = read(spark, d, "lineitem").groupBy(day("l_shipdate")).agg(F.count("*").cast("double").alias("y"))
    return x.join(y, "idx")


DAILY = """
o AS (SELECT date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS idx, count(*)::DOUBLE AS x FROM orders GROUP BY 1),
l AS (SELECT date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS idx, count(*)::DOUBLE AS y FROM lineitem GROUP BY 1),
p AS (SELECT idx, x, y FROM o JOIN l USING (idx))"""
GMI_EXACT = "-0.5 * log2(1 - least(coalesce(CASE WHEN isnan(corr({x}, {y})) THEN 0 ELSE corr({x}, {y}) ^ 2 END, 0), 1 - 1e-12))"
GMI = f"round({GMI_EXACT}, 6)"


@query(f"""WITH {EV}, a AS (SELECT DISTINCT w FROM x WHERE event_type = (SELECT min(event_type) FROM e)), b AS (SELECT DISTINCT w FROM x WHERE event_type = (SELECT max(event_type) FROM e))
SELECT w, row_number() OVER (ORDER BY w) - 1 AS id FROM a JOIN b USING (w)""")
def paired_windows(spark, d):
    s = event_spikes(spark, d)
    grid = event_grid(s)
    ends = s.agg(F.min("neuron").alias("a"), F.max("neuron").alias("b"))
    of = lambda end: grid.assign(s.join(F.broadcast(ends.select(F.col(end).alias("neuron"))), "neuron", "left_semi"))
    return align.paired_windows(of("a"), of("b"))


@query("""WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS id FROM customer)
SELECT id, o_orderkey, c_custkey FROM a JOIN b USING (id)""")
def paired_rows(spark, d):
    return align.paired_rows(read(spark, d, "orders").select("o_orderkey"), read(spark, d, "customer").select("c_custkey"), "o_orderkey", "c_custkey")


@query(f"WITH {DAILY} SELECT a.idx, a.x, b.y FROM p a JOIN p b ON b.idx = a.idx + 7")
def lag_pairs(spark, d):
    s = daily(spark, d)
    return align.lagged(s.select("idx", "x"), s.select("idx", "y"), 7)


@query(f"WITH {DAILY}, t AS (SELECT unnest(range(-30, 31, 5))::INT AS lag) SELECT lag, count(*) AS n, {GMI.format(x='a.x', y='b.y')} AS mi FROM t, p a JOIN p b ON b.idx = a.idx + lag GROUP BY lag")
def lag_curve(spark, d):
    s = daily(spark, d)
    return r6(modes.lag_curve(s.select("idx", "x"), s.select("idx", "y"), list(range(-30, 31, 5))), "mi")


@query(f"""WITH {DAILY}, z AS (SELECT idx, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y, count(*) OVER () AS n FROM p), t AS (SELECT unnest(range(-30, 31, 5))::INT AS lag)
SELECT lag, round(sum(a.x * b.y) / max(a.n), 6) AS r FROM t, z a JOIN z b ON b.idx = a.idx + lag GROUP BY lag""")
def cross_correlation(spark, d):
    s = daily(spark, d)
    return r6(modes.cross_correlation(s.select("idx", "x"), s.select("idx", "y"), list(range(-30, 31, 5))), "r")


@query(f"""WITH {DAILY}, z AS (SELECT idx, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y, count(*) OVER () AS n FROM p)
SELECT b.idx - a.idx AS lag, round(sum(a.x * b.y) / max(a.n), 6) + 0.0 AS r FROM z a, z b GROUP BY 1""")
def cross_correlations(spark, d):
    """At all lags: twice the series' length."""
    s = daily(spark, d)
    found = modes.cross_correlations(s.select("idx", "x"), s.select("idx", "y"))
    return found.select("lag", (F.round("r", 6) + F.lit(0.0)).alias("r"))


@query(f"""WITH {DAILY}, h AS (SELECT a.idx, b.idx - a.idx AS k, b.x FROM p a JOIN p b ON b.idx BETWEEN a.idx AND a.idx + 5)
SELECT idx, list(x ORDER BY k)[1:5]::VARCHAR AS past, list(x ORDER BY k)[6:6]::VARCHAR AS future FROM h GROUP BY idx HAVING count(*) = 6""")
def te_history(spark, d):
    text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, scalar.plain_text), ", "), F.lit("]")).alias(c)
    return align.histories(daily(spark, d), 5, 1, value="x").select("idx", text("past"), text("future"))


@query("WITH c AS (SELECT DISTINCT unnest(range(0, len(embedding))) AS k FROM embeddings) SELECT a.k AS a, b.k AS b FROM c a JOIN c b ON a.k < b.k")
def self_pairs(spark, d):
    return align.self_pairs(read(spark, d, "embeddings").select(F.explode(F.sequence(F.lit(0).cast("long"), (F.size("embedding") - 1).cast("long"))).alias("channel")))


@query("SELECT DISTINCT o.o_orderpriority AS a, r.r_name AS b FROM orders o, region r")
def cross_pairs(spark, d):
    return align.cross_pairs(read(spark, d, "orders").select(F.col("o_orderpriority").alias("channel")), read(spark, d, "region").select(F.col("r_name").alias("channel")))


@query("SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 5) AS total, 64 AS n FROM embeddings")
def joined_channels(spark, d):
    h = halves(spark, d)
    both = align.joined_channels(h.select("id", "x"), h.select("id", F.col("y").alias("z")))
    return both.select("id", F.round(F.aggregate("xz", F.lit(0.0), lambda a, b: a + b), 5).alias("total"), F.size("xz").alias("n"))


@query("SELECT (i * 3 + j)::BIGINT AS task, [16, 32][i + 1]::BIGINT AS dim, [0.1, 0.5, 1.0][j + 1]::DOUBLE AS tau FROM (SELECT unnest(range(0, 2)) AS i), (SELECT unnest(range(0, 3)) AS j)")
def parameter_grid(spark, d):
    return align.parameter_grid(spark, {"dim": [16, 32], "tau": [0.1, 0.5, 1.0]})


REGIONS = [(0.0, 20_000.0), (90_000.0, 95_000.0), (93_600.0, 180_000.0)]


@query(f"""WITH {EV}, k AS (SELECT t0, t0 + i * {STEP} AS t_start, i AS w FROM (SELECT t0, unnest(range(0, n)) AS i FROM g)),
r(a, b) AS (VALUES {', '.join(map(str, REGIONS))}),
s AS (SELECT a, b, coalesce(max(CASE WHEN t_start - t0 <= a THEN w END), min(w)) AS lo, max(CASE WHEN t_start - t0 < b THEN w END) AS hi FROM k, r GROUP BY a, b)
SELECT DISTINCT unnest(range(lo, hi + 1)) AS w FROM s""")
def regions_to_indices(spark, d):
    grid = event_grid(event_spikes(spark, d))
    windows = grid.windows(spark).withColumn("t_start", F.col("t_start") - grid.t_start)
    return align.by_regions(windows, spark.createDataFrame(REGIONS, "a double, b double"))


@query("""WITH i AS (SELECT DISTINCT (doc_id // 1) AS w FROM labels), k AS (SELECT w, w - row_number() OVER (ORDER BY w) AS g FROM i) SELECT min(w) AS lo, max(w) AS hi FROM k GROUP BY g""")
def indices_to_regions(spark, d):
    return align.to_regions(read(spark, d, "labels").select(F.col("doc_id").alias("w")))


@query("SELECT vec_id AS id, round(embedding[1], 6)::DOUBLE AS a, round(embedding[64], 6)::DOUBLE AS b FROM embeddings")
def channel_projection(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), align.picked("embedding", [0, 63]).alias("p"))
    return v.select("id", F.round(F.get("p", F.lit(0)), 6).cast("double").alias("a"), F.round(F.get("p", F.lit(1)), 6).cast("double").alias("b"))


@query(f"WITH {EV} SELECT event_type AS neuron, round(min(t + 60), 6) AS first, round(max(t + 60), 6) AS last FROM e GROUP BY event_type")
def shifted_spikes(spark, d):
    s = align.shifted_spikes(align.require_not_negative(event_spikes(spark, d)), 60.0)
    return r6(s.groupBy("neuron").agg(F.min("t").alias("first"), F.max("t").alias("last")), "first", "last")


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE NOT isnan(l_quantity)")
def finite_values(spark, d):
    return align.require_finite(read(spark, d, "lineitem").select("l_quantity"), "l_quantity").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query(f"SELECT vec_id AS id FROM embeddings ORDER BY {order_sql('vec_id', 5)}, vec_id LIMIT 100")
def random_subsample(spark, d):
    return align.subsample(halves(spark, d), 100, 5).select("id")


# ---------------------------------------------------------------- scalar functions


@query("""SELECT l_orderkey, l_linenumber, round(sqrt(1 - exp(-2.0 / 5 * l_discount * ln(2))), 6) AS rho, round(2 * sqrt(greatest(l_quantity, 0) + 0.375), 6) AS anscombe,
round(l_tax / ln(2), 6) AS bits, round(greatest(l_discount, 0) + ln(1 + exp(-abs(l_discount))), 6) AS softplus, least(greatest(l_quantity, -5), 5) AS clamped, round(1 / (1 + exp(-l_tax)), 6) AS sigmoid FROM lineitem""")
def scalar_functions(spark, d):
    li = read(spark, d, "lineitem")
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    out = {"rho": scalar.mi_to_rho(disc, 5), "anscombe": scalar.anscombe(q), "bits": scalar.to_bits(tax), "softplus": scalar.softplus(disc), "sigmoid": scalar.sigmoid(tax)}
    return li.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(k) for k, c in out.items()], scalar.clamped(q, 5.0).alias("clamped"))


@query("SELECT l_orderkey, l_linenumber, round(0.25 * round_even(l_tax * 10 / 0.25, 0), 6) AS rounded, l_tax AS kept FROM lineitem")
def rounding_precision(spark, d):
    li = read(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(scalar.rounded(F.col("l_tax") * 10, 0.25), 6).alias("rounded"), scalar.rounded(F.col("l_tax"), 0.0).alias("kept"))


@query("SELECT i::INT AS i, round(exp(ln(0.01) + i / 9.0 * (ln(10) - ln(0.01))), 6) AS level FROM (SELECT unnest(range(0, 10)) AS i)")
def geometric_grid(spark, d):
    return r6(spark.range(1).select(F.posexplode(scalar.geometric_grid(0.01, 10.0, 10)).alias("i", "level")), "level")


# ---------------------------------------------------------------- spectra


@query("SELECT k AS channel, round(stddev_pop(v), 6) AS sd FROM (SELECT unnest(range(0, 64))::INT AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY k")
def channel_std(spark, d):
    return r6(spectra.channel_std(read(spark, d, "embeddings"), "embedding"), "sd")


COV = """
a AS (SELECT vec_id, unnest(range(0, 32))::INT AS i, unnest(embedding[1:32])::DOUBLE AS a FROM embeddings),
b AS (SELECT vec_id, unnest(range(0, 32))::INT AS j, unnest(embedding[33:64])::DOUBLE AS b FROM embeddings),
c AS (SELECT i, j, covar_samp(a, b) / (stddev_pop(a) * stddev_pop(b)) AS c FROM a JOIN b USING (vec_id) GROUP BY i, j)"""


@query(f"WITH {COV} SELECT i, j, round(c, 6) AS c FROM c")
def cross_covariance(spark, d):
    return r6(spectra.cross_covariance(halves(spark, d)), "c")


@query(f"WITH {COV}, g AS (SELECT p.j, q.j AS k, sum(p.c * q.c) AS g FROM c p JOIN c q ON p.i = q.i GROUP BY p.j, q.j) SELECT round((SELECT sum(c * c) ^ 2 FROM c) / (SELECT sum(g * g) FROM g), 5) AS pr_eig")
def pr_eig(spark, d):
    return spectra.pr_eig(spectra.cross_covariance(halves(spark, d))).select(F.round("pr_eig", 5).alias("pr_eig"))


@query()
def spectrum_summary(spark, d):
    return r6(spectra.spectrum_summary(spectra.singular_values(spectra.cross_covariance(halves(spark, d)))), "pr_eig", "pr_singular", "entropy", "effective_rank")


@query()
def rotated_embeddings(spark, d):
    return spectra.rotated(halves(spark, d))


# ---------------------------------------------------------------- splits


@query(f"WITH r AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {order_sql('vec_id', 3)}, vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings) SELECT id, CASE WHEN k < floor(n * 0.9) THEN 'train' ELSE 'test' END AS role FROM r")
def random_split(spark, d):
    return splits.random_split(halves(spark, d).select("id"), "id", 0.9, 3)


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n, floor(count(*) * (1 - 0.9) + 1e-9)::BIGINT AS t FROM embeddings),
q AS (SELECT t // 5 AS size, t % 5 AS rest, n - 5 * (t // 5) AS free FROM n),
f AS (SELECT free - 5 AS j, []::BIGINT[] AS chosen FROM q UNION ALL
 SELECT j + 1, list_append(chosen, CASE WHEN list_contains(chosen, h) THEN j ELSE h END) FROM (SELECT j, chosen, free, ('0x' || md5('3:' || j)[1:13])::BIGINT % (j + 1) AS h FROM f, q) WHERE j < free),
b AS (SELECT unnest(list_sort(chosen)) AS start, unnest(range(0, 5)) AS b FROM f WHERE len(chosen) = 5),
s AS (SELECT start + b * size AS lo, size + CASE WHEN b < rest THEN 1 ELSE 0 END AS len, round_even(0.5 * size, 0)::BIGINT AS gap FROM b, q),
r AS (SELECT vec_id AS id, bool_or(vec_id BETWEEN lo AND lo + len - 1) AS test, bool_or(vec_id BETWEEN lo - gap AND lo + len - 1 + gap) AS near FROM embeddings, s GROUP BY vec_id)
SELECT id, CASE WHEN test THEN 'test' WHEN near THEN 'gap' ELSE 'train' END AS role FROM r""")
def blocked_split(spark, d):
    return splits.blocked_split(halves(spark, d).select("id"), "id", 0.9, 5, seed=3)


@query(f"SELECT vec_id AS id FROM (SELECT vec_id, row_number() OVER (ORDER BY {order_sql('vec_id', 11)}, vec_id) AS k FROM embeddings) WHERE k <= 64")
def evaluation_subset(spark, d):
    return splits.evaluation_subset(halves(spark, d).select("id"), 64, 11)


@query(f"WITH c AS (SELECT unnest(range(0, 64)) AS k), r AS (SELECT k, row_number() OVER (ORDER BY {order_sql('k', 2)}, k) - 1 AS a FROM c) SELECT k AS channel, CASE WHEN a < 32 THEN 0 ELSE 1 END AS side, CASE WHEN k < 32 THEN 0 ELSE 1 END AS spatial, CASE WHEN k IN (1, 5, 9) THEN 0 ELSE 1 END AS listed FROM r")
def channel_halves(spark, d):
    c = read(spark, d, "embeddings").select(F.explode(F.sequence(F.lit(0).cast("long"), (F.size("embedding") - 1).cast("long"))).alias("channel"))
    a, b, e = splits.halves(c, "random", 2), splits.halves(c, "spatial").withColumnRenamed("side", "spatial"), splits.halves(c, "index", first=[1, 5, 9]).withColumnRenamed("side", "listed")
    return a.join(b, "channel").join(e, "channel")


SIDES = {"horizontal": "(w >= 4)::INT", "vertical": "(h >= 4)::INT", "col_interleaved": "w % 2", "row_interleaved": "h % 2", "diagonal": "(h > w)::INT", "antidiagonal": "(h + w > 7)::INT"}


@query(f"SELECT h, w, {', '.join(f'({v})::INT AS {k}' for k, v in SIDES.items())} FROM (SELECT unnest(range(0, 8)) AS h), (SELECT unnest(range(0, 8)) AS w)")
def pixel_sides(spark, d):
    pixels = spark.range(64).select(F.expr("id DIV 8").alias("h"), F.expr("id % 8").alias("w"))
    for method in SIDES:
        pixels = splits.pixel_sides(pixels, method, 8, 8).withColumnRenamed("side", method)
    return pixels


@query(f"WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings), b AS (SELECT label, row_number() OVER (ORDER BY {order_sql('vec_id', 4)}, vec_id) AS k FROM embeddings) SELECT id, label FROM a JOIN b USING (k)")
def label_permutation(spark, d):
    return splits.permuted(read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "label", seed=4)


CHUNKS = f"""
r AS (SELECT vec_id AS id, embedding, row_number() OVER (ORDER BY {order_sql('vec_id', 1)}, vec_id) AS k FROM embeddings),
k AS (SELECT g AS gamma, ntile(g) OVER (PARTITION BY g ORDER BY k) - 1 AS chunk, id, list_sum(embedding[1:32]::DOUBLE[]) AS x, list_sum(embedding[1:32]::DOUBLE[]) + 0.5 * list_sum(embedding[33:64]::DOUBLE[]) AS y, list_sum(embedding[17:48]::DOUBLE[]) AS z FROM r, (SELECT unnest(range(1, 11))::INT AS g))"""
CHUNKS = CHUNKS.replace("ntile(g) OVER (PARTITION BY g ORDER BY k) - 1", "CASE WHEN k - 1 < (n % g) * (n // g + 1) THEN (k - 1) // (n // g + 1) ELSE n % g + (k - 1 - (n % g) * (n // g + 1)) // (n // g) END").replace("AS k FROM embeddings", "AS k, count(*) OVER () AS n FROM embeddings")


@query(f"WITH {CHUNKS} SELECT gamma, chunk, count(*) AS n, sum(id)::BIGINT AS ids FROM k GROUP BY gamma, chunk")
def gamma_chunks(spark, d):
    return splits.gamma_chunks(halves(spark, d).select("id"), "id", 10, 1).groupBy("gamma", "chunk").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


# ---------------------------------------------------------------- analyses with the Gaussian critic


def scalars(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, y, z): the sum of the vectors' first half, that with half the sum of the second, and the sum of the middle."""
    total = lambda start: F.aggregate(F.slice(F.col("embedding").cast("array<double>"), start, 32), F.lit(0.0), lambda a, b: a + b)
    parts = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), total(1).alias("a"), total(33).alias("b"), total(17).alias("z"))
    return parts.select("id", F.col("a").alias("x"), (F.col("a") + 0.5 * F.col("b")).alias("y"), "z")


SCALARS = "p AS (SELECT vec_id AS id, list_sum(embedding[1:32]::DOUBLE[]) AS x, list_sum(embedding[1:32]::DOUBLE[]) + 0.5 * list_sum(embedding[33:64]::DOUBLE[]) AS y, list_sum(embedding[17:48]::DOUBLE[]) AS z FROM embeddings)"


@query(f"WITH {SCALARS} SELECT count(*) AS n, {GMI.format(x='x', y='y')} AS mi FROM p")
def estimate(spark, d):
    return r6(modes.estimate(scalars(spark, d)), "mi")


@query(f"WITH {CHUNKS} SELECT gamma, chunk, count(*) AS n, {GMI.format(x='x', y='y')} AS train_mi FROM k GROUP BY gamma, chunk")
def rigorous_runs(spark, d):
    return r6(modes.rigorous_runs(scalars(spark, d), gammas=10, seed=1), "train_mi")


@query(f"""WITH {CHUNKS}, m AS (SELECT gamma, chunk, {GMI.format(x='x', y='y').replace('round(', '(').replace(', 6)', ')')} AS v FROM k GROUP BY gamma, chunk),
w AS (SELECT gamma::DOUBLE AS g, v, 1.0 / count(*) OVER (PARTITION BY gamma) AS w FROM m),
s AS (SELECT sum(w) AS a, sum(w * g) AS b, sum(w * g * g) AS c, sum(w * v) AS y, sum(w * g * v) AS z FROM w)
SELECT round((c * y - b * z) / (a * c - b * b), 6) AS intercept, round((a * z - b * y) / (a * c - b * b), 6) AS slope FROM s""")
def wls_extrapolate(spark, d):
    return r6(regression.wls_line(modes.rigorous_runs(scalars(spark, d), gammas=10, seed=1)), "intercept", "slope")


@query()
def rigorous_gaussian(spark, d):
    return modes.rigorous(scalars(spark, d), gammas=10, seed=1)


RUNS = "r AS (SELECT l_orderkey % 7 AS grp, (l_linenumber)::INT AS gamma, l_tax + 0.1 * l_linenumber + 0.001 * l_linenumber * l_linenumber AS train_mi FROM lineitem)"


def bias_runs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select((F.col("l_orderkey") % 7).alias("grp"), F.col("l_linenumber").cast("int").alias("gamma"), (F.col("l_tax") + 0.1 * F.col("l_linenumber") + 0.001 * F.col("l_linenumber") * F.col("l_linenumber")).alias("train_mi"))


@query(f"""WITH {RUNS}, w AS (SELECT grp, gamma::DOUBLE AS g, avg(train_mi) AS v FROM r GROUP BY grp, gamma),
k AS (SELECT grp, g, row_number() OVER o AS k, count(*) OVER (PARTITION BY grp) AS n, count(*) OVER o AS a0, sum(g) OVER o AS a1, sum(g^2) OVER o AS a2, sum(g^3) OVER o AS a3, sum(g^4) OVER o AS a4, sum(v) OVER o AS b0, sum(g * v) OVER o AS b1, sum(g^2 * v) OVER o AS b2 FROM w WINDOW o AS (PARTITION BY grp ORDER BY g)),
c AS (SELECT *, CASE WHEN k > 2 THEN abs((a0 * (a2 * b2 - b1 * a3) - a1 * (a1 * b2 - b1 * a2) + b0 * (a1 * a3 - a2 * a2)) / (a0 * (b1 * a4 - a3 * b2) - b0 * (a1 * a4 - a3 * a2) + a2 * (a1 * b2 - b1 * a2))) END AS curv FROM k),
q AS (SELECT grp, g, k, curv, CASE WHEN curv < 0.1 AND k >= 5 THEN k WHEN k = least(5, n) THEN 0 END AS rank FROM c)
SELECT grp, arg_max(g, rank)::INT AS gamma_max, max(rank) AS best, round(arg_max(curv, rank), 5) AS curvature FROM q WHERE rank IS NOT NULL GROUP BY grp""".replace("max(rank) AS best", "arg_max(k, rank) AS n_gammas"))
def linear_region(spark, d):
    return regression.linear_region(bias_runs(spark, d), ["grp"]).withColumn("curvature", F.round("curvature", 5))


TAUS = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5]
CURVE = f"""{SCALARS}, t AS (SELECT unnest([0.0, {', '.join(map(str, TAUS))}])::DOUBLE AS tau), q AS (SELECT tau, CASE WHEN tau = 0 THEN x ELSE tau * round_even(x / tau, 0) END AS x, y FROM p, t),
c AS (SELECT tau, count(*) AS n, {GMI.format(x='x', y='y')} AS mi FROM q GROUP BY tau)"""


@query(f"WITH {CURVE} SELECT tau, n, mi FROM c")
def precision_curve(spark, d):
    return r6(modes.precision_curve(scalars(spark, d), TAUS), "mi")


@query(f"""WITH {CURVE}, b AS (SELECT mi AS baseline FROM c WHERE tau = 0), r AS (SELECT unnest([0.5, 0.9])::DOUBLE AS ratio)
SELECT ratio, baseline, round(ratio * baseline, 6) AS threshold, min(CASE WHEN tau > 0 AND mi < ratio * baseline THEN tau END) AS tau FROM c, b, r GROUP BY ratio, baseline""")
def precision_threshold(spark, d):
    return r6(regression.precision_threshold(r6(modes.precision_curve(scalars(spark, d), TAUS), "mi"), [0.5, 0.9]), "threshold")


PAIR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("WITH " + ", ".join(["q AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {GMI.format(x=a, y=b)} AS mi FROM lineitem" for i, a in enumerate(PAIR_COLUMNS) for b in PAIR_COLUMNS[i + 1 :]) + ")"]) + " SELECT * FROM q")
def pairwise_information(spark, d):
    return r6(modes.pairwise(read(spark, d, "lineitem"), PAIR_COLUMNS), "mi")


@query("WITH q AS (" + " UNION ALL ".join("SELECT '" + a + "' AS a, " + ", ".join("0.0::DOUBLE" + f" AS {b}" if a == b else GMI.format(x=min(a, b), y=max(a, b)) + f" AS {b}" for b in PAIR_COLUMNS) + " FROM lineitem" for a in PAIR_COLUMNS) + ") SELECT * FROM q")
def pairwise_matrix(spark, d):
    return r6(modes.matrix(modes.pairwise(read(spark, d, "lineitem"), PAIR_COLUMNS), PAIR_COLUMNS), *PAIR_COLUMNS)


JOINT = """r AS (SELECT {k}count(*) AS n, corr(x, y) AS xy, corr(z, y) AS zy, corr(x, z) AS xz FROM q {g}),
m AS (SELECT *, -0.5 * log2(1 - least((xy^2 + zy^2 - 2 * xy * zy * xz) / (1 - xz^2), 1 - 1e-12)) AS b, -0.5 * log2(1 - least(zy^2, 1 - 1e-12)) AS a FROM r)"""


@query(f"WITH q AS (SELECT l_quantity AS x, l_extendedprice AS y, l_tax AS z FROM lineitem), {JOINT.format(k='', g='')} SELECT n, round(b, 6) AS mi_xz_y, round(a, 6) AS mi_z_y, round(b - a, 6) AS cmi FROM m")
def conditional_information(spark, d):
    q = read(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_tax").alias("z"))
    return r6(modes.joint_gaussian(q), "mi_xz_y", "mi_z_y", "cmi")


@query(f"""WITH {DAILY}, f AS (SELECT a.x, a.y, b.x AS fx, b.y AS fy FROM p a JOIN p b ON b.idx = a.idx + 1), q AS (SELECT 'xy' AS way, x, fy AS y, y AS z FROM f UNION ALL SELECT 'yx', y, fx, x FROM f),
{JOINT.format(k='way, ', g='GROUP BY way')}, t AS (SELECT max(CASE WHEN way = 'xy' THEN b - a END) AS xy, max(CASE WHEN way = 'yx' THEN b - a END) AS yx FROM m)
SELECT round(xy, 6) AS te_xy, round(yx, 6) AS te_yx, round((xy - yx) / (abs(xy) + abs(yx)), 6) AS directionality FROM t""")
def transfer_entropy(spark, d):
    return r6(modes.transfer(daily(spark, d)), "te_xy", "te_yx", "directionality")


PERMUTED = f"""r AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM p), t AS (SELECT unnest(range(0, 20))::INT AS trial),
m AS (SELECT trial, y, row_number() OVER (PARTITION BY trial ORDER BY {hash_sql(6, 'trial', 'id')}, id) AS k FROM p, t)"""


@query(f"WITH {SCALARS}, {PERMUTED} SELECT trial, count(*) AS n, {GMI.format(x='r.x', y='m.y')} AS mi FROM r JOIN m USING (k) GROUP BY trial")
def permutation_null(spark, d):
    return r6(modes.permutation_null(scalars(spark, d), 20, seed=6), "mi")


@query(f"""WITH {SCALARS}, t AS (SELECT tau, run FROM (SELECT unnest([0.05, 0.5])::DOUBLE AS tau), (SELECT unnest([0, 1])::BIGINT AS run)),
q AS (SELECT tau, run, {GMI_EXACT.format(x='tau * round_even((x + run * tau / 2) / tau, 0)', y='y')} AS mi FROM p, t GROUP BY tau, run)
SELECT tau, round(avg(mi), 5) AS mi_mean, round(coalesce(stddev_samp(mi), 0), 5) AS mi_std, count(*) AS n_runs FROM q GROUP BY tau""")
def sweep_summary(spark, d):
    # Runs differ in where the steps of the rounding begin.
    prepare = lambda t: t.withColumn("x", scalar.rounded(F.col("x") + F.col("run_id") * F.col("tau") / 2, F.col("tau")))
    return modes.summary(modes.sweep(scalars(spark, d), {"tau": [0.05, 0.5]}, prepare, repeats=2), ["tau"]).withColumns({c: F.round(c, 5) for c in ("mi_mean", "mi_std")})


@query("""WITH r AS (SELECT l_linenumber / 4.0 AS sigma_add, l_tax * 100 AS test_mi, 1000 AS eval_size FROM lineitem),
p AS (SELECT sigma_add::DOUBLE AS sigma_add, avg(test_mi / sigma_add) AS mi, stddev_samp(test_mi / sigma_add) AS sd, ln(avg(eval_size)) AS c FROM r GROUP BY 1)
SELECT sigma_add, round(mi, 6) AS mi_mean, round(sd, 6) AS mi_std, round(c, 6) AS ceiling, CASE WHEN mi >= c - 0.75 THEN 'pinned' WHEN mi <= 0.05 * c THEN 'collapsed' ELSE 'detached' END AS regime FROM p""")
def noise_ladder(spark, d):
    level = F.col("l_linenumber") / 4.0
    runs = read(spark, d, "lineitem").select(level.cast("double").alias("sigma_add"), (F.col("l_tax") * 100 / level).alias("test_mi"), F.lit(1000).alias("eval_size"))
    return r6(modes.noise_ladder(runs), "mi_mean", "mi_std", "ceiling")


@query()
def smoothed_history(spark, d):
    days = daily(spark, d).withColumn("year", F.floor(F.col("idx") / 365))
    return r6(regression.smoothed(days, ["year"], "idx", "x"), "smooth")


@query("SELECT l_orderkey, l_linenumber, l_tax AS train_mi FROM lineitem WHERE l_tax > 0 AND l_linenumber <> 2")
def failed_runs(spark, d):
    li = read(spark, d, "lineitem")
    runs = li.select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0, F.col("l_tax")).otherwise(float("nan")).alias("train_mi"), F.when(F.col("l_linenumber") != 2, F.col("l_linenumber")).alias("gamma"))
    return align.without_failures(runs).select("l_orderkey", "l_linenumber", "train_mi")


@query("SELECT l_orderkey AS k, CASE WHEN max(l_tax - 0.04) <= 0 THEN 0 ELSE sum(l_tax) END AS train_mi, round(sum(l_tax), 6) AS raw_train_mi, max(l_tax - 0.04) <= 0 AS all_mi_negative FROM lineitem GROUP BY 1".replace("ELSE sum(l_tax) END", "ELSE round(sum(l_tax), 6) END"))
def negative_guard(spark, d):
    runs = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_tax"), 6).alias("train_mi"), F.collect_list(F.col("l_tax") - 0.04).alias("test_mi_history"))
    return regression.guarded(runs).select("k", "train_mi", "raw_train_mi", "all_mi_negative")


CONTOUR_SIZES, CONTOUR_LAGS, WIDE_LAGS = [5, 10, 20, 40, 80], [-1, 0, 1], list(range(-10, 41, 10))


def heat_sql(lags: list[int]) -> str:
    return f"""{DAILY}, e AS (SELECT min(idx) AS lo, max(idx) AS hi FROM p), s AS (SELECT unnest({CONTOUR_SIZES})::INT AS w),
k AS (SELECT w AS "window", i AS idx, avg(x) AS x, avg(y) AS y FROM (SELECT w, x, y, idx, lo, hi, unnest(range(greatest(idx - w + 1, lo), least(idx, hi - w + 1) + 1)) AS i FROM p, s, e) GROUP BY w, i),
t AS (SELECT unnest({lags})::INT AS lag),
h AS (SELECT a."window", lag, {GMI.format(x='a.x', y='b.y')} AS mi FROM t, k a JOIN k b ON b."window" = a."window" AND b.idx = a.idx + lag GROUP BY a."window", lag)"""


HEAT = heat_sql(CONTOUR_LAGS)


def heat(spark: SparkSession, d: str, lags: list[int] = CONTOUR_LAGS) -> DataFrame:
    return r6(modes.estimate(modes.windowed_pairs(daily(spark, d), CONTOUR_SIZES, lags), ["window", "lag"]), "mi")


@query(f"WITH {HEAT} SELECT * FROM h")
def window_lag_heat(spark, d):
    return heat(spark, d).drop("n")


@query(f"""WITH {HEAT}, z AS (SELECT * FROM h WHERE lag = 0), f AS (SELECT median(mi) AS floor FROM (SELECT mi FROM z ORDER BY "window" LIMIT 3)), c AS (SELECT max(mi) AS peak FROM z)
SELECT "window", mi FROM z, f, c WHERE mi > floor + 0.1 * (peak - floor) ORDER BY "window" LIMIT 1""")
def causal_contour(spark, d):
    return modes.causal_contour(heat(spark, d))


#: The lines of h at the level's value, by marching squares; lines are joined by a walk from every point.
LINES = f"""{heat_sql(WIDE_LAGS)}, level AS (SELECT median(mi) AS level FROM h),
c AS (SELECT lag::DOUBLE AS x0, "window"::DOUBLE AS y0, mi AS z, lead(lag::DOUBLE) OVER r AS x1, lead(mi) OVER r AS zr FROM h WINDOW r AS (PARTITION BY "window" ORDER BY lag)),
d AS (SELECT *, lead(y0) OVER u AS y1, lead(z) OVER u AS z01, lead(zr) OVER u AS z11 FROM c WINDOW u AS (PARTITION BY x0 ORDER BY y0)),
q AS (SELECT x0, x1, y0, y1, z AS z00, zr AS z10, z01, z11, level FROM d, level WHERE x1 IS NOT NULL AND y1 IS NOT NULL),
g AS (SELECT *, CASE WHEN (z00 > level) <> (z10 > level) THEN {{'at': 'h:' || x0 || ':' || y0, 'x': x0 + (level - z00) / (z10 - z00) * (x1 - x0), 'y': y0}} END AS b,
  CASE WHEN (z10 > level) <> (z11 > level) THEN {{'at': 'v:' || x1 || ':' || y0, 'x': x1, 'y': y0 + (level - z10) / (z11 - z10) * (y1 - y0)}} END AS r,
  CASE WHEN (z01 > level) <> (z11 > level) THEN {{'at': 'h:' || x0 || ':' || y1, 'x': x0 + (level - z01) / (z11 - z01) * (x1 - x0), 'y': y1}} END AS t,
  CASE WHEN (z00 > level) <> (z01 > level) THEN {{'at': 'v:' || x0 || ':' || y0, 'x': x0, 'y': y0 + (level - z00) / (z01 - z00) * (y1 - y0)}} END AS l FROM q),
w AS (SELECT b, r, t, l, (z00 > level) <> ((z00 + z10 + z01 + z11) / 4 > level) AS apart, list_filter([b, r, t, l], lambda p: p IS NOT NULL) AS ps FROM g),
m AS (SELECT unnest(CASE WHEN len(ps) = 2 THEN [{{'a': ps[1], 'b': ps[2]}}] WHEN len(ps) = 4 AND apart THEN [{{'a': b, 'b': l}}, {{'a': r, 'b': t}}] WHEN len(ps) = 4 THEN [{{'a': b, 'b': r}}, {{'a': l, 'b': t}}] END) AS s FROM w),
n AS (SELECT s.a.at AS src, s.b.at AS dst FROM m UNION SELECT s.b.at, s.a.at FROM m),
v(node, root) AS (SELECT src, src FROM n UNION SELECT n.dst, v.root FROM v JOIN n ON n.src = v.node),
lb AS (SELECT node, min(root) AS line FROM v GROUP BY node),
z AS (SELECT line, count(*) AS segments, sum(sqrt((s.a.x - s.b.x) ^ 2 + (s.a.y - s.b.y) ^ 2)) AS length FROM m JOIN lb ON lb.node = s.a.at GROUP BY line),
f AS (SELECT DISTINCT lb.line, p.x AS lag, p.y AS "window", segments, length FROM (SELECT s.a AS p FROM m UNION ALL SELECT s.b FROM m) JOIN lb ON lb.node = p.at JOIN z USING (line)),
best AS (SELECT * FROM f WHERE line = (SELECT line FROM z ORDER BY segments DESC, length DESC, line LIMIT 1))"""


def wide_heat(spark: SparkSession, d: str) -> tuple[DataFrame, float]:
    """The heatmap over many lags, written, and its median."""
    found = written(heat(spark, d, WIDE_LAGS), "heat")
    return found, found.agg(F.median("mi")).first()[0]


@query(f"""WITH RECURSIVE {LINES} SELECT count(*) OVER () AS points, segments, round(length, 4) AS length, round(lag, 4) AS lag, round("window", 4) AS "window" FROM best""")
def longest_contour(spark, d):
    table, level = wide_heat(spark, d)
    best = contours.longest_line(contours.contour_lines(table, level))
    counted = best.join(F.broadcast(best.groupBy("line").agg(F.count("*").alias("points"))), "line")  # one line
    return counted.select("points", "segments", *[F.round(c, 4).alias(c) for c in ("length", "lag", "window")])


@query(f"""WITH RECURSIVE {LINES}, z0 AS (SELECT * FROM h WHERE lag = 0), fl AS (SELECT median(mi) AS floor FROM (SELECT mi FROM z0 ORDER BY "window" LIMIT 3)), pk AS (SELECT max(mi) AS peak FROM z0),
cc AS (SELECT "window" AS contour FROM z0, fl, pk WHERE mi > floor + 0.1 * (peak - floor) ORDER BY "window" LIMIT 1),
ll AS (SELECT contour, lag::DOUBLE AS lx, (contour - lag)::DOUBLE AS ly FROM (SELECT DISTINCT lag FROM h), cc WHERE contour - lag BETWEEN (SELECT min("window") FROM h) AND (SELECT max("window") FROM h)),
br AS (SELECT contour, (lag + lx) / 2 AS lag, ("window" + ly) / 2 AS "window", sqrt((lag - lx) ^ 2 + ("window" - ly) ^ 2) AS length FROM ll, (SELECT lag, "window" FROM best) ORDER BY length LIMIT 1)
SELECT contour, round(lag, 4) AS lag, round("window", 4) AS "window", round(length, 4) AS length, round(length * 0.6, 4) AS radius FROM br""")
def parsimonious_circle(spark, d):
    table, level = wide_heat(spark, d)
    return modes.parsimonious_circle(table, level).withColumns({c: F.round(c, 4) for c in ("lag", "window", "length", "radius")})


@query()
def transfer_entropy_history(spark, d):
    return modes.transfer_histories(daily(spark, d), history=3, horizon=2)


@query("""SELECT l_linenumber AS k, round(avg(l_tax) * 200, 6) AS test_mi, count(*) AS eval_size, round(avg(l_tax) * 200, 6) > 0.85 * ln(count(*)) AS near_ceiling, round(avg(l_discount) * 100, 6) AS pr_eig,
round(avg(l_discount) * 100, 6) >= 0.8 * 6 AS near_dimension FROM lineitem GROUP BY 1""")
def ceiling_flags(spark, d):
    runs = read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.avg("l_tax") * 200, 6).alias("test_mi"), F.count("*").alias("eval_size"), F.round(F.avg("l_discount") * 100, 6).alias("pr_eig"))
    return regression.near_dimension(regression.near_ceiling(runs), 6)


@query("""WITH h AS (SELECT l_orderkey AS k, l_linenumber AS e, l_extendedprice AS v FROM lineitem), m AS (SELECT *, max(v) OVER (PARTITION BY k ORDER BY e, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(v) OVER (PARTITION BY k) AS top FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY e, v) - 1 AS i FROM m)
SELECT k, min(i)::INT AS epoch FROM n WHERE (before IS NULL OR (v - before) / (abs(before) + 1e-8) > 0) AND v >= 0.8 * top GROUP BY k""")
def conservative_epoch(spark, d):
    runs = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))), lambda s: s["l_extendedprice"]).alias("history"))
    return runs.select("k", regression.conservative_epoch(F.col("history"), 0.8, 0.0).alias("epoch"))


NOISE = f"sqrt(-2 * ln({uniform_sql(0, 9, 'id', 'channel')})) * cos(2 * pi() * {uniform_sql(1, 9, 'id', 'channel')})"


@query(f"""WITH c AS (SELECT vec_id AS id, unnest(range(0, 32))::INT AS channel, unnest(embedding[1:32])::DOUBLE AS v FROM embeddings), d AS (SELECT channel, stddev_pop(v) AS sd FROM c GROUP BY channel)
SELECT level AS sigma_add, id, channel, round(v + level * sd * {NOISE}, 5) + 0.0 AS v FROM c JOIN d USING (channel), (SELECT unnest([0.25, 1.0])::DOUBLE AS level)""")
def fixed_noise(spark, d):
    noisy = splits.fixed_noise(halves(spark, d).select("id", "x"), [0.25, 1.0], seed=9)
    return noisy.select("sigma_add", "id", F.posexplode("x").alias("channel", "v")).withColumn("v", F.round("v", 5) + 0.0)  # no negative zero


SPLITS = [splits.positions("random", 64, 3, k) for k in range(3)]
SPLIT_SQL = " UNION ALL ".join(f"SELECT {k} AS split, {[c + 1 for c in a]} AS a, {[c + 1 for c in b]} AS b" for k, (a, b) in enumerate(SPLITS))


@query(f"""WITH o AS ({SPLIT_SQL}), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
a AS (SELECT split, vec_id, unnest(range(0, 32)) AS i, unnest(list_transform(a, lambda c: e[c])) AS a FROM v, o), b AS (SELECT split, vec_id, unnest(range(0, 32)) AS j, unnest(list_transform(b, lambda c: e[c])) AS b FROM v, o),
c AS (SELECT split, i, j, covar_samp(a, b) / (stddev_pop(a) * stddev_pop(b)) AS c FROM a JOIN b USING (split, vec_id) GROUP BY split, i, j),
g AS (SELECT p.split, p.j, q.j AS k, sum(p.c * q.c) AS g FROM c p JOIN c q USING (split, i) GROUP BY p.split, p.j, q.j)
SELECT x.split::INT AS split, round(s2 * s2 / s4, 5) AS pr_eig FROM (SELECT split, sum(c * c) AS s2 FROM c GROUP BY split) x JOIN (SELECT split, sum(g * g) AS s4 FROM g GROUP BY split) y USING (split)""")
def dimensionality(spark, d):
    """Participation ratios of the cross-covariance between random halves of all channels, for three splits."""
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return api.run(vectors, "dimensionality", n_splits=3, seed=3).table.select("split", F.round("pr_eig", 5).alias("pr_eig"))


@query()
def dimensionality_ladder(spark, d):
    """The same with fixed noise added at two levels, the channels halved as an image of 8 x 8."""
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    return r6(api.run(vectors, "dimensionality", split_method="diagonal", shape=(8, 8), levels=(0.5, 2.0), whitening="zca").table, "pr_eig", "pr_singular", "entropy", "effective_rank")


@query("SELECT count(*) AS n, round(sum(a.embedding[1]::DOUBLE * b.embedding[64]::DOUBLE), 5) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 3")
def temporal_views(spark, d):
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    pairs = api.view_pairs(vectors, 1, "temporal", 0, lag=3)
    return pairs.agg(F.count("*").alias("n"), F.round(F.sum(F.get("x", F.lit(0)) * F.get("y", F.lit(63))), 5).alias("total"))


SIDE_LISTS = {m: splits.positions(m, 64, shape=(8, 8), first=[1, 5, 9]) for m in ("index", *SIDES)}


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, vec_id AS id, round(list_sum(list_transform({[k + 1 for k in a]}, lambda c: embedding[c]::DOUBLE)), 5) AS x, round(list_sum(list_transform({[k + 1 for k in b]}, lambda c: embedding[c]::DOUBLE)), 5) AS y FROM embeddings" for m, (a, b) in SIDE_LISTS.items()))
def image_views(spark, d):
    """The sums of both views of every vector, taken as an image of 8 x 8."""
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, b: a + b), 5).alias(c)
    found = None
    for m, (a, b) in SIDE_LISTS.items():
        part = vectors.select(F.lit(m).alias("method"), "id", align.picked("x", a).alias("x"), align.picked("x", b).alias("y")).select("method", "id", total("x"), total("y"))
        found = part if found is None else found.union(part)
    return found


@query()
def learned_estimate(spark, d):
    """A trained critic on the halves of the vectors."""
    training = critics.Training(n_epochs=5, learning_rate=2e-3, seed=1)
    return critics.learned(halves(spark, d), training).select("train_mi", "test_mi", "best_epoch", "eval_size")


@query()
def learned_precision(spark, d):
    """A critic trained once on the halves of the vectors, frozen, and scored on copies with both halves rounded."""
    t = critics.Training(n_epochs=5, learning_rate=2e-3, seed=1)
    scores = critics.corrupted_scores(critics.train(halves(spark, d), t), [0.05, 0.2, 0.8], target="both")
    return scores.select("tau", "n", "mi")


@query()
def learned_spectra(spark, d):
    """Participation ratios of the embeddings of the halves after each of four epochs."""
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    found = api.run(vectors, "dimensionality", split_method="spatial", critic="mlp", n_epochs=4, embedding_dim=8)
    return found.details["epochs"].select("split", "epoch", "pr_eig", "pr_singular", "effective_rank")


@query()
def synthetic_gaussians(spark, d):
    return generators.correlated_gaussians(spark, 2000, 5, 2.0, seed=42)


@query(f"""WITH {EV} SELECT event_type AS neuron, floor(t / 3600)::BIGINT AS hour, count(*) AS n FROM e GROUP BY 1, 2""")
def stream_binned(spark, d):
    return binned.run_once(spark, d)


@query("""WITH e AS (SELECT event_type AS neuron, epoch(ts::TIMESTAMP) AS t FROM events), m AS (SELECT max(t) AS top FROM e),
w AS (SELECT neuron, (floor(t / 7200) - k)::BIGINT * 2 AS hour FROM e, (SELECT unnest(range(0, 3)) AS k))
SELECT neuron, hour, count(*) AS n FROM w, m WHERE (hour + 6) * 3600 <= top - 86400 GROUP BY 1, 2""")
def stream_closed_windows(spark, d):
    """A stream in append mode: windows that are a day past when the stream ends."""
    return binned.run_closed(spark, d)


@query("""WITH s AS (SELECT event_type AS channel, epoch(ts::TIMESTAMP) AS t, max(value::DOUBLE) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
q AS (SELECT channel, k, k * 1800.0::DOUBLE AS t FROM (SELECT channel, unnest(range(ceil(min(t) / 1800)::BIGINT, floor(max(t) / 1800)::BIGINT + 1)) AS k FROM s GROUP BY channel)),
l AS (SELECT q.channel, q.k, q.t, s.t AS lt, s.value AS lv FROM q ASOF JOIN s ON q.channel = s.channel AND q.t >= s.t),
b AS (SELECT l.*, s.t AS rt, s.value AS rv FROM l ASOF JOIN s ON l.channel = s.channel AND l.t <= s.t)
SELECT channel, k, round(CASE WHEN lt = t THEN lv ELSE lv + (rv - lv) / (rt - lt) * (t - lt) END, 5) AS value FROM b""")
def stream_resampled(spark, d):
    """A stream of samples by event type on a grid of half hours, the last sample carried over."""
    return resampled.run_once(spark, d).withColumn("value", F.round("value", 5))


# ---------------------------------------------------------------- streams in pairs, corruption, grids and rigorous scalars


@query(f"""WITH {EV}, v AS (SELECT w FROM (SELECT DISTINCT w, t FROM x) GROUP BY w HAVING count(*) >= 25), i AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS id FROM v)
SELECT id AS w, 5 AS slots, count(*) AS events FROM i JOIN x USING (w) GROUP BY id""")
def paired_streams(spark, d):
    """A signal and spikes on one grid: only windows with 25 times or more stay."""
    options = {"seconds": 1800.0, "min_coverage": 5.0}
    wx, wy = tables.paired(event_signal(spark, d), event_spikes(spark, d), "continuous", "spike", SIZE, STEP, options, {"bin_size": 1800.0})
    y = wy.groupBy("w").agg(F.round(F.sum("value") * 1800.0).cast("long").alias("events"))
    return wx.groupBy("w").agg(F.count("*").cast("int").alias("slots")).join(y, "w")


@query(f"WITH {EV} SELECT event_type AS neuron, round(sum(0.5 * round_even((t - t0) / 0.5, 0)), 4) AS rounded, round(sum((t - t0) + 0.2 * ({uniform_sql(4, 'event_id')} - 0.5)), 4) AS jittered FROM (SELECT event_id, event_type, epoch_us(ts) / 1e6 AS t FROM events), g GROUP BY event_type")
def corrupted_spikes(spark, d):
    ev = read(spark, d, "events").select("event_id", F.col("event_type").alias("neuron"), tables.seconds("ts").alias("t"))
    first = ev.agg(F.min("t").alias("t0"))
    cells = ev.crossJoin(F.broadcast(first)).select("event_id", "neuron", (F.col("t") - F.col("t0")).alias("value"))  # one row
    noisy = corrupt.apply_noise(cells, "spike", 0.2, 4, ["event_id"]).select("event_id", F.col("value").alias("noisy"))
    both = corrupt.apply_precision(cells, "spike", 0.5).join(noisy, "event_id")
    return both.groupBy("neuron").agg(F.round(F.sum("value"), 4).alias("rounded"), F.round(F.sum("noisy"), 4).alias("jittered"))


@query(f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN v <> 0 THEN v + 0.1 * sqrt(-2 * ln({uniform_sql(0, 5, 'l_orderkey', 'l_linenumber')})) * cos(2 * pi() * {uniform_sql(1, 5, 'l_orderkey', 'l_linenumber')}) ELSE v END, 5) + 0.0 AS continuous,
round(CASE WHEN v > 0 THEN greatest(v + 0.1 * ({uniform_sql(5, 'l_orderkey', 'l_linenumber')} - 0.5), 0) ELSE v END, 5) + 0.0 AS binned FROM (SELECT *, l_discount AS v FROM lineitem)""")
def noisy_cells(spark, d):
    keys = ["l_orderkey", "l_linenumber"]
    cells = read(spark, d, "lineitem").select(*keys, F.col("l_discount").alias("continuous"), F.col("l_discount").alias("binned"))
    noisy = corrupt.apply_noise(corrupt.apply_noise(cells, "continuous", 0.1, 5, keys, "continuous"), "binned", 0.1, 5, keys, "binned")
    return noisy.withColumns({c: F.round(c, 5) + 0.0 for c in ("continuous", "binned")})  # no negative zero


@query(f"""WITH {SCALARS}, t AS (SELECT 0.0::DOUBLE AS tau, 0 AS draw UNION ALL SELECT tau, draw FROM (SELECT unnest([0.5, 2.0])::DOUBLE AS tau), (SELECT unnest(range(0, 4))::INT AS draw)),
q AS (SELECT tau, draw, {GMI.format(x='xx', y='y').replace('round(', '(').replace(', 6)', ')')} AS mi FROM (SELECT *, x + tau * ({uniform_sql(2, "'x'", 'draw', 'id')} - 0.5) AS xx FROM p, t) GROUP BY tau, draw)
SELECT tau, round(avg(mi), 5) AS mi, round(stddev_pop(mi), 5) AS mi_std, count(*) AS n_runs FROM q GROUP BY tau""")
def noise_precision(spark, d):
    found = modes.noise_curve(scalars(spark, d), [0.5, 2.0], samples=4, seed=2)
    return found.withColumns({c: F.round(c, 5) for c in ("mi", "mi_std")})


@query(f"""WITH {DAILY}, t AS (SELECT lag, tau FROM (SELECT unnest([-1, 0, 1])::INT AS lag), (SELECT unnest([2.0, 20.0])::DOUBLE AS tau)),
q AS (SELECT lag, tau, {GMI.format(x='tau * round_even(a.x / tau, 0)', y='b.y')} AS mi FROM t, p a JOIN p b ON b.idx = a.idx + lag GROUP BY lag, tau)
SELECT lag, tau, mi + 0.0 AS mi_mean, 0.0::DOUBLE AS mi_std, 2::BIGINT AS n_runs FROM q""")
def lag_grid(spark, d):
    prepare = lambda t: t.withColumn("x", scalar.rounded(F.col("x"), F.col("tau")))
    return r6(api.run(daily(spark, d), "lag", lags=(-1, 0, 1), grid={"tau": [2.0, 20.0]}, prepare=prepare, repeats=2).table, "mi_mean", "mi_std")


@query("WITH t AS (SELECT unnest([0.5, 1.0])::DOUBLE AS power), q AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, power, {GMI.format(x=f'(({a} + 1) ^ power)', y=b)} AS mi FROM lineitem, t GROUP BY power" for a, b in [("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax")]) + ") SELECT a, b, power, mi AS mi_mean, 0.0::DOUBLE AS mi_std, 1::BIGINT AS n_runs FROM q")
def pairwise_grid(spark, d):
    rows = read(spark, d, "lineitem").withColumn("id", F.xxhash64("l_orderkey", "l_linenumber"))
    prepare = lambda t: t.withColumn("l_quantity", F.pow(F.col("l_quantity") + 1, F.col("power")))
    found = api.run(rows, "pairwise", columns=("l_quantity", "l_extendedprice", "l_tax"), pairs=(("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax")), grid={"power": [0.5, 1.0]}, prepare=prepare)
    return r6(found.table, "mi_mean", "mi_std")


@query(f"""WITH {CHUNKS.replace('unnest(range(1, 11))', 'unnest(range(1, 6))').replace('r AS (SELECT vec_id', 'o AS (SELECT vec_id').replace('FROM r,', 'FROM o,')}, q AS (SELECT * FROM k), {JOINT.format(k='gamma, chunk, ', g='GROUP BY gamma, chunk')}
SELECT gamma, chunk, n, round(b - a, 6) AS train_mi FROM m""")
def rigorous_conditional_runs(spark, d):
    return r6(modes.rigorous_conditional_runs(scalars(spark, d), gammas=5, seed=1), "train_mi")


@query()
def rigorous_conditional(spark, d):
    return api.run(scalars(spark, d), "conditional", rigorous=True, seed=1).table


@query(f"""WITH {DAILY}, f AS (SELECT a.idx, a.x, a.y, b.x AS fx, b.y AS fy FROM p a JOIN p b ON b.idx = a.idx + 1),
oo AS (SELECT *, row_number() OVER (ORDER BY {order_sql('idx', 1)}, idx) AS k, count(*) OVER () AS nn FROM f),
c AS (SELECT g AS gamma, CASE WHEN k - 1 < (nn % g) * (nn // g + 1) THEN (k - 1) // (nn // g + 1) ELSE nn % g + (k - 1 - (nn % g) * (nn // g + 1)) // (nn // g) END AS chunk, x, y, fx, fy FROM oo, (SELECT unnest(range(1, 6))::INT AS g)),
q AS (SELECT 'xy' AS way, gamma, chunk, x, fy AS y, y AS z FROM c UNION ALL SELECT 'yx', gamma, chunk, y, fx, x FROM c), {JOINT.format(k='way, gamma, chunk, ', g='GROUP BY way, gamma, chunk')}
SELECT way, gamma, chunk, n, round(b - a, 6) AS train_mi FROM m""")
def rigorous_transfer_runs(spark, d):
    return r6(modes.rigorous_transfer_runs(daily(spark, d), gammas=5, seed=1), "train_mi")


@query()
def conditional_arrays(spark, d):
    """The vectors' first and last 21 entries, given the 22 between them."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[F.slice(F.col("embedding").cast("array<double>"), at, n).alias(c) for c, at, n in (("x", 1, 21), ("z", 22, 22), ("y", 44, 21))])
    return r6(modes.conditional_arrays(v), "mi_xz_y", "mi_z_y", "cmi")


@query(f"""WITH {SCALARS}, {PERMUTED.replace('SELECT trial, y,', 'SELECT trial, y,')}, q AS (SELECT trial, r.x, m.y, r.z FROM r JOIN m USING (k)), {JOINT.format(k='trial, ', g='GROUP BY trial').replace('r AS (SELECT trial', 'rr AS (SELECT trial').replace('FROM r)', 'FROM rr)')}
SELECT trial, n, round(b - a, 6) AS cmi FROM m2""".replace('m AS (SELECT *, -0.5', 'm2 AS (SELECT *, -0.5'))
def conditional_null(spark, d):
    return r6(api.run(scalars(spark, d), "permutation", of="conditional", n_permutations=20, seed=6).table.select("trial", "n", "cmi"), "cmi")
