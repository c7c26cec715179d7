"""A small learned critic: two multilayer encoders whose inner products score pairs, trained on a lower bound.

Training is data-parallel. A task's rows are dealt by a seeded hash into shards of about `shard_rows`, once; in each epoch every
shard takes its gradient steps from the task's weights, and the shards' weights are averaged by their rows. The bound is
evaluated on groups of about `max_eval_samples` test rows, all of them, and averaged. Weights are rows of a table, one for each task and
epoch, so a stopped run goes on where it stopped and any epoch's weights can be chosen afterwards. A task of one shard is trained as on one machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infospan.functions import gram
from infospan.functions.scalar import NATS_IN_BIT, seed_of
from infospan.sources.store import deleted, finished, scratch


@dataclass(frozen=True)
class Training:
    n_epochs: int = 50
    learning_rate: float = 5e-4
    batch_size: int = 128
    hidden_dim: int = 64
    embedding_dim: int = 16
    train_fraction: float = 0.9
    patience: int = 1000
    min_improvement: float = 0.001
    peak_fraction: float = 0.9
    estimator: str = "infonce"
    clip: float = 5.0
    shard_rows: int = 20_000
    max_eval_samples: int = 5_000
    seed: int = 0


def bound_and_gradient(s: np.ndarray, estimator: str, clip: float) -> tuple[float, np.ndarray]:
    """The bound of a square score matrix in nats and its gradient; SMILE's gradient is that of its Jensen-Shannon term."""
    n, diagonal = len(s), np.eye(len(s), dtype=bool)
    if estimator == "infonce":
        e = np.exp(s - s.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        lse = np.log(e.sum(1)) + s.max(1)
        return float(np.log(n) + (s.diagonal() - lse).mean()), (diagonal - p) / n
    c = np.clip(s, -clip, clip)
    off = c[~diagonal]
    value = c.diagonal().mean() - (np.log(np.exp(off - off.max()).mean()) + off.max())
    grad = np.where(diagonal, 1 / (1 + np.exp(c)) / n, -1 / (1 + np.exp(-c)) / (n * (n - 1))) * (np.abs(s) < clip)
    return float(value), grad


class Encoder:
    """Linear, softplus-free ReLU, linear; Adam."""

    def __init__(self, inputs: int, t: Training, rng: np.random.Generator):
        sizes = [inputs, t.hidden_dim, t.hidden_dim, t.embedding_dim]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.m = [np.zeros_like(p) for p in self.w + self.b]
        self.v = [np.zeros_like(p) for p in self.w + self.b]
        self.step = 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        self.held = [x]
        for k, (w, b) in enumerate(zip(self.w, self.b, strict=True)):
            x = x @ w + b
            if k < len(self.w) - 1:
                x = np.maximum(x, 0)
            self.held.append(x)
        return x

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.w + self.b])

    def load(self, flat: np.ndarray) -> Encoder:
        at = 0
        for group in (self.w, self.b):
            for k, p in enumerate(group):
                group[k] = flat[at : at + p.size].reshape(p.shape).copy()
                at += p.size
        return self

    def state(self) -> np.ndarray:
        """Weights and both of Adam's moments."""
        return np.concatenate([self.flat(), *[p.ravel() for p in self.m + self.v]])

    def restore(self, state: np.ndarray, step: int) -> Encoder:
        n = len(state) // 3
        self.load(state[:n])
        at = n
        for group in (self.m, self.v):
            for k, q in enumerate(group):
                group[k] = state[at : at + q.size].reshape(q.shape).copy()
                at += q.size
        self.step = step
        return self

    def learn(self, grad: np.ndarray, rate: float) -> None:
        """One ascent step for the gradient of the last output."""
        gw, gb = [], []
        for k in range(len(self.w) - 1, -1, -1):
            gw.append(self.held[k].T @ grad)
            gb.append(grad.sum(0))
            if k:
                grad = (grad @ self.w[k].T) * (self.held[k] > 0)
        self.step += 1
        for i, (p, g) in enumerate(zip(self.w + self.b, gw[::-1] + gb[::-1], strict=True)):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            p += rate * (self.m[i] / (1 - 0.9**self.step)) / (np.sqrt(self.v[i] / (1 - 0.999**self.step)) + 1e-8)


def encoders(inputs: tuple[int, int], t: Training, states: list[np.ndarray] | None = None, step: int = 0) -> tuple[Encoder, Encoder]:
    rng = np.random.default_rng(t.seed)
    pair = Encoder(inputs[0], t, rng), Encoder(inputs[1], t, rng)
    return pair if states is None else tuple(e.restore(np.asarray(s), step) for e, s in zip(pair, states, strict=True))


def steps(x: np.ndarray, y: np.ndarray, f: Encoder, g: Encoder, t: Training, seed: int) -> None:
    """One epoch's gradient steps over the rows, in batches of a seeded order."""
    scale, order = 1 / np.sqrt(t.embedding_dim), np.random.default_rng(seed).permutation(len(x))
    for i in range(0, len(x) - 1, t.batch_size):
        rows = order[i : i + t.batch_size]
        if len(rows) > 1:
            a, b = f(x[rows]), g(y[rows])
            _, grad = bound_and_gradient(scale * a @ b.T, t.estimator, t.clip)
            f.learn(scale * grad @ b, t.learning_rate)
            g.learn(scale * grad.T @ a, t.learning_rate)


#: Rows of a score matrix that are made at once where only its bound is wanted.
SCORED_AT_ONCE = 512


def bound(a: np.ndarray, b: np.ndarray, t: Training) -> float:
    """The bound of the score matrix of embeddings a and b in nats, made a few rows at a time."""
    n, scale, own, rest = len(a), 1 / np.sqrt(t.embedding_dim), [], []
    for low in range(0, n, SCORED_AT_ONCE):
        s = scale * a[low : low + SCORED_AT_ONCE] @ b.T
        s = np.clip(s, -t.clip, t.clip) if t.estimator == "smile" else s
        at = np.arange(len(s))
        own.append(s[at, low + at].copy())
        if t.estimator == "smile":
            s[at, low + at] = -np.inf
        top = s.max(axis=1)
        rest.append(top + np.log(np.exp(s - top[:, None]).sum(axis=1)))
    own, rest = np.concatenate(own), np.concatenate(rest)
    if t.estimator == "infonce":
        return float(np.log(n) + (own - rest).mean())
    return float(own.mean() - (rest.max() + np.log(np.exp(rest - rest.max()).sum()) - np.log(n * (n - 1))))


def evaluated(x: np.ndarray, y: np.ndarray, f: Encoder, g: Encoder, t: Training) -> float:
    return bound(f(x), g(y), t)


#: Shards of (k, part): rows side by side in the order of their ids. part < 0: a group of test rows, SHOWN: of training rows.
SHARD = "k int, part int, lot int, n int, x binary, y binary"
#: A task's weights and Adam's moments after `epoch` epochs, its scales, and the scores of the epochs before.
STATE = "k int, epoch int, step long, fx binary, gy binary, xs binary, ys binary, history array<struct<test:double,train:double,size:long>>"
#: What a shard gives to an epoch: its weights times its rows, or its part of the scores.
GIVEN = "k int, lot int, part int, n long, step long, fx binary, gy binary, test double, tested long, size long, train double, trained long"
MOMENTS = "k int, lot int, part int, n long, mx binary, vx binary, my binary, vy binary"
SHOWN = -(1 << 30)
#: Bytes of states up to which they are sent to the shards; larger ones meet their shards in a shuffle.
SENT_BYTES = 256 << 20
RUN = "train_mi double, raw_train_mi double, test_mi double, best_epoch int, conservative_epoch int, conservative_test_mi double, all_mi_negative boolean, eval_size int, test_mi_history array<double>, x_weights array<double>, y_weights array<double>, error string"


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float64)


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, np.float64).tobytes()


def _sum_given(part: pd.DataFrame) -> pd.DataFrame:
    """One row: the sums over shards, in the order of their numbers."""
    part = part.sort_values("part")
    own = part[part["n"] > 0]
    total = lambda c: _bytes(sum((_array(b) for b in own[c]), np.zeros(0 if own.empty else len(own[c].iloc[0]) // 8)))
    row = {"k": part["k"].iloc[0], "lot": 0, "part": part["lot"].iloc[0], "n": own["n"].sum(), "step": part["step"].max(), "fx": total("fx"), "gy": total("gy")}
    return pd.DataFrame([row | {c: part[c].sum() for c in ("test", "tested", "train", "trained")} | {"size": part["size"].max()}])[[c.split()[0] for c in GIVEN.split(", ")]]


def _sum_moments(part: pd.DataFrame) -> pd.DataFrame:
    """One row: the means and sums of squared deviations of all shards together."""
    part = part.sort_values("part")
    n, row = part["n"].to_numpy()[:, None], {"k": part["k"].iloc[0], "lot": 0, "part": part["lot"].iloc[0], "n": int(part["n"].sum())}
    for c in ("x", "y"):
        m, v = (np.stack([_array(b) for b in part[f"{kind}{c}"]]) for kind in "mv")
        mean = (n * m).sum(axis=0) / n.sum()
        row |= {f"m{c}": _bytes(mean), f"v{c}": _bytes((v + n * (m - mean) ** 2).sum(axis=0))}
    return pd.DataFrame([row])[[c.split()[0] for c in MOMENTS.split(", ")]]


def _mean_given(part: pd.DataFrame) -> pd.DataFrame:
    """One row: the states' mean by their rows."""
    row = _sum_given(part)
    n = row["n"].iloc[0]
    return row.assign(**{c: [_bytes(_array(row[c].iloc[0]) / n) if n else b""] for c in ("fx", "gy")})


def _summed(given: DataFrame, schema: str, by, last, lots: int) -> DataFrame:
    """by() over a task's lots, if there are several, then last() over the task: neither has more rows than about the root of the shards' number."""
    return (given.groupBy("k", "lot").applyInPandas(by, schema) if lots > 1 else given).groupBy("k").applyInPandas(last, schema)


def _started(moments: DataFrame, t: Training) -> DataFrame:
    """The states before training."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                scales = [np.concatenate([_array(m), np.maximum(np.sqrt(_array(v) / r.n), 1e-8)]) for m, v in ((r.mx, r.vx), (r.my, r.vy))]
                f, g = encoders((len(scales[0]) // 2, len(scales[1]) // 2), t)
                rows.append((r.k, 0, 0, _bytes(f.state()), _bytes(g.state()), _bytes(scales[0]), _bytes(scales[1]), []))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATE.split(", ")[:8]])

    return moments.mapInPandas(run, STATE)


def _loaded(row: dict, t: Training) -> tuple[np.ndarray, np.ndarray, Encoder, Encoder]:
    """A shard's scaled rows and its task's encoders."""
    xs, ys = _array(row["xs"]), _array(row["ys"])
    dx, dy = len(xs) // 2, len(ys) // 2
    x, y = _array(row["x"]).reshape(row["n"], dx), _array(row["y"]).reshape(row["n"], dy)
    f, g = encoders((dx, dy), t, [_array(row["fx"]), _array(row["gy"])], row["step"])
    return (x - xs[:dx]) / xs[dx:], (y - ys[:dy]) / ys[dy:], f, g


def _rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):
        yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _met(shards: DataFrame, states: DataFrame, tasks: int, inputs: int, t: Training) -> DataFrame:
    """Shards with their task's state. The states are sent where their size, which the layers give, is within SENT_BYTES."""
    weights = 24 * (inputs * t.hidden_dim + 2 * t.hidden_dim * (t.hidden_dim + t.embedding_dim + 2))
    own = states.select("k", "step", "fx", "gy", "xs", "ys")
    return shards.join(F.broadcast(own) if tasks * weights <= SENT_BYTES else own, "k")


def _pass(met: DataFrame, t: Training, epoch: int) -> DataFrame:
    """Scores of the states that come with the shards, from the first epoch on, and what the shards make of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows_of(batch):
                if (r["part"] < 0 and not epoch) or (r["part"] >= 0 and epoch == t.n_epochs) or r["n"] < 2:
                    continue
                x, y, f, g = _loaded(r, t)
                head, n = {"k": r["k"], "lot": r["lot"], "part": r["part"]}, r["n"]
                if r["part"] >= 0:
                    steps(x, y, f, g, t, seed_of(t.seed, epoch, r["part"]))
                    found = head | {"n": n, "step": f.step, "fx": _bytes(n * f.state()), "gy": _bytes(n * g.state()), "test": 0.0, "tested": 0, "size": 0, "train": 0.0, "trained": 0}
                else:
                    v, shown = n * evaluated(x, y, f, g, t), r["part"] == SHOWN
                    found = head | {"n": 0, "step": 0, "fx": b"", "gy": b"", "test": 0.0 if shown else v, "tested": 0 if shown else n, "size": 0 if shown else n, "train": v if shown else 0.0, "trained": n if shown else 0}
                yield pa.RecordBatch.from_pylist([found], _GIVEN)

    return met.mapInArrow(run, GIVEN)


_GIVEN = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[c.split()[1]]) for c in GIVEN.split(", ")])


def _next(states: DataFrame, given: DataFrame, epoch: int, lots: int) -> DataFrame:
    """The states after the epoch, with the scores of the states before it."""
    summed = _summed(given, GIVEN, _sum_given, _mean_given, lots).drop("lot", "part", "n")
    kept = states.select("k", "xs", "ys", "history")  # a row a task, without weights
    score = F.struct(F.try_divide("test", "tested").alias("test"), F.try_divide("train", "trained").alias("train"), "size")
    history = F.concat("history", F.array(score)) if epoch else F.col("history")
    return summed.join(F.broadcast(kept), "k").select("k", F.lit(epoch + 1).alias("epoch"), "step", "fx", "gy", "xs", "ys", history.alias("history"))


@dataclass
class _Task:
    """What the driver knows of a task: its scores."""

    history: list[float] = field(default_factory=list)
    best: tuple[float, int, float] = (-np.inf, 0, 0.0)
    improved: list[int] = field(default_factory=list)
    missed: int = 0
    eval_size: int = 0
    error: str | None = None
    over: bool = False
    training: Training = field(default_factory=Training)

    def note(self, epoch: int, score: float | None, own: float | None, size: int, t: Training) -> None:
        if score is None or own is None:
            self.error, self.over = "too few rows to train on", True
            return
        if not np.isfinite(score):
            self.error, self.over = f"the bound is {score} in epoch {epoch}", True
            return
        self.history.append(score)
        self.eval_size = size
        if self.best[0] == -np.inf or (score - self.best[0]) / (abs(self.best[0]) + 1e-8) > t.min_improvement:
            self.best, self.missed = (score, epoch, own), 0
            self.improved.append(epoch)
        else:
            self.missed += 1
            self.over = self.missed >= t.patience

    def conservative(self, t: Training) -> int:
        """The first improving epoch that reaches `peak_fraction` of the best one's score; the best where that isn't above 0."""
        score, epoch, _ = self.best
        return next((e for e in self.improved if self.history[e] >= t.peak_fraction * score), epoch) if score > 0 else epoch

    def row(self, unit: float) -> tuple:
        if self.error or not self.history:
            return (*[None] * 9, self.error or "too few rows to train on")
        negative, (score, epoch, own), early = max(self.history) <= 0, self.best, self.conservative(t=self.training)
        return (0.0 if negative else own / unit, own / unit, score / unit, epoch, early, self.history[early] / unit, negative, self.eval_size, [h / unit for h in self.history], None)


@dataclass
class Trained:
    """runs: (keys, RUN columns), weights those of the best epoch. weights: (keys, epoch, x_weights, y_weights) after every epoch, from 0.
    shards: the written rows; tasks: (k, keys); states: every epoch's states."""

    runs: DataFrame
    weights: DataFrame
    shards: DataFrame
    tasks: DataFrame
    states: DataFrame
    training: Training
    n_tasks: int
    inputs: int


def _sharded(samples: DataFrame, t: Training, keys: list[str], key: str, path: str) -> list:
    """Writes the shards of all tasks, a shard a row, and returns the tasks, each by its number."""
    spark = samples.sparkSession
    table = samples.select(F.struct(*keys).alias("task") if keys else F.lit(0).alias("task"), F.col(key).alias("_id"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))
    drawn = lambda name: F.pmod(F.xxhash64(F.lit(f"{name}:{t.seed}"), "_id"), F.lit(1_000_000))  # noqa: E731 - apart from the orders by which chunks and permutations are dealt
    table = table.withColumn("u", drawn("role") / 1e6)
    listed = sorted((r.asDict() for r in table.groupBy("task").agg(F.count("*").alias("rows"), F.first(F.size("x")).alias("dx"), F.first(F.size("y")).alias("dy")).collect()), key=lambda r: repr(r["task"]))  # tasks are parameters
    plan = []
    for k, r in enumerate(listed):
        train, test = r["rows"] * t.train_fraction, r["rows"] * (1 - t.train_fraction)
        shards = max(1, -(-int(train) // t.shard_rows))
        plan.append((k, r["task"], shards, max(1, -(-int(test) // t.max_eval_samples)), int(np.ceil(np.sqrt(shards))), int(min(1.0, min(t.max_eval_samples, test) / max(1.0, train)) * 1_000_000)))
    named = spark.createDataFrame(plan, f"k int, task {table.schema['task'].dataType.simpleString()}, shards int, evals int, lots int, shown int")
    table = table.join(F.broadcast(named), table["task"].eqNullSafe(named["task"])).drop("task")
    train, again = F.col("u") < t.train_fraction, drawn("shard")
    seen = train & (drawn("shown") < F.col("shown"))
    part = F.when(train, F.pmod(again, F.col("shards"))).otherwise(-1 - F.pmod(again, F.col("evals"))).cast("int")
    parts = F.explode(F.when(seen, F.array(part, F.lit(SHOWN))).otherwise(F.array(part)))
    dealt = table.select("k", parts.alias("part"), "lots", "_id", "x", "y").withColumn("lot", F.pmod(F.col("part"), F.col("lots")).cast("int"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_id", kind="stable")
        x, y = (np.stack(rows[c].to_list()) for c in ("x", "y"))
        return pd.DataFrame([{"k": key[0], "part": key[1], "lot": rows["lot"].iloc[0], "n": len(rows), "x": _bytes(x), "y": _bytes(y)}])

    dealt.groupBy("k", "part").applyInPandas(run, SHARD).write.parquet(path)
    return listed


def _moments(shards: DataFrame, lots: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows_of(batch):
                found = {c: r[c] for c in ("k", "lot", "part", "n")}
                for c in ("x", "y"):
                    v = _array(r[c]).reshape(r["n"], -1)
                    found |= {f"m{c}": _bytes(v.mean(axis=0)), f"v{c}": _bytes(((v - v.mean(axis=0)) ** 2).sum(axis=0))}
                yield pa.RecordBatch.from_pylist([found], pa.schema([(c, k) for c, k in zip(("k", "lot", "part", "n", "mx", "vx", "my", "vy"), (*[pa.int32()] * 3, pa.int64(), *[pa.binary()] * 4), strict=True)]))

    return _summed(shards.where("part >= 0").mapInArrow(run, MOMENTS), MOMENTS, _sum_moments, _sum_moments, lots)


def _weights(states: DataFrame) -> DataFrame:
    """(k, epoch, x_weights, y_weights): scales, then the layers' weights, without Adam's moments."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            flat = lambda scales, state: [np.concatenate([_array(s), _array(w)[: len(w) // 24]]) for s, w in zip(part[scales], part[state], strict=True)]  # noqa: B023, E731
            yield part[["k", "epoch"]].assign(x_weights=flat("xs", "fx"), y_weights=flat("ys", "gy"))

    return states.where("octet_length(fx) > 0").select("k", "epoch", "xs", "ys", "fx", "gy").mapInPandas(run, "k int, epoch int, x_weights array<double>, y_weights array<double>")


def train(samples: DataFrame, training: Training, keys: list[str] | None = None, key: str = "id", bits: bool = True, folder: str | None = None) -> Trained:
    """Trains a critic for each task of samples (keys, id, x array, y array), over all its rows, all tasks side by side.

    The rows are shuffled once, into shards; an epoch is one pass over the shards where they lie, which meet the table of states, and writes
    the next one. A share `train_fraction` of the rows, the first by a seeded hash, trains; the rest tests. A failed
    training gives a row with its error and null results. folder: where the tables go; a run that ended before its time goes on from the last
    state written there. The driver holds the scores.
    """
    keys, t, spark = keys or [], training, samples.sparkSession
    folder = folder or scratch(spark, "critic")
    rows, state = f"{folder}/shards", lambda e: f"{folder}/state-{e}"
    if finished(spark, rows) and finished(spark, f"{folder}/tasks"):
        listed = [r.asDict() for r in spark.read.parquet(f"{folder}/tasks").orderBy("k").collect()]
    else:
        for path in (rows, f"{folder}/tasks"):
            deleted(spark, path)
        listed = _sharded(samples, t, keys, key, rows)
        kind = f"struct<{', '.join(f'`{c}`:{samples.schema[c].dataType.simpleString()}' for c in keys)}>" if keys else "int"
        spark.createDataFrame([(k, r["task"], r["dx"], r["dy"]) for k, r in enumerate(listed)], f"k int, task {kind}, dx int, dy int").write.parquet(f"{folder}/tasks")
    shards = spark.read.schema(SHARD).parquet(rows)
    lots = 1 + (shards.agg(F.max("lot")).first()[0] or 0)
    tasks, inputs = {k: _Task(training=t) for k in range(len(listed))}, max((r["dx"] + r["dy"] for r in listed), default=0)
    if not finished(spark, state(0)):
        deleted(spark, state(0))
        _started(_moments(shards, lots), t).write.parquet(state(0))
    states = spark.read.schema(STATE).parquet(state(0))
    last, started = 0, {r["k"] for r in states.select("k").collect()}
    for k, task in tasks.items():
        if k not in started:
            task.error, task.over = "too few rows to train on", True
    for epoch in range(t.n_epochs + 1):
        alive = [k for k, task in tasks.items() if not task.over]
        if not alive:
            break
        if not finished(spark, state(epoch + 1)):
            given = f"{folder}/given-{epoch}"
            for path in (given, state(epoch + 1)):
                deleted(spark, path)
            mine = states if len(alive) == len(tasks) else states.join(F.broadcast(spark.createDataFrame([(k,) for k in alive], "k int")), "k")
            _pass(_met(shards, mine, len(alive), inputs, t), t, epoch).write.parquet(given)
            _next(mine, spark.read.schema(GIVEN).parquet(given), epoch, lots).write.parquet(state(epoch + 1))
            deleted(spark, given)
        states, last = spark.read.schema(STATE).parquet(state(epoch + 1)), epoch + 1
        scores = {r["k"]: r["score"] for r in states.select("k", F.try_element_at("history", F.lit(-1)).alias("score")).collect()}
        for k in alive:
            if k not in scores:
                tasks[k].error, tasks[k].over = "too few rows to train on", True
            elif epoch:
                tasks[k].note(epoch - 1, scores[k]["test"], scores[k]["train"], scores[k]["size"], t)
    every = spark.read.schema(STATE).parquet(*[state(e) for e in range(last + 1)])
    unit = NATS_IN_BIT if bits else 1.0
    named = spark.createDataFrame([(k, *([r["task"][c] for c in keys])) for k, r in enumerate(listed)], "k int" + "".join(f", `{c}` {samples.schema[c].dataType.simpleString()}" for c in keys))
    found = spark.createDataFrame([(k, *tasks[k].row(unit)) for k in range(len(listed))], "k int, " + ", ".join(c for c in RUN.split(", ") if "weights" not in c))
    weights = _weights(every)
    best = weights.withColumn("best_epoch", F.col("epoch") - 1).drop("epoch")
    runs = named.join(found, "k").join(best, ["k", "best_epoch"], "left").select(*keys, *[c.split()[0] for c in RUN.split(", ")])
    after = named.join(weights.where("epoch > 0"), "k").select(*keys, (F.col("epoch") - 1).alias("epoch"), "x_weights", "y_weights")
    return Trained(runs, after, shards, named, every, t, len(listed), inputs)


def learned(samples: DataFrame, training: Training, keys: list[str] | None = None, key: str = "id", bits: bool = True) -> DataFrame:
    """The runs of train(): (keys, run columns), one training for each task, over all its rows."""
    return train(samples, training, keys, key, bits).runs


def corrupted_scores(trained: Trained, taus: list[float], method: str = "rounding", target: str = "x", draws: int = 10, bits: bool = True) -> DataFrame:
    """(keys, tau, draw, n, mi) of the training rows under the frozen critics of their best epochs, with x, y or both corrupted.

    rounding: to multiples of tau, half to even, one draw; noise: uniform over (-tau/2, tau/2), `draws` draws. tau 0 is added and leaves the rows as
    they are. One pass over the shards: every copy is made, embedded and scored in the task that reads the rows, in groups of
    `max_eval_samples` rows at most, all rows in one of them.
    """
    t, unit = trained.training, NATS_IN_BIT if bits else 1.0
    keys = [c for c in trained.tasks.columns if c != "k"]
    listed = sorted({0.0, *map(float, taus)})
    copies = [(tau, d) for tau in listed for d in range(draws if method == "noise" and tau > 0 else 1)]
    frozen = trained.runs.where("error IS NULL").select(*[F.col(c).alias(f"_{c}") for c in keys], (F.col("best_epoch") + 1).alias("epoch"))
    chosen = trained.tasks.join(F.broadcast(frozen), [trained.tasks[c].eqNullSafe(F.col(f"_{c}")) for c in keys]) if keys else trained.tasks.crossJoin(F.broadcast(frozen))  # a row a task
    states = trained.states.join(F.broadcast(chosen.select("k", "epoch")), ["k", "epoch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows_of(batch):
                n, found = r["n"], []
                xs, ys = _array(r["xs"]), _array(r["ys"])
                dx, dy = len(xs) // 2, len(ys) // 2
                raw = {"x": _array(r["x"]).reshape(n, dx), "y": _array(r["y"]).reshape(n, dy)}
                f, g = encoders((dx, dy), t, [_array(r["fx"]), _array(r["gy"])], r["step"])
                order = np.random.default_rng(seed_of(t.seed, "groups", r["part"])).permutation(n)
                for tau, draw in copies:
                    rng = np.random.default_rng(seed_of(t.seed, "noise", r["part"], tau, draw))
                    changed = dict(raw)
                    for c in ("x", "y"):
                        if tau > 0 and target in (c, "both"):
                            changed[c] = tau * np.rint(raw[c] / tau) if method == "rounding" else raw[c] + tau * (rng.random(raw[c].shape) - 0.5)
                    a, b = f((changed["x"] - xs[:dx]) / xs[dx:]), g((changed["y"] - ys[:dy]) / ys[dy:])
                    for group in np.array_split(order, -(-n // t.max_eval_samples)):
                        if len(group) > 1:
                            found.append((r["k"], tau, draw, len(group), bound(a[group], b[group], t)))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kind) for c, kind in enumerate((pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.float64()))], ["k", "tau", "draw", "n", "v"])

    scored = _met(trained.shards.where("part >= 0"), states, trained.n_tasks, trained.inputs, t).mapInArrow(run, "k int, tau double, draw int, n long, v double")
    means = scored.groupBy("k", "tau", "draw").agg(F.sum("n").alias("rows"), (F.sum(F.col("v") * F.col("n")) / F.sum("n") / unit).alias("mi"))
    return means.join(trained.tasks, "k").select(*keys, "tau", "draw", F.col("rows").alias("n"), "mi")


def _blocks(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ids, n, x, y): samples side by side, a key's rows of each batch in one block, so that weights meet blocks, not rows."""
    own = samples.select(*keys, "id", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))
    columns = ["ids", "n", "x", "y"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            groups = [part.iloc[at] for at in part.groupby(keys, dropna=False, sort=False).indices.values()] if keys else [part]
            found = [(*rows[keys].iloc[0], rows["id"].to_numpy(), len(rows), *(_bytes(np.stack(rows[c].to_list())) for c in ("x", "y"))) for rows in groups if len(rows)]
            yield pd.DataFrame(found, columns=[*keys, *columns])

    named = "".join(f"`{k}` {own.schema[k].dataType.simpleString()}, " for k in keys)
    return own.mapInPandas(run, f"{named}ids array<{own.schema['id'].dataType.simpleString()}>, n int, x binary, y binary")


def embeddings_by_epoch(trained: Trained, samples: DataFrame, epochs: list[int] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, epoch, id, x, y): samples (keys, id, x, y) embedded by their task's critic after each epoch, or after those listed.

    A task's weights of all epochs meet its samples' blocks: sent up to SENT_BYTES, shuffled beyond.
    """
    t, weights, keys = trained.training, trained.weights, keys or []
    if epochs is not None:
        weights = weights.where(F.col("epoch").isin(epochs))
    listed = weights.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("epoch", "x_weights", "y_weights"))).alias("w"))
    size = 8 * (trained.inputs * (t.hidden_dim + 2) + 2 * (t.hidden_dim + 1) * (t.hidden_dim + t.embedding_dim + 1)) * (t.n_epochs + 1 if epochs is None else len(epochs)) * trained.n_tasks
    blocks = _blocks(samples, keys)
    both = blocks.join(F.broadcast(listed) if size <= SENT_BYTES else listed, keys) if keys else blocks.crossJoin(F.broadcast(listed))  # one row
    named = "".join(f"`{k}` {samples.schema[k].dataType.simpleString()}, " for k in keys)
    schema = f"{named}epoch int, id {samples.schema['id'].dataType.simpleString()}, x array<double>, y array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                n, ids = batch["n"][i].as_py(), batch["ids"].slice(i, 1).flatten()
                sides = {c: np.frombuffer(batch[c][i].as_buffer(), np.float64).reshape(n, -1) for c in ("x", "y")}
                every = batch["w"].slice(i, 1).flatten()
                for e in range(len(every)):
                    w = every.slice(e, 1).flatten()
                    out = {c: _embedded(sides[c], w[1 + s].flatten().to_numpy(), t) for s, c in enumerate(("x", "y"))}
                    same = [batch[k].take(pa.array(np.full(n, i))) for k in keys]
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel())) for v in out.values()]
                    yield pa.RecordBatch.from_arrays([*same, w[0].take(pa.array(np.zeros(n, np.int64))), ids, *lists], [*keys, "epoch", "id", "x", "y"])

    return both.mapInArrow(run, schema)


def _embedded(v: np.ndarray, flat: np.ndarray, t: Training) -> np.ndarray:
    d = v.shape[1]
    return Encoder(d, t, np.random.default_rng(0)).load(flat[2 * d :])((v - flat[:d]) / flat[d : 2 * d])


def _forward(part: pd.DataFrame, side: str, t: Training) -> list[np.ndarray]:
    return list(_embedded(np.stack(part[side].to_list()), np.asarray(part[f"{side}_weights"].iloc[0]), t))


def aligned(embedded: DataFrame, to: int, column: str = "x") -> DataFrame:
    """embedded (epoch, id, x, y) with `column` turned, epoch by epoch, onto that of the epoch `to`: the orthogonal matrix nearest to their d x d cross sums.

    Only these sums leave the tasks, d * d numbers an epoch and task.
    """
    one = embedded.where(F.col("epoch") == to).select("id", F.col(column).alias("_to"))
    pairs = embedded.select("epoch", "id", F.col(column).alias("_own")).join(one, "id")
    sums = gram.sums(pairs.select("epoch", F.col("_own").alias("x"), F.col("_to").alias("y")), ["epoch"])

    def nearest(part: pd.DataFrame) -> pd.DataFrame:
        r = part.iloc[0]
        n, dx, mean, moment = gram.unpacked(r)
        cross = moment[:dx, dx:] + n * np.outer(mean[:dx], mean[dx:])
        u, _, v = np.linalg.svd(cross)
        return pd.DataFrame([{"epoch": r["epoch"], "_turn": (u @ v).reshape(-1)}])

    turns = sums.groupBy("epoch").applyInPandas(nearest, "epoch int, _turn array<double>")

    @F.pandas_udf("array<double>")
    def turned(own: pd.Series, turn: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(a) @ np.asarray(b).reshape(len(a), -1) for a, b in zip(own, turn, strict=True)])

    return embedded.join(F.broadcast(turns), "epoch").withColumn(column, turned(column, "_turn")).drop("_turn")


def embed(samples: DataFrame, model: DataFrame, training: Training, keys: list[str] | None = None) -> DataFrame:
    """samples (keys, id, x, y) with x_embedding and y_embedding by the models of learned() with the same training parameters.

    A model's weights depend on its layers, not on the data, and are joined to the samples of its task.
    """
    keys = keys or []
    weights = model.where("error IS NULL").select(*keys, "x_weights", "y_weights")
    both = samples.join(weights, keys) if keys else samples.crossJoin(F.broadcast(weights))  # one row
    both = both.withColumns({c: F.col(c).cast("array<double>") for c in ("x", "y")})
    schema, columns = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in samples.columns), list(samples.columns)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, group in part.groupby([*keys], dropna=False) if keys else [((), part)]:
                if len(group):
                    yield group[columns].assign(x_embedding=_forward(group, "x", training), y_embedding=_forward(group, "y", training))

    return both.mapInPandas(run, f"{schema}, x_embedding array<double>, y_embedding array<double>")
