"""run(): one entry for all analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from infospan.config import as_dict, configured
from infospan.errors import DataShapeError
from infospan.functions import regression, spectra
from infospan.functions.scalar import NATS_IN_BIT
from infospan.operators import align, splits
from infospan.plans import critics, modes
from infospan.results import Results
from infospan.sources.store import written

INFORMATION = ("mi", "mi_mean", "mi_std", "mi_corrected", "slope", "se", "mi_error", "pi_error", "train_mi", "raw_train_mi", "test_mi", "cmi", "mi_xz_y", "mi_z_y", "te_xy", "te_yx", "baseline", "threshold")


def _units(df: DataFrame, units: str) -> DataFrame:
    """Every column of information, once, in the wanted unit; plans work in bits."""
    if units == "bits":
        return df
    return df.withColumns({c: F.col(c) * NATS_IN_BIT for c in df.columns if c in INFORMATION})


def _need(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise DataShapeError(f"the table lacks {', '.join(missing)}")
    return df


def run(data: DataFrame, mode: str = "estimate", **options) -> Results:
    """Runs an analysis over a table of aligned samples.

    estimate, sweep, rigorous, precision, permutation: (id, x, y); lag, transfer: (idx, x, y); conditional: (id, x, y, z);
    pairwise: any numeric columns; dimensionality: (id, x array). x and y are numbers for the Gaussian critic (estimate and conditional take arrays, too) and
    arrays for `critic='mlp'`, which all modes but transfer offer; pairwise takes numbers, too. lag, conditional and pairwise take a
    `grid` like sweep. With a learned critic, details have its `runs`; precision trains once and scores all corrupted copies with
    the frozen critic, and dimensionality takes the spectra of the embeddings after every epoch, the last improving one in its table.
    """
    c = configured(mode, options)
    details: dict[str, DataFrame] = {}
    t = critics.Training(c.n_epochs, c.learning_rate, c.batch_size, c.hidden_dim, c.embedding_dim, estimator=c.estimator, max_eval_samples=c.max_eval_samples, seed=c.seed) if c.critic == "mlp" else None
    by_critic = (lambda table, keys, key="id": critics.learned(table, t, keys, key).withColumn("mi", F.col("train_mi"))) if t else None
    if mode == "estimate" and t:
        table = by_critic(_need(data, "id", "x", "y"), [])
    elif mode == "estimate":
        table = modes.estimate_arrays(data) if data.schema["x"].dataType.typeName() == "array" else modes.estimate(_need(data, "x", "y"))
    elif mode == "sweep":
        runs = modes.sweep(_need(data, "id", "x", "y"), c.grid, c.prepare, c.repeats, c.fraction, c.seed, by_critic)
        table, details["runs"] = modes.summary(runs, list(c.grid)), runs
    elif mode == "rigorous":
        _need(data, "id", "x", "y")
        if t:
            chunks = splits.gamma_chunks(data, "id", c.gammas, c.seed)
            runs = written(by_critic(chunks, ["gamma", "chunk"]).where("error IS NULL").select("gamma", "chunk", F.col("eval_size").cast("long").alias("n"), "train_mi"), "runs")
        else:
            runs = modes.rigorous_runs(data, gammas=c.gammas, seed=c.seed)
        table = regression.extrapolated(runs, None, c.delta_threshold, c.min_gamma_points, c.confidence_level, c.residual_threshold, c.leverage_threshold)
        details["runs"] = runs
    elif mode == "lag":
        _need(data, "idx", "x", "y")
        if t:
            pairs = modes.lag_pairs(data.select("idx", "x"), data.select("idx", "y"), list(c.lags), c.equalize_n)
            if c.grid:
                table, details["runs"] = _gridded(pairs, c, lambda rows, keys: by_critic(rows, keys, "idx"), ["lag"], "idx")
            else:
                details["runs"] = by_critic(pairs, ["lag"], "idx")
                table = details["runs"].select("lag", F.col("eval_size").cast("long").alias("n"), "mi")
        elif c.grid:
            pairs = modes.lag_pairs(data.select("idx", "x"), data.select("idx", "y"), list(c.lags), c.equalize_n)
            table, details["runs"] = _gridded(pairs, c, modes.estimate, ["lag"], "idx")
        else:
            table = modes.lag_curve(data.select("idx", "x"), data.select("idx", "y"), list(c.lags), c.equalize_n)
    elif mode == "precision":
        if t:
            trained = critics.train(_need(data, "id", "x", "y"), t)
            scores = critics.corrupted_scores(trained, list(c.tau_grid), c.corruption_method, c.corrupt_target, c.n_noise_samples)
            table = written(modes.summary(scores, ["tau"], population=True).withColumnRenamed("mi_mean", "mi"), "precision")
            details["runs"] = trained.runs
        elif c.corruption_method == "noise":
            table = modes.noise_curve(_need(data, "id", "x", "y"), list(c.tau_grid), c.n_noise_samples, c.corrupt_target, c.seed)
        else:
            table = modes.precision_curve(_need(data, "x", "y"), list(c.tau_grid), c.corrupt_target)
        ratios = c.threshold_ratio if isinstance(c.threshold_ratio, (list, tuple)) else [c.threshold_ratio]
        details["thresholds"] = _units(regression.precision_threshold(table, list(ratios)), c.output_units)
    elif mode == "conditional":
        _need(data, "x", "y", "z")
        if t and c.rigorous:
            raise ValueError("rigorous conditional information is offered with the gaussian critic")
        by = (lambda rows, keys=None: modes.conditional_by(rows, keys or [], by_critic)) if t else modes.conditional_arrays if data.schema["x"].dataType.typeName() == "array" else modes.joint_gaussian
        if c.rigorous:
            details["runs"] = modes.rigorous_conditional_runs(_need(data, "id"), gammas=c.gammas, seed=c.seed)
            table = modes.rigorous_scalar(details["runs"])
        elif c.grid:
            table, details["runs"] = _gridded(_need(data, "id"), c, lambda rows, keys: by(rows, keys).withColumn("mi", F.col("cmi")), [], "id")
        else:
            table = by(data)
    elif mode == "transfer":
        _need(data, "idx", "x", "y")
        if c.rigorous:
            details["runs"] = modes.rigorous_transfer_runs(data, c.prediction_horizon, gammas=c.gammas, seed=c.seed)
            table = modes.rigorous_scalar(details["runs"], ["way"])
        else:
            table = modes.transfer(data) if c.history_window == c.prediction_horizon == 1 else modes.transfer_histories(data, c.history_window, c.prediction_horizon)
    elif mode == "pairwise":
        listed = (list(c.columns), list(c.others) if c.others else None, list(c.pairs) if c.pairs else None)
        _need(data, *c.columns, *(c.others or ()))
        by_pairs = lambda rows, keys: by_critic(modes.pairwise_samples(rows, *listed, keys), [*keys, "a", "b"])
        if t and c.grid:
            table, details["runs"] = _gridded(_need(data, "id"), c, by_pairs, ["a", "b"], "id", population=True)
        elif t:
            details["runs"] = by_pairs(_need(data, "id"), [])
            table = details["runs"].select("a", "b", "mi")
        elif c.grid:
            table, details["runs"] = _gridded(_need(data, "id"), c, lambda rows, keys: modes.pairwise(rows, *listed, keys), ["a", "b"], "id", population=True)
        else:
            table = modes.pairwise(data, *listed)
    elif mode == "permutation":
        if t:
            if c.of == "conditional":
                by = lambda rows, keys: modes.conditional_by(rows, keys, by_critic)
                table, seen = modes.permuted_runs(_need(data, "id", "x", "y", "z"), c.n_permutations, by, seed=c.seed), modes.conditional_by(data, [], by_critic)
            else:
                table, seen = modes.permuted_runs(_need(data, "id", "x", "y"), c.n_permutations, by_critic, seed=c.seed), by_critic(data, [])
        elif c.of == "conditional":
            table = modes.permuted_runs(_need(data, "id", "x", "y", "z"), c.n_permutations, modes.joint_gaussian, seed=c.seed)
        else:
            table = modes.permutation_null(_need(data, "id", "x", "y"), c.n_permutations, seed=c.seed)
        if not t:
            seen = modes.joint_gaussian(data) if c.of == "conditional" else modes.estimate(data)
        details["observed"] = _units(seen, c.output_units)
    elif t:
        table, details["epochs"], details["runs"] = learned_dimensionality(_need(data, "id", "x"), t, c)
        details["summary"] = modes.dimensionality_summary(table, [])
    else:
        table = dimensionality(_need(data, "id", "x"), c.n_splits, c.split_method, c.whitening, c.seed, c.lag, c.indices, c.shape, c.levels)
        details["summary"] = modes.dimensionality_summary(table, ["sigma_add"] if c.levels else [])
    return Results(mode, as_dict(c), _units(table, c.output_units), {k: v if k in ("thresholds", "observed") else _units(v, c.output_units) for k, v in details.items()})


def _gridded(tasks: DataFrame, c, by, keys: list[str], key: str, population: bool = False) -> tuple[DataFrame, DataFrame]:
    """Summary by keys and grid, and the runs."""
    own = [k for k in keys if k in tasks.columns]
    runs = modes.sweep(tasks, c.grid, c.prepare, c.repeats, c.fraction, c.seed, by, own, key)
    return modes.summary(runs, [*keys, *c.grid], population=population), runs


def learned_dimensionality(samples: DataFrame, t: critics.Training, c) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The spectra (split, pr_eig, pr_singular, entropy, effective_rank, mi) of the embeddings of each split's critic after its best epoch, those after every epoch, and the runs."""
    views = written(view_pairs(samples.select("id", "x"), c.n_splits, c.split_method, c.seed, c.lag, c.indices, c.shape, keep=["id"]), "views")
    trained = critics.train(views, t, ["split"])
    embedded = critics.embeddings_by_epoch(trained, views, keys=["split"])
    keys = ["split", "epoch"]
    epochs = written(spectra.spectrum_summary(spectra.singular_values(spectra.cross_covariance(embedded, c.whitening, keys), keys), keys), "spectra")
    best = trained.runs.select("split", F.col("best_epoch").alias("epoch"), F.col("train_mi").alias("mi"))
    return epochs.join(best, keys).drop("epoch"), epochs, trained.runs


def view_pairs(samples: DataFrame, n_splits: int, method: str, seed: int, lag: int | None = None, indices: tuple | None = None, shape: tuple | None = None, keys: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(keys, keep, split, x, y): two halves of the channels of every sample, or, if `temporal`, sample id and the one at id + lag."""
    keys, keep = keys or [], keep or []
    v = samples.select(*keys, "id", F.col("x").cast("array<double>").alias("v"))
    if method == "temporal":
        later = v.select(*keys, (F.col("id") - lag).alias("id"), F.col("v").alias("y"))
        return v.join(later, [*keys, "id"]).select(*keys, *keep, F.lit(0).alias("split"), F.col("v").alias("x"), "y")
    n = samples.select(F.size("x")).first()[0]
    parts = []
    for split in range(n_splits if method == "random" else 1):
        a, b = splits.positions(method, n, seed, split, list(indices) if indices else None, shape)
        parts.append(F.struct(F.lit(split).alias("split"), align.picked("v", a).alias("x"), align.picked("v", b).alias("y")))
    return v.select(*keys, *keep, F.explode(F.array(*parts)).alias("p")).select(*keys, *keep, "p.*")


def dimensionality(samples: DataFrame, n_splits: int, method: str, whitening: str, seed: int, lag: int | None = None, indices: tuple | None = None, shape: tuple | None = None, levels: tuple[float, ...] = ()) -> DataFrame:
    """(sigma_add, split, pr_eig, pr_singular, entropy, effective_rank) of the cross-covariance between two views; sigma_add: the added noise where `levels` are given."""
    keys = ["sigma_add"] if levels else []
    noisy = splits.fixed_noise(samples.select("id", "x"), list(levels), seed) if levels else samples
    pairs = view_pairs(noisy, n_splits, method, seed, lag, indices, shape, keys)
    keys = [*keys, "split"]
    return spectra.spectrum_summary(spectra.singular_values(spectra.cross_covariance(pairs, whitening, keys), keys), keys)
