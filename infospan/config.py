"""Parameters of the analyses: names, types, least values and defaults. Unknown names and bad values are errors."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any


@dataclass(frozen=True)
class Common:
    output_units: str = "bits"
    seed: int = 0
    critic: str = "gaussian"

    def __post_init__(self) -> None:
        _one_of("output_units", self.output_units, ("bits", "nats"))
        _one_of("critic", self.critic, ("gaussian", "mlp") if isinstance(self, Learned) else ("gaussian",))


@dataclass(frozen=True)
class Learned(Common):
    """Parameters of the learned critic."""

    estimator: str = "infonce"
    n_epochs: int = 50
    learning_rate: float = 5e-4
    batch_size: int = 128
    embedding_dim: int = 16
    hidden_dim: int = 64
    max_eval_samples: int = 5000

    def __post_init__(self) -> None:
        super().__post_init__()
        _one_of("estimator", self.estimator, ("infonce", "smile"))
        for name in ("n_epochs", "batch_size", "embedding_dim", "hidden_dim", "max_eval_samples"):
            _least(name, getattr(self, name), 1)


@dataclass(frozen=True)
class Estimate(Learned):
    pass


@dataclass(frozen=True)
class Sweep(Learned):
    grid: dict[str, list] = field(default_factory=dict)
    prepare: Any = None
    repeats: int = 1
    fraction: float = 1.0

    def __post_init__(self) -> None:
        super().__post_init__()
        _least("repeats", self.repeats, 1)


@dataclass(frozen=True)
class Gridded(Learned):
    """grid: values of columns that `prepare` reads; the analysis runs once for each combination and repeat and is summed up over repeats."""

    grid: dict[str, list] = field(default_factory=dict)
    prepare: Any = None
    repeats: int = 1
    fraction: float = 1.0

    def __post_init__(self) -> None:
        super().__post_init__()
        _least("repeats", self.repeats, 1)


@dataclass(frozen=True)
class Rigorous(Learned):
    gammas: int = 10
    delta_threshold: float = 0.1
    min_gamma_points: int = 5
    confidence_level: float = 0.68
    residual_threshold: float = 2.5
    leverage_threshold: float = 0.2

    def __post_init__(self) -> None:
        super().__post_init__()
        _least("gammas", self.gammas, 2)
        if not 0 < self.confidence_level < 1:
            raise ValueError("confidence_level lies between 0 and 1")


@dataclass(frozen=True)
class Lag(Gridded):
    lags: tuple[int, ...] = tuple(range(-10, 11))
    equalize_n: bool = False


@dataclass(frozen=True)
class Precision(Learned):
    tau_grid: tuple[float, ...] = (0.1, 0.5, 1.0)
    threshold_ratio: float | list[float] = 0.9
    corruption_method: str = "rounding"
    corrupt_target: str = "x"
    n_noise_samples: int = 10

    def __post_init__(self) -> None:
        super().__post_init__()
        _one_of("corruption_method", self.corruption_method, ("rounding", "noise"))
        _one_of("corrupt_target", self.corrupt_target, ("x", "y", "both"))
        _least("n_noise_samples", self.n_noise_samples, 1)


@dataclass(frozen=True)
class Conditional(Gridded):
    rigorous: bool = False
    gammas: int = 10


@dataclass(frozen=True)
class Transfer(Common):
    rigorous: bool = False
    gammas: int = 10
    history_window: int = 1
    prediction_horizon: int = 1

    def __post_init__(self) -> None:
        super().__post_init__()
        _least("history_window", self.history_window, 1)
        _least("prediction_horizon", self.prediction_horizon, 1)


@dataclass(frozen=True)
class Pairwise(Gridded):
    columns: tuple[str, ...] = ()
    others: tuple[str, ...] | None = None
    pairs: tuple[tuple[str, str], ...] | None = None


@dataclass(frozen=True)
class Dimensionality(Learned):
    n_splits: int = 5
    split_method: str = "random"
    whitening: str = "std"
    lag: int | None = None
    indices: tuple[int, ...] | None = None
    shape: tuple[int, int] | None = None
    levels: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        _one_of("split_method", self.split_method, ("random", "spatial", "temporal", "index", "horizontal", "vertical", "col_interleaved", "row_interleaved", "diagonal", "antidiagonal"))
        _one_of("whitening", self.whitening, ("std", "zca", "none"))
        if self.split_method == "temporal" and not (isinstance(self.lag, int) and self.lag >= 1):
            raise ValueError("a temporal split needs a lag of 1 or more")


@dataclass(frozen=True)
class Permutation(Learned):
    n_permutations: int = 100
    of: str = "estimate"

    def __post_init__(self) -> None:
        super().__post_init__()
        _one_of("of", self.of, ("estimate", "conditional"))
        _least("n_permutations", self.n_permutations, 1)


MODES: dict[str, type[Common]] = {
    "estimate": Estimate, "sweep": Sweep, "rigorous": Rigorous, "lag": Lag, "precision": Precision, "conditional": Conditional,
    "transfer": Transfer, "pairwise": Pairwise, "dimensionality": Dimensionality, "permutation": Permutation,
}


def _one_of(name: str, value: object, allowed: tuple) -> None:
    if value not in allowed:
        raise ValueError(f"{name} is one of {', '.join(map(str, allowed))}")


def _least(name: str, value: float, least: float) -> None:
    if value < least:
        raise ValueError(f"{name} is at least {least}")


def configured(mode: str, options: dict[str, Any]) -> Common:
    """The mode's parameters with defaults filled in."""
    _one_of("mode", mode, tuple(MODES))
    known = {f.name for f in fields(MODES[mode])}
    if unknown := set(options) - known:
        raise ValueError(f"{mode} has no parameters {', '.join(sorted(unknown))}")
    return MODES[mode](**options)


def as_dict(config: Common) -> dict[str, Any]:
    return asdict(config)
