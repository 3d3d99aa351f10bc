"""The engine's configuration."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: Default values and ranges, fixed so that models trained with defaults agree. sigma_in_range is of log10(sigma_in);
#: tikh_range lists candidates.
DEFAULTS = dict(
    bias_in=0.1, bias_out=1.0, connect=3, n_folds=4, val_fold_step=None, n_func_evals=20, n_grid=4, n_initial_rand=0,
    n_units=100, n_wash=50, max_l_tests=10, max_short_tests=10, t_val=None, t_train=None, t_test=0.5, upsample=5,
    win_type="sparse", norm_method="range", noise=1e-10, optimize=("rho", "sigma_in", "tikh"), rho=0.9,
    rho_range=(0.8, 1.05), sigma_in=1e-3, sigma_in_range=(-5.0, -1.0), tikh=1e-12, tikh_range=(1e-8, 1e-10, 1e-12, 1e-16),
    leak_rate=1.0, leak_rate_range=(0.1, 1.0), optimize_parameter_normalization=None, param_shift_range=(-1.0, 1.0),
    param_norm_range=(0.1, 10.0), seed=0,
)


@dataclass(frozen=True)
class Config:
    """Settings of one model. Unlike attributes set by name, unknown keys raise TypeError."""

    n_dim: int
    dt: float = 1.0
    observed_idx: tuple[int, ...] | None = None
    n_param: int = 0
    mode: str = "ragged"
    bias_in: float = DEFAULTS["bias_in"]
    bias_out: float = DEFAULTS["bias_out"]
    connect: int = DEFAULTS["connect"]
    n_folds: int = DEFAULTS["n_folds"]
    val_fold_step: int | None = DEFAULTS["val_fold_step"]
    validation_metric: str | None = None
    n_func_evals: int = DEFAULTS["n_func_evals"]
    n_grid: int = DEFAULTS["n_grid"]
    n_initial_rand: int = DEFAULTS["n_initial_rand"]
    n_units: int = DEFAULTS["n_units"]
    n_wash: int = DEFAULTS["n_wash"]
    max_l_tests: int = DEFAULTS["max_l_tests"]
    max_short_tests: int = DEFAULTS["max_short_tests"]
    t_val: float | None = DEFAULTS["t_val"]
    t_train: float | None = DEFAULTS["t_train"]
    t_test: float = DEFAULTS["t_test"]
    upsample: int = DEFAULTS["upsample"]
    win_type: str = DEFAULTS["win_type"]
    norm_method: str | None = DEFAULTS["norm_method"]
    noise: float = DEFAULTS["noise"]
    optimize: tuple[str, ...] = DEFAULTS["optimize"]
    rho: float = DEFAULTS["rho"]
    rho_range: tuple[float, float] = DEFAULTS["rho_range"]
    sigma_in: float = DEFAULTS["sigma_in"]
    sigma_in_range: tuple[float, float] = DEFAULTS["sigma_in_range"]
    tikh: float = DEFAULTS["tikh"]
    tikh_range: tuple[float, ...] = DEFAULTS["tikh_range"]
    leak_rate: float = DEFAULTS["leak_rate"]
    leak_rate_range: tuple[float, float] = DEFAULTS["leak_rate_range"]
    optimize_parameter_normalization: bool | None = DEFAULTS["optimize_parameter_normalization"]
    param_shift_range: tuple[float, float] = DEFAULTS["param_shift_range"]
    param_norm_range: tuple[float, float] = DEFAULTS["param_norm_range"]
    seed: int = DEFAULTS["seed"]

    def __post_init__(self):
        if self.mode not in ("regular", "ragged"):
            raise ValueError(f"mode must be 'regular' or 'ragged', not {self.mode!r}")
        if self.observed_idx is None:
            object.__setattr__(self, "observed_idx", tuple(range(self.n_dim)))
        if any(not 0 <= i < self.n_dim for i in self.observed_idx):
            raise ValueError(f"observed_idx {self.observed_idx} is outside of {self.n_dim} dimensions")
        if self.optimize_parameter_normalization is None:  # rescale parameters unless told otherwise
            object.__setattr__(self, "optimize_parameter_normalization", self.n_param > 0)

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)

    @property
    def dt_esn(self) -> float:
        return self.dt * self.upsample

    @property
    def n_dim_in(self) -> int:
        return len(self.observed_idx) + self.n_param

    def steps(self, span: float | None, name: str) -> int:
        """Steps of a time span; Python's round is half to even."""
        if span is None:
            raise ValueError(f"{name} is not set")
        return int(round(span / self.dt_esn))

    @property
    def n_train(self) -> int:
        return self.steps(self.t_train, "t_train")

    @property
    def n_val(self) -> int:
        return self.steps(self.t_val, "t_val")

    @property
    def n_test(self) -> int:
        return self.steps(self.t_test, "t_test")

    def searched(self) -> list[str]:
        """Hyperparameters of the search; parameter shifts and norms come along for parametric models."""
        names = list(self.optimize)
        if self.optimize_parameter_normalization and self.n_param:
            names += [f"param_{kind}_{i}" for i in range(self.n_param) for kind in ("shift", "norm") if f"param_{kind}_{i}" not in names]
        return names

    def range_of(self, name: str) -> tuple[float, float]:
        for prefix in ("param_shift", "param_norm"):
            if name.startswith(prefix + "_"):
                return getattr(self, prefix + "_range")
        return getattr(self, name + "_range")

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]
