"""Random input and reservoir matrices, from explicit and separate random streams."""

from __future__ import annotations

import numpy as np

from ..config import Config


def stream(seed: int, purpose: str) -> np.random.Generator:
    """A generator of its own for each purpose, so none depends on how often another was used."""
    return np.random.default_rng([seed, *purpose.encode()])


def input_matrix(cfg: Config) -> np.ndarray:
    """(n_units, n_dim_in + 1), the bias column last. ``sparse``: each unit hears one state column or the bias, and all
    parameters; ``dense``: everything. Weights are uniform in (-1, 1)."""
    rng, n_in, n_state = stream(cfg.seed, "input"), cfg.n_dim_in, cfg.n_dim_in - cfg.n_param
    if cfg.win_type == "dense":
        return rng.uniform(-1, 1, (cfg.n_units, n_in + 1))
    if cfg.win_type != "sparse":
        raise ValueError(f"win_type must be 'sparse' or 'dense', not {cfg.win_type!r}")
    out = np.zeros((cfg.n_units, n_in + 1))
    heard = np.append(np.arange(n_state), n_in)[rng.integers(0, n_state + 1, cfg.n_units)]
    out[np.arange(cfg.n_units), heard] = rng.uniform(-1, 1, cfg.n_units)
    if cfg.n_param:
        out[:, n_state:n_in] = rng.uniform(-1, 1, (cfg.n_units, cfg.n_param))
    return out


def spectral_radius(w: np.ndarray) -> float:
    return float(np.abs(np.linalg.eigvals(w)).max())


def reservoir_matrix(cfg: Config) -> np.ndarray:
    """Random graph with ``connect`` inputs for each unit on average, scaled to spectral radius 1."""
    rng, n = stream(cfg.seed, "reservoir"), cfg.n_units
    for _ in range(100):
        w = rng.uniform(-1, 1, (n, n)) * (rng.random((n, n)) < cfg.connect / max(n - 1, 1))
        radius = spectral_radius(w)
        if radius > 1e-9:  # a small graph may have no cycle
            return w / radius
    raise ValueError("no reservoir with a positive spectral radius was drawn; raise connect or n_units")


#: Integer-hash weights that SQL can compute as well, for checks: their multipliers, modulus and scale are fixed.
def formula_weight(i: int, j: int, salt: int) -> float:
    return ((i * 7919 + j * 104729 + salt * 15485863) % 2000) / 1000.0 - 1


def formula_matrices(n_units: int, n_in: int) -> tuple[np.ndarray, np.ndarray]:
    w_in = np.array([[formula_weight(i, j, 1) for j in range(n_in + 1)] for i in range(n_units)])
    return w_in, np.array([[formula_weight(i, j, 2) for j in range(n_units)] for i in range(n_units)])
