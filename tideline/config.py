"""Options of the three operators, and the checks made on them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from enum import IntEnum


class LearnType(IntEnum):
    """How rows are grouped into training windows."""

    BATCH = 0
    MOVING = 1
    TIME = 2


def _check_int(name: str, value, low: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an int, got {value!r}")
    if value < low:
        raise ValueError(f"{name} must be at least {low}, got {value}")


def _check_real(name: str, value) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"{name} must be a double, got {value!r}")
    if not math.isfinite(value):
        raise ValueError(f"{name} must be finite, got {value}")


class _Options:
    """Checks shared by the option classes."""

    def _check_window(self) -> None:
        if isinstance(self.learn_type, bool) or not isinstance(self.learn_type, int):
            raise TypeError(f"learn_type must be an int, got {self.learn_type!r}")
        if self.learn_type not in tuple(LearnType):
            raise ValueError(
                f"learn_type must be 0 (batch), 1 (moving window) or 2 (time), got {self.learn_type}"
            )
        _check_int("batch_size", self.batch_size, 1)
        _check_int("num_iterations", self.num_iterations, 0)
        if self.learn_type == LearnType.MOVING:
            _check_int("window_shift", self.window_shift, 1)
            if self.window_shift > self.batch_size:
                raise ValueError(
                    f"window_shift {self.window_shift} is larger than batch_size {self.batch_size}"
                )
        else:
            _check_int("window_shift", self.window_shift, 0)

    def _check_ci(self) -> None:
        _check_real("ci", self.ci)
        if not 0 < self.ci < 1:
            raise ValueError(f"ci must lie between 0 and 1, got {self.ci}")

    @property
    def shift(self) -> int:
        """Rows between the starts of two count windows."""
        return self.window_shift if self.learn_type == LearnType.MOVING else self.batch_size

    @classmethod
    def from_arguments(cls, arguments: Sequence):
        """Split a positional call into options and data columns.

        The call starts with seven constants, or with none of them: when the
        first argument is a column, every argument is data and the defaults hold.
        """
        arguments = list(arguments)
        if not arguments:
            raise TypeError("no arguments given")
        first = arguments[0]
        if isinstance(first, bool) or not isinstance(first, (int, float)):
            return cls(), arguments
        names = cls.POSITIONAL
        if len(arguments) < len(names):
            raise TypeError(f"expected the constants {', '.join(names)} before the data columns")
        values = {}
        for name, value in zip(names, arguments):
            kinds = cls.CONSTANT_TYPES[name]
            if isinstance(value, bool) or not isinstance(value, kinds):
                wanted = "double" if kinds is float else "int"
                raise TypeError(f"{name} must be a constant of type {wanted}, got {value!r}")
            values[name] = value
        return cls(**values), arguments[len(names):]


@dataclass(frozen=True)
class LinRegOptions(_Options):
    """Options of the regression; the defaults are those of the bare call."""

    learn_type: int = LearnType.BATCH
    window_shift: int = 1
    batch_size: int = 10
    num_iterations: int = 100
    step_size: float = 1e-8
    mini_batch_fraction: float = 1.0
    ci: float = 0.95
    convergence_tol: float = 0.001
    seed: int = 42
    on_diverge: str = "emit"

    POSITIONAL = (
        "learn_type", "window_shift", "batch_size", "num_iterations",
        "step_size", "mini_batch_fraction", "ci",
    )
    CONSTANT_TYPES = {
        "learn_type": int, "window_shift": int, "batch_size": int, "num_iterations": int,
        "step_size": float, "mini_batch_fraction": float, "ci": float,
    }

    def __post_init__(self):
        self._check_window()
        self._check_ci()
        _check_real("step_size", self.step_size)
        _check_real("mini_batch_fraction", self.mini_batch_fraction)
        if not 0 < self.mini_batch_fraction <= 1:
            raise ValueError(
                f"mini_batch_fraction must lie in (0, 1], got {self.mini_batch_fraction}"
            )
        _check_real("convergence_tol", self.convergence_tol)
        if not 0 <= self.convergence_tol <= 1:
            raise ValueError(f"convergence_tol must lie in [0, 1], got {self.convergence_tol}")
        if self.on_diverge not in ("error", "emit"):
            raise ValueError(f"on_diverge must be 'error' or 'emit', got {self.on_diverge!r}")


@dataclass(frozen=True)
class KMeansOptions(_Options):
    """Options of the batch-wise k-means."""

    learn_type: int = LearnType.BATCH
    window_shift: int = 0
    batch_size: int = 10
    num_iterations: int = 100
    num_clusters: int = 1
    alpha: float = 0
    ci: float = 0.95
    init: str = "parallel"
    epsilon: float = 1e-4
    update: str = "replace"
    seed: int = 42

    POSITIONAL = (
        "learn_type", "window_shift", "batch_size", "num_iterations",
        "num_clusters", "alpha", "ci",
    )
    CONSTANT_TYPES = {
        "learn_type": int, "window_shift": int, "batch_size": int, "num_iterations": int,
        "num_clusters": int, "alpha": (int, float), "ci": float,
    }

    def __post_init__(self):
        self._check_window()
        self._check_ci()
        _check_int("num_clusters", self.num_clusters, 1)
        _check_real("alpha", self.alpha)
        _check_real("epsilon", self.epsilon)
        if self.epsilon < 0:
            raise ValueError(f"epsilon must not be negative, got {self.epsilon}")
        if self.init not in ("parallel", "random", "first_k"):
            raise ValueError(f"init must be 'parallel', 'random' or 'first_k', got {self.init!r}")
        if self.update not in ("replace", "decay"):
            raise ValueError(f"update must be 'replace' or 'decay', got {self.update!r}")
        if self.update == "decay" and not 0 <= self.alpha <= 1:
            raise ValueError(f"alpha must lie in [0, 1] for update='decay', got {self.alpha}")


@dataclass(frozen=True)
class MicroClusterOptions(_Options):
    """Options of the two-level clustering.

    ``batch_size`` is the number of rows between two emitted clusterings. A period is
    summarised in blocks of ``block_rows`` rows at most, each in one task; the kernels
    of a longer period depend on it. Any integer is taken as ``learn_type``: all
    types run alike. ``mode="tree"`` combines the kernels of all periods so far as a tree:
    no key is one sequential walk, rows never leave, and ``horizon`` and
    ``radius_factor`` have no effect.
    """

    learn_type: int = LearnType.BATCH
    window_shift: int = 0
    batch_size: int = 1000
    num_iterations: int = 100
    num_clusters: int = 1
    alpha: float = 0
    ci: float = 0.95
    max_kernels: int = 100
    radius_factor: float = 2.0
    horizon: int = 1000
    weighted: bool = True
    instance_limit: int = -1
    seed: int = 42
    block_rows: int = 10_000
    mode: str = "walk"

    POSITIONAL = KMeansOptions.POSITIONAL
    CONSTANT_TYPES = KMeansOptions.CONSTANT_TYPES

    def __post_init__(self):
        # Type and shift are accepted and have no effect on this operator.
        if not isinstance(self.learn_type, int) or isinstance(self.learn_type, bool):
            raise TypeError("learn_type must be int")
        _check_int("window_shift", self.window_shift, 0)
        _check_int("batch_size", self.batch_size, 1)
        _check_int("num_iterations", self.num_iterations, 0)
        _check_int("block_rows", self.block_rows, 1)
        self._check_ci()
        _check_int("num_clusters", self.num_clusters, 1)
        _check_int("max_kernels", self.max_kernels, 1)
        _check_int("horizon", self.horizon, 1)
        _check_int("instance_limit", self.instance_limit, -1)
        _check_real("alpha", self.alpha)
        _check_real("radius_factor", self.radius_factor)
        if self.radius_factor <= 0:
            raise ValueError(f"radius_factor must be positive, got {self.radius_factor}")
        if self.mode not in ("walk", "tree"):
            raise ValueError(f"mode must be 'walk' or 'tree', got {self.mode!r}")

    @property
    def shift(self) -> int:
        return self.batch_size
