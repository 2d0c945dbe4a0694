"""Solvers and cost models by name: the library's own, and those that a user adds.

A solver gets the moments of one window and a penalty, and returns non-negative weights. Whatever names a back-test, a comparison or a fit is given are looked
up here on the driver, and the functions travel to the executors with the job, the user's own by value: their modules need not be installed there.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column

from ..operators import accounting
from . import kernels


@dataclass(frozen=True)
class Moments:
    """What a fit sees of a window of n dates and p assets: G = X'X, c = X'y, y'y, and the number of assets wanted where a solver takes one."""

    g: np.ndarray
    c: np.ndarray
    yy: float
    n: int
    cardinality: int


@dataclass(frozen=True)
class Solver:
    """``run(moments, lam, start)`` gives (weights, iterations, converged, trace). Without ``penalised`` it runs once a window, with a penalty of 0; ``warm`` ones start from the larger penalty's weights."""

    name: str
    run: Callable
    penalised: bool = True
    warm: bool = False

    def weights(self, m: Moments, lam: float, start: np.ndarray | None) -> tuple[np.ndarray, int, bool, list]:
        w, iterations, converged, trace = self.run(m, lam, start)
        w = np.asarray(w, dtype=float)
        if w.shape != m.c.shape or not np.isfinite(w).all() or (w < -1e-9).any():
            raise ValueError(f"solver {self.name}: weights must be {len(m.c)} finite numbers, none below 0")
        return np.maximum(w, 0.0), int(iterations), bool(converged), list(trace)


_SOLVERS: dict[str, Solver] = {}
_COSTS: dict[str, Callable[..., Column]] = {}


def register_solver(name: str, run: Callable, penalised: bool = True, warm: bool = False) -> None:
    """Makes ``run`` a method under ``name``. A name can be given anew, but not one of a rule."""
    if name in RULES:
        raise ValueError(f"{name} is a rule")
    module = sys.modules.get(run.__module__)
    if module is not None and run.__module__ not in ("__main__", "builtins") and not run.__module__.startswith(__package__.split(".")[0] + "."):
        cloudpickle.register_pickle_by_value(module)
    _SOLVERS[name] = Solver(name, run, penalised, warm)


def solver(name: str) -> Solver:
    if name not in _SOLVERS:
        raise ValueError(f"unknown solver: {name}; known are {', '.join(sorted(_SOLVERS))}")
    return _SOLVERS[name]


def solvers() -> tuple[str, ...]:
    return tuple(_SOLVERS)


def register_cost(name: str, build: Callable[..., Column]) -> None:
    """Makes ``build(**parameters)``, a column of the cost per unit traded, a cost model under ``name``."""
    _COSTS[name] = build


def cost(name: str, **parameters) -> Column:
    if name not in _COSTS:
        raise ValueError(f"unknown cost model: {name}; known are {', '.join(sorted(_COSTS))}")
    return _COSTS[name](**parameters)


#: Methods that rank assets and fit nothing.
RULES = ("equal_mean", "cap_weighted", "equal_cap", "random", "benchmark")

for _name in kernels.ALGORITHMS:
    register_solver(_name, lambda m, lam, start, algo=_name: kernels.fit_l1(m.g, m.c, lam, algo, start), warm=True)
register_solver("reweighted", lambda m, lam, start: kernels.fit_reweighted(m.g, m.c, lam))
register_solver("reweighted_relative", lambda m, lam, start: kernels.fit_reweighted(m.g, m.c, lam, relative=True))
register_solver("omp", lambda m, lam, start: kernels.fit_omp(m.g, m.c, m.yy, m.cardinality), penalised=False)
register_cost("none", accounting.no_cost)
register_cost("linear", accounting.linear_cost)
register_cost("sqrt_impact", accounting.sqrt_impact_cost)
