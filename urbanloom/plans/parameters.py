"""Scalars of the spatial model, declared once by their configuration keys."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import make_dataclass, replace
from typing import Any

from urbanloom.errors import ConfigurationError

#: Smallest positive normal double, the floor of logarithms and powers.
TINY = 2.2250738585072014e-308
#: No solver runs longer.
MOST_ITERATIONS = 10_000

#: Configuration section and key (fixed names) of each scalar, its name in the equations, and its default.
SCALARS = (
    # How a fixed point is sought.
    ("numerics", "damping_equilibrium", "damping", 0.1),
    ("numerics", "tolerance_equilibrium", "tolerance", 1e-6),
    ("numerics", "maximum_iterations", "maximum_iterations", MOST_ITERATIONS),
    ("numerics", "print_every", "print_every", 25),
    # Commuting and tastes.
    ("model", "commuting_elasticity", "epsilon", 4.0),
    ("model", "commuting_time_coefficient", "kappa", 0.01),
    # Shares of spending, of output and of floor space.
    ("model", "expenditure_share_consumption", "beta", 0.75),
    ("model", "production_share_labor", "alpha", 0.8),
    ("model", "construction_land_share", "land_share", 0.25),
    # Spillovers of density: strength, and decay by the minute.
    ("model", "amenity_spillover", "amenity_spillover", 0.155),
    ("model", "amenity_spatial_decay", "amenity_decay", 0.3),
    ("model", "productivity_spillover", "productivity_spillover", 0.071),
    ("model", "productivity_spatial_decay", "productivity_decay", 0.2),
)


def _checked(scalars: Any) -> None:
    if not (0 < scalars.alpha < 1 and 0 < scalars.beta < 1):
        raise ConfigurationError("production and consumption shares must lie strictly between 0 and 1")
    object.__setattr__(scalars, "maximum_iterations", min(int(scalars.maximum_iterations), MOST_ITERATIONS))


class Parameters(make_dataclass("Scalars", [(name, type(default), default) for _, _, name, default in SCALARS], frozen=True, namespace={"__post_init__": _checked})):
    @property
    def gamma_constant(self) -> float:
        """The mean of the Fréchet taste shock, evaluated once on the driver as Spark has no gamma function."""
        return math.gamma((self.epsilon - 1) / self.epsilon)

    def without_spillovers(self) -> Parameters:
        return replace(self, productivity_spillover=0.0, amenity_spillover=0.0)

    @classmethod
    def from_config(cls, config: Mapping[str, Any]) -> Parameters:
        return cls(**{name: type(default)(config[section][key]) for section, key, name, default in SCALARS})
