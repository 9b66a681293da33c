"""Registered queries over the driver's tables; importing a module registers its queries."""

from . import comparing, grading, graphs, literature, naming, ranking, reading, whole  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
