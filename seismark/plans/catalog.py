"""All registered queries; importing the modules fills the registry."""

from seismark.plans import q_compare, q_holdout, q_infer, q_runs, q_sources, q_telemetry, q_text  # noqa: F401
from seismark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
