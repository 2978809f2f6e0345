"""Transform operators by name."""

from sparkloom.operators import aggregate, branching, custom, fields, joins, serde  # noqa: F401  (registers them)
from sparkloom.operators.base import REGISTRY, Context

__all__ = ["REGISTRY", "Context"]
