"""All registered queries in one mapping."""

from workload import books, trading  # noqa: F401
from workload.queries import REGISTRY

__all__ = ["REGISTRY"]
