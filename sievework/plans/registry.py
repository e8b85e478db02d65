"""Registered queries and the SQL that computes the same rows."""

from . import project, structure  # noqa: F401  (register their queries)
from .evidence import ORACLES, QUERIES  # noqa: F401
