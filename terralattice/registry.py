"""Named queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from terralattice.plans import _register
from terralattice.plans import areas, filters, names, places, roads, search, shapes, storage  # noqa: F401  (they register their queries)

QUERIES = _register.QUERIES
ORACLES = _register.ORACLES
