"""All queries of the core, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from strandframe.plans import files, general, kernels, relational

QUERIES = {**general.QUERIES, **relational.QUERIES, **kernels.QUERIES, **files.QUERIES}
ORACLES = {**general.ORACLES, **relational.ORACLES, **kernels.ORACLES, **files.ORACLES}
ENTRY = kernels.sketch_pair_sources
