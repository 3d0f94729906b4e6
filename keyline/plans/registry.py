"""Named queries over the driver's tables and the SQL each is checked against."""

from __future__ import annotations

from keyline.plans import files, harness, parts, relational, selection

QUERIES = selection.QUERIES | relational.QUERIES | harness.QUERIES | parts.QUERIES | files.QUERIES
ORACLES = selection.ORACLES | relational.ORACLES | harness.ORACLES | parts.ORACLES | files.ORACLES
