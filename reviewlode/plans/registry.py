"""Named queries and the SQL that checks them."""

from __future__ import annotations

from reviewlode.operators import delivery
from reviewlode.plans import queries, studies
from reviewlode.sources import csv_rejects

QUERIES = {
    "p4_found": csv_rejects.p4_found,
    "p4_loaded": csv_rejects.p4_loaded,
    "p5_found": delivery.p5_found,
    "p5_kept": delivery.p5_kept,
} | queries.QUERIES | studies.QUERIES
ORACLE_SQL = {"p4_found": csv_rejects.P4_FOUND_SQL, "p4_loaded": csv_rejects.P4_LOADED_SQL, "p5_found": delivery.P5_FOUND_SQL, "p5_kept": delivery.P5_KEPT_SQL} | queries.SQL
