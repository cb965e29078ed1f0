"""All queries of the core, by name."""

from __future__ import annotations

from . import census, commerce, graphs, intake, problems

QUERIES = {**census.Q, **graphs.Q, **commerce.Q, **intake.QUERIES, **problems.QUERIES}
SQL = {**census.SQL, **graphs.SQL, **commerce.SQL, **intake.SQL, **problems.SQL}
FLAGSHIP = "metric_profile"
