"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import assembly, helpers, records, scalars, sequences, streams, votes

FLAGSHIP = "vote_words"
PLANS = (scalars, votes, sequences, records, assembly, streams, helpers)


def queries() -> dict:
    return {name: pair[0] for plan in PLANS for name, pair in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: pair[1] for plan in PLANS for name, pair in plan.QUERIES.items() if pair[1]}
