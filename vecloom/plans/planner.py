"""The choice between exact and index search, made on a bounded count before a plan is built."""

from __future__ import annotations

from pyspark.sql import DataFrame

EXACT_LIMIT = 5_000
"""Filtered searches with at most so many matches are exact."""
INDEX_FROM = 1_000_000
"""Unfiltered searches of collections from this size on use an index, where there is one."""


def over_fetch(k: int) -> int:
    """Candidates that an index search fetches for a filter to choose from."""
    return max(10 * k, 100)


def matched(filtered: DataFrame, limit: int = EXACT_LIMIT) -> int:
    """Matches, counted up to limit + 1 only."""
    return filtered.limit(limit + 1).count()


def strategy(*, has_filter: bool, matches: int | None, rows: int, has_index: bool) -> str:
    """exact, post_filter or index."""
    if has_filter:
        return "exact" if matches is None or matches <= EXACT_LIMIT or not has_index else "post_filter"
    return "index" if has_index and rows >= INDEX_FROM else "exact"
