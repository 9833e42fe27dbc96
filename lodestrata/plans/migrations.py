"""Forward-only schema migrations of tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame


class MigrationError(Exception):
    pass


class DowngradeRefused(MigrationError):
    pass


class MissingMigration(MigrationError):
    pass


def path_of(have: int, want: int, known: Mapping[int, object]) -> list[int]:
    """The versions to step from, checked as a whole before anything runs."""
    if have > want:
        raise DowngradeRefused(f"version {have} is newer than {want}")
    steps = list(range(have, want))
    missing = [v for v in steps if v not in known]
    if missing:
        raise MissingMigration(f"no step from version {missing[0]}")
    return steps


def migrate(df: DataFrame, have: int, want: int, steps: Mapping[int, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """df brought from version `have` to `want` by the steps registered for each version."""
    for v in path_of(have, want, steps):
        df = df.transform(steps[v])
    return df
