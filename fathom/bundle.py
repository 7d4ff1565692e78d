"""Dataset contract: a lazy DataFrame plus its declared roles."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class DatasetRoles:
    features: tuple[str, ...]
    target: str
    units: dict = field(default_factory=dict)
    source: str = ""
    description: str = ""

    def with_(self, **kw) -> "DatasetRoles":
        return replace(self, **kw)


@dataclass(frozen=True)
class Bundle:
    """``df`` stays lazy; only schema facts live on the driver.

    ``encoding`` is the long dictionary table ``(column, code, class)`` of
    label-encoded features (None when nothing was encoded).
    """

    df: DataFrame
    roles: DatasetRoles
    encoding: DataFrame | None = None

    @property
    def features(self) -> list[str]:
        return list(self.roles.features)

    @property
    def target(self) -> str:
        return self.roles.target


def quote(name: str) -> str:
    """Back-quote a column name for SQL expressions (names may hold spaces)."""
    return "`" + name.replace("`", "``") + "`"
