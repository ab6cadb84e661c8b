"""Projection by index or name, skip and limit, as one validated object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from larkspur.errors import SelectionError
from larkspur.sources.layout import resolve_name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def select_columns(df: DataFrame, indices: list[int]) -> DataFrame:
    """Columns in the order asked for.  An empty list, an index that doesn't exist and a repeated one are errors."""
    if not indices:
        raise SelectionError("no columns asked for")
    bad = [i for i in indices if not 0 <= i < len(df.columns)]
    if bad:
        raise SelectionError(f"no column {bad[0]}; there are {len(df.columns)}")
    if len(set(indices)) < len(indices):
        raise SelectionError("a column is asked for twice")
    return df.select(*(df[quoted(df.columns[i])] for i in indices))


def column_index(df: DataFrame, name: str) -> int:
    at = resolve_name(df.columns, name)
    if at < 0:
        raise SelectionError(f"unknown column {name!r}")
    return at


def select_names(df: DataFrame, names: list[str]) -> DataFrame:
    """By name: exact, then without trailing blanks; case matters; empty names are passed over."""
    return select_columns(df, [column_index(df, n) for n in names if n])


@dataclass
class RowSelection:
    """skip and limit rows, choose columns; indices win over names.  Empty lists choose nothing and so everything."""

    skip: int = 0
    limit: int | None = None
    indices: list[int] | None = None
    names: list[str] | None = None

    def project(self, df: DataFrame) -> DataFrame:
        if self.indices:
            return select_columns(df, self.indices)
        names = [n for n in self.names or () if n]
        return select_names(df, names) if names else df

    @property
    def projects(self) -> bool:
        return bool(self.indices) or any(self.names or ())

    def window(self, df: DataFrame, order: list[str | Column]) -> DataFrame:
        """Rows skip..skip+limit of the order; a projection is an error here.

        Which of several equal rows are taken is left open, unless the order names the rows' places too
        (of files: `_metadata.file_path` and `_metadata.row_index`).
        """
        if self.projects:
            raise SelectionError("a window takes no projection; use apply")
        return self._cut(df, order)

    def apply(self, df: DataFrame, order: list[str | Column]) -> DataFrame:
        """Projection of the window's rows; without a projection it is an error."""
        if not self.projects:
            raise SelectionError("nothing is projected; use window")
        return self.project(self._cut(df, order))

    def _cut(self, df: DataFrame, order: list[str | Column]) -> DataFrame:
        if self.skip < 0 or self.limit is not None and self.limit < 0:
            raise SelectionError("skip and limit can't be negative")
        if not self.skip and self.limit is None:
            return df
        df = df.orderBy(*order)
        if self.skip:
            df = df.offset(self.skip)
        return df if self.limit is None else df.limit(self.limit)


class MaskedRow:
    """Cells of a row by name or index; those outside the projection are refused."""

    def __init__(self, row, allowed: list[str] | None = None):
        self.row, self.names = row, list(row.__fields__)
        self.allowed = None if allowed is None else set(allowed)

    def cell(self, key: str | int):
        at = key if isinstance(key, int) else resolve_name(self.names, key)
        if not 0 <= at < len(self.names):
            raise SelectionError(f"unknown column {key!r}")
        if self.allowed is not None and self.names[at].rstrip() not in self.allowed and self.names[at] not in self.allowed:
            raise SelectionError(f"column {self.names[at]!r} is not part of the projection")
        return self.row[at]

    def get_as(self, key: str | int, convert):
        """A cell through the caller's own conversion; null stays null."""
        value = self.cell(key)
        return None if value is None else convert(value)
