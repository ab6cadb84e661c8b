"""Errors and warnings of reading, with the section they are about."""

from __future__ import annotations

import logging

log = logging.getLogger("larkspur")


class TableError(Exception):
    """Base of all errors that a table file can cause."""


class Corrupted(TableError):
    def __init__(self, section: str, details: str):
        super().__init__(f"corrupted {section}: {details}")
        self.section = section


class Unsupported(TableError):
    pass


class InvalidMetadata(TableError):
    pass


class SelectionError(TableError, ValueError):
    """A projection or window that can't be resolved."""


class SinkError(TableError, ValueError):
    """A sink that is used out of turn, or gets rows that don't fit."""


def warn(message: str, source: str | None = None) -> None:
    log.warning("%s%s", f"{source}: " if source else "", message)


def log_to(path: str) -> logging.Handler:
    """Warnings also go to a file, in whole lines; close the handler, or remove it from `log`, to end that."""
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(levelname)s: %(message)s"))
    log.addHandler(handler)
    return handler
