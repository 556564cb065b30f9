"""What a source is, and the table of known sources.

A source is described by the schema of its documents and by column expressions
over one listed item.  Adding one takes no Python that runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column

Fields = Callable[[Column, Column], Mapping[str, Column]]


@dataclass(frozen=True)
class Detail:
    """A second document per item that brings the long text."""

    document: str
    fields: Callable[[Column], Mapping[str, Column]]


@dataclass(frozen=True)
class Source:
    """How listed items are found in a document and turned into columns.

    ``document``  DDL of a whole document
    ``items``     path of the item array in it
    ``fields``    (item, settings) to columns of a listed row; ``settings`` is the
                  company's map of plain settings
    ``total``     path of the announced number of items, where there is one
    ``item``      DDL of one item, for XML read element by element
    ``row_tag``   element of one item, for XML
    ``keep``      which items to keep
    """

    name: str
    document: str
    items: str
    fields: Fields
    total: str | None = None
    item: str | None = None
    row_tag: str | None = None
    keep: Callable[[Column], Column] | None = None
    detail: Detail | None = None

    @property
    def is_xml(self) -> bool:
        return self.row_tag is not None


_SOURCES: dict[str, Source] = {}


def register(entry: Source) -> Source:
    _SOURCES[entry.name] = entry
    return entry


def registered() -> list[str]:
    return sorted(_SOURCES)


def source(name: str) -> Source:
    if name not in _SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(registered())}")
    return _SOURCES[name]
