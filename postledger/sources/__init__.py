from postledger.sources import builtin  # noqa: F401  (registers the built-in sources)
from postledger.sources.landing import (
    details_from_bodies,
    items_from_bodies,
    read_details,
    read_items,
)
from postledger.sources.listing import completeness, limit_listing, normalise, union_sources
from postledger.sources.registry import Detail, Source, register, registered, source

__all__ = [
    "Detail",
    "Source",
    "completeness",
    "details_from_bodies",
    "items_from_bodies",
    "limit_listing",
    "normalise",
    "read_details",
    "read_items",
    "register",
    "registered",
    "source",
    "union_sources",
]
