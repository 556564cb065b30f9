"""The five built-in sources.

Fixed values: source names (users' configurations hold them) and the field names
of each document format.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from postledger.functions.scalars import (
    first_or_default,
    id_text,
    lenient_date,
    non_empty,
    or_empty,
    place,
    site_url,
)
from postledger.sources.registry import Detail, Source, register


def _paged_listing(item: Column, settings: Column) -> Mapping[str, Column]:
    path = or_empty(item["externalPath"])
    # The test is for an empty array, not for an empty first bullet.
    has_bullet = F.size(F.coalesce(item["bulletFields"], F.array().cast("array<string>"))) > 0
    return {
        "ats_job_id": F.when(has_bullet, first_or_default(item["bulletFields"])).otherwise(path),
        "title": item["title"],
        "url": site_url(settings["base_url"], settings["site_name"], path),
        "location": item["locationsText"],
        "detail_key": path,
    }


def _paged_detail(document: Column) -> Mapping[str, Column]:
    info = document["jobPostingInfo"]
    return {
        "raw_description": info["jobDescription"],
        "department": or_empty(info["jobCategory"]["descriptor"]),
    }


PAGED_LISTING = register(
    Source(
        name="workday",
        document="""total INT, jobPostings ARRAY<STRUCT<title: STRING, externalPath: STRING,
            locationsText: STRING, postedOn: STRING, bulletFields: ARRAY<STRING>>>""",
        items="jobPostings",
        total="total",
        fields=_paged_listing,
        detail=Detail(
            document="""jobPostingInfo STRUCT<jobDescription: STRING,
                jobCategory: STRUCT<descriptor: STRING>>""",
            fields=_paged_detail,
        ),
    )
)


def _board(item: Column, settings: Column) -> Mapping[str, Column]:
    return {
        "ats_job_id": id_text(item["id"]),
        "title": item["title"],
        "url": item["absolute_url"],
        "location": item["location"]["name"],
        "department": first_or_default(item["departments"], "name"),
        "detail_key": F.when(item["id"] != "0", id_text(item["id"])),
    }


BOARD = register(
    Source(
        name="greenhouse",
        # Only fields that are read, so that no other one can be of a wrong type.
        document="""jobs ARRAY<STRUCT<id: STRING, title: STRING, absolute_url: STRING,
            location: STRUCT<name: STRING>, departments: ARRAY<STRUCT<name: STRING>>>>""",
        items="jobs",
        fields=_board,
        detail=Detail(
            document="content STRING",
            fields=lambda document: {"raw_description": document["content"]},
        ),
    )
)


def _search_result(item: Column, settings: Column) -> Mapping[str, Column]:
    found = item["MatchedObjectDescriptor"]
    where = F.get(found["PositionLocation"], F.lit(0))
    text = F.get(found["PositionFormattedDescription"], F.lit(0))
    return {
        "ats_job_id": found["ID"],
        "title": found["PositionTitle"],
        "url": found["PositionURI"],
        "location": place(where["CityName"], where["CountryCode"]),
        "department": first_or_default(found["JobCategory"], "Name"),
        "raw_description": non_empty(text["Tasks"], text["Content"]),
        "posted_date": lenient_date(found["PublicationStartDate"]),
    }


SEARCH_RESULT = register(
    Source(
        name="mercedesbenz",
        document="""SearchResult STRUCT<SearchResultCountAll: INT, SearchResultItems: ARRAY<STRUCT<
            MatchedObjectDescriptor: STRUCT<ID: STRING, PositionTitle: STRING, PositionURI: STRING,
            PublicationStartDate: STRING,
            PositionLocation: ARRAY<STRUCT<CityName: STRING, CountryCode: STRING>>,
            PositionFormattedDescription: ARRAY<STRUCT<Tasks: STRING, Content: STRING>>,
            JobCategory: ARRAY<STRUCT<Name: STRING>>>>>>""",
        items="SearchResult.SearchResultItems",
        total="SearchResult.SearchResultCountAll",
        fields=_search_result,
        keep=lambda item: item["MatchedObjectDescriptor"].isNotNull(),
    )
)


def _flat_feed(item: Column, settings: Column) -> Mapping[str, Column]:
    where = F.get(item["locations"]["location"], F.lit(0))
    return {
        "ats_job_id": item["jobid"],
        "title": item["title"],
        "url": item["url"],
        "location": place(where["city"], where["country"]),
        "department": item["employer"],
        "raw_description": item["description"],
        "posted_date": lenient_date(item["published"]),
    }


_FLAT_ITEM = (
    ("jobid", "STRING"),
    ("title", "STRING"),
    ("url", "STRING"),
    ("published", "STRING"),
    ("employer", "STRING"),
    ("description", "STRING"),
    ("locations", "STRUCT<location: ARRAY<STRUCT<city: STRING, country: STRING>>>"),
)

_RSS_ITEM = (
    ("title", "STRING"),
    ("link", "STRING"),
    ("guid", "STRING"),
    ("description", "STRING"),
    ("g:id", "STRING"),
    ("g:location", "STRING"),
    ("g:job_function", "STRING"),
)


def _ddl(fields: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields)


def _struct(fields: tuple[tuple[str, str], ...]) -> str:
    return "STRUCT<" + ", ".join(f"`{name}`: {kind}" for name, kind in fields) + ">"


FLAT_FEED = register(
    Source(
        name="google",
        document=f"job ARRAY<{_struct(_FLAT_ITEM)}>",
        items="job",
        item=_ddl(_FLAT_ITEM),
        row_tag="job",
        fields=_flat_feed,
    )
)


def _rss(item: Column, settings: Column) -> Mapping[str, Column]:
    return {
        "ats_job_id": non_empty(item["guid"], item["g:id"]),
        "title": item["title"],
        "url": item["link"],
        "location": item["g:location"],
        "department": item["g:job_function"],
        "raw_description": item["description"],
    }


RSS = register(
    Source(
        name="volkswagen",
        document=f"channel STRUCT<item: ARRAY<{_struct(_RSS_ITEM)}>>",
        items="channel.item",
        item=_ddl(_RSS_ITEM),
        row_tag="item",
        fields=_rss,
    )
)
