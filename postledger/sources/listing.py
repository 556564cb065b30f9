"""From items to listed rows, and what is known about a company's listing as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postledger import schemas
from postledger.functions.scalars import or_empty, unique_key
from postledger.sources.landing import detail_ref
from postledger.sources.registry import Source


def normalise(items: DataFrame, source: Source, companies: DataFrame) -> DataFrame:
    """Listed rows (``schemas.LISTED``) of a source's items.

    Text stays raw here: only rows that turn out to be new pay for HTML stripping.
    """
    settings = companies.where(F.col("ats") == source.name).select("company", "config")
    joined = items.join(settings, "company")
    fields = dict(source.fields(F.col("item"), F.col("config")))
    detail_key = fields.pop("detail_key", None)
    texts = ("ats_job_id", "title", "url", "location", "department", "raw_description")
    columns = {name: or_empty(fields.get(name, F.lit(""))) for name in texts}
    columns["posted_date"] = fields.get("posted_date", F.lit(None).cast("date"))
    columns["detail_ref"] = (
        F.lit(None).cast("string") if detail_key is None else detail_ref(F.col("company"), detail_key)
    )
    has_item = F.col("ordinal").isNotNull()
    kept = source.keep(F.col("item")) if source.keep else F.lit(True)
    columns["usable"] = has_item & kept
    columns["unique_key"] = F.when(has_item, unique_key(F.col("company"), columns["ats_job_id"]))
    order = [part.split()[0] for part in schemas.LISTED.replace("\n", " ").split(",")]
    return joined.select(
        *[columns[name].alias(name) if name in columns else F.col(name) for name in order]
    )


def union_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def limit_listing(items: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` items of each company.  Rows without an item take no item's place.

    Pages that start beyond the limit are filtered first, so what a company sorts is
    bounded by the limit and one page however long its listing is.
    """
    if not limit:
        return items
    order = Window.partitionBy("company").orderBy(F.col("ordinal").asc_nulls_last())
    return (
        items.where(F.col("offset") < limit)
        .withColumn("_row", F.row_number().over(order))
        .where(F.col("_row") <= limit)
        .drop("_row")
    )


def completeness(listed: DataFrame) -> DataFrame:
    """(company, complete) of the companies in a listing.

    A company is complete if all its documents parsed and list at least as many items
    as announced.  The announced total never cuts rows off.
    """
    enough = F.count("ordinal") >= F.coalesce(F.max("announced"), F.lit(0))
    return listed.groupBy("company").agg((enough & ~F.bool_or("corrupt")).alias("complete"))
