"""Adding detail documents to listed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Replace description (and department, where the detail brings one) of rows that
    have a detail document; leave the others as they are.  Adds ``enriched``.

    Of several details of one ``detail_ref`` the last one by ``detail_order`` counts.
    Details that no row refers to are left out before anything else.  Rows without a
    reference get a key of their own, which matches nothing, because joining them on null
    would send all of them to one task.
    """
    key = F.coalesce(F.col("detail_ref"), F.concat(F.lit("\x1e"), F.col("unique_key")))
    order = F.col("detail_order") if "detail_order" in details.columns else F.lit(0).cast("bigint")
    needed = rows.select("detail_ref").where(F.col("detail_ref").isNotNull()).distinct()
    last = (
        details.withColumn("detail_order", order)
        .join(needed, "detail_ref", "left_semi")
        .groupBy("detail_ref")
        .agg(F.max(F.struct("detail_order", "detail_description", "detail_department")).alias("last"))
    )
    found = last.select(
        F.col("detail_ref").alias("_ref"), "last.detail_description", "last.detail_department", F.lit(True).alias("_found")
    )
    joined = rows.withColumn("_key", key).join(found, F.col("_key") == F.col("_ref"), "left")
    return joined.withColumns(
        {
            "raw_description": F.when(F.col("_found"), F.col("detail_description")).otherwise(
                F.col("raw_description")
            ),
            "department": F.coalesce("detail_department", "department"),
            "enriched": F.coalesce("_found", F.lit(False)),
        }
    ).drop("_key", "_ref", "_found", "detail_description", "detail_department")
