"""Reading landed documents.

Layout of one run, one directory per source so that a source is one scan however
many companies use it:

    <run>/source=<name>/listing/company=<company>/<offset>.json   (or .xml)
    <run>/source=<name>/detail/company=<company>/<detail key>.json

At large scale many small files are the bottleneck, so the same documents may
also arrive as rows (company, offset, body), for example from compacted Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postledger.sources.registry import Source

CORRUPT = "_corrupt"

# Pages are numbered by row offset; within a page rows are numbered from zero, and an array
# cannot hold more than this leaves room for.
_PAGE_SHIFT = 31

# Text is kept as it is: no trimming, and no guessing of nulls.
_XML_TEXT = {"ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": CORRUPT}


def listing_path(run: str, source: Source) -> str:
    return f"{run}/source={source.name}/listing"


def detail_path(run: str, source: Source) -> str:
    return f"{run}/source={source.name}/detail"


@contextmanager
def _few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Loads within list directories in a few tasks a core.

    A load lists at once, by default with a task for each directory up to 10,000, and there
    is a directory for each company: starting these tasks takes far longer than they do.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def feed_files(spark: SparkSession, run: str, source: Source) -> DataFrame:
    """(company, corrupt), one row per landed XML feed, so that an empty feed counts too.

    Reading by element never sees that a feed breaks off.  A feed is whole if the element
    that it opens first is closed behind its last item tag.  The files are split at ``>``
    for that, and tags inside comments and CDATA sections do not count.  Telling them
    apart orders the pieces of one file in one task (a window over the file).
    """
    path = listing_path(run, source)
    with _few_listing_tasks(spark):
        raw = (
            spark.read.format("text")
            .schema("value STRING, company STRING")
            .option("basePath", path)
            .option("lineSep", ">")
            .load(path)
        )
    tag = F.col("value")
    # Comments and CDATA sections end in a piece ending with "--" or "]]" (the ">" was cut).
    # What they hold is no markup: a piece is hidden if one opened before it and did not
    # end, or if one opens in it, which holds its trailing tag then.
    kinds = (("<!--", "--"), ("<![CDATA[", "]]"))
    found = raw.select(
        "company",
        "value",
        F.col("_metadata.file_path").alias("file"),
        _position().alias("position"),
        *[(tag.contains(start) & ~tag.endswith(end)).alias(f"_open{k}") for k, (start, end) in enumerate(kinds)],
        *[tag.endswith(end).alias(f"_end{k}") for k, (_, end) in enumerate(kinds)],
    )
    before = Window.partitionBy("company", "file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    inside = [
        F.coalesce(F.max(F.when(F.col(f"_open{k}"), F.col("position"))).over(before), F.lit(-1))
        > F.coalesce(F.max(F.when(F.col(f"_end{k}"), F.col("position"))).over(before), F.lit(-1))
        for k in range(len(kinds))
    ]
    hidden = reduce(or_, [*inside, *[F.col(f"_open{k}") for k in range(len(kinds))]])
    shown = found.withColumn("_hidden", hidden)
    visible = ~F.col("_hidden")
    opened = F.when(visible, F.nullif(F.regexp_extract(tag, r"^\s*<([\p{L}_:][^\s/<]*)", 1), F.lit("")))
    closed = F.when(visible, F.nullif(F.regexp_extract(tag, r"</([^\s/<]+)\s*$", 1), F.lit("")))
    pieces = shown.select(
        "company",
        "file",
        "position",
        opened.alias("opened"),
        tag.rlike(r"/\s*$").alias("alone"),
        closed.alias("closed"),
        (visible & tag.rlike(rf"</?\Q{source.row_tag}\E(\s[^<]*)?/?\s*$")).alias("of_item"),
    )
    first = F.min(F.when(F.col("opened").isNotNull(), F.struct("position", "opened", "alone")))
    # A row per file and name of a closing tag, then a row per file.
    names = pieces.groupBy("company", "file", "closed").agg(
        F.max("position").alias("at"), first.alias("first"), F.max(F.when(F.col("of_item"), F.col("position"))).alias("item")
    )
    files = names.groupBy("company", "file").agg(
        F.min("first").alias("first"), F.max("item").alias("item"), F.collect_list(F.struct("closed", "at")).alias("ends")
    )
    last = F.coalesce("item", F.lit(-1))
    ended = F.exists("ends", lambda end: (end["closed"] == F.col("first.opened")) & (end["at"] > last))
    return files.select("company", (~F.coalesce(ended | F.col("first.alone"), F.lit(False))).alias("corrupt"))


def _position() -> Column:
    """A number that grows along a file.

    A task holds at most one full block of a file, and a block has more bytes than rows, so
    block start plus row number keeps the order of the document.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + row


def _exploded(documents: DataFrame, source: Source) -> DataFrame:
    """(company, offset, ordinal, item, announced, corrupt): one row per item of each
    document, and one without an item for a document that has none.

    A field of another type than declared is null and marks its document as corrupt; the
    document's items stay.  A document that does not parse at all has none.
    """
    announced = F.col(f"document.{source.total}") if source.total else F.lit(None).cast("int")
    exploded = documents.select(
        "company",
        "offset",
        announced.alias("announced"),
        "corrupt",
        F.posexplode_outer(F.col(f"document.{source.items}")).alias("position", "item"),
    )
    ordinal = F.shiftleft(F.col("offset"), _PAGE_SHIFT) + F.col("position")
    return exploded.select("company", "offset", ordinal.alias("ordinal"), "item", "announced", "corrupt")


def _is_corrupt(field: str) -> Column:
    """Whether a record did not parse as declared.

    Spark refuses to read files for the corrupt record alone, so a field stands beside it.
    """
    told = F.when(F.col(f"`{field}`").isNull(), F.col(CORRUPT).isNotNull()).otherwise(F.length(CORRUPT) > 0)
    return F.coalesce(told, F.lit(False))


def read_documents(spark: SparkSession, run: str, source: Source) -> DataFrame:
    """(company, offset, document, corrupt) of a JSON source."""
    path = listing_path(run, source)
    with _few_listing_tasks(spark):
        raw = (
            spark.read.format("json")
            .schema(f"{source.document}, {CORRUPT} STRING, company STRING")
            .option("basePath", path)
            .option("multiLine", True)
            .option("columnNameOfCorruptRecord", CORRUPT)
            .load(path)
        )
    fields = [c for c in raw.columns if c not in (CORRUPT, "company")]
    number = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.[^.]*\z", 1)
    return raw.select(
        "company",
        F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint")).alias("offset"),
        F.struct(*fields).alias("document"),
        _is_corrupt(fields[0]).alias("corrupt"),
    )


def read_items(spark: SparkSession, run: str, source: Source) -> DataFrame:
    """(company, offset, ordinal, item, announced, corrupt) of a source's landed listings."""
    if not source.is_xml:
        return _exploded(read_documents(spark, run, source), source)
    path = listing_path(run, source)
    with _few_listing_tasks(spark):
        raw = (
            spark.read.format("xml")
            .schema(f"{source.item}, {CORRUPT} STRING, company STRING")
            .option("basePath", path)
            .option("rowTag", source.row_tag)
            .options(**_XML_TEXT)
            .load(path)
        )
    names = [c for c in raw.columns if c not in (CORRUPT, "company")]
    fields = [F.col(f"`{c}`") for c in names]
    # An element that does not parse is no item.
    whole = ~_is_corrupt(names[0])
    items = raw.select(
        "company",
        F.lit(0).cast("bigint").alias("offset"),
        F.when(whole, _position()).alias("ordinal"),
        F.when(whole, F.struct(*fields)).alias("item"),
        F.lit(None).cast("int").alias("announced"),
        (~whole).alias("corrupt"),
    )
    return items.unionByName(feed_files(spark, run, source), allowMissingColumns=True)


def documents_from_bodies(bodies: DataFrame, source: Source) -> DataFrame:
    """Parse (company, offset, body) rows into documents."""
    schema = f"{source.document}, {CORRUPT} STRING"
    if source.is_xml:
        parsed = F.from_xml("body", schema, {"mode": "PERMISSIVE", **_XML_TEXT})
    else:
        parsed = F.from_json("body", schema, {"columnNameOfCorruptRecord": CORRUPT})
    return bodies.select("company", "offset", parsed.alias("document")).select(
        "company", "offset", "document", F.col(f"document.{CORRUPT}").isNotNull().alias("corrupt")
    )


def items_from_bodies(bodies: DataFrame, source: Source) -> DataFrame:
    return _exploded(documents_from_bodies(bodies, source), source)


def detail_ref(company: Column, detail_key: Column) -> Column:
    """What an item and its detail document share; null where an item names none."""
    return F.when(detail_key != "", F.concat_ws("\x1f", company, F.ltrim(detail_key, F.lit("/"))))


def _detail_rows(documents: DataFrame, source: Source) -> DataFrame:
    """A detail with a field of another type counts as long as its text is there."""
    fields = source.detail.fields(F.col("document"))
    usable = documents.where(~F.col("corrupt") | fields["raw_description"].isNotNull())
    return usable.select(
        detail_ref(F.col("company"), F.col("detail_key")).alias("detail_ref"),
        F.coalesce(fields["raw_description"], F.lit("")).alias("detail_description"),
        fields.get("department", F.lit(None).cast("string")).alias("detail_department"),
        "detail_order",
    )


def read_details(spark: SparkSession, run: str, source: Source) -> DataFrame:
    """(detail_ref, detail_description, detail_department, detail_order) of the landed details.

    A file's path below its company is the item's detail key.
    """
    path = detail_path(run, source)
    with _few_listing_tasks(spark):
        raw = (
            spark.read.format("json")
            .schema(f"{source.detail.document}, {CORRUPT} STRING, company STRING")
            .option("basePath", path)
            .option("multiLine", True)
            .option("columnNameOfCorruptRecord", CORRUPT)
            .load(path)
        )
    fields = [c for c in raw.columns if c not in (CORRUPT, "company")]
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    key = F.regexp_extract(decoded, r"/detail/company=[^/]*/(.*)\.json\z", 1)
    modified = F.unix_micros("_metadata.file_modification_time")
    documents = raw.select(
        "company",
        key.alias("detail_key"),
        F.struct(*fields).alias("document"),
        _is_corrupt(fields[0]).alias("corrupt"),
        modified.alias("detail_order"),
    )
    return _detail_rows(documents, source)


def details_from_bodies(bodies: DataFrame, source: Source) -> DataFrame:
    """The same from (company, detail_key, body) rows, with an ``ordinal`` where copies have
    an order; bodies that do not parse are left out."""
    schema = f"{source.detail.document}, {CORRUPT} STRING"
    parsed = F.from_json("body", schema, {"columnNameOfCorruptRecord": CORRUPT})
    order = F.col("ordinal").cast("bigint") if "ordinal" in bodies.columns else F.lit(0).cast("bigint")
    documents = bodies.select("company", "detail_key", parsed.alias("document"), order.alias("detail_order"))
    return _detail_rows(documents.withColumn("corrupt", F.col(f"document.{CORRUPT}").isNotNull()), source)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
