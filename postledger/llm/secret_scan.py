"""Secret scans over an incremental blob ledger.

Every version of a document is a blob, addressed by the SHA-256 of its text.  A ledger
keeps which blobs were scanned by which version of the rules, and what was found in them.
A scan looks up the pairs that the ledger does not hold, scans one copy of each such blob,
appends, and joins all findings back to every path that holds the blob.

Only DataFrame code.  Deciding what is unseen needs digests and ids only.  The text of the
chosen copies is fetched by a semi join on row keys, so copies of one blob, however many,
never meet in one task: the first run shuffles each text once, a later one little more than
the unseen ones, as Spark broadcasts a short list of them or filters by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postledger.llm.shared import text_of, workspace, written
from postledger.operators.bounds import broadcast_within


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost first and not overlapping; those whose ``group`` is
    shorter than ``least`` code points are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules.  Where a longer run always begins at the same place, the
# least length stands in the pattern, so that short runs are never listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# A line of a key body with its break, real or escaped, and indentation; long runs may be parted
# by spaces.  What a line is depends on the text alone and repeats are bounded, so that failed
# tries stay linear and matchers that recurse stay shallow.
_BREAK = r"[ \t]*[\r\n\\][ \t\r\n\\>]*"
_LINE = rf"(?:[A-Za-z0-9+/=]{{16}}[A-Za-z0-9+/=]*[ \t\r\n\\>]+|[A-Za-z0-9+/=]{{1,15}}{_BREAK})"
_HEADER = rf"[nr\\]*(?:Proc-Type|DEK-Info):[^\r\n\\]*{_BREAK}"
_LAST = r"(?:[A-Za-z0-9+/]{16,}=*|[A-Za-z0-9+/]+(?:=+|\z))"
# A key with its body: through the END line, if no other such mark comes before it, or else all
# base64 lines.  After 180 of these, base64 and white space to whatever else comes first.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"(?:[^-]*(?:-{1,4}[^-]+){0,100}-----END [A-Z ]*PRIVATE KEY-----"
    rf"|[ \t\r\n\\>]*(?:{_HEADER}){{0,4}}"
    rf"(?:{_LINE}{{60}}{_LINE}{{60}}{_LINE}{{60}}[A-Za-z0-9+/= \t\r\n\\>]*|{_LINE}{{0,60}}{_LINE}{{0,60}}{_LINE}{{0,60}}{_LAST}?))"
)

# What else is found, by the published forms of these keys.
MORE_RULES = (
    Rule("private_key", PRIVATE_KEY),
    Rule("hub_token", r"\bgh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"\bxox[abprs]-[0-9A-Za-z-]{20,}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

SPAN = T.ArrayType(
    T.StructType([T.StructField("start", T.IntegerType()), T.StructField("order", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())])
)


@dataclass(frozen=True)
class RuleSet:
    """``version`` changes with the rules: ledgers hold what each version found."""

    version: str = "1+key-bodies"
    rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES


class BlobLedger:
    """Findings by blob and rule version, in Parquet below a folder that all executors share.

    ``scanned`` and ``findings`` are one table: a blob without findings has an empty list.
    Runs append; a run that dies leaves no committed files, and repeating it scans the same
    blobs again.  Runs of one ledger must not overlap.
    """

    SCHEMA = T.StructType(
        [T.StructField("blob", T.BinaryType()), T.StructField("rule_version", T.StringType()), T.StructField("spans", SPAN)]
    )

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path = spark, f"{folder.rstrip('/')}/blobs"

    def read(self) -> DataFrame:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(conf).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def append(self, found: DataFrame) -> None:
        found.select(*self.SCHEMA.names).write.mode("append").parquet(self.path)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The spans of one rule in code points, the end exclusive.

    Splitting at the matches gives the gaps between them; the places follow from the
    running sum of gaps and matches.
    """
    gaps = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches

    def placed(parts: Column) -> Column:
        # One pass: where the next gap begins, and the spans so far.
        start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("spans"))
        none = F.array().cast(SPAN)

        def step(state: Column, part: Column) -> Column:
            begin = state["at"] + part["gap"]
            end = begin + part["match"]
            span = F.struct(
                begin.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")
            )
            spans = F.coalesce(state["spans"], none)
            kept = F.when(part["group"] >= rule.least, F.concat(spans, F.array(span))).otherwise(spans)
            return F.struct(end.alias("at"), kept.alias("spans"))

        return F.coalesce(F.aggregate(parts, start, step)["spans"], none)

    parts = F.zip_with(
        F.slice(gaps, 1, F.size(gaps) - 1),
        F.arrays_zip(matches.alias("m"), groups.alias("g")),
        lambda gap, m: F.struct(
            F.length(gap).alias("gap"), F.length(m["m"]).alias("match"), F.length(m["g"]).alias("group")
        ),
    )
    return F.when(text.rlike(rule.pattern), placed(parts)).otherwise(F.array().cast(SPAN))


def find(text: Column, rules: tuple[Rule, ...]) -> Column:
    """All spans of a text, by start, then kind as listed."""
    return F.array_sort(F.concat(*[spans_of(text, rule, k) for k, rule in enumerate(rules)]))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan(docs: DataFrame, ledger: BlobLedger, rule_set: RuleSet = RuleSet(), path: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Path, blob and spans of every row of ``docs``; the ledger holds all its blobs afterwards.

    A null text is the empty text.  A path may be null, and may occur several times with
    equal texts (repeated rows stay) or different ones (versions: each keeps its findings).
    A blob is scanned once whichever and however many paths hold it.  Empty tables give an
    empty result; other columns of ``docs`` are not read.
    """
    folder = folder or workspace(docs.sparkSession, "secrets")
    rows = docs.select(F.col(path).alias("path"), text_of(text).alias("text"))
    versions = written(rows.select("path", blob_of(F.col("text")).alias("blob")), f"{folder}/versions")
    known = ledger.read().filter(F.col("rule_version") == rule_set.version)
    unseen = (
        versions.groupBy("blob")
        .agg(F.min("path").alias("path"))
        .join(known.select("blob"), "blob", "left_anti")
    )
    unseen = written(unseen, f"{folder}/unseen")
    # One copy of a blob: any row of the chosen path that has this digest.
    chosen = unseen.select(F.col("path").alias("chosen_path"), F.col("blob").alias("chosen_blob"))
    copies = rows.withColumn("blob", blob_of(F.col("text"))).join(
        chosen, F.col("path").eqNullSafe(F.col("chosen_path")) & (F.col("blob") == F.col("chosen_blob")), "left_semi"
    )
    found = copies.select("blob", F.lit(rule_set.version).alias("rule_version"), find(F.col("text"), rule_set.rules).alias("spans"))
    ledger.append(found)
    # Equal rows of one path may have been scanned together; they found the same.
    findings = (
        ledger.read()
        .filter((F.col("rule_version") == rule_set.version) & (F.size("spans") > 0))
        .select("blob", "spans")
        .distinct()
    )
    return versions.join(findings, "blob", "left").select(
        F.col("path").alias(path), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans")
    )


def shown(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, ledger: BlobLedger, rule_set: RuleSet = RuleSet(), text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``[kind]``; rows, columns and null texts stay.

    Overlapping spans are replaced together, by the kind of the first of them.
    """
    columns = docs.columns
    found = scan(docs, ledger, rule_set, text=text).filter(F.size("spans") > 0)
    hidden = broadcast_within(found.select(F.col("blob").alias("found blob"), "spans").distinct().withColumnRenamed("spans", "found spans"))
    joined = docs.withColumn("own blob", blob_of(text_of(text))).join(
        hidden, F.col("own blob") == F.col("found blob"), "left"
    )
    body = F.col(text)

    def cut(state: Column, span: Column) -> Column:
        begin, end = F.greatest(span["start"], state["at"]), F.greatest(span["end"], state["at"])
        mark = F.when(span["start"] >= state["at"], F.concat(F.lit("["), span["kind"], F.lit("]"))).otherwise("")
        gap = F.substring(body, state["at"] + 1, F.greatest(begin - state["at"], F.lit(0)))
        return F.struct(end.alias("at"), F.concat(state["out"], gap, mark).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(
        "found spans", start, cut, lambda s: F.concat(s["out"], F.substring(body, s["at"] + 1, F.length(body)))
    )
    return joined.withColumn(text, F.when(F.col("found spans").isNull(), body).otherwise(clean)).select(*columns)



def report_sql(rules: tuple[Rule, ...] = RuleSet().rules, base: tuple[Rule, ...] = BASE_RULES) -> str:
    """What the registered query must equal: spans from the gaps between matches."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    parts, spans = [], []
    for k, rule in enumerate(rules):
        parts.append(f"""regexp_extract_all(text, {quoted(rule.pattern)}) AS m{k},
            regexp_extract_all(text, {quoted(rule.pattern)}, {rule.group}) AS g{k},
            string_split_regex(text, {quoted(rule.pattern)}) AS s{k}""")
        lengths = "list_transform({}, lambda x: length(x))"
        start = f"(list_sum({lengths.format(f's{k}[1:i]')}) + coalesce(list_sum({lengths.format(f'm{k}[1:i - 1]')}), 0))"
        spans.append(
            f"list_transform(list_filter(range(1, len(m{k}) + 1), lambda i: length(g{k}[i]) >= {rule.least}), lambda i: "
            f"{{'start': CAST({start} AS BIGINT), 'o': {k}, 'text': {quoted(rule.kind + ':')} || CAST({start} AS BIGINT) "
            f"|| ':' || CAST({start} + length(m{k}[i]) AS BIGINT)}})"
        )
    shown = "coalesce(array_to_string(list_transform({}, lambda x: x.text), ','), '')"
    own = f"list_filter(spans, lambda x: x.o < {len(base)})"
    counts = ", ".join(
        f"CAST(len(list_filter(spans, lambda x: x.o = {k})) AS BIGINT) AS n_{rule.kind}" for k, rule in enumerate(base)
    )
    return f"""
    WITH parts AS (
        SELECT doc_id, {", ".join(parts)} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    ), found AS (
        SELECT doc_id, list_sort({" || ".join(spans)}) AS spans FROM parts
    )
    SELECT doc_id, {counts}, sha256({shown.format(own)}) AS base_sha256, {shown.format("spans")} AS spans FROM found
    """
