"""Chat formatting as a relation: turns are grouped, sorted, merged and concatenated by
Spark expressions.

A conversation becomes one string in which control strings mark roles and turns, and a list
of segments of which some are under the loss mask.  Control strings inside roles and texts
are escaped by a backslash, so the string can always be read back.

Turns are sorted and merged in blocks of neighbouring turns first, and the blocks of a
conversation then: merging adjacent runs of one role is associative.  So the rows of a
long conversation are sorted in many tasks, and the last one sees a few blocks of it.  The
finished string is one value, which Spark limits to 2 GB.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """``opening`` role ``heading`` text ``between`` text ``closing``, a group per run of a role.

    ``foreign`` are control strings of other templates that are escaped as well.  Texts of
    ``learned`` roles are under the loss mask.  ``block`` turns are merged at a time.
    """

    opening: str = "<|im_start|>"
    heading: str = "<|im_sep|>"
    between: str = "<|im_next|>"
    closing: str = "<|im_end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    learned: tuple[str, ...] = ("assistant",)
    block: int = 256

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or ESCAPE in c or any(d[0] in c[1:] for d in self.controls):
                raise ValueError(f"{c!r} can't be escaped: a control string begins inside it")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.opening, self.heading, self.between, self.closing, *self.foreign)


def escaped(text: Column, template: Template) -> Column:
    """Backslashes doubled, and one put behind the first character of each control string."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + ESCAPE + c[1:])), template.controls, doubled)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _quoted(control: str) -> str:
    return r"\Q" + control + r"\E"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _merged(runs: Column) -> Column:
    """Adjacent runs (role, texts) of the same role as one."""

    def merge(run: Column) -> Column:
        begins = F.filter(
            F.transform(run, lambda r, k: k),
            lambda k: (k == 0) | (F.get(run, k)["role"] != F.coalesce(F.get(run, k - 1)["role"], F.lit(""))),
        )

        def gather(start: Column) -> Column:
            return F.transform(
                start,
                lambda s, j: F.struct(
                    F.get(run, s)["role"].alias("role"),
                    F.flatten(
                        F.transform(
                            F.slice(run, s + 1, F.coalesce(F.get(start, j + 1), F.size(run)) - s),
                            lambda r: r["texts"],
                        )
                    ).alias("texts"),
                ),
            )

        return _let(begins, gather)

    return _let(runs, merge)


def _segments(runs: Column, template: Template) -> Column:
    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def of_run(run: Column) -> Column:
        learned, no = run["role"].isin(*template.learned), F.lit(False)
        head = F.concat(F.lit(template.opening), escaped(run["role"], template), F.lit(template.heading))
        texts = F.transform(
            run["texts"],
            lambda t, k: F.array(
                segment(F.when(k > 0, F.lit(template.between)).otherwise(""), no),
                segment(escaped(t, template), learned),
            ),
        )
        return F.concat(
            F.array(segment(head, no)), F.flatten(texts), F.array(segment(F.lit(template.closing), no))
        )

    return F.filter(F.flatten(F.transform(runs, of_run)), lambda s: (s["text"] != "") | s["loss"])


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted, segments) from rows (conv_id, turn, role, text).

    ``segments`` are (text, loss) and concatenate to ``formatted``.  Turns come by number,
    those without one first, equal numbers by role and text; repeated rows are turns of
    their own.  A null role or text is empty.  Rows without a ``conv_id`` are one
    conversation.  Adjacent turns of one role are merged into one group that keeps its
    texts apart.  An empty table gives an empty result; other columns are not read.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.floor(F.col("turn") / template.block).alias("block"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    blocks = (
        rows.groupBy("conv_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select(
            "conv_id",
            "block",
            _merged(
                F.transform(
                    "turns", lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
                )
            ).alias("runs"),
        )
    )
    whole = (
        blocks.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("block", "runs"))).alias("blocks"))
        .select("conv_id", _merged(F.flatten(F.transform("blocks", lambda b: b["runs"]))).alias("runs"))
    )
    made = whole.select("conv_id", _segments(F.col("runs"), template).alias("segments"))
    return made.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def turns_of(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted string holds."""

    def of_group(group: Column) -> Column:
        halves = F.split(group, _quoted(template.heading), 2)
        role = unescaped(F.substring(F.get(halves, F.lit(0)), len(template.opening) + 1, 1 << 30))
        texts = F.split(F.get(halves, F.lit(1)), _quoted(template.between), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    groups = _let(F.split(formatted, _quoted(template.closing), -1), lambda g: F.slice(g, 1, F.size(g) - 1))
    return F.flatten(F.transform(groups, of_group))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digest(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Counts and digests read back from formatted conversations."""
    read = chats.select(
        "conv_id",
        turns_of(F.col("formatted"), template).alias("turns"),
        learned_text(F.col("segments")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def digest_sql(template: Template = Template()) -> str:
    """What the registered query must equal."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def escape(column: str) -> str:
        column = f"replace({column}, {text(ESCAPE)}, {text(ESCAPE * 2)})"
        for c in template.controls:
            column = f"replace({column}, {text(c)}, {text(c[0] + ESCAPE + c[1:])})"
        return column

    group = len(template.opening) + len(template.heading) + len(template.closing)
    order = "turn NULLS FIRST, role, text"
    learned = f"role IN ({', '.join(map(text, template.learned))})"
    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', {text(PROBE)}
        UNION ALL SELECT -1, 1, 'assistant', {text(PROBE)}
    ), placed AS (
        SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY {order}) AS before FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY {order})) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE {learned}), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY {order}) FILTER (WHERE {learned}), '')) AS loss_sha256,
           CAST(sum(length({escape("text")}) + CASE WHEN before = role THEN {len(template.between)}
                    ELSE {group} + length({escape("role")}) END) AS BIGINT) AS formatted_chars
    FROM placed GROUP BY conv_id
    """


# Fixed value: what both turns of the added conversation say.
PROBE = "</s>[INST] ok [/INST]"
