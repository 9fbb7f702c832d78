"""Chat formatting: every participant's view of a dialogue, with masks of the turns to learn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turn numbers that one rendered part spans; a longer dialogue is rendered in several parts.
PART_TURNS = 64
#: Turns that a part may hold, in parts' spans, if numbers repeat or are null; beyond, it is cut into sections.
CROWDED = 4
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def _plain(c: F.Column) -> F.Column:
    """A text in which no marker of a turn can stand: "<|" is rendered "< |"."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """Rows (conv_col, speaker, part, section, n_turns, n_own, rendered, mask): the dialogue as each participant sees it.

    A participant is a distinct role other than "system". In its view its own turns are the assistant's, the others' are a
    user's with the role as name, the system's stay the system's; mask lists the ranges "start-end" of characters of
    rendered, joined by ";", that hold the speaker's own texts. Turns are ordered by number (nulls last), role and text;
    rows that repeat are rendered as often as they are. A null role is the participant "unknown"; a null text is empty; a
    null conv_col is one conversation. "<|" is rendered "< |" in texts and roles, and line ends in a role as blanks, so that
    neither can end a turn or begin one. A conversation of system turns only has no participant and no row; an empty table
    no rows; other columns play no part.

    A part holds the turns of `part_turns` successive numbers, so a conversation of any length is spread over tasks. A part
    of over CROWDED times as many turns, as numbers repeat or are null, is cut into sections of `part_turns` turns each, so no
    task gathers more; parts and sections follow each other without gap. Participants and parts' sizes are counted with a
    combine before the shuffle, and a hot conversation's join with its participants can be split, as it has parts in many rows.
    """
    role = F.regexp_replace(_plain(F.coalesce(F.col(role_col), F.lit("unknown"))), "[\\r\\n]", " ")
    body = _plain(F.coalesce(F.col(text_col), F.lit("")))
    n = F.col(turn_col).cast("long")
    part = F.coalesce(F.floor(n / part_turns), F.lit((1 << 62) // part_turns)).cast("long")
    rows = turns.select(F.col(conv_col).alias("c"), n.alias("n"), role.alias("r"), body.alias("x"), part.alias("part"))
    sizes = rows.groupBy("c", "part").agg(F.count("*").alias("k")).where(F.col("k") > CROWDED * part_turns)
    crowded = cut(sizes.select(F.col("c").alias("cc"), F.col("part").alias("cp")))
    if crowded.take(1):
        same = F.col("c").eqNullSafe(F.col("cc")) & (F.col("part") == F.col("cp"))
        placed = _placed(rows.join(crowded, same, "left_semi")).withColumn("section", F.floor(F.col("p") / part_turns).cast("long")).drop("p")
        rows = rows.join(crowded, same, "left_anti").withColumn("section", F.lit(0).cast("long")).unionByName(placed)
    else:
        rows = rows.withColumn("section", F.lit(0).cast("long"))
    item = F.struct(F.col("n").isNull().alias("z"), "n", "r", "x")
    parts = rows.groupBy("c", "part", "section").agg(F.sort_array(F.collect_list(item)).alias("turns"))
    people = rows.where(F.col("r") != SYSTEM).select("c", F.col("r").alias("speaker")).distinct().withColumnRenamed("c", "pc")
    views = parts.join(people, F.col("c").eqNullSafe(F.col("pc")))
    mine = lambda t: t["r"] == F.col("speaker")
    head = lambda t: F.concat(F.lit(BEGIN), F.when(mine(t), "assistant").when(t["r"] == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), t["r"])), F.lit("\n"))
    views = views.withColumn("heads", F.transform("turns", head))
    views = views.withColumn("pieces", F.zip_with("heads", "turns", lambda h, t: F.concat(h, t["x"], F.lit(END))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("m"))
    own = F.zip_with("heads", "turns", lambda h, t: F.struct(mine(t).alias("mine"), F.length(h).alias("h"), F.length(t["x"]).alias("x")))

    def step(a: F.Column, t: F.Column) -> F.Column:
        start = a["at"] + t["h"]
        span = F.array(F.concat(start.cast("string"), F.lit("-"), (start + t["x"]).cast("string")))
        return F.struct((start + t["x"] + len(END)).alias("at"), F.when(t["mine"], F.concat(a["m"], span)).otherwise(a["m"]).alias("m"))

    mask = F.aggregate(own, zero, step, lambda a: a["m"])
    return views.withColumn("spans", mask).select(
        F.col("c").alias(conv_col), "speaker", "part", "section", F.size("turns").cast("long").alias("n_turns"), F.size("spans").cast("long").alias("n_own"),
        F.array_join("pieces", "").alias("rendered"), F.array_join("spans", ";").alias("mask"),
    )


def _placed(rows: DataFrame) -> DataFrame:
    """rows (c, part, n, r, x) with p, each turn's place in its part from 0.

    A range sort deals the turns in order, however many a part has; equal ones are told apart by where they were read. A place
    is the rank within the task's own range plus what earlier ranges hold of the part. The sorted turns are written, so that
    ranges stay what they were; their counts, a row for each range that a part crosses, are joined back.
    """
    order = ["c", "part", F.col("n").asc_nulls_last(), "r", "x", "u"]
    spread = rows.withColumn("u", F.monotonically_increasing_id())
    dealt = cut(spread.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("g", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()))
    held = dealt.groupBy("c", "part", "g").agg(F.count("*").alias("k"), F.min("i").alias("first"))
    earlier = Window.partitionBy("c", "part").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    b = held.select(F.col("c").alias("hc"), F.col("part").alias("hp"), F.col("g").alias("hg"), "first", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"))
    both = dealt.join(b, (F.col("g") == F.col("hg")) & (F.col("part") == F.col("hp")) & F.col("c").eqNullSafe(F.col("hc")))
    return both.select("c", "n", "r", "x", "part", (F.col("before") + F.col("i") - F.col("first")).alias("p"))


def rotate_sql(table: str = "conversations", part_turns: int = PART_TURNS) -> str:
    """The same in DuckDB's SQL."""
    return f"""
WITH t AS (SELECT conv_id AS c, turn AS n, regexp_replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '[\\r\\n]', ' ', 'g') AS r, replace(coalesce(text, ''), '<|', '< |') AS x,
        coalesce(floor(turn / {part_turns})::BIGINT, {(1 << 62) // part_turns}) AS part FROM {table}),
w AS (SELECT *, row_number() OVER (PARTITION BY c, part ORDER BY n NULLS LAST, r, x) - 1 AS p, count(*) OVER (PARTITION BY c, part) AS k FROM t),
people AS (SELECT DISTINCT c AS pc, r AS speaker FROM t WHERE r <> '{SYSTEM}'),
v AS (SELECT c, speaker, part, CASE WHEN k > {CROWDED * part_turns} THEN p // {part_turns} ELSE 0 END AS section, p, x, r = speaker AS mine, '{BEGIN}' || CASE WHEN r = speaker THEN 'assistant' WHEN r = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user name=' || r END || chr(10) AS h
        FROM w JOIN people ON c IS NOT DISTINCT FROM pc),
s AS (SELECT *, coalesce(sum(length(h) + length(x) + {len(END)}) OVER (PARTITION BY c, speaker, part, section ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(h) AS pos FROM v)
SELECT c AS conv_id, speaker, part, section, count(*) AS n_turns, count(*) FILTER (mine) AS n_own, string_agg(h || x || '<|im_end|>' || chr(10), '' ORDER BY p) AS rendered,
        coalesce(string_agg(pos::VARCHAR || '-' || (pos + length(x))::VARCHAR, ';' ORDER BY p) FILTER (mine), '') AS mask FROM s GROUP BY c, speaker, part, section
"""
