"""Chat formatting by perspective: every participant of a dialogue in turn is the assistant, the others are named users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stampbook.llm.common import scratch_folder, tidy, written
from stampbook.operators.numbering import numbered

SYSTEM = "system"
UNNAMED = "unnamed"
END = "<|end|>"
#: Turns of a row; longer dialogues go on in further rows, so that no row grows with the dialogue.
PART_TURNS = 512


def rotated(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One rendering of every dialogue for each of its participants.

    Turns are in the order of turn, then name, then text, then role (missing last). A participant is a role other than system, one
    for each distinct role; a missing and an empty role are one. Its name is the role with everything but letters, digits, dash and
    underscore as underscore, ``unnamed`` for a missing one. Where roles of one dialogue would share that name, those that differ
    from it take their percent-encoded role instead (a missing one: "%"), which can be decoded and equals no other name. Each
    turn is a header line, its text and an end mark; the mask covers text and end mark of the
    perspective's own turns. A missing text is empty; "<|" inside texts is set apart, so that no text can hold a mark.

    Result: conv_id, perspective, part (0, 1, ... of ``part_turns`` turns each), n_turns, own_turns, rendered, mask ("from-to" in
    code points of this part, joined by commas), masked_chars. Dialogues of system turns alone have no participant and no row. Rows
    without conv_id are one dialogue. Repeated rows are turns like others. An empty table gives an empty result; other columns
    are ignored. Turns are numbered by range partitions and rendered in parts: a dialogue of any length is never in one task.
    """
    name = F.regexp_replace("role", "[^A-Za-z0-9_-]", "_")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    rows = rows.withColumn("name", F.when(name == "", F.lit(UNNAMED)).otherwise(name))
    placed = numbered(rows, [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("name"), F.col("text"), F.col("role")], "at", scratch_folder(conversations.sparkSession))
    first = written(placed.groupBy("conv_id").agg(F.min("at").alias("first")), "first").withColumnRenamed("conv_id", "_c")
    roles = written(placed.where(F.col("role") != SYSTEM).select("conv_id", "role", "name").distinct(), "roles")
    shared = roles.groupBy("conv_id", "name").agg((F.min("role") != F.max("role")).alias("shared")).where("shared").select(F.col("conv_id").alias("_c"), F.col("name").alias("_n"))
    shared = roles.join(shared, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("name") == F.col("_n")), "left_semi")
    escaped = F.when(F.col("role") == "", F.lit("%")).otherwise(F.replace(F.url_encode("role"), F.lit("+"), F.lit("%20")))
    other = written(shared.where("role <> name").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), escaped.alias("_name")), "other")

    def named(rows):
        """Rows with the names of their roles; few roles share one."""
        same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r"))
        return rows.join(other, same, "left").withColumn("name", F.coalesce("_name", "name")).drop("_c", "_r", "_name")

    speakers = named(roles).select(F.col("conv_id").alias("_c"), F.col("name").alias("perspective"))
    turns = named(placed).drop("role").join(first, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c").withColumn("at", F.col("at") - F.col("first"))
    turns = turns.withColumn("part", F.floor(F.col("at") / part_turns).cast("int"))
    views = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c")))
    own = F.col("name") == F.col("perspective")
    header = F.when(own, F.lit("<|assistant|>\n")).when(F.col("name") == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), "name", F.lit("|>\n")))
    views = views.select("conv_id", "perspective", "part", "at", own.alias("own"), F.length(header).alias("head"), F.concat(header, "text", F.lit(END + "\n")).alias("piece"))

    place = Window.partitionBy("conv_id", "perspective", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # part_turns rows at most
    stop = F.sum(F.length("piece")).over(place)
    views = views.withColumns({"a": stop - F.length("piece") + F.col("head"), "b": stop - 1})
    pieces = F.array_sort(F.collect_list(F.struct("at", "piece", "own", "a", "b")))
    found = views.groupBy("conv_id", "perspective", "part").agg(pieces.alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["own"]), lambda x: F.concat(x["a"].cast("string"), F.lit("-"), x["b"].cast("string")))
    chars = F.aggregate(F.filter("p", lambda x: x["own"]), F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return found.select(
        "conv_id", "perspective", "part", F.size("p").cast("long").alias("n_turns"), F.size(F.filter("p", lambda x: x["own"])).cast("long").alias("own_turns"),
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("rendered"), F.array_join(spans, ",").alias("mask"), chars.alias("masked_chars"),
    )


@tidy
def op6_perspectives(spark, folder: str) -> DataFrame:
    """The whole of conversations."""
    return rotated(spark.read.parquet(f"{folder}/conversations.parquet"))


CHECK = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, CASE WHEN coalesce(role, '') = '' THEN '{UNNAMED}' ELSE regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g') END AS plain,
    replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
r AS (SELECT conv_id, role, plain, count(*) OVER (PARTITION BY conv_id, plain) AS sharing FROM (SELECT DISTINCT conv_id, role, plain FROM t WHERE role <> '{SYSTEM}')),
p AS (SELECT conv_id, role, CASE WHEN sharing = 1 OR role = plain THEN plain WHEN role = '' THEN '%' ELSE replace(replace(url_encode(role), '%2A', '*'), '~', '%7E') END AS perspective FROM r),
n AS (SELECT t.*, coalesce(p.perspective, plain) AS name, row_number() OVER (PARTITION BY t.conv_id ORDER BY turn NULLS LAST, plain, text, t.role) - 1 AS pos
    FROM t LEFT JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.role = p.role),
v AS (SELECT n.conv_id, perspective, (pos // {PART_TURNS})::INTEGER AS part, pos, name = perspective AS own, text,
    CASE WHEN name = perspective THEN '<|assistant|>' WHEN name = '{SYSTEM}' THEN '<|system|>' ELSE '<|user name=' || name || '|>' END || chr(10) AS head
    FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, head || text || '{END}' || chr(10) AS piece, sum(length(head || text || '{END}' || chr(10))) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos) AS stop FROM v)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (own) AS own_turns, string_agg(piece, '' ORDER BY pos) AS rendered,
    coalesce(string_agg((stop - length(piece) + length(head))::BIGINT || '-' || (stop - 1)::BIGINT, ',' ORDER BY pos) FILTER (own), '') AS mask,
    coalesce(sum(length(piece) - 1 - length(head)) FILTER (own), 0)::BIGINT AS masked_chars
FROM s GROUP BY ALL"""
