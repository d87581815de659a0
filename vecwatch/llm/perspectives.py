"""Multi-party perspective rotation.

A dialogue is rendered once for every participant: that speaker's turns become the assistant's, the others' turns those of users who bear their
names, and only the assistant's words are trained on. System turns stay system turns and are nobody's perspective. A rendered
dialogue is the sequence of its segments: each row has a segment, the place where it starts, and the part of it that the mask covers. So a dialogue of any
length is made by many tasks; `dialogues` joins the segments of those that fit one row. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored, whole

SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns that a running length goes through at once; longer dialogues are cut into such buckets.
BUCKET_TURNS = 1024


def perspectives(turns: DataFrame) -> DataFrame:
    """A row per participant and turn: conv_id, participant, turn, speaker, rendered_role, segment, seg_start, mask_start, mask_end.

    Positions count characters of the rendered dialogue; the mask covers the words and the end mark of the participant's own turns (else it is empty: both ends null). Turns are in order of `turn`, nulls last,
    ties by role, then text. A null role is a speaker of its own, named `unknown`; a null text is empty. A null conv_id is a dialogue of its own. A dialogue of system turns
    alone has no perspective. Repeated rows are repeated turns. Extra columns are not read; an empty table gives no rows.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), whole().alias("text"))
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("participant")).distinct()
    # a dialogue with a great many turns is a skewed key of this join, which Spark splits at run time
    out = rows.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("participant"), "assistant").otherwise("user")
    out = out.withColumn("rendered_role", role)
    head = F.concat(F.lit(OPEN), F.col("rendered_role"), F.when(F.col("rendered_role") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("\n"))
    out = out.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, F.col("text"), F.lit(CLOSE))).drop("text")
    out = out.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / BUCKET_TURNS), F.lit((1 << 62))))
    length = F.length("segment").cast("long")
    sums = out.groupBy("conv_id", "participant", "bucket").agg(F.sum(length).alias("n"))
    before = W.partitionBy("conv_id", "participant").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("participant").alias("p"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = W.partitionBy("conv_id", "participant", "bucket").orderBy(F.col("turn").asc_nulls_last(), "speaker", "segment").rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("upto", F.sum(length).over(within))
    out = out.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("participant") == F.col("p")) & (F.col("bucket") == F.col("b")))
    start = (F.col("offset") + F.col("upto") - length).cast("long")
    own = F.col("rendered_role") == "assistant"
    return out.select("conv_id", "participant", "turn", "speaker", "rendered_role", "segment", start.alias("seg_start"),
                      F.when(own, start + F.col("head")).cast("long").alias("mask_start"), F.when(own, start + length).cast("long").alias("mask_end"))


def dialogues(turns: DataFrame) -> DataFrame:
    """A row per dialogue and participant with the whole rendered text and the masked ranges, for dialogues that fit one row."""
    parts = F.sort_array(F.collect_list(F.struct("seg_start", "segment", "mask_start", "mask_end")))
    out = perspectives(turns).groupBy("conv_id", "participant").agg(parts.alias("parts"))
    masks = F.transform(F.filter("parts", lambda p: p["mask_start"].isNotNull()), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end")))
    return out.select("conv_id", "participant", F.array_join("parts.segment", "").alias("text"), masks.alias("masks"))


SQL = f"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> '{SYSTEM}'),
r AS (SELECT t.*, p.participant, CASE WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' WHEN speaker = participant THEN 'assistant' ELSE 'user' END AS rendered_role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '{OPEN}' || rendered_role || CASE WHEN rendered_role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM r),
s AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS LAST, speaker, segment ROWS UNBOUNDED PRECEDING) - length(segment) AS BIGINT) AS seg_start FROM s)
SELECT conv_id, participant, turn, speaker, rendered_role, segment, seg_start,
  CASE WHEN rendered_role = 'assistant' THEN CAST(seg_start + length(head) AS BIGINT) END AS mask_start,
  CASE WHEN rendered_role = 'assistant' THEN CAST(seg_start + length(segment) AS BIGINT) END AS mask_end
FROM o"""
