"""Multi-party perspective rotation: each participant's turns as the assistant's, the others' as named users'.

All of it is DataFrame operations. A conversation is rendered in chunks of neighbouring turns, and those in parts
where many turns have one number or none, so that no long one is ever gathered whole; a prefix sum over their
lengths places each in the rendering.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatConfig:
    """Roles that set the scene and take no part, turns in a chunk and a part of one, and the marks around a turn."""

    scene: tuple[str, ...] = ("system",)
    chunk_turns: int = 64
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"


def _render(turn: Column, speaker: Column, config: ChatConfig) -> Column:
    """``(head, body, own)`` of a turn: the opening mark and name, then the text and closing mark."""
    role = turn["role"]
    name = F.when(role == speaker, F.lit("assistant")).when(role.isin(*config.scene), role).otherwise(F.concat(F.lit("user name="), role))
    return F.struct(
        F.concat(F.lit(config.begin), name, F.lit("\n")).alias("head"),
        F.concat(turn["text"], F.lit(config.end)).alias("body"),
        (role == speaker).alias("own"),
    )


def perspectives(conversations: DataFrame, config: ChatConfig = ChatConfig()) -> DataFrame:
    """Every conversation from every participant's side, in chunks.

    ``conversations`` has ``conv_id, turn, role, text``; further columns are not read. Returns ``conv_id,
    speaker, chunk`` (turn divided by ``chunk_turns``), ``part`` (from 0; others only where more turns than that are
    in a chunk), ``start_char`` (of the part in the whole rendering), ``n_turns, text`` and ``mask``: ``begin-end``
    pairs of characters in ``text``, joined by commas, that the assistant is to learn, its texts with their closing
    marks. Joining the chunks and parts of a speaker in order gives the whole rendering.

    Turns come in the order of turn, role and text; repeated rows stay. A null text is empty, a null role is
    named ``unknown``, null turns come first, and rows with a null conv_id are left out. A conversation of
    scene-setting roles alone has no participants and no rows.
    """
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("chunk", F.coalesce(F.floor(F.col("turn") / config.chunk_turns), F.lit(-1)).cast("long"))
    speakers = turns.where(~F.col("role").isin(*config.scene)).select("conv_id", F.col("role").alias("speaker")).distinct()
    place = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text"))
    parts = turns.withColumn("part", F.floor((place - 1) / config.chunk_turns).cast("long"))
    chunks = parts.groupBy("conv_id", "chunk", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    told = chunks.join(speakers, "conv_id").withColumn("parts", F.transform("turns", lambda t: _render(t, F.col("speaker"), config)))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "")
    # Fold the parts into the place reached and the spans so far.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    spans = F.aggregate(
        "parts",
        start,
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["own"], F.array_append(s["spans"], F.concat_ws("-", (s["at"] + F.length(p["head"])).cast("string"), (s["at"] + F.length(p["head"]) + F.length(p["body"])).cast("string")))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: F.array_join(s["spans"], ","),
    )
    done = told.select("conv_id", "speaker", "chunk", "part", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), spans.alias("mask"))
    before = Window.partitionBy("conv_id", "speaker").orderBy("chunk", "part").rowsBetween(Window.unboundedPreceding, -1)
    return done.select("conv_id", "speaker", "chunk", "part", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0)).cast("long").alias("start_char"), "n_turns", "text", "mask")


#: The same rows in DuckDB SQL.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    CAST(coalesce(floor(turn / 64.0), -1) AS BIGINT) AS chunk
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
p AS (
  SELECT t.conv_id, speaker, chunk, turn, role, text, role = speaker AS own,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || role END || chr(10) AS head,
    text || '<|im_end|>' || chr(10) AS body
  FROM t JOIN s USING (conv_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text) AS k FROM p),
g AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, speaker, chunk ORDER BY k) - 1) // 64 AS BIGINT) AS part FROM o),
w AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, chunk, part ORDER BY k) AS upto,
    sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY k) AS upto_all
  FROM g)
SELECT conv_id, speaker, chunk, part, CAST(min(upto_all - length(head) - length(body)) AS BIGINT) AS start_char, count(*) AS n_turns,
  string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(upto - length(body) AS VARCHAR) || '-' || CAST(upto AS VARCHAR), ',' ORDER BY k) FILTER (own), '') AS mask
FROM w GROUP BY conv_id, speaker, chunk, part
"""
