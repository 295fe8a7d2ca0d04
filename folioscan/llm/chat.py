"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once, with that participant as assistant and all
others as named users; masks are the spans of the assistant's own words. Messages of context roles stay as they are in
every rendering. A dialogue comes in blocks of at most BLOCK turns, so that no row or task holds an unbounded one:
ordinary dialogues are one block, and the blocks of a long one, in order, are its whole text.
"""

from __future__ import annotations

from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, n_partitions

BLOCK = 64
START, END = "<|im_start|>", "<|im_end|>\n"


def numbered(turns: DataFrame) -> DataFrame:
    """turns with their place in their conversation, from 0, in the order of turn, speaker and text.

    Rows are range-partitioned by that whole order and numbered within partitions; a conversation that crosses
    partitions is continued by what the partitions before hold of it, one row a partition.
    """
    order = ["conv_id", "turn", "speaker", "text"]
    kinds = dict(turns.dtypes)
    ordered = turns.repartitionByRange(n_partitions(turns), *order).sortWithinPartitions(*order)

    def run(batches):
        pid, last, n, row = TaskContext.get().partitionId(), object(), 0, 0
        for b in batches:
            place = []
            for c in b.column("conv_id").to_pylist():
                n = n + 1 if c == last else 0
                last = c
                place.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pid] * len(place), pa.int32()), pa.array(range(row, row + len(place)), pa.int64()), pa.array(place, pa.int64())], [*b.schema.names, "pid", "row", "place"])
            row += len(place)

    schema = ", ".join(f"{c} {kinds[c]}" for c in order) + ", pid int, row bigint, place bigint"
    rows = materialize(ordered.select(*order).mapInArrow(run, schema), "turns")
    edge = F.struct("row", "conv_id", "place")
    ends = sorted(rows.groupBy("pid").agg(F.min(edge).alias("first"), F.max(edge).alias("last")).collect())
    carried, base = [], 0
    for one, two in pairwise(ends):
        alone = one["first"]["conv_id"] == one["last"]["conv_id"]
        base = one["last"]["place"] + 1 + (base if alone else 0)
        if one["last"]["conv_id"] == two["first"]["conv_id"]:
            carried.append((two["pid"], two["first"]["conv_id"], base))
        else:
            base = 0
    if not carried:
        return rows.drop("pid", "row")
    spark = turns.sparkSession
    more = F.broadcast(spark.createDataFrame(carried, f"at int, of {kinds['conv_id']}, base bigint"))  # a row a partition at most
    joined = rows.join(more, (F.col("pid") == F.col("at")) & F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return joined.withColumn("place", F.col("place") + F.coalesce("base", F.lit(0))).drop("pid", "row", "at", "of", "base")


def unmarked(text: Column) -> Column:
    """Marker strings broken up by a blank, so that they can't pass for structure."""
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def rotate(conversations: DataFrame, context_roles: tuple[str, ...] = ("system",), block: int = BLOCK) -> DataFrame:
    """conv_id, assistant, block, n_turns, text, spans (array of start and end, code points within the block's text).

    conversations: conv_id, turn, role, text. A null role is the speaker "unknown"; a null text is empty; a null turn
    comes first; rows without conv_id form one conversation; rows of one turn are ordered by speaker and text, and
    repeated rows all stay. Marker strings within texts and speakers are broken up by a blank and line ends within
    speakers become blanks, so neither can pass for structure; assistant is the role as it is. A conversation of context roles alone has no participant and yields nothing; an empty table nothing; extra columns
    aren't read. Rows out are turns times participants.
    """
    speaker = F.coalesce(F.col("role"), F.lit("unknown"))
    turns = conversations.select("conv_id", "turn", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    people = turns.filter(~F.col("speaker").isin(*context_roles)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("assistant")).distinct()
    rows = numbered(turns).join(materialize(people, "participants"), F.col("conv_id").eqNullSafe(F.col("of")))
    own = F.col("speaker") == F.col("assistant")
    name = F.translate(unmarked(F.col("speaker")), "\n\r", "  ")
    head = F.when(own, F.lit(f"{START}assistant\n")).when(F.col("speaker").isin(*context_roles), F.concat(F.lit(START), name, F.lit("\n"))).otherwise(F.concat(F.lit(f"{START}user name="), name, F.lit("\n")))
    said = unmarked(F.col("text"))
    segment = F.struct(F.col("place"), F.concat(head, said, F.lit(END)).alias("all"), F.length(head).alias("start"), F.length(said).alias("size"), own.alias("own"))
    grouped = rows.select("conv_id", "assistant", F.floor(F.col("place") / block).cast("long").alias("block"), segment.alias("s")).groupBy("conv_id", "assistant", "block").agg(F.sort_array(F.collect_list("s")).alias("s"))
    spans = """transform(filter(transform(s, (x, i) -> named_struct('own', x.own, 'start', aggregate(slice(s, 1, i), 0L, (a, y) -> a + length(y.all)) + x.start, 'size', x.size)), x -> x.own),
                         x -> named_struct('start', x.start, 'end', x.start + x.size))"""
    return grouped.select("conv_id", "assistant", "block", F.size("s").cast("long").alias("n_turns"), F.array_join(F.transform("s", lambda x: x.all), "").alias("text"), F.expr(spans).alias("spans"))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, text) - 1 AS place FROM t
), p AS (
  SELECT DISTINCT conv_id AS of, speaker AS assistant FROM t WHERE speaker <> 'system'
), s AS (
  SELECT conv_id, assistant, place // {BLOCK} AS block, place, speaker = assistant AS own, replace(text, '<|im_', '< |im_') AS said,
         CASE WHEN speaker = assistant THEN '{START}assistant' WHEN speaker = 'system' THEN '{START}system' ELSE '{START}user name=' || translate(replace(speaker, '<|im_', '< |im_'), chr(10) || chr(13), '  ') END || chr(10) AS head
  FROM n JOIN p ON conv_id IS NOT DISTINCT FROM of
), o AS (
  SELECT *, head || said || '<|im_end|>' || chr(10) AS whole, coalesce(sum(length(head) + length(said) + {len(END)}) OVER (PARTITION BY conv_id, assistant, block ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM s
)
SELECT conv_id, assistant, block, count(*) AS n_turns, string_agg(whole, '' ORDER BY place) AS text,
       coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(said) AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (WHERE own), '') AS spans
FROM o GROUP BY ALL
"""
