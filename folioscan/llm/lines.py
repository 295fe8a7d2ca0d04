"""Line dedup by deletion neighbourhoods, in DataFrame expressions alone.

Two lines within one edit (insertion, deletion or substitution of one code point) have an equal variant: what is left
of them when one code point goes. Lines with an equal variant at the same place and of the same length differ there at
most; a line that equals a variant of a longer one is one deletion away from it. So a group of equal variants needs no
pairs: its members are held against its earliest one. Variants are hashed keys, and verify() measures the edit
distance of every pair that makes a line go.

A line has as many variants as code points, so they are emitted only where they can meet, by two lossless levels. One
edit leaves the first or the second half alone, and of blocks of about sqrt(n) code points all but one; only lines that
share a half, then all but one block, with another line emit their variants, and only within that block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, columns_of, discard, fresh, materialize, row_key

#: Lines under this many code points are held for equal only if they are identical; a parameter, 1 compares all.
NEAR = 16


def first_lines(docs: DataFrame, id_col: str, text_col: str, near: int) -> DataFrame:
    """(id, line, h1, h2, keys) of all lines with a word; keys are hashes of halves, null for short lines."""
    own = docs.filter(F.col(id_col).isNotNull()).select(row_key(id_col, text_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "said"))
    n, said = F.length("said"), F.col("said")

    def key(side: int, m: Column, at: Column, size: Column) -> Column:
        return F.xxhash64(F.lit(side), m, F.substring(said, at, size))

    short = n - 1
    half, rest = F.floor(n / 2).cast("int"), F.floor(short / 2).cast("int")
    keys = F.array(
        key(0, n, F.lit(1), half),
        key(1, n, half + 1, n - half),
        key(0, short, F.lit(1), rest),
        key(1, short, n - short + rest + 1, short - rest),
    )
    return own.filter(said.rlike(WORD)).select("id", "line", F.xxhash64("said").alias("h1"), F.xxhash64(F.lit(1), "said").alias("h2"), F.when(n >= near, keys).alias("keys"))


def shared(rows: DataFrame, key: str, label: str, *carry: str) -> DataFrame:
    """A stored table of the carried columns of rows (key, h1, ...) whose key another line, told by h1, has too."""
    met = rows.groupBy(key).agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter(F.col("low") != F.col("high")).select(key)
    met = materialize(met, "keys")
    out = materialize(rows.join(met.hint("merge"), key, "left_semi").select(*carry).distinct(), label)
    discard(met)
    return out


def blocks(said: DataFrame) -> DataFrame:
    """(id, line, h1, m, long, block, key): for each line, as the shorter (long = 0) or the longer of a pair whose shorter
    one has m code points, a hash of all but one block."""
    roles = said.select("id", "line", "h1", "said", F.explode(F.array(F.lit(0), F.lit(1))).alias("long")).withColumn("m", F.length("said") - F.col("long")).filter(F.col("m") > 0)
    width = F.ceil(F.sqrt("m")).cast("int")
    each = roles.withColumn("width", width).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / width).cast("int"))))
    start, end = F.col("block") * F.col("width"), F.least((F.col("block") + 1) * F.col("width"), F.col("m"))
    n = F.length("said")
    key = F.xxhash64("m", "block", F.substring(F.col("said"), F.lit(1), start), F.substring(F.col("said"), end + F.col("long") + 1, n))
    return each.select("id", "line", "h1", "m", "long", "block", key.alias("key"))


def variants(said: DataFrame, found: DataFrame) -> DataFrame:
    """(id, line, kind, key): kind 0 is a variant at its place, for lines of equal length; 1 a whole line; 2 a variant without its place."""
    rows = said.join(found, ["id", "line"])
    width = F.ceil(F.sqrt("m")).cast("int")
    start, end = F.col("block") * width, F.least((F.col("block") + 1) * width, F.col("m"))
    rows = rows.withColumn("p", F.explode(F.sequence(start, F.when(F.col("long") == 1, end).otherwise(end - 1))))
    n, p = F.length("said"), F.col("p")
    left, right = F.substring(F.col("said"), F.lit(1), p), F.substring(F.col("said"), p + 2, n)
    at_place = F.xxhash64(F.lit(0), "m", p, F.concat(left, right))
    kinds = rows.select("id", "line", F.when(F.col("long") == 1, F.lit(2)).otherwise(F.lit(0)).alias("kind"), F.when(F.col("long") == 1, F.xxhash64(F.lit(1), F.concat(left, right))).otherwise(at_place).alias("key"))
    # Only a line that shares all but one block with a longer one can equal a variant of one.
    shorter = found.filter(F.col("long") == 0).select("id", "line").distinct()
    whole = said.join(shorter, ["id", "line"], "left_semi").select("id", "line", F.lit(1).alias("kind"), F.xxhash64(F.lit(1), "said").alias("key"))
    return kinds.union(whole).distinct()


def close_lines(firsts: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A stored table (id, line) of distinct lines that an earlier one is within one edit of. Every table goes once the next is written."""
    keyed = firsts.filter(F.col("keys").isNotNull()).select("id", "line", "h1", F.explode("keys").alias("key"))
    alive = shared(keyed, "key", "alive", "id", "line", "h1")
    halves = materialize(alive.groupBy("id").agg(F.collect_list(F.struct("line", "h1")).alias("own")), "halves")
    discard(alive)
    # Whole texts are joined by merging at every size: what they meet grows with them.
    texts = docs.select(row_key(id_col, text_col).alias("id"), F.split(F.col(text_col), "\n").alias("lines")).join(halves.hint("merge"), "id")
    said = texts.select("id", "lines", F.explode("own").alias("o"))
    said = materialize(said.select("id", F.col("o.line").alias("line"), F.col("o.h1").alias("h1"), F.expr("lines[o.line]").alias("said")).dropDuplicates(["id", "line"]), "said")
    discard(halves)
    found = shared(blocks(said), "key", "blocks", "id", "line", "m", "long", "block")
    every = materialize(variants(said, found), "variants")
    discard(found)
    at = F.struct("id", "line")
    least = every.groupBy("key").agg(*(F.min(F.when(F.col("kind") == k, at)).alias(f"k{k}") for k in range(3)))
    least = materialize(least, "least")
    against = F.when(F.col("kind") == 0, F.col("k0")).when(F.col("kind") == 1, F.col("k2")).otherwise(F.col("k1"))
    pairs = every.join(least.hint("merge"), "key").select("id", "line", against.alias("of")).filter(F.col("of") < at)
    pairs = materialize(pairs.select("id", "line", F.col("of.id").alias("of_id"), F.col("of.line").alias("of_line")).distinct(), "pairs")
    discard(every, least)
    out = materialize(verify(pairs, said).select("id", "line").distinct(), "close")
    discard(pairs, said)
    return out


def verify(pairs: DataFrame, said: DataFrame) -> DataFrame:
    """The pairs whose lines are within one edit."""
    one = pairs.join(said.select("id", "line", "said").hint("merge"), ["id", "line"])
    other = said.select(F.col("id").alias("of_id"), F.col("line").alias("of_line"), F.col("said").alias("of_said"))
    return one.join(other.hint("merge"), ["of_id", "of_line"]).filter(F.levenshtein("said", "of_said", 1) >= 0).select("id", "line", "of_id", "of_line")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """(id, lines): for each document that has any, the numbers, from 0, of its lines that go. id is as in common.row_key."""
    every = materialize(first_lines(docs, id_col, text_col, near), "lines")
    first = materialize(every.groupBy("h1", "h2").agg(F.min(F.struct("id", "line")).alias("first")), "firsts")
    met = materialize(every.join(first.hint("merge"), ["h1", "h2"]).select("id", "line", "h1", "keys", "first"), "met")
    discard(every, first)
    at = F.struct("id", "line")
    firsts = met.filter(F.col("first") == at).select("id", "line", "h1", "keys")
    close = close_lines(firsts, docs, id_col, text_col)
    same = met.filter(F.col("first") < at).select("id", "line")
    # Copies of a line that goes for being near an earlier one go as copies.
    out = materialize(same.union(close).groupBy("id").agg(F.collect_set("line").alias("lines")), "gone")
    discard(met, close)
    return out


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """docs, all columns, with text_col less every line that an earlier one equals or, if both have near code points,
    comes within one edit of; n_lines and n_removed name columns for the number of lines with a word and of those gone.

    Earlier means a smaller id, or the same id and a smaller line number; lines are judged on the input, so a line
    goes for an earlier one even if that goes too. Lines are parted by line feeds and compared as they are; lines
    without a word stay and are compared with nothing. A null text stays null; a null id is neither cut nor held
    against others; rows that repeat an id and its text are one document and are cut alike; rows that share an id alone
    are documents of their own, the one with the smaller text hash earlier; an empty table gives an empty one; columns
    of any name stay as they are.
    """
    key, lines, gone_id, gone = fresh(docs, "key", "lines", "gone_id", "gone")
    found = repeated_lines(docs, id_col, text_col, near).select(F.col("id").alias(gone_id), F.col("lines").alias(gone))
    own = docs.withColumn(key, F.when(F.col(id_col).isNotNull(), row_key(id_col, text_col)))
    own = own.join(found.hint("merge"), F.col(key) == F.col(gone_id), "left").withColumn(lines, F.split(F.col(text_col), "\n"))
    left = f"array_join(transform(array_except(sequence(0, size(`{lines}`) - 1), `{gone}`), i -> `{lines}`[i]), '\n')"
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.expr(left))
    more = []
    if n_lines:
        more.append(F.size(F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: x.rlike(WORD))).cast("long").alias(n_lines))
    if n_removed:
        more.append(F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(n_removed))
    return own.select(*(text.alias(c) if c == text_col else x for c, x in zip(docs.columns, columns_of(docs), strict=True)), *more)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_lines (with a word), n_removed and the MD5 of the text that remove_lines leaves."""
    left = remove_lines(docs.select(id_col, text_col), id_col, text_col, n_lines="n_lines", n_removed="n_removed")
    return left.select(id_col, "n_lines", "n_removed", F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_md5"))


#: The SQL joins lines by equal halves, which two lines within one edit always have, and measures the distance itself.
ORACLE = rf"""
WITH l AS (
  SELECT doc_id, i - 1 AS line, s[i] AS said FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) AS u(i)
), w AS (
  SELECT *, length(said) AS n FROM l WHERE regexp_matches(said, '[^\x20\x09-\x0D]')
), f AS (
  SELECT said, n, row_number() OVER (ORDER BY doc_id, line) AS o, doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY said ORDER BY doc_id, line) AS k FROM w) WHERE k = 1
), r AS (
  SELECT o, said, n, m, left(said, m // 2) AS a, right(said, m - m // 2) AS b FROM (SELECT *, unnest([n, n - 1]) AS m FROM f WHERE n >= {NEAR})
), p AS (
  SELECT x.o, x.said, y.o AS o2, y.said AS said2 FROM r x JOIN r y ON x.m = y.m AND x.a = y.a AND x.o > y.o
  UNION SELECT x.o, x.said, y.o, y.said FROM r x JOIN r y ON x.m = y.m AND x.b = y.b AND x.o > y.o
), c AS (
  SELECT DISTINCT o FROM p WHERE levenshtein(said, said2) <= 1
), g AS (
  SELECT w.doc_id, w.line FROM w JOIN f USING (said) WHERE (w.doc_id, w.line) <> (f.doc_id, f.line) OR f.o IN (SELECT o FROM c)
), k AS (
  SELECT doc_id, string_agg(said, chr(10) ORDER BY line) AS kept FROM l WHERE (doc_id, line) NOT IN (SELECT (doc_id, line) FROM g) GROUP BY doc_id
)
SELECT d.doc_id, coalesce((SELECT count(*) FROM w WHERE w.doc_id = d.doc_id), 0) AS n_lines, coalesce((SELECT count(*) FROM g WHERE g.doc_id = d.doc_id), 0) AS n_removed, md5(coalesce(kept, '')) AS text_md5
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
