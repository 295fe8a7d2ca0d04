"""Rules over page texts: unresolved references, drafts, repeated words, punctuation, floats, brackets, numbering.

Input is pages with content_text (see content_pages). Matches are counted page by page within the scan stage; one
shuffle brings the few numbers and previews of a paper together.
"""

from __future__ import annotations

import unicodedata
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.groups import map_groups, values
from ..functions.text import contexts, dehyphenate, hits, matched, occurrences
from ..plans.findings import finding, union

#: The digits 0 to 9 of every script that has any, in that order.
DIGITS = "".join(c for c in map(chr, range(128, 0x110000)) if unicodedata.decimal(c, None) is not None)


def content_pages(pages: DataFrame, lines: DataFrame | None = None, review_numbers: DataFrame | None = None) -> DataFrame:
    """pages with content_text: the lines that aren't review numbers, in order, or the raw text where there are none; hyphens at line ends are undone."""
    raw = F.coalesce(F.col("raw_text"), F.lit(""))
    if lines is None:
        return pages.withColumn("content_text", dehyphenate(raw))
    own = lines if review_numbers is None else lines.join(review_numbers.select("paper_id", "page_num", "block_no", "line_no").hint("merge"), ["paper_id", "page_num", "block_no", "line_no"], "left_anti")
    joined = own.groupBy("paper_id", "page_num").agg(F.sort_array(F.collect_list(F.struct("block_no", "line_no", "text"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x.text), "\n")
    laid_out = lines.select("paper_id", "page_num").distinct().join(joined.hint("merge"), ["paper_id", "page_num"], "left").select("paper_id", "page_num", F.coalesce(text, F.lit("")).alias("laid_out"))
    return pages.join(laid_out.hint("merge"), ["paper_id", "page_num"], "left").withColumn("content_text", F.when(_blank(raw), raw).otherwise(dehyphenate(F.coalesce("laid_out", raw)))).drop("laid_out")


def _blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def page_matches(pages: DataFrame, rules: tuple[str, ...] | None = None) -> DataFrame:
    """(paper_id, page_num, rule, n, examples): one row for each rule (of those asked for) that matches on a page.

    Counts are made in the scan; previews only behind the filter on them, and not at all where nobody reads them.
    """
    t = F.col("content_text")
    none = F.array().cast("array<string>")
    long_number = F.exists(F.concat(hits(t, P.FIGURE, 1), hits(t, P.TABLE, 1)), lambda x: F.length(x) > P.MAX_NUMBER_DIGITS)
    read = ~_blank(t)
    counts = {
        "R09": F.when(read & long_number, 1).otherwise(0),
        "R10": F.when(read, 0).otherwise(1),
        "R11": F.when(matched(t, P.UNRESOLVED), 1).otherwise(0),
        "R12": occurrences(t, P.DRAFT),
        "R13": occurrences(t, P.REPEATED),
        "R14": occurrences(t, P.STUTTER) + occurrences(t, P.ISOLATED),
        "R15": occurrences(t, P.SMALL_FLOAT),
    }
    previews = {
        "R12": lambda: contexts(t, P.DRAFT),
        "R13": lambda: contexts(t, P.REPEATED),
        "R14": lambda: F.slice(F.concat(contexts(t, P.STUTTER), contexts(t, P.ISOLATED)), 1, P.PREVIEW),
        "R15": lambda: F.slice(hits(t, P.SMALL_FLOAT), 1, P.PREVIEW),
    }
    wanted = [r for r in counts if rules is None or r in rules]
    found = F.array(*(F.struct(F.lit(r).alias("rule"), counts[r].cast("bigint").alias("n")) for r in wanted))
    rows = pages.select("paper_id", "page_num", "content_text", F.explode(found).alias("m")).select("paper_id", "page_num", "content_text", "m.rule", "m.n").filter(F.col("n") > 0)
    examples = none
    for r in wanted:
        if r in previews:
            examples = F.when(F.col("rule") == r, previews[r]()).otherwise(examples)
    return rows.select("paper_id", "page_num", "rule", "n", examples.alias("examples"))


def match_findings(matches: DataFrame) -> DataFrame:
    """R09 to R15 of each paper."""
    place = F.transform("examples", lambda x: F.concat(F.lit("page "), F.col("page_num").cast("string"), F.lit(' "'), x, F.lit('"')))
    own = matches.withColumn("examples", place).groupBy("paper_id", "rule").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("page_num", "examples"))).alias("p"))
    own = own.select("paper_id", "rule", "n", F.transform("p", lambda x: x.page_num).alias("pages"), F.flatten(F.transform("p", lambda x: x.examples)).alias("examples"))
    shown = F.when((F.col("n") > P.PREVIEW) & (F.size("examples") > 0), F.concat(F.slice("examples", 1, P.PREVIEW), F.array(F.lit("...")))).otherwise(F.col("examples"))
    return finding(own, F.col("rule"), "n", F.col("pages").cast("array<int>"), shown, limit=P.PREVIEW + 1)


def bracket_balance(pages: DataFrame) -> DataFrame:
    """(paper_id, kind, diff): openers less closers, where they differ. Openers without closer less closers without
    opener is just that difference, so no stack is needed to decide, and counts add up over pages."""
    t = F.col("content_text")
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), (count(k[0]) - count(k[1])).alias("d")) for k in ("()", "[]", "{}")))
    rows = pages.select("paper_id", F.explode(kinds).alias("k")).select("paper_id", "k.*").filter(F.col("d") != 0)
    return rows.groupBy("paper_id", "kind").agg(F.sum("d").alias("diff")).filter(F.col("diff") != 0)


def bracket_places(pages: DataFrame, balance: DataFrame) -> DataFrame:
    """(paper_id, examples): where brackets of unbalanced papers stay open or close nothing; the last three and the first three of each kind."""
    own = pages.select("paper_id", "page_num", "content_text").join(balance.select("paper_id").distinct().hint("merge"), "paper_id", "left_semi")

    def places(texts: list[str], numbers: list[int]) -> list[str]:
        text = "\n".join(texts)
        ends = list(accumulate(len(t) + 1 for t in texts))

        def tell(at: int, what: str) -> str:
            page = next((n for n, e in zip(numbers, ends, strict=True) if at < e), numbers[-1])
            return f'page {page} "{" ".join(text[max(0, at - P.CONTEXT) : at + P.CONTEXT + 1].split())}": {what}'

        said = []
        for opener, closer in ("()", "[]", "{}"):
            waiting: list[int] = []
            stray: list[int] = []
            for at, c in ((i, c) for i, c in enumerate(text) if c in (opener, closer)):
                if c == opener:
                    waiting.append(at)
                else:
                    (waiting.pop() if waiting else stray.append(at))
            said += [tell(at, f"'{opener}' not closed") for at in waiting[-3:]] + [tell(at, f"'{closer}' has no matching opener") for at in stray[:3]]
        return said

    def every(t: pa.Table, at: list[int]) -> pa.Table:
        papers, numbers, texts = (values(t, c) for c in ("paper_id", "page_num", "content_text"))
        said = [places(texts[a:e], numbers[a:e]) for a, e in pairwise(at)]
        return pa.table({"paper_id": pa.array([papers[a] for a in at[:-1]], pa.int64()), "examples": pa.array(said, pa.list_(pa.string()))})

    return map_groups(own, ["paper_id"], every, "paper_id bigint, examples array<string>", (F.col("page_num"),))


def bracket_findings(pages: DataFrame) -> DataFrame:
    balance = bracket_balance(pages)
    signs = balance.groupBy("paper_id").agg(F.sum(F.abs("diff")).alias("n"), F.sort_array(F.collect_list(F.format_string("'%s' %+d", F.col("kind"), F.col("diff")))).alias("kinds"))
    own = signs.join(bracket_places(pages, balance).hint("merge"), "paper_id", "left")
    return finding(own, "R16", "n", examples=F.concat("kinds", F.coalesce("examples", F.array().cast("array<string>"))), limit=8)


def float_numbers(pages: DataFrame) -> DataFrame:
    """(paper_id, label, number), distinct; over-long numbers are left out (R09). Digits of other scripts are read as such."""
    t = F.when(_blank(F.col("content_text")), F.lit("")).otherwise(F.col("content_text"))
    both = F.array(*(F.struct(F.lit(k).alias("label"), F.transform(hits(t, p, 1), lambda x: F.translate(x, DIGITS, "0123456789" * (len(DIGITS) // 10))).alias("x")) for k, p in (("Figure", P.FIGURE), ("Table", P.TABLE))))
    rows = pages.select("paper_id", F.explode(both).alias("b")).select("paper_id", "b.label", F.explode("b.x").alias("x"))
    number = F.expr("try_cast(x as int)")
    return rows.filter(F.length("x") <= P.MAX_NUMBER_DIGITS).select("paper_id", "label", number.alias("number")).filter(F.col("number").isNotNull()).distinct()


def number_gaps(numbers: DataFrame) -> DataFrame:
    """(paper_id, label, missing, preview): what lies between numbers that occur; only the first GAP_PREVIEW are spelt out."""
    follow = Window.partitionBy("paper_id", "label").orderBy("number")
    step = numbers.withColumn("next", F.lead("number").over(follow)).filter(F.col("next") - F.col("number") > 1)
    some = F.sequence(F.col("number") + 1, F.least(F.col("next") - 1, F.col("number") + P.GAP_PREVIEW))
    own = step.select("paper_id", "label", (F.col("next") - F.col("number") - 1).cast("bigint").alias("k"), F.struct("number", some.alias("x")).alias("s"))
    out = own.groupBy("paper_id", "label").agg(F.sum("k").alias("missing"), F.sort_array(F.collect_list("s")).alias("s"))
    return out.select("paper_id", "label", "missing", F.slice(F.flatten(F.transform("s", lambda x: x.x)), 1, P.GAP_PREVIEW).alias("preview"))


def gap_findings(pages: DataFrame) -> DataFrame:
    gaps = number_gaps(float_numbers(pages))
    said = F.concat("label", F.lit(": "), F.array_join(F.col("preview").cast("array<string>"), " "), F.when(F.col("missing") > F.size("preview"), F.lit(" ...")).otherwise(F.lit("")))
    own = gaps.groupBy("paper_id").agg(F.sum("missing").alias("n"), F.sort_array(F.collect_list(said)).alias("x"))
    return finding(own, "R17", "n", examples=F.col("x"))


def content_findings(pages: DataFrame) -> DataFrame:
    """R09 to R17 for pages with content_text. Pages without text are unchecked (R10), not passed."""
    return union([match_findings(page_matches(pages)), bracket_findings(pages), gap_findings(pages)])
