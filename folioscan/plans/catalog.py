"""All registered queries of the audit engine, with the SQL that says what each must return.

Queries run over whole tables. Rules whose text needs look-around or back-references are told to DuckDB by an
equivalent without them; what SQL can't tell at all has no SQL and is held against brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import median
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import bibliography, content, identity, layout, liveness, pageformat, urls
from ..sources.papers import Tables, empty, from_texts
from . import audit as audits
from . import seeds
from .findings import RULES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CONTENT = seeds.sql(seeds.PAGES)


class Placed(NamedTuple):
    """What the run rules look at of a line."""

    text: str
    y0: float


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.content_pages(seeds.frame(spark, sf_dir, seeds.PAGES))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.frame(spark, sf_dir, seeds.PAPERS)


def csv(col) -> F.Column:
    return F.array_join(F.col(col).cast("array<string>") if isinstance(col, str) else col, ",")


def matches(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return content.page_matches(pages(spark, sf_dir), (rule,))


def matched_pages(rule: str, where: str) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matches(spark, sf_dir, rule).groupBy("paper_id").agg(F.array_sort(F.collect_set("page_num")).alias("p")).select("paper_id", csv("p").alias("pages"))

    return run, f"SELECT paper_id, string_agg(CAST(page_num AS VARCHAR), ',' ORDER BY page_num) AS pages FROM ({CONTENT}) WHERE {where} GROUP BY paper_id"


def match_counts(rule: str, count: str) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return matches(spark, sf_dir, rule).groupBy("paper_id").agg(F.sum("n").alias("n"))

    return run, f"SELECT paper_id, CAST(sum({count}) AS BIGINT) AS n FROM ({CONTENT}) GROUP BY paper_id HAVING sum({count}) > 0"


READ = r"regexp_matches(raw_text, '\S')"
TEXT_RULES = {
    "r09_long_numbers": matched_pages("R09", rf"{READ} AND len(list_filter(list_concat(regexp_extract_all(raw_text, '\b(?:Figure|Fig\.?)\s*(\d+)\b', 1), regexp_extract_all(raw_text, '\bTable\s*(\d+)\b', 1)), lambda x: length(x) > 9)) > 0"),
    "r10_unreadable_pages": matched_pages("R10", f"NOT {READ}"),
    "r11_unresolved_references": matched_pages("R11", r"regexp_matches(raw_text, '(?i)\[\?\]|\?\?|\b(?:Figure|Fig\.|Table|Equation|Eq\.|Section|Chapter)\s+\?')"),
    "r12_draft_markers": match_counts("R12", r"len(regexp_extract_all(raw_text, '(?i)\b(?:TODO|FIXME|XXX|TBD)\b'))"),
    "r14_odd_punctuation": match_counts("R14", r"len(regexp_extract_all(raw_text, ',,|;;')) + len(list_filter(regexp_extract_all(raw_text, '[.\d]+'), lambda x: x = '..')) + len(list_filter(regexp_split_to_array(raw_text, '\s+'), lambda x: x IN (',', ';')))"),
    "r15_lower_case_floats": match_counts("R15", r"len(regexp_extract_all(raw_text, '\b(?:figure|fig\.?|table)\s*\d+\b'))"),
}
for _name, (_run, _sql) in TEXT_RULES.items():
    query(_name, _sql)(_run)


@query(
    "r13_repeated_words",
    rf"""
WITH w AS (SELECT paper_id, page_num, list_filter(regexp_split_to_array(raw_text, '\s+'), lambda x: x <> '') AS w FROM ({CONTENT})),
p AS (SELECT paper_id, lower(regexp_extract(w[i], '(?:^|[^\p{{L}}\p{{N}}_])([A-Za-z]{{2,}})$', 1)) AS a, lower(regexp_extract(w[i + 1], '^([A-Za-z]{{2,}})(?:$|[^\p{{L}}\p{{N}}_])', 1)) AS b FROM w, unnest(range(1, len(w))) AS u(i))
SELECT DISTINCT paper_id FROM p WHERE a <> '' AND a = b""",
)
def repeated_words(spark, sf_dir):
    return matches(spark, sf_dir, "R13").select("paper_id").distinct()


def spelt_contexts(pattern: str) -> str:
    """SQL for contexts(): a match starts behind all matches and rests before it."""
    return rf"""
WITH t AS (SELECT paper_id, page_num, raw_text, regexp_extract_all(raw_text, '{pattern}') AS m, regexp_split_to_array(raw_text, '{pattern}') AS r FROM ({CONTENT})),
i AS (SELECT *, unnest(range(1, least(len(m), {P.PREVIEW}) + 1)) AS i FROM t WHERE len(m) > 0),
s AS (SELECT *, list_sum(list_transform(r[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM i),
c AS (SELECT paper_id, page_num, i, trim(regexp_replace(substring(raw_text, CAST(greatest(s - {P.CONTEXT}, 0) + 1 AS BIGINT), CAST(s + length(m[i]) + {P.CONTEXT} - greatest(s - {P.CONTEXT}, 0) AS BIGINT)), '\s+', ' ', 'g')) AS c FROM s)
SELECT paper_id, page_num, string_agg(c, ' | ' ORDER BY i) AS contexts FROM c GROUP BY ALL"""


@query("r12_draft_contexts", spelt_contexts(r"(?i)\b(?:TODO|FIXME|XXX|TBD)\b"))
def draft_contexts(spark, sf_dir):
    return matches(spark, sf_dir, "R12").select("paper_id", "page_num", F.array_join("examples", " | ").alias("contexts"))


@query(
    "r16_bracket_balance",
    "WITH c AS (SELECT paper_id, k AS kind, sum(length(raw_text) - length(replace(raw_text, k[1], '')) - length(raw_text) + length(replace(raw_text, k[2], ''))) AS d "
    f"FROM ({CONTENT}), unnest(['()', '[]', '{{}}']) AS u(k) GROUP BY ALL) SELECT paper_id, kind, CAST(d AS BIGINT) AS diff FROM c WHERE d <> 0",
)
def bracket_balance(spark, sf_dir):
    return content.bracket_balance(pages(spark, sf_dir)).withColumn("diff", F.col("diff").cast("bigint"))


#: A closer is stray where the running balance reaches a new low; an opener stays open where no later balance comes back to the one before it.
PLACES = rf"""
WITH t AS (SELECT paper_id, string_agg(raw_text, chr(10) ORDER BY page_num) AS text, max(length(raw_text)) FILTER (WHERE page_num = 1) AS one FROM ({CONTENT}) GROUP BY paper_id),
u AS (SELECT paper_id FROM t, unnest(['()', '[]', '{{}}']) AS u(k) WHERE length(replace(text, k[1], '')) <> length(replace(text, k[2], '')) GROUP BY paper_id),
h AS (SELECT paper_id, text, one, unnest(range(1, length(text) + 1)) AS i FROM t SEMI JOIN u USING (paper_id)),
b AS (SELECT paper_id, text, one, kind, i, CASE WHEN text[i] = kind[1] THEN 1 ELSE -1 END AS d FROM h, unnest(['()', '[]', '{{}}']) AS k(kind) WHERE text[i] IN (kind[1], kind[2])),
s AS (SELECT *, sum(d) OVER (PARTITION BY paper_id, kind ORDER BY i) AS s FROM b),
m AS (SELECT *, coalesce(min(s) OVER (PARTITION BY paper_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, min(s) OVER (PARTITION BY paper_id, kind ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM s),
x AS (SELECT *, row_number() OVER (PARTITION BY paper_id, kind, d ORDER BY i DESC) AS last, row_number() OVER (PARTITION BY paper_id, kind, d ORDER BY i) AS first FROM m WHERE d = -1 AND s < least(low, 0) OR d = 1 AND later > s - 1),
y AS (SELECT *, 'page ' || CASE WHEN i - 1 < one + 1 THEN '1' ELSE '2' END || ' "' || trim(regexp_replace(substring(text, greatest(0, i - 1 - {P.CONTEXT}) + 1, i + {P.CONTEXT} - greatest(0, i - 1 - {P.CONTEXT})), '\s+', ' ', 'g')) || '": ' || chr(39) || text[i] || chr(39) || CASE d WHEN 1 THEN ' not closed' ELSE ' has no matching opener' END AS said FROM x WHERE d = 1 AND last <= 3 OR d = -1 AND first <= 3)
SELECT u.paper_id, coalesce(string_agg(said, ' | ' ORDER BY list_position(['()', '[]', '{{}}'], kind), d DESC, i), '') AS places FROM u LEFT JOIN y USING (paper_id) GROUP BY u.paper_id"""


@query("r16_bracket_places", PLACES)
def bracket_places(spark, sf_dir):
    own = pages(spark, sf_dir)
    return content.bracket_places(own, content.bracket_balance(own)).select("paper_id", F.array_join("examples", " | ").alias("places"))


NUMBERS = rf"""
SELECT DISTINCT paper_id, label, CAST(x AS INTEGER) AS number FROM (
  SELECT paper_id, 'Figure' AS label, unnest(regexp_extract_all(raw_text, '\b(?:Figure|Fig\.?)\s*(\d+)\b', 1)) AS x FROM ({CONTENT})
  UNION ALL SELECT paper_id, 'Table', unnest(regexp_extract_all(raw_text, '\bTable\s*(\d+)\b', 1)) FROM ({CONTENT})) WHERE length(x) <= 9"""


@query("e03_float_numbers", NUMBERS)
def float_numbers(spark, sf_dir):
    return content.float_numbers(pages(spark, sf_dir))


@query(
    "r17_number_gaps",
    f"""
WITH n AS ({NUMBERS}), g AS (SELECT *, lead(number) OVER (PARTITION BY paper_id, label ORDER BY number) AS next FROM n),
m AS (SELECT paper_id, label, number, next - number - 1 AS k, range(number + 1, least(next, number + {P.GAP_PREVIEW} + 1)) AS x FROM g WHERE next - number > 1)
SELECT paper_id, label, CAST(sum(k) AS BIGINT) AS missing, array_to_string(list_slice(flatten(list(x ORDER BY number)), 1, {P.GAP_PREVIEW}), ',') AS preview FROM m GROUP BY ALL""",
)
def number_gaps(spark, sf_dir):
    return content.number_gaps(content.float_numbers(pages(spark, sf_dir))).withColumn("preview", csv("preview"))


def told(findings: DataFrame) -> DataFrame:
    return findings.select("paper_id", F.array_join("examples", "|").alias("said"))


PAPERS = seeds.sql(seeds.PAPERS)


@query("r18_author_metadata", rf"SELECT paper_id, author AS said FROM ({PAPERS}) WHERE trim(lower(regexp_replace(coalesce(author, ''), '\s+', ' ', 'g'))) NOT IN ('', {', '.join(f"'{a}'" for a in P.ANONYMOUS_AUTHORS)})")
def author_metadata(spark, sf_dir):
    return told(identity.author_findings(papers(spark, sf_dir)))


@query("r19_word_processor", f"SELECT paper_id, creator AS said FROM ({PAPERS}) WHERE lower(creator) LIKE '%word%'")
def word_processor(spark, sf_dir):
    return told(identity.creator_findings(papers(spark, sf_dir)))


@query(
    "r20_local_paths",
    rf"SELECT paper_id, f || ' ' || p AS said FROM (SELECT paper_id, f, regexp_extract(v, '([A-Za-z]:\\Users\\[^\\\s]+|/Users/[^/\s]+|/home/[^/\s]+)', 1) AS p FROM (SELECT paper_id, 'Creator' AS f, creator AS v FROM ({PAPERS}) UNION ALL SELECT paper_id, 'Producer', producer FROM ({PAPERS}))) WHERE p <> ''",
)
def local_paths(spark, sf_dir):
    return told(identity.path_findings(papers(spark, sf_dir)))


@query(
    "r21_first_page_identity",
    rf"""
WITH h AS (SELECT paper_id, list_sort(list_distinct(list_concat(
  regexp_extract_all(raw_text, '(?i)\b(?:University|College|Institute|Institute of|Laboratory|Academy|Corporation|Company|School of|Department of)\b'),
  regexp_extract_all(raw_text, '(?i)[\p{{L}}\p{{N}}_.!#$%&''*+/=?^`{{|}}~-]+@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{{2,}}\b')))) AS h FROM ({CONTENT}) WHERE page_num = 1)
SELECT paper_id, array_to_string(h, '|') AS hits FROM h WHERE len(h) > 0""",
)
def first_page(spark, sf_dir):
    return identity.first_page_hits(pages(spark, sf_dir)).select("paper_id", F.array_join("hits", "|").alias("hits"))


@query("r22_acknowledgments", rf"SELECT paper_id, string_agg(CAST(page_num AS VARCHAR), ',' ORDER BY page_num) AS pages FROM ({CONTENT}) WHERE regexp_matches(raw_text, '(?i)\b(?:Acknowledgments?|Acknowledgements?)\b') GROUP BY paper_id")
def acknowledgments(spark, sf_dir):
    return identity.acknowledgment_findings(pages(spark, sf_dir)).select("paper_id", csv("pages").alias("pages"))


ANNOTATED = f"SELECT paper_id, page_num, CASE WHEN uri LIKE 'doi.org/%' THEN 'https://' || uri ELSE uri END AS url FROM ({seeds.sql(seeds.LINKS)}) WHERE uri LIKE 'http%' OR uri LIKE 'doi%'"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.frame(spark, sf_dir, seeds.LINKS).withColumn("rect", F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>"))


@query("a08_link_annotations", ANNOTATED)
def link_annotations(spark, sf_dir):
    return urls.annotations(links(spark, sf_dir)).drop("rect")


TEXTED = rf"SELECT DISTINCT paper_id, CASE WHEN u LIKE 'doi.org/%' THEN 'https://' || rtrim(u, '.,;:') ELSE rtrim(u, '.,;:') END AS url FROM (SELECT paper_id, unnest(regexp_extract_all(raw_text, '(https?://[^\s\]>}}\"''<>]+|doi\.org/[^\s\]>}}\"''<>]+)')) AS u FROM ({CONTENT}))"


@query("c11_text_urls", TEXTED)
def text_urls(spark, sf_dir):
    return urls.text_urls(pages(spark, sf_dir))


REVEALING = "(" + " OR ".join([*(f"contains(lower(url), '{h}')" for h in P.REVEALING_HOSTS), "contains(lower(url), '/~')"]) + ")"


@query("r23_revealing_links", f"SELECT paper_id, string_agg(url, '|' ORDER BY url) AS said FROM (SELECT paper_id, url FROM ({TEXTED}) UNION SELECT paper_id, url FROM ({ANNOTATED})) WHERE {REVEALING} GROUP BY paper_id")
def revealing_links(spark, sf_dir):
    every = urls.text_urls(pages(spark, sf_dir)).union(urls.annotations(links(spark, sf_dir)).select("paper_id", "url")).distinct()
    return told(identity.link_findings(every))


@query("r01_file_size", f"SELECT paper_id, CASE WHEN file_bytes / 1048576.0 > 10 THEN 'Warning' ELSE 'Pass' END AS level FROM ({PAPERS})")
def file_size(spark, sf_dir):
    return pageformat.size_findings(papers(spark, sf_dir)).select("paper_id", "level")


@query("r02_page_limit", f"SELECT paper_id, CASE WHEN page_count > 9 THEN 'Error' ELSE 'Pass' END AS level FROM ({PAPERS})")
def page_limit(spark, sf_dir):
    return pageformat.length_findings(papers(spark, sf_dir), 9).select("paper_id", "level")


@query("r03_blank_pages", f"SELECT paper_id, string_agg(CAST(page_num AS VARCHAR), ',' ORDER BY page_num) AS pages FROM ({CONTENT}) WHERE NOT {READ} GROUP BY paper_id")
def blank_pages(spark, sf_dir):
    own = pages(spark, sf_dir).withColumns({"n_images": F.lit(0), "n_drawings": F.lit(0)})
    return pageformat.blank_pages(own).select("paper_id", csv("p").alias("pages"))


BASE = ", ".join(f"'{f}'" for f in P.BASE_FONTS)


@query(
    "r04_r05_fonts",
    f"""
WITH f AS (SELECT paper_id, regexp_replace(font_name, '^[A-Z]{{6}}\\+', '') AS name, bool_or(embedded) AS e FROM ({seeds.sql(seeds.FONTS)}) GROUP BY paper_id, xref, font_name)
SELECT paper_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE NOT e AND name NOT IN ({BASE})), '') AS missing,
       coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE NOT e AND name IN ({BASE})), '') AS standard FROM f GROUP BY paper_id""",
)
def fonts(spark, sf_dir):
    return pageformat.font_verdicts(seeds.frame(spark, sf_dir, seeds.FONTS)).select("paper_id", csv("missing").alias("missing"), csv("standard").alias("standard"))


@query(
    "r07_low_resolution",
    f"SELECT paper_id, page_num, img_no, round(dpi, 6) AS dpi FROM (SELECT *, least(width_px / (wide / 72), height_px / (high / 72)) AS dpi FROM ({seeds.sql(seeds.IMAGES)}) WHERE wide > 0 AND high > 0) WHERE dpi > 0 AND dpi < {P.MIN_DPI}",
)
def low_resolution(spark, sf_dir):
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("wide").alias("x1"), F.col("high").alias("y1"))
    return pageformat.low_resolution(seeds.frame(spark, sf_dir, seeds.IMAGES).withColumn("bbox", box)).withColumn("dpi", F.round("dpi", 6))


def paper_pages(lines: DataFrame) -> DataFrame:
    return lines.select("paper_id", "page_num").distinct().select("paper_id", "page_num", *(F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 500.0), ("y1", 792.0))))


def unmarked(lines: DataFrame) -> DataFrame:
    """Lines for the margin rule where no review numbers are possible."""
    rect = {"page_x0": F.lit(0.0), "page_y0": F.lit(0.0), "page_x1": F.lit(500.0), "page_y1": F.lit(792.0)}
    return layout.flat_lines(lines).withColumns(rect | {"is_review": F.lit(False), "is_header": F.lit(False)})


@query(
    "r08_overflow_fixed_margin",
    rf"SELECT paper_id, string_agg(DISTINCT CAST(page_num AS VARCHAR), ',' ORDER BY CAST(page_num AS VARCHAR)) AS pages FROM ({seeds.LAYOUT}) WHERE regexp_matches(line, '\S') AND (x0 < 36 - 3 OR x1 > 500 - 36 + 3) GROUP BY paper_id",
)
def overflow_fixed(spark, sf_dir):
    lines = seeds.layout_lines(spark, sf_dir)
    out = layout.overflow_pages(paper_pages(lines), unmarked(lines), empty(spark, "images"), 36.0)
    return out.select("paper_id", csv(F.array_sort(F.col("pages").cast("array<string>"))).alias("pages"))


@query("r08_overflow_inferred_bands")
def overflow_inferred(spark, sf_dir):
    lines = seeds.layout_lines(spark, sf_dir)
    return layout.overflow_pages(paper_pages(lines), layout.marked_lines(lines, paper_pages(lines)), empty(spark, "images")).select("paper_id", csv("pages").alias("pages"))


@query("f02_text_bands")
def text_bands(spark, sf_dir):
    bands = layout.paper_bands(seeds.frame(spark, sf_dir, seeds.EDGES))
    return bands.select("paper_id", F.explode("bands").alias("b")).select("paper_id", F.col("b.l").alias("left_edge"), F.col("b.r").alias("right_edge"))


@query(
    "e08_order_statistics",
    f"""
WITH e AS (SELECT paper_id, list_sort(list(x1)) AS v FROM ({seeds.sql(seeds.EDGES)}) GROUP BY paper_id)
SELECT paper_id, list_median(v) AS middle, v[CAST(round_even(0.95 * (len(v) - 1), 0) AS INTEGER) + 1] AS nearest, v[CAST(floor((len(v) - 1) * 0.1) AS INTEGER) + 1] AS low FROM e""".replace("list_median(v)", "list_aggregate(v, 'median')"),
)
def order_statistics(spark, sf_dir):
    @F.pandas_udf("middle double, nearest double, low double")
    def ranks(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"middle": values.map(median), "nearest": values.map(lambda v: layout.nearest_rank(list(v), 0.95)), "low": values.map(lambda v: layout.floor_rank(list(v), 0.1))})

    own = seeds.frame(spark, sf_dir, seeds.EDGES).groupBy("paper_id").agg(F.collect_list("x1").alias("v"))
    return own.select("paper_id", ranks("v").alias("r")).select("paper_id", "r.*")


@query(
    "f05_consecutive_runs",
    """
WITH n AS (SELECT DISTINCT l_orderkey AS paper_id, l_linenumber AS number, l_partkey AS y FROM lineitem),
b AS (SELECT *, CASE WHEN number = lag(number) OVER w + 1 AND y > lag(y) OVER w + 2 THEN 0 ELSE 1 END AS cut FROM n WINDOW w AS (PARTITION BY paper_id ORDER BY y, number)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY paper_id ORDER BY y, number ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT paper_id, CAST(run AS BIGINT) AS run, CAST(min(number) AS BIGINT) AS first, count(*) AS n FROM r GROUP BY paper_id, run""",
)
def consecutive_runs(spark, sf_dir):
    @F.pandas_udf("array<struct<run:bigint,first:bigint,n:bigint>>")
    def runs(numbers: pd.Series) -> pd.Series:
        def found(own):
            rows = [Placed(str(x["number"]), x["y"]) for x in own]
            return [{"run": k + 1, "first": int(r[0].text), "n": len(r)} for k, r in enumerate(layout.counting_runs(rows))]

        return numbers.map(found)

    own = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("paper_id"), F.struct(F.col("l_partkey").alias("y"), F.col("l_linenumber").alias("number")).alias("x"))
    each = own.groupBy("paper_id").agg(F.sort_array(F.collect_set("x")).alias("x"))
    return each.select("paper_id", F.explode(runs("x")).alias("r")).select("paper_id", "r.*")


ENTRIES = r"""
SELECT doc_id AS paper_id, i - 1 AS no, s[i] AS text, trim(regexp_replace(lower(regexp_replace(string_split(s[i], '.')[1], '[^A-Za-z0-9\s]', '', 'g')), '\s+', ' ', 'g')) AS t
FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a reference of that paper."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "text"))


@query("d01_identical_titles", f"WITH e AS (SELECT * FROM ({ENTRIES}) WHERE length(t) >= 10) SELECT a.paper_id, CAST(a.no AS INTEGER) AS i, CAST(b.no AS INTEGER) AS j FROM e a JOIN e b ON a.paper_id = b.paper_id AND a.t = b.t AND a.no < b.no")
def identical_titles(spark, sf_dir):
    """First sentences stand for titles, reduced to ASCII letters and digits on both sides."""
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.split("text", r"\.")[0], r"[^A-Za-z0-9\s]", "")), r"\s+", " "))
    return bibliography.title_pairs(entries(spark, sf_dir), F.when(F.length(plain) >= P.TITLE_CHARS, plain))


@query("d02_similar_entries")
def similar_entries(spark, sf_dir):
    return bibliography.similar_pairs(entries(spark, sf_dir))


@query("d03_repeated_fragments")
def repeated_fragments(spark, sf_dir):
    """A fragment needs a year, and the documents have none: a few common words stand for one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.regexp_replace("text", r"\b(?:the|der|les|que)\b", "2020")
    return docs.select(F.col("doc_id").alias("paper_id"), F.explode(bibliography.repeated_fragments(text)).alias("fragment"))


@query("f11_bibliographies")
def bibliographies(spark, sf_dir):
    lines = seeds.layout_lines(spark, sf_dir)
    heading = F.when(F.col("block_no") == 0, F.lit("References")).otherwise(F.concat(F.lit("["), F.col("block_no").cast("string"), F.lit("] "), F.col("text")))
    return bibliography.bibliographies(lines.withColumn("text", heading), paper_pages(lines))


@query(
    "j01_link_liveness",
    f"SELECT paper_id, CASE list_sum(list_transform(string_split(url, ''), lambda c: unicode(c))) % 4 WHEN 0 THEN '' WHEN 1 THEN url || ' (HTTP 404)' WHEN 2 THEN url || ' (HTTP 503)' ELSE url || ' (redirect loop)' END AS said FROM ({ANNOTATED})",
)
def link_liveness(spark, sf_dir):
    """Liveness of the planted links against a transport that answers by the address; nothing is requested."""
    own = urls.annotations(links(spark, sf_dir)).select("paper_id", "url")
    return told(liveness.liveness_findings(own, liveness.probe(own, canned)))


def canned(url: str) -> tuple[int, str | None]:
    kind = sum(map(ord, url)) % 4
    return ((200, None), (404, None), (503, None), (301, url))[kind]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Papers with texts and with lines, words, links, fonts and images of their own."""
    read = lambda text: seeds.frame(spark, sf_dir, text)
    texts = from_texts(papers(spark, sf_dir), read(seeds.PAGES))
    lines = seeds.layout_lines(spark, sf_dir).withColumn("page_num", F.col("page_num") + 2).unionByName(read(seeds.REFERENCES))
    rect = {c: F.lit(v) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 612.0), ("y1", 792.0))}
    laid_out = lines.select("paper_id", "page_num").distinct().withColumns(rect | {"raw_text": F.lit("laid out"), "n_images": F.lit(0), "n_drawings": F.lit(0)})
    pages = texts.pages.withColumns(rect).unionByName(laid_out.select(*texts.pages.columns))
    return Tables(papers=texts.papers, pages=pages, lines=lines, words=read(seeds.WORDS), links=read(seeds.PAPER_LINKS), fonts=read(seeds.PAPER_FONTS), images=read(seeds.PAPER_IMAGES))


def text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings that texts and metadata give; offline."""
    own = pages(spark, sf_dir)
    parts = [pageformat.size_findings(papers(spark, sf_dir)), content.content_findings(own), identity.identity_findings(papers(spark, sf_dir), own, urls.text_urls(own))]
    return audits.union(parts)


@query("h04_all_text_findings")
def all_text_findings(spark, sf_dir):
    return text_findings(spark, sf_dir).select("paper_id", "seq", "level", "check_type", "rule_id", "n", csv("pages").alias("pages"), F.array_join("examples", "|").alias("examples"), "message_en")


def one_each(name: str, rule: str) -> str:
    """A finding of the rule for each paper that the query of that name returns."""
    return f"SELECT DISTINCT paper_id, '{rule}' AS rule_id FROM ({SQL[name]})"


#: The rules that find something in each paper; R20 finds something once a field.
FOUND = " UNION ALL ".join([
    f"SELECT paper_id, CASE level WHEN 'Pass' THEN 'R01P' ELSE 'R01' END AS rule_id FROM ({SQL['r01_file_size']})",
    *(one_each(q, r) for q, r in (
        ("r09_long_numbers", "R09"), ("r10_unreadable_pages", "R10"), ("r11_unresolved_references", "R11"), ("r12_draft_markers", "R12"), ("r13_repeated_words", "R13"), ("r14_odd_punctuation", "R14"),
        ("r15_lower_case_floats", "R15"), ("r16_bracket_balance", "R16"), ("r17_number_gaps", "R17"), ("r18_author_metadata", "R18"), ("r19_word_processor", "R19"), ("r21_first_page_identity", "R21"),
        ("r22_acknowledgments", "R22"),
    )),
    f"SELECT paper_id, 'R20' AS rule_id FROM ({SQL['r20_local_paths']})",
    f"SELECT DISTINCT paper_id, 'R23' AS rule_id FROM ({TEXTED}) WHERE {REVEALING}",
])
LEVELS = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{v[1]}'" for r, v in RULES.items()) + " END"
TYPES = "CASE rule_id " + " ".join(f"WHEN '{r}' THEN '{v[2]}'" for r, v in RULES.items()) + " END"
RANK = "list_position(['Pass', 'Unchecked', 'Warning', 'Error'], level)"


@query("h04_finding_levels", f"SELECT paper_id, {LEVELS} AS level, {TYPES} AS check_type, substring(rule_id, 1, 3) AS rule_id, count(*) AS n FROM ({FOUND}) GROUP BY ALL")
def finding_levels(spark, sf_dir):
    """How many findings each rule makes in a paper: the union of all text rules without what they say."""
    return text_findings(spark, sf_dir).groupBy("paper_id", "level", "check_type", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a09_report_order",
    f"""
WITH f AS (SELECT paper_id, rule_id, {LEVELS} AS level FROM ({FOUND}))
SELECT paper_id, path, CAST({RANK} AS INTEGER) AS rank, CAST(substring(rule_id, 2, 2) AS INTEGER) AS seq, row_number() OVER (PARTITION BY paper_id ORDER BY {RANK}, rule_id) AS place FROM f JOIN ({PAPERS}) USING (paper_id)""",
)
def report_order(spark, sf_dir):
    """The report's lines by their places within their papers, without their wording."""
    lines = audits.report(text_findings(spark, sf_dir), papers(spark, sf_dir), "en")
    return lines.select("paper_id", "path", "rank", "seq", F.row_number().over(Window.partitionBy("paper_id").orderBy("rank", "seq")).cast("bigint").alias("place"))


@query(
    "a10_summary",
    f"""
WITH f AS (SELECT paper_id, {LEVELS} AS level FROM ({FOUND})),
s AS (SELECT p.paper_id, count(*) FILTER (WHERE level = 'Error') AS errors, count(*) FILTER (WHERE level = 'Warning') AS warnings, coalesce(bool_or(level = 'Unchecked'), false) AS has_unchecked FROM ({PAPERS}) p LEFT JOIN f USING (paper_id) GROUP BY p.paper_id)
SELECT *, false AS failed, errors + warnings > 0 AS has_issues, errors + warnings = 0 AND NOT has_unchecked AS all_clear FROM s""",
)
def summaries(spark, sf_dir):
    return audits.summary(text_findings(spark, sf_dir), papers(spark, sf_dir))


@query("a09_report")
def reports(spark, sf_dir):
    return audits.report(text_findings(spark, sf_dir), papers(spark, sf_dir), "en")


@query("k01_full_audit")
def full_audit(spark, sf_dir):
    """Every rule over papers with texts, layout, bibliography, words, links, fonts and images; liveness against canned answers."""
    found = audits.audit(tables(spark, sf_dir), audits.Options(max_pages=9, transport=canned, lang="en"))
    return found.select("paper_id", "level", "rule_id", "n", "message_en")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_text_findings(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
