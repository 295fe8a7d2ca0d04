"""Papers made of the driver's tables.

The raw documents hold next to none of what the rules look for, and a query without rows proves nothing. So every
document becomes a paper of two pages: its text with one planted sentence, and another planted sentence alone, chosen by
the id. The SELECTs are plain SQL that Spark and DuckDB read alike; the stored tables aren't touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLANTED = (
    "See [?] and Figure ? or ?? here.",
    "TODO: fix this. FIXME later, it is tbd.",
    "See Figure 1 and Figure 4 and Fig. 40; Table 2, Table 5 and Table 12345678901.",
    "An open (bracket [here and } there, then (another.",
    "odd ,, punctuation ;; two.. dots , alone ... fine",
    "see figure 3 and table 2 or fig. 7 below",
    "",
    "Example University, Department of Things. Mail a.b@cs.example.edu or x@y.org now",
    "We put the Acknowledgments here.",
    "Code at https://github.com/a/b, http://x.org/~me/p.html and doi.org/10.1/x.",
    "the the end end",
    "plain words",
)


def _planted(choice: str) -> str:
    """Braces are doubled, as in everything that sql() and frame() fill in."""
    return f"CASE {choice} " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(PLANTED)).replace("{", "{{").replace("}", "}}") + " END"


PAGES = f"""
SELECT doc_id AS paper_id, 1 AS page_num, coalesce(text, '') || chr(10) || {_planted("doc_id % 12")} AS raw_text FROM {{documents}}
UNION ALL SELECT doc_id, 2, {_planted("(doc_id + 5) % 12")} FROM {{documents}}"""
PAPERS = """
SELECT doc_id AS paper_id, concat('/papers/', source, '/', CAST(doc_id AS VARCHAR(20)), '.pdf') AS path, n_chars * 4096 AS file_bytes, CAST(1 + doc_id % 14 AS INT) AS page_count,
       CASE doc_id % 5 WHEN 0 THEN 'Alice Example' WHEN 1 THEN '  Anonymous   Authors ' WHEN 2 THEN '' ELSE NULL END AS author,
       CASE doc_id % 4 WHEN 0 THEN 'Microsoft Word' WHEN 1 THEN '/home/alice/paper/main.tex' ELSE 'LaTeX' END AS creator,
       CASE doc_id % 3 WHEN 0 THEN '/Users/bob/tex' ELSE 'pdfTeX' END AS producer, CAST(NULL AS VARCHAR(20)) AS read_error FROM {documents}"""
LINKS = """
SELECT page_id AS paper_id, 1 AS page_num, CAST(page_id AS INT) AS link_no,
       CASE page_id % 4 WHEN 0 THEN concat('https://github.com/u', CAST(page_id AS VARCHAR(20))) WHEN 1 THEN concat('doi.org/10.1/', CAST(page_id AS VARCHAR(20))) WHEN 2 THEN url ELSE 'mailto:a@b.org' END AS uri FROM {pages}"""
FONTS = """
SELECT o_orderkey AS paper_id, 1 AS page_num, CAST(o_custkey AS INT) AS xref,
       CASE o_orderkey % 4 WHEN 0 THEN 'ABCDEF+Times-Roman' WHEN 1 THEN 'ABCDEF+Arial' WHEN 2 THEN 'Symbol' ELSE 'CMR10' END AS font_name, o_orderkey % 3 = 0 AS embedded FROM {orders}"""
IMAGES = """
SELECT l_orderkey AS paper_id, CAST(l_linenumber AS INT) AS page_num, CAST(l_linenumber AS INT) AS img_no,
       CAST(l_partkey % 50 - 5 AS DOUBLE) AS wide, CAST(l_suppkey % 40 AS DOUBLE) AS high, CAST(l_quantity AS INT) AS width_px, CAST(l_quantity * 2 AS INT) AS height_px FROM {lineitem}"""
EDGES = "SELECT CAST(floor(l_orderkey / 16) AS BIGINT) AS paper_id, CAST(l_partkey % 97 AS DOUBLE) AS x0, CAST(l_partkey % 97 + 100 + l_suppkey % 31 AS DOUBLE) AS x1 FROM {lineitem}"

#: A laid-out paper beside its text: a last page with a bibliography of six entries, whose titles repeat in every third paper
#: and are cut off in every fifth, and line numbers of a review copy in every second.
REFERENCES = """
SELECT doc_id AS paper_id, 900 AS page_num, CAST(k AS INT) AS block_no, 0 AS block_type, 0 AS line_no,
       named_struct('x0', IF(k > 100, 20.0D, 72.0D), 'y0', 60.0D + 14 * (k % 100), 'x1', IF(k > 100, 32.0D, 72.0D + least(440, 5 * length(text))), 'y1', 70.0D + 14 * (k % 100)) AS bbox,
       text, IF(k > 100, 5.0D, 10.0D) AS font_size, 68.0D + 14 * (k % 100) AS baseline
FROM (SELECT doc_id, posexplode(array('References', '[1] Field, A. A first study of large things. In Venue, 2019.', '[2] Stone, B. Another tale of many small works. 2020.',
             CASE WHEN doc_id % 3 = 0 THEN '[3] Field, A. A first study of large things. Journal, 2021.' ELSE '[3] Rivers, C. Water in its own words. 2021.' END,
             CASE WHEN doc_id % 5 = 0 THEN '[4]' ELSE '[4] Hill, D. High ground and what is beyond it. 2018.' END, '[5] Meadow, E. Green fields seen from afar. 2017.', '[6] Wood, F. Trees of every kind. 2016.')) AS (k, text) FROM {documents}
      UNION ALL SELECT doc_id, 100 + n, CAST(17 + n AS STRING) FROM {documents} LATERAL VIEW explode(sequence(1, 6)) s AS n WHERE doc_id % 2 = 0)"""
WORDS = """
SELECT doc_id AS paper_id, 2 AS page_num, CAST(n AS INT) AS word_no, 72.0D AS x0, 60.0D + 12 * n AS y0, 200.0D AS x1, 70.0D + 12 * n AS y1, word AS text
FROM (SELECT doc_id, posexplode(array('see', 'https://x.org/long/', concat('path', CAST(doc_id % 10 AS STRING), '.'), 'and', concat('https://github.com/a', CAST(doc_id DIV 2 % 4 AS STRING)))) AS (n, word) FROM {documents} WHERE doc_id % 2 = 0)"""
PAPER_LINKS = """
SELECT doc_id AS paper_id, 2 AS page_num, 0 AS link_no, concat('https://x.org/long/path', CAST(doc_id % 10 AS STRING)) AS uri, named_struct('x0', 70.0D, 'y0', 70.0D, 'x1', 205.0D, 'y1', 96.0D) AS rect FROM {documents} WHERE doc_id % 2 = 0"""
PAPER_FONTS = """
SELECT doc_id AS paper_id, 1 AS page_num, CAST(k AS INT) AS xref, CASE k WHEN 0 THEN 'ABCDEF+Times-Roman' WHEN 1 THEN 'Arial' ELSE 'CMR10' END AS font_name, k = 2 OR doc_id % (k + 2) > 0 AS embedded
FROM {documents} LATERAL VIEW explode(array(0, 1, 2)) s AS k"""
PAPER_IMAGES = """
SELECT doc_id AS paper_id, 1 AS page_num, 0 AS img_no, named_struct('x0', IF(doc_id % 4 = 0, 2.0D, 100.0D), 'y0', 300.0D, 'x1', 172.0D, 'y1', 372.0D) AS bbox, CAST(100 + 50 * (doc_id % 3) AS INT) AS width_px, 300 AS height_px FROM {documents} WHERE doc_id % 7 < 3"""

TABLES = ("documents", "pages", "orders", "lineitem")


def sql(text: str) -> str:
    """The SELECT over the views of that name."""
    return text.format(**{t: t for t in TABLES})


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text line of a document as a laid-out line: 12 pt apart, 40 to a page, about 4 pt a character, every seventh inset."""
    return spark.sql(
        """
        SELECT doc_id AS paper_id, CAST(1 + n DIV 40 AS INT) AS page_num, CAST(n AS INT) AS block_no, 0 AS block_type, 0 AS line_no,
               named_struct('x0', 72.0D + IF(n % 7 = 0, 10, 0), 'y0', 72.0D + 12 * (n % 40), 'x1', 72.0D + least(length(line), 100 + doc_id % 20) * 4.0D, 'y1', 82.0D + 12 * (n % 40)) AS bbox,
               line AS text, 10.0D AS font_size, 80.0D + 12 * (n % 40) AS baseline
        FROM (SELECT doc_id, posexplode(split(coalesce(text, ''), '\n')) AS (n, line) FROM {documents})""",
        documents=spark.read.parquet(f"{sf_dir}/documents.parquet"),
    )


LAYOUT = """
SELECT doc_id AS paper_id, CAST(1 + n // 40 AS INTEGER) AS page_num, n, 72.0 + CASE WHEN n % 7 = 0 THEN 10 ELSE 0 END AS x0, 72.0 + least(length(line), 100 + doc_id % 20) * 4.0 AS x1, line
FROM (SELECT doc_id, i - 1 AS n, s[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents), unnest(range(1, len(s) + 1)) AS u(i))"""
