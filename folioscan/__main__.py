"""python -m folioscan PATH...: audit PDF files and print the reports."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.audit import Options, audit, exit_code, report, summary
from .sources import papers, pdf


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="folioscan")
    p.add_argument("paths", nargs="+")
    p.add_argument("--num_workers", type=int)
    p.add_argument("--disable_link_check", action="store_true")
    p.add_argument("--max_pages", type=int)
    p.add_argument("--min_dpi", type=float, default=Options.min_dpi)
    p.add_argument("--margin_pt", type=float)
    p.add_argument("--lang", choices=("zh", "en"), default="zh")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("folioscan").getOrCreate()
    files, errors = papers.discover(spark, a.paths)
    for e in errors:
        print(e, file=sys.stderr)
    if files.isEmpty():
        return 2
    tables = pdf.read_pdf(spark, [p for p in a.paths if not any(e.startswith(f"{p}: ") for e in errors)])
    found = audit(tables, Options(a.max_pages, a.min_dpi, a.margin_pt, a.disable_link_check, a.lang, a.num_workers)).cache()
    for row in report(found, tables.papers, a.lang).toLocalIterator():
        print(f"{row.path}: {row.line}")
    return exit_code(summary(found, tables.papers), errors)


if __name__ == "__main__":
    sys.exit(main())
