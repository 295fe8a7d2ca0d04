"""The planted paper of seven pages, boundary cases, and brute force for what SQL can't tell."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioscan.functions import patterns as P
from folioscan.functions.text import contexts
from folioscan.operators import bibliography, content, identity, layout, liveness, pageformat, urls
from folioscan.plans.audit import Options, audit, exit_code, report, summary
from folioscan.sources.papers import SCHEMAS, Tables, discover, from_texts, load, save


def pages_of(spark, *texts, paper=1):
    rows = [(paper, k + 1, t) for k, t in enumerate(texts)]
    return content.content_pages(spark.createDataFrame(rows, "paper_id bigint, page_num int, raw_text string"))


def python(pattern):
    flags = re.I if pattern.startswith(("(?Ui)",)) else 0
    return re.compile(re.sub(r"^\(\?Ui?\)", "", pattern), flags)


def test_patterns_and_contexts_equal_python(spark):
    rng = random.Random(1)
    pool = ["the", "The", " ", "\n", "  ", ",,", "..", "...", ".", ",", ";", "é", "TODO", "xxx", "Figure", "fig.", " 3", "12", "??", "[?]", "table ", "漢", "a"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(300)]
    for p in (P.UNRESOLVED, P.DRAFT, P.REPEATED, P.STUTTER, P.ISOLATED, P.SMALL_FLOAT, P.FIGURE, P.TABLE):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", contexts(F.col("t"), p).alias("x"))
        for i, got in df.collect():
            t = texts[i]
            want = [" ".join(t[max(0, m.start() - 20) : m.end() + 20].split()) for m in python(p).finditer(t)][:5]
            assert got == want, (p, t)


def rules(findings):
    return {(r.rule_id, r.level): r for r in findings.collect()}


def test_content_rules_on_planted_pages(spark):
    pages = pages_of(
        spark,
        "Alice Example, Example University, a.b@cs.example.edu",
        "See [?], Figure ? here. TODO FIXME TBD The the open ( bracket ,, and , alone",
        "Figure 1 Figure 3 Figure 1000000 Table 1 Table 3 Table 12345678901234567890 figure 2",
        "Acknowledgments",
        "  \n ",
    )
    got = rules(content.content_findings(pages))
    assert set(got) == {("R09", "Unchecked"), ("R10", "Unchecked"), ("R11", "Error"), ("R12", "Error"), ("R13", "Warning"), ("R14", "Warning"), ("R15", "Warning"), ("R16", "Warning"), ("R17", "Warning")}
    assert got["R12", "Error"].n == 3 and got["R13", "Warning"].n == 1 and got["R14", "Warning"].n == 2
    assert got["R09", "Unchecked"].pages == [3] and got["R10", "Unchecked"].pages == [5] and got["R11", "Error"].pages == [2]
    gaps = {r.label: (r.missing, r.preview) for r in content.number_gaps(content.float_numbers(pages)).collect()}
    assert gaps == {"Figure": (999_997, [2, *range(4, 23)]), "Table": (1, [2])}
    assert rules(identity.acknowledgment_findings(pages))["R22", "Warning"].pages == [4]
    assert identity.first_page_hits(pages).first().hits == ["University", "a.b@cs.example.edu"]


def test_quiet_cases(spark):
    for text in (")(", "only Figure 5", "fine text... 1..2 f : X", "that than"):
        assert content.content_findings(pages_of(spark, text)).collect() == []


def test_brackets_equal_a_stack(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("()[]{} ab", k=40)) for _ in range(60)]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "paper_id bigint, page_num int, raw_text string")
    got = {(r.paper_id, r.kind): r["diff"] for r in content.bracket_balance(content.content_pages(df)).collect()}
    want = {(i, k): d for i, t in enumerate(texts) for k in ("()", "[]", "{}") if (d := t.count(k[0]) - t.count(k[1]))}
    assert got == want
    own = pages_of(spark, "a (b", "c) d)")
    assert content.bracket_places(own, content.bracket_balance(own)).first().examples == ["page 2 \"a (b c) d)\": ')' has no matching opener"]


def test_hyphens_and_review_numbers_leave_the_text(spark):
    pages = spark.createDataFrame([(1, 1, "raw"), (1, 2, None)], "paper_id bigint, page_num int, raw_text string")
    lines = spark.createDataFrame([(1, 1, 0, 0, "The Ta-"), (1, 1, 0, 1, "ble"), (1, 1, 1, 0, "017")], "paper_id bigint, page_num int, block_no int, line_no int, text string")
    got = content.content_pages(pages, lines, lines.filter("text = '017'"))
    assert {r.page_num: r.content_text for r in got.collect()} == {1: "The Table", 2: ""}


def test_metadata_rules(spark):
    rows = [(1, "Alice", "Microsoft Word", "C:\\Users\\bob\\x"), (2, " Anonymous   Authors ", None, "/home/al/t"), (3, "匿名作者", "Wordsmith", None), (4, None, "LaTeX", "pdfTeX"), (5, "Anonymous, Bob", "", "")]
    df = spark.createDataFrame(rows, "paper_id bigint, author string, creator string, producer string")
    assert {r.paper_id for r in identity.author_findings(df).collect()} == {1, 5}
    assert {r.paper_id for r in identity.creator_findings(df).collect()} == {1, 3}
    assert {(r.paper_id, r.examples[0]) for r in identity.path_findings(df).collect()} == {(1, "Producer C:\\Users\\bob"), (2, "Producer /home/al")}


def test_urls_are_trimmed(spark):
    want = {"http://a.b/(x)y).": "http://a.b/(x)y", "http://a.b/c.,;:": "http://a.b/c", "doi.org/10.1/(2)3": "https://doi.org/10.1/(2)3", "http://a)b": "http://a", "http://a(b)(c(d)).e)f": "http://a(b)(c(d)).e", "http://é/漢).": "http://é/漢"}
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.x for r in df.select("u", urls.complete(F.col("u")).alias("x")).collect()} == want


def test_wrapped_links_drop_only_their_own_prefix(spark):
    box = {"x0": 0.0, "y0": 0.0, "x1": 100.0, "y1": 30.0}
    links = spark.createDataFrame([(1, 1, 0, "http://a.org/long/path", box)], SCHEMAS["links"])
    words = [(1, 1, 0, 0.0, 0.0, 50.0, 10.0, "http://a.org/long"), (1, 1, 1, 110.0, 5.0, 120.0, 12.0, "017"), (1, 1, 2, 0.0, 12.0, 50.0, 22.0, "/path."), (1, 1, 3, 300.0, 300.0, 350.0, 310.0, "http://a.org/long")]
    pages = spark.createDataFrame([(1, 2, "see http://b.org/x.")], "paper_id bigint, page_num int, raw_text string")
    got = {r.url for r in urls.all_urls(pages, links, spark.createDataFrame(words, SCHEMAS["words"])).collect()}
    assert got == {"http://a.org/long/path", "http://a.org/long", "http://b.org/x"}
    got = {r.url for r in urls.all_urls(pages, links, spark.createDataFrame(words[:3], SCHEMAS["words"])).collect()}
    assert got == {"http://a.org/long/path", "http://b.org/x"}


def test_format_rules(spark):
    papers = spark.createDataFrame([(1, 10 * 1024 * 1024, 9), (2, 10 * 1024 * 1024 + 1, 10)], "paper_id bigint, file_bytes bigint, page_count int")
    assert {(r.paper_id, r.rule_id, r.level) for r in pageformat.size_findings(papers).collect()} == {(1, "R01", "Pass"), (2, "R01", "Warning")}
    assert {(r.paper_id, r.level) for r in pageformat.length_findings(papers, 9).collect()} == {(1, "Pass"), (2, "Error")}
    assert pageformat.length_findings(papers, None).collect() == []
    fonts = spark.createDataFrame([(1, 1, 5, "ABCDEF+Symbol", False), (1, 2, 5, "ABCDEF+Symbol", False), (1, 1, 6, "Odd", None), (1, 1, 7, "Good", True)], SCHEMAS["fonts"])
    assert {(r.paper_id, r.rule_id, tuple(r.examples)) for r in pageformat.font_findings(papers, fonts).collect()} == {(1, "R04", ("Odd",)), (1, "R05", ("Symbol",)), (2, "R06", ())}
    box = lambda w, h: {"x0": 0.0, "y0": 0.0, "x1": w, "y1": h}
    images = spark.createDataFrame([(1, 1, 0, box(72.0, 72.0), 149, 300), (1, 1, 1, box(72.0, 72.0), 150, 150), (1, 1, 2, box(72.0, 72.0), 0, 90), (1, 1, 3, box(0.0, 72.0), 9, 9), (1, 1, 4, None, 9, 9)], SCHEMAS["images"])
    assert [(r.img_no, r.dpi) for r in pageformat.low_resolution(images).collect()] == [(0, 149.0)]
    pages = spark.createDataFrame([(1, 1, None, 0, 0), (1, 2, " ", 0, 3), (1, 3, "", 1, 0), (1, 4, "x", 0, 0)], "paper_id bigint, page_num int, raw_text string, n_images int, n_drawings int")
    assert pageformat.blank_pages(pages).first().p == [1]


TEXT = "a line of body text that is long enough to count"


def column(n, x0=72.0, x1=540.0, page=1, start=0, numbers=None, size=10.0, step=12.0):
    rows = []
    for k in range(n):
        y = 60.0 + step * (start + k)
        rows.append((1, page, start + k, 0, 0, {"x0": x0, "y0": y, "x1": x1, "y1": y + 10}, TEXT, 10.0, y + 8))
        if numbers is not None:
            rows.append((1, page, 1000 + start + k, 0, 0, {"x0": 40.0, "y0": y, "x1": 50.0, "y1": y + 10}, str(numbers + k), size, y + 8))
    return rows


def laid_out(spark, rows, pages=1):
    rects = [(1, p, 0.0, 0.0, 612.0, 792.0, "x", 0, 0) for p in range(1, pages + 1)]
    return spark.createDataFrame(rows, SCHEMAS["lines"]), spark.createDataFrame(rects, SCHEMAS["pages"])


def test_review_numbers(spark):
    marks = lambda rows: {r.text for r in layout.marked_lines(*laid_out(spark, rows)).filter("is_review").collect()}
    assert marks(column(5, numbers=11, size=6.0)) == {"11", "12", "13", "14", "15"}
    assert marks(column(5, numbers=11, size=10.0)) == set()
    assert len(marks(column(40, numbers=1, size=10.0))) == 40
    assert marks(column(2, numbers=11, size=6.0)) == set()


def test_bands_and_overflow(spark):
    edges = [(72.0, 290.0)] * 10 + [(320.0, 540.0)] * 10 + [(80.0, 290.0)] * 2
    assert layout.bands_of(edges) == [(72.0, 290.0), (320.0, 540.0)]
    assert [len(g) for g in layout.anchored([0, 2, 3, 4, 7], lambda x: x, 3)] == [3, 2]
    images = spark.createDataFrame([], SCHEMAS["images"])

    def over(rows):
        lines, pages = laid_out(spark, rows)
        got = layout.overflow_pages(pages, layout.marked_lines(lines, pages), images).first()
        return got.pages if got else None

    two = column(12, 72.0, 290.0) + column(12, 320.0, 540.0, start=20)
    wide = lambda a, b: [(1, 1, 900, 0, 0, {"x0": a, "y0": 700.0, "x1": b, "y1": 710.0}, "a title", 12.0, 708.0)]
    assert over(two) is None
    assert over(two + wide(150.0, 462.0)) is None
    assert over(two + wide(72.0, 560.0)) == [1]
    assert over(two + wide(100.0, 330.0)) == [1]
    assert over(column(9, 20.0, 500.0)) == [1]


def test_repeated_and_similar_references(spark):
    texts = ["[1] Field, A. A study of large things. In Venue, 2020.", "[2] Field, A. A study of large things. Journal, 2021.", "[3] Stone, B. Another tale entirely here. 2019.", "[4] Q"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "paper_id bigint, no int, text string")
    assert [(r.i, r.j) for r in bibliography.title_pairs(df, bibliography.entry_title("text")).collect()] == [(0, 1)]
    assert [(r.i, r.j) for r in bibliography.similar_pairs(df).collect()] == [(0, 1)]
    assert bibliography.title("[1] Field, A. Shortname. 2020.") is None
    seed = "smith and jones a very long title about deep things in the year 2020 proceedings of something large"
    assert bibliography.fragments(f"{seed} middle words {seed}") == [seed]


def references(n, style):
    out = []
    for k in range(n):
        a, t = f"Field{'abcdefgh'[k]}, A. and Stone, B.", f"The {k}th title of many works"
        out += {"label": [f"[{k + 1}] A. Field and B. Stone.", f"{t}. In Venue, 2020."], "year": [f"{a} {t}.", "Journal of Venue, 2020."], "header": [f"{a} (2020).", f"{t}. Venue."]}[style]
    return out


@pytest.mark.parametrize("style", ["label", "year", "header"])
def test_bibliographies_of_three_styles(spark, style):
    rows = [(1, 1, 0, 0, 0, {"x0": 72.0, "y0": 60.0, "x1": 200.0, "y1": 72.0}, "References", 12.0, 70.0)]
    for k, text in enumerate(references(6, style)):
        x, y = 72.0 + 10 * (k % 2), 80.0 + 12 * k
        rows.append((1, 1, k + 1, 0, 0, {"x0": x, "y0": y, "x1": x + 300, "y1": y + 10}, text, 10.0, y + 8))
    rows.append((1, 1, 99, 0, 0, {"x0": 72.0, "y0": 500.0, "x1": 200.0, "y1": 510.0}, "Appendix A", 12.0, 508.0))
    rows.append((1, 1, 100, 0, 0, {"x0": 72.0, "y0": 520.0, "x1": 400.0, "y1": 530.0}, "Not a reference at all, just text", 10.0, 528.0))
    parts = bibliography.bibliographies(*laid_out(spark, rows)).collect()
    assert sum(r.kind == "entry" for r in parts) == 6 and not any(r.kind == "unresolved" for r in parts)


def test_public_addresses_and_verification():
    assert [liveness.is_public(a) for a in ("8.8.8.8", "10.0.0.1", "192.0.0.5", "127.0.0.1", "2606:4700::1", "2002::1", "2001::1", "fe80::1")] == [True, False, False, False, True, False, False, False]
    public = lambda host, port: ["8.8.8.8"]
    assert liveness.admitted("https://a.org/x", public) == ("a.org", 443, "8.8.8.8")
    for bad in ("ftp://a.org", "http://u:p@a.org", "http://a.org:8080", "http://localhost", "http://x.local", "http://a b.org", "http://nodots", "http://10.0.0.1/", "http:///x"):
        with pytest.raises(liveness.Refused):
            liveness.admitted(bad, public)
    chain = lambda n: lambda u: (302, f"/{int(u.rsplit('/', 1)[1]) + 1}") if int(u.rsplit("/", 1)[1]) < n else (200, None)
    assert liveness.verify("http://a.org/0", chain(5))[0] == "ok"
    assert liveness.verify("http://a.org/0", chain(6))[0] == "unknown"
    assert liveness.verify("http://a.org/0", lambda u: (301, u)) == ("unknown", "redirect loop")
    assert liveness.verify("http://a.org/0", lambda u: (410, None)) == ("dead", "HTTP 410")
    calls = []

    def broken(u):
        calls.append(u)
        raise OSError

    assert liveness.verify("http://a.org", broken)[0] == "unknown" and len(calls) == 2


def test_each_address_is_requested_once_and_failures_stay_with_their_papers(spark, tmp_path):
    log = tmp_path / "requests"

    def get(url):
        with log.open("a") as f:
            f.write(url + "\n")
        if "bad" in url:
            raise KeyError(url)
        return (404 if "gone" in url else 200), None

    rows = [(k % 4, f"http://{('ok', 'gone', 'fine')[k % 3]}.org/{k % 12}") for k in range(60)] + [(9, "http://bad.org/1"), (3, "http://ok.org/0")]
    df = spark.createDataFrame(rows, "paper_id long, url string").distinct()
    found = liveness.liveness_findings(df, liveness.probe(df, get))
    got = {(r.paper_id, r.rule_id) for r in found.collect()}
    assert found.count() == len(got) and (9, "R34") in got and {r for p, r in got if p != 9} <= {"R25", "R27"}
    assert sorted(log.read_text().split()) == sorted({u for _, u in rows})


def test_one_paper_that_breaks_its_parser_leaves_the_others(spark):
    rows = [(1, 1, 0, 0, 0, {"x0": 72.0, "y0": 60.0, "x1": 200.0, "y1": 72.0}, "References", 12.0, 70.0), (1, 1, 1, 0, 0, {"x0": 72.0, "y0": 80.0, "x1": 300.0, "y1": 90.0}, "[1] A. Field. A long title of works. 2020.", 10.0, 88.0)]
    lines, pages = laid_out(spark, rows)
    lines = lines.union(lines.withColumn("paper_id", F.lit(2).cast("bigint")).withColumn("text", F.lit(None).cast("string")))
    pages = pages.union(pages.withColumn("paper_id", F.lit(2).cast("bigint")))
    papers = spark.createDataFrame([(1,), (2,), (3,)], "paper_id bigint")
    got = {(r.paper_id, r.rule_id) for r in bibliography.bibliography_findings(papers, bibliography.bibliographies(lines, pages)).collect()}
    assert got == {(1, "R33"), (2, "R34"), (3, "R28")}


def test_full_audit_report_and_exit_code(spark, tmp_path):
    papers = spark.createDataFrame([(1, "/b.pdf", 100, 1, "Alice", None, None, None), (2, "/a.pdf", 100, 1, None, None, None, None), (3, "/c.pdf", 5, None, None, None, None, "broken")], SCHEMAS["papers"])
    lines, pages = laid_out(spark, column(12))
    texts = pages.withColumn("raw_text", F.lit("TODO see https://github.com/x"))
    empty = from_texts(papers, texts)
    t = Tables(papers, texts.union(texts.withColumn("paper_id", F.lit(2).cast("bigint")).withColumn("raw_text", F.lit("fine"))), lines, empty.words, empty.links, empty.fonts, empty.images)
    save(t, str(tmp_path))
    t = load(spark, str(tmp_path))
    found = audit(t, Options(transport=lambda u: (404, None))).cache()
    by = {}
    for r in found.collect():
        by.setdefault(r.paper_id, set()).add((r.rule_id, r.level))
    assert by[3] == {("R34", "Error")}
    assert {("R18", "Error"), ("R23", "Warning"), ("R25", "Error"), ("R28", "Unchecked")} <= by[1]
    assert by[2] == {("R01", "Pass"), ("R06", "Pass"), ("R28", "Unchecked")}
    s = summary(found, t.papers)
    state = {r.paper_id: r for r in s.collect()}
    assert state[3].failed and not state[2].has_issues and state[2].has_unchecked and not state[2].all_clear
    assert exit_code(s, []) == 1 and exit_code(s, ["x"]) == 2 and exit_code(s.filter("paper_id < 3"), []) == 0
    out = report(found, t.papers, "en").collect()
    assert [r.path for r in out] == sorted(r.path for r in out)
    assert out[0].line.startswith("✓")


def test_discovery(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("a.pdf", "d/b.PDF", "d/c.txt"):
        (tmp_path / n).write_bytes(b"123")
    files, errors = discover(spark, [str(tmp_path), str(tmp_path / "a.pdf"), str(tmp_path / "none")])
    rows = files.collect()
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["a.pdf", "b.PDF"] and rows[0].file_bytes == 3
    assert len(errors) == 1


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from folioscan.sources.store import shared_dir

    def session(**conf):
        own = dict(conf)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: own.get(k.rpartition("spark.")[2], default), set=lambda k, v: own.update({k.rpartition("spark.")[2]: v})))

    assert shared_dir(session(**{"checkpoint.dir": "s3a://b/x/", "master": "yarn"})) == "s3a://b/x"
    assert shared_dir(session(master="local[4]")).startswith("/")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master=master))


def test_recorded_pages_become_tables_and_findings(spark, tmp_path):
    from folioscan.sources.pdf import read_pdf

    class RecordedPage:
        """What the PDF library answers for a page, as plain values."""

        rect = (0, 0, 612, 792)

        def get_text(self, kind="text", flags=None):
            line = {"bbox": (72, 60, 300, 70), "spans": [{"text": "TODO see ", "size": 10, "origin": (72, 68)}, {"text": "[?]", "size": 9, "origin": (200, 69)}]}
            return {"text": "TODO see [?]", "words": [(72, 60, 100, 70, "TODO", 0, 0, 0)], "dict": {"blocks": [{"type": 0, "lines": [line]}, {"type": 1}]}}[kind]

        def get_image_info(self):
            return [{"bbox": (0, 0, 72, 72), "width": 100, "height": 90}]

        def get_drawings(self):
            return []

        def get_fonts(self):
            return [(5, "", "", "ABCDEF+Odd"), (6, "", "", "Good")]

        def get_links(self):
            return [{"uri": "https://github.com/a", "from": (1, 2, 3, 4)}, {"kind": 1}]

    class RecordedDocument(list):
        metadata, page_count = {"author": "Alice", "creator": None}, 1

        def xref_length(self):
            return 10

        def xref_get_key(self, xref, key):
            return ("xref", "7 0 R") if (xref, key) == (6, "FontDescriptor") else ("xref", "8 0 R") if (xref, key) == (7, "FontFile2") else ("null", "null")

        def xref_is_stream(self, xref):
            return xref == 8

        def xref_stream(self, xref):
            return b"font"

    def opened(content):
        if content == b"bad":
            raise ValueError("not a PDF")
        return RecordedDocument([RecordedPage()])

    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.PDF").write_bytes(b"bad")
    save(read_pdf(spark, [str(tmp_path), str(tmp_path / "a.pdf")], opened), str(tmp_path / "tables"))
    t = load(spark, str(tmp_path / "tables"))
    assert {(r.path.rsplit("/", 1)[1], r.read_error) for r in t.papers.collect()} == {("a.pdf", None), ("b.PDF", "ValueError: not a PDF")}
    line = t.lines.first()
    assert (line.text, line.font_size, line.baseline, line.block_no) == ("TODO see [?]", 10.0, 68.5, 0)
    assert {r.font_name: r.embedded for r in t.fonts.collect()} == {"ABCDEF+Odd": False, "Good": True}
    assert [r.uri for r in t.links.sort("link_no").collect()] == ["https://github.com/a", None] and t.words.first().text == "TODO"
    found = {(r.rule_id, r.level) for r in audit(t, Options(disable_link_check=True)).collect()}
    assert {("R04", "Error"), ("R07", "Warning"), ("R11", "Error"), ("R12", "Error"), ("R18", "Error"), ("R23", "Warning"), ("R34", "Error")} <= found
