"""Patterns and word lists of the audit rules.

Fixed values: results must agree with the rules as published, so these are stated as they are, in Java syntax with
Unicode classes where the rule asks for them.
"""

from __future__ import annotations

UNRESOLVED = r"(?Ui)\[\?\]|\?\?|\b(?:Figure|Fig\.|Table|Equation|Eq\.|Section|Chapter)\s+\?"
DRAFT = r"(?Ui)\b(TODO|FIXME|XXX|TBD)\b"
REPEATED = r"(?Ui)\b([A-Za-z]{2,})\s+\1\b"
STUTTER = r"(?U),,|;;|(?<![.\d])\.{2}(?![.\d])"
ISOLATED = r"(?U)(?<!\S)[,;](?!\S)"
SMALL_FLOAT = r"(?U)\b(?:figure|fig\.?|table)\s*\d+\b"
FIGURE = r"(?U)\b(?:Figure|Fig\.?)\s*(\d+)\b"
TABLE = r"(?U)\bTable\s*(\d+)\b"
HYPHENATED = "(?U)(?<=[A-Za-z])[-­][ \t]*\n\\s*(?=[a-z])"

AFFILIATION = r"(?Ui)\b(University|College|Institute|Institute of|Laboratory|Academy|Corporation|Company|School of|Department of)\b"
EMAIL = r"(?Ui)[\w.!#$%&'*+/=?^`{|}~-]+@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,}\b"
LOCAL_PATH = r"(?U)([A-Za-z]:\\Users\\[^\\\s]+|/Users/[^/\s]+|/home/[^/\s]+)"
ACKNOWLEDGMENT = r"(?Ui)\b(Acknowledgments?|Acknowledgements?)\b"
TEXT_URL = r"""(?U)(https?://[^\s\]>}"'<>]+|doi\.org/[^\s\]>}"'<>]+)"""

ANONYMOUS_AUTHORS = ("anonymous", "anonymous author", "anonymous authors", "anonymous submission", "匿名作者")
REVEALING_HOSTS = ("github.com", "drive.google.com", "dropbox.com", "huggingface.co", "github.io", "gitlab.com", "bitbucket.org")
BASE_FONTS = (
    "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic",
    "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique",
    "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique",
    "Symbol", "ZapfDingbats",
)
SUBSET_PREFIX = r"^[A-Z]{6}\+"
FRAGMENT_BOILERPLATE = ("in proceedings of", "proceedings of the", "advances in neural information processing systems", "in computer vision", "in european conference", "arxiv preprint")

MAX_NUMBER_DIGITS, GAP_PREVIEW, PREVIEW, CONTEXT = 9, 20, 5, 20
MAX_MB, MIN_DPI, DEFAULT_MARGIN = 10.0, 150, 36.0
BODY_CHARS, BODY_WIDTH, BODY_LINES = 20, 80.0, 10
EDGE, OVERFLOW, CLUSTER_SHARE = 3.0, 3.0, 0.03
SIMILAR, TITLE_CHARS, FRAGMENT_CHARS, SEED_WORDS = 0.8, 10, 80, 10
REDIRECTS, ATTEMPTS = 5, 2
