"""Column -> Column functions: measuring, cleaning and normalising text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of extraction artefacts. They read alike in Java and RE2.
SCATTERED = r"\b[a-zA-Z]\s{2,}[a-zA-Z]\s{2,}[a-zA-Z]\b"
REPEATED_PUNCTUATION = r"[.]{3,}|[_]{3,}"
DASHES = r"[-]{3,}"
ISOLATED_PUNCTUATION = r"\s[.,;:!?]\s"
MALFORMED_WORD = r"\b[a-zA-Z]+[0-9]+[a-zA-Z]+[a-zA-Z0-9]*\b"
EXCESSIVE_SPACE = r"\s{3,}"
OCR_ARTEFACT = "|".join([SCATTERED, REPEATED_PUNCTUATION, ISOLATED_PUNCTUATION, MALFORMED_WORD, EXCESSIVE_SPACE])
JS_FUNCTION = r"(?i)function\s+\w+\s*\([^)]*\)\s*\{[^}]*\}"
CSS_RULE = r"(?i)\.[a-zA-Z][\w-]*\s*\{[^}]*\}"
SCRIPT_TAG = r"(?is)<script[^>]*>.*?</script>"
STYLE_TAG = r"(?is)<style[^>]*>.*?</style>"
NAVIGATION = r"(?i)\b(?:Skip to main content|Back to top|Main navigation|Site navigation)\b"
BREADCRUMB = r"(?:Home\s*[>»]\s*|[>»]\s*){2,}"
PAGINATION = r"(?i)\b(?:Page \d+ of \d+|First page|Last page|Previous page|Next page|^\d+ of \d+$)\b"
SENTENCE_BREAK = r"[.!?]\s+[A-Z]"
SENTENCE_MARK = r"[.!?]"
BLANKS = r"[ \t\f\x0b\r\x{a0}\x{2000}-\x{200b}\x{2028}\x{2029}\x{3000}]+"
BLANK_LINES = r"\n\s*\n\s*\n+"
CONTROL = r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x{9f}]"
REPLACEMENT = r"\x{fffd}+"
COMBINING = r"[\x{300}-\x{36f}]+"
CYRILLIC_RUN = r"[\x{400}-\x{4ff}]{3,}"
TABLE_RULE = r"^\|[|:\s-]*\|$"
HTML_COMMENT = r"(?s)<!--.*?-->"
HTML_TAG = r"(?s)<[^>]+>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: Catalyst would copy the expression
    to each place that uses it, and evaluate every copy."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_all(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def match_bytes(text: Column, pattern: str) -> Column:
    """Bytes of all matches together."""
    return F.aggregate(matches(text, pattern), F.lit(0).cast("long"), lambda n, m: n + F.octet_length(m))


def words(text: Column) -> Column:
    """Runs between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines without line ends; a closing line end opens no line."""
    body = replace_all(replace_all(text, r"\r\n", "\n"), r"\n$", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def line_count(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def is_blank_page(text: Column) -> Column:
    """Fewer than 3 characters that aren't white space."""
    return F.char_length(replace_all(text, r"\s+", "")) < 3


def text_confidence(text: Column) -> Column:
    """Share of readable characters in the bytes, less penalties for replacement
    and control characters and for long Cyrillic runs, from 0 to 1."""
    n = F.octet_length(text).cast("double")
    readable = F.char_length(replace_all(text, r"[^\x21-\x7e\s]+", ""))
    penalty = (F.regexp_count(text, F.lit(REPLACEMENT)) + F.regexp_count(text, F.lit(CONTROL)) * 2) / n
    cyrillic = F.when(match_bytes(text, CYRILLIC_RUN) > n * 0.1, 0.3).otherwise(0.0)
    return F.when(text == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), readable / n - penalty - cyrillic)))


def fix_mojibake(text: Column) -> Column:
    """Without control and replacement characters and combining marks."""
    return replace_all(replace_all(replace_all(text, CONTROL, ""), REPLACEMENT, ""), COMBINING, "")


def clean_scripts(text: Column) -> Column:
    for pattern in (SCRIPT_TAG, STYLE_TAG, JS_FUNCTION, CSS_RULE):
        text = replace_all(text, pattern, " ")
    return text


def clean_navigation(text: Column) -> Column:
    for pattern in (NAVIGATION, BREADCRUMB, PAGINATION):
        text = replace_all(text, pattern, " ")
    return text


def clean_dashes(text: Column) -> Column:
    """Runs of dashes become dots, but not in the rules of pipe tables."""
    by_line = F.transform(lines(text), lambda x: F.when(F.trim(x).rlike(TABLE_RULE), x).otherwise(replace_all(x, DASHES, "...")))
    return F.when(text.rlike(DASHES), F.array_join(by_line, "\n")).otherwise(text)


def clean_ocr(text: Column) -> Column:
    """OCR artefacts: dashes, repeated and isolated punctuation, malformed words, wide gaps."""
    text = replace_all(clean_dashes(text), REPEATED_PUNCTUATION, "...")
    for pattern in (ISOLATED_PUNCTUATION, MALFORMED_WORD, EXCESSIVE_SPACE):
        text = replace_all(text, pattern, " ")
    return text


def normalize_whitespace(text: Column) -> Column:
    """One space for runs of blanks, one empty line for several."""
    return replace_all(replace_all(text, BLANKS, " "), BLANK_LINES, "\n\n")


def clean_extracted(text: Column) -> Column:
    """Scripts, OCR artefacts, navigation and white space, in this order."""
    return F.trim(normalize_whitespace(clean_navigation(clean_ocr(clean_scripts(text)))))


def clean_repeated_punctuation(text: Column) -> Column:
    """A run of marks becomes its first."""
    return replace_all(text, r"([!?.,])[!?.,]+", "$1")


def clean_same_punctuation(text: Column) -> Column:
    """Runs of one mark, of ! ? and commas only."""
    return replace_all(replace_all(replace_all(text, "!{2,}", "!"), r"\?{2,}", "?"), ",{2,}", ",")


def normalize_spaces(text: Column) -> Column:
    """Paragraphs and lines trimmed, empty ones dropped."""
    paragraph = lambda p: F.array_join(F.filter(F.transform(F.split(replace_all(p, BLANKS, " "), "\n+"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    return F.array_join(F.filter(F.transform(F.split(text, "\n\n"), paragraph), lambda p: p != ""), "\n\n")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def strip_control(text: Column) -> Column:
    """Without C0 controls and DEL, but with tab, line feed and carriage return."""
    return replace_all(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def strip_comments(text: Column) -> Column:
    return replace_all(text, HTML_COMMENT, "")


def strip_html(text: Column) -> Column:
    """Scripts, styles and tags removed, white space single."""
    body = replace_all(replace_all(replace_all(text, SCRIPT_TAG, ""), STYLE_TAG, ""), HTML_TAG, " ")
    return F.trim(replace_all(body, r"\s+", " "))


def is_valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data)


def splits_character(data: Column, offset: Column) -> Column:
    """Whether a byte offset lies inside a UTF-8 character: the byte there is a continuation."""
    byte = F.conv(F.hex(F.substring(F.encode(data, "utf-8"), offset + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(0xC0) == 0x80, F.lit(False))
