"""Quality scores of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# Weights and bounds.
OCR_WEIGHT, SCRIPT_WEIGHT, NAVIGATION_WEIGHT, STRUCTURE_WEIGHT, METADATA_WEIGHT = 0.3, 0.2, 0.1, 0.2, 0.1
SHORT, LONG = 10, 1000
SENTENCE_WORDS, PARAGRAPH_WORDS = (10, 30), (50, 300)
FIELDS = ("title", "author", "subject", "description", "keywords")


def _share(part: Column, text: Column) -> Column:
    return F.least(F.lit(1.0), part / F.octet_length(text).cast("double"))


def dash_bytes(text: Column) -> Column:
    """Bytes of dash runs outside the rules of pipe tables."""
    return F.aggregate(T.lines(text), F.lit(0).cast("long"), lambda n, x: n + F.when(F.trim(x).rlike(T.TABLE_RULE), F.lit(0).cast("long")).otherwise(T.match_bytes(x, T.DASHES)))


def ocr_penalty(text: Column) -> Column:
    found = T.match_bytes(text, T.OCR_ARTEFACT) + dash_bytes(text)
    return F.when(F.contains(text, F.lit("  ")) | F.contains(text, F.lit("...")), _share(found, text)).otherwise(0.0)


def script_penalty(text: Column) -> Column:
    found = sum((T.match_bytes(text, p) for p in (T.CSS_RULE, T.SCRIPT_TAG, T.STYLE_TAG)), T.match_bytes(text, T.JS_FUNCTION))
    gate = F.contains(text, F.lit("function")) | F.contains(text, F.lit("<script")) | F.contains(text, F.lit("<style"))
    return F.when(gate, _share(found, text)).otherwise(0.0)


def navigation_penalty(text: Column) -> Column:
    found = T.match_bytes(text, T.NAVIGATION) + T.match_bytes(text, T.BREADCRUMB) + T.match_bytes(text, T.PAGINATION)
    return F.when(text == "", 0.0).otherwise(_share(found, text))


def structure_bonus(text: Column) -> Column:
    def score(counts: Column) -> Column:
        n, sentences, paragraphs = counts[0], F.greatest(F.lit(1), counts[1]), counts[2] + 1
        total = (
            F.when((n / sentences).between(*SENTENCE_WORDS), 0.3).otherwise(0.0)
            + F.when((n / paragraphs).between(*PARAGRAPH_WORDS), 0.3).otherwise(0.0)
            + F.when(paragraphs > 1, 0.2).otherwise(0.0)
            + F.when(text.rlike(T.SENTENCE_MARK), 0.2).otherwise(0.0)
        )
        return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), total))

    return T.let(F.array(F.regexp_count(text, F.lit(r"\S+")), F.regexp_count(text, F.lit(T.SENTENCE_BREAK)), F.regexp_count(text, F.lit("\n\n"))), score)


def metadata_bonus(metadata: Column) -> Column:
    """Share of the important fields that a map<string, ...> has."""
    return F.coalesce(sum((F.map_contains_key(metadata, f).cast("int") for f in FIELDS[1:]), F.map_contains_key(metadata, FIELDS[0]).cast("int")) / float(len(FIELDS)), F.lit(0.0))


def quality_score(text: Column, metadata: Column | None = None) -> Column:
    """From 0 to 1; 0 for blank, 0.1 for texts under 10 bytes."""
    n = F.octet_length(text)
    extra = metadata_bonus(metadata) * METADATA_WEIGHT if metadata is not None else F.lit(0.0)
    plain = 1.0 - ocr_penalty(text) * OCR_WEIGHT + structure_bonus(text) * STRUCTURE_WEIGHT
    more = F.when(n > LONG, script_penalty(text) * SCRIPT_WEIGHT + navigation_penalty(text) * NAVIGATION_WEIGHT).otherwise(0.0)
    return F.when(~text.rlike(r"\S"), 0.0).when(n < SHORT, 0.1).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), plain - more + extra)))
