"""Languages by stop-word hits: our own published-style scorer, with the output
shapes of single and tiled detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.reduction import STOPWORDS

# Two-letter and three-letter codes of languages.
PAIRS = "en eng ru rus zh cmn es spa pt por it ita fr fra de deu uk ukr ka kat ar ara hi hin ja jpn he heb yi yid pl pol am amh jv jav ko kor nb nob da dan sv swe fi fin tr tur nl nld hu hun cs ces el ell bg bul be bel mr mar kn kan ro ron sl slv hr hrv sr srp mk mkd lt lit lv lav et est ta tam vi vie ur urd th tha gu guj uz uzb pa pan az aze id ind te tel fa pes ml mal or ori my mya ne nep si sin km khm tk tuk ak aka zu zul sn sna af afr la lat sk slk ca cat tl tgl hy hye eo epo bn ben cy cym"
CODES = dict(zip(PAIRS.split()[::2], PAIRS.split()[1::2], strict=True))
#: Languages that a script tells alone, the commonest where it writes several.
SCRIPTS = {"amh": "Ethiopic", "ara": "Arabic", "ben": "Bengali", "cmn": "Han", "ell": "Greek", "guj": "Gujarati", "heb": "Hebrew", "hin": "Devanagari", "hye": "Armenian", "jpn": "Hiragana", "kan": "Kannada", "kat": "Georgian", "khm": "Khmer", "kor": "Hangul", "mal": "Malayalam", "mya": "Myanmar", "ori": "Oriya", "pan": "Gurmukhi", "rus": "Cyrillic", "sin": "Sinhala", "tam": "Tamil", "tel": "Telugu", "tha": "Thai"}
TILE = 200
MULTIPLE_THRESHOLD = 0.35


def ranked(text: Column) -> Column:
    """struct<s, k>: the negative share of words that are stop words of the best
    language, or of letters that are of its script, and its code; ties go to the code that sorts first."""

    def best(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1))
        each = [F.struct((-F.size(F.filter(words, lambda w: w.isin(stop))) / n).alias("s"), F.lit(CODES[lang]).alias("k")) for lang, stop in STOPWORDS.items()]  # noqa: B023
        return F.array_min(F.array(*each))

    words = T.let(T.words(F.lower(T.replace_all(text, r"[^\p{L}\s]", ""))), best)
    return F.when(text.rlike(r"[^\p{IsLatin}\P{L}]"), F.least(words, _by_script(text))).otherwise(words)


def _by_script(text: Column) -> Column:
    """The best language by script, null if no letter is of a known one. Chinese characters beside
    Japanese syllables are Japanese."""
    letters = F.greatest(F.char_length(T.replace_all(text, r"[^\p{L}\p{M}]", "")), F.lit(1))
    own = lambda name: F.char_length(T.replace_all(text, rf"[^\p{{Is{name}}}]", ""))
    japanese = own("Hiragana") + F.char_length(T.replace_all(text, r"[^\p{IsKatakana}]", ""))
    count = {code: own(name) for code, name in SCRIPTS.items()}
    count["jpn"] = F.when(japanese > 0, japanese + own("Han")).otherwise(0)
    count["cmn"] = F.when(japanese > 0, 0).otherwise(own("Han"))
    return F.array_min(F.array(*[F.when(n > 0, F.struct((-n / letters).alias("s"), F.lit(code).alias("k"))) for code, n in count.items()]))


def detect(text: Column, least: float) -> Column:
    """struct<code, share> of the best language, the code null below ``least``."""
    return T.let(ranked(text), lambda b: F.struct(F.when(-b["s"] >= least, b["k"]).alias("code"), (-b["s"]).alias("share")))


def tiles(docs: DataFrame, key: str = "doc_id", size: int = TILE) -> DataFrame:
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("text") - 1, F.lit(0)), F.lit(size))
    return docs.where(F.trim("text") != "").select(key, F.explode(F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(size)))).alias("tile"))


def multiple(docs: DataFrame, least: float, key: str = "doc_id") -> DataFrame:
    """(key, place, language, votes): languages by the number of tiles they win, ties
    by code; a text whose tiles all stay undecided falls back to its best language."""
    code = detect(F.col("tile"), min(least, MULTIPLE_THRESHOLD))["code"]
    votes = tiles(docs, key).select(key, code.alias("language")).groupBy(key, "language").agg(F.count(F.lit(1)).alias("votes")).where("language IS NOT NULL")
    whole = detect(F.col("text"), least)["code"]
    single = docs.join(votes.select(key).distinct(), key, "left_anti").where(F.trim("text") != "").select(key, whole.alias("language"), F.lit(0).cast("long").alias("votes")).where("language IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), "language"))
    return votes.unionByName(single).select(key, place.alias("place"), "language", "votes")
