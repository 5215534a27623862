"""Token reduction: filters, sentence selection, semantic filtering, hypernyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Our own short lists, by language.
STOPWORDS = {
    "en": "a an and are as at be been but by for from had has have he her his i if in is it its not of on or she so than that the their them then there they this to was we were what when which who will with you your".split(),
    "de": "aber als am an auch auf aus bei das dass dem den der des die doch ein eine einem einen einer eines er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so um und von vor war wie wir zu zum zur".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous".split(),
    "es": "al como con de del desde donde el ella ellos en entre es esta este ha hay la las le lo los más mi muy no nos o para pero por que se si sin sobre su sus también un una y ya yo".split(),
}
# Weights and bounds of the scores, and the dictionaries.
EDGE, IDEAL, NUMERIC, CAPITAL, LONG, MARKS, DIVERSITY, ENTROPY = 0.3, 0.2, 0.3, 0.25, 0.2, 0.15, 0.15, 0.1
IDEAL_WORDS, LONG_BYTES = (3, 25), 8
KEPT_SENTENCES, THRESHOLD = 0.4, 0.3
IMPORTANT = {
    "result": 0.8, "conclusion": 0.8, "important": 0.7, "significant": 0.7, "analysis": 0.7, "method": 0.6, "data": 0.6, "system": 0.6,
    "performance": 0.6, "improvement": 0.6, "process": 0.5, "algorithm": 0.5, "function": 0.5, "model": 0.5, "implementation": 0.5,
}
HYPERNYMS = {
    "car": "vehicle", "dog": "animal", "apple": "fruit", "chair": "furniture", "book": "publication", "computer": "device", "algorithm": "method",
    "implementation": "approach", "optimization": "improvement", "analysis": "study",
}
CJK = r"[\x{4e00}-\x{9fff}]"


def light(text: Column) -> Column:
    """Without comments, with single spaces and one empty line at most."""
    return T.replace_all(T.replace_all(T.strip_comments(T.clean_repeated_punctuation(text)), " {2,}", " "), r"\n{3,}", "\n\n")


def core(word: Column) -> Column:
    """The word's letters in lower case."""
    return F.lower(T.replace_all(word, r"[^\p{L}]", ""))


def remove_stopwords(text: Column, stopwords: list[str]) -> Column:
    """Words in order, without stopwords. Kept as they are: words of capitals, with
    digits, without letters, and of a single byte of letters."""
    ordinary = lambda c: (F.octet_length(c) <= 1) | ~c.isin(stopwords)
    keep = lambda w: w.rlike("^[^a-z\\x{80}-\\x{10ffff}]{2,}$") | w.rlike("[0-9]") | T.let(core(w), ordinary)
    return F.array_join(F.filter(T.words(text), keep), " ")


def moderate(text: Column, stopwords: list[str]) -> Column:
    return remove_stopwords(light(text), stopwords)


def has_important_form(word: Column) -> Column:
    """Capitals, a digit, more than 10 bytes, or several capitals among others."""
    capitals = F.char_length(T.replace_all(word, r"[^\p{Lu}]", ""))
    return ((F.octet_length(word) > 1) & word.rlike(r"^\p{Lu}+$")) | word.rlike(r"\p{N}") | (F.octet_length(word) > 10) | ((capitals > 1) & (capitals < F.octet_length(word)))


def remove_common_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, reduced): words that are important in form, or rare and not short, or
    long for their text; if under a third is left, words of 3 letters and more."""
    words = docs.select(key, F.posexplode(T.words(F.col(text))).alias("k", "w")).withColumn("c", core(F.col("w")))
    n = F.char_length("c")
    by_word = words.withColumn("freq", F.count(F.lit(1)).over(Window.partitionBy(key, "c")))
    by_doc = Window.partitionBy(key)
    sized = by_word.select("*", F.count(F.lit(1)).over(by_doc).alias("total"), F.avg(F.when(n > 0, n)).over(by_doc).alias("mean"))
    keep = (F.col("c") == "") | has_important_form(F.col("w")) | ((F.col("freq") <= 2) & (n >= F.col("mean") * 0.8)) | (n >= F.col("mean") * 1.5)
    spare = (F.col("c") == "") | (n >= 3) | has_important_form(F.col("w"))
    join = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("k", "w")))), lambda s: s["w"]), " ")
    reduced = sized.groupBy(key).agg(F.first("total").alias("total"), F.count_if(keep).alias("kept"), join(keep).alias("a"), join(spare).alias("b"))
    found = reduced.select(key, F.when(F.col("kept") < F.floor(F.col("total") / 3), F.col("b")).otherwise(F.col("a")).alias("r"), F.col("total").alias("t"))
    return docs.select(key, text).join(found, key, "left").select(key, F.when(F.coalesce("t", F.lit(0)) < 4, F.col(text)).otherwise(F.col("r")).alias("reduced"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]"), lambda s: F.trim(T.replace_all(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def entropy(text: Column) -> Column:
    """Bits per lower-cased character, 5 at most: log2 n less the mean log2 of each
    character's count, from runs of the sorted characters."""
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    part = lambda a: F.when(a["run"] > 0, a["run"] * F.log2(a["run"])).otherwise(0.0)
    step = lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(c.alias("c"), F.lit(1).alias("run"), (a["sum"] + part(a)).alias("sum")))
    bits = lambda chars: F.when(F.size(chars) == 0, 0.0).otherwise(F.least(F.lit(5.0), F.log2(F.size(chars)) - F.aggregate(chars, start, step, lambda a: a["sum"] + part(a)) / F.size(chars)))
    return T.let(F.array_sort(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)."), F.lit(0))), bits)


def scored_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, k, sentence, n, score) for each sentence of each text."""
    split = docs.select(key, sentences(F.col(text)).alias("all")).select(key, F.size("all").alias("n"), F.posexplode("all").alias("k", "sentence"))
    s = F.col("sentence")

    def score(words: Column) -> Column:
        n = F.size(words)
        share = lambda keep: F.size(F.filter(words, keep)) / n
        # Counting distinct words stops once enough are seen.
        kinds = F.least(F.size(F.array_distinct(F.transform(words, core))), F.greatest(F.lit(1), F.ceil(n * 0.6)))
        return (
            F.when((F.col("k") == 0) | (F.col("k") == F.col("n") - 1), EDGE).otherwise(0.0)
            + F.when(n.between(*IDEAL_WORDS), IDEAL).otherwise(0.0)
            + share(lambda w: w.rlike(r"\p{N}")) * NUMERIC
            + share(lambda w: (F.octet_length(w) > 1) & w.rlike(r"^\p{Lu}+$")) * CAPITAL
            + share(lambda w: F.octet_length(w) > LONG_BYTES) * LONG
            + F.regexp_count(s, F.lit(r"[!-/:-@\[-`{-~]")) / F.octet_length(s) * MARKS
            + kinds / n * DIVERSITY
            + entropy(s) * ENTROPY
        )

    return split.select(key, "k", "sentence", "n", F.round(T.let(T.words(s), score), 6).alias("score"))


def select_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, selected): the best 40 % of sentences in their order; texts of two or fewer stay."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "k"))
    kept = scored_sentences(docs, key, text).withColumn("r", rank).where((F.col("n") > 2) & (F.col("r") <= F.ceil(F.col("n") * KEPT_SENTENCES)))
    best = kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "sentence"))), lambda x: x["sentence"]), ". ").alias("best"))
    return docs.select(key, text).join(best, key, "left").select(key, F.coalesce("best", text).alias("selected"))


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def technical(word: Column) -> Column:
    return (F.octet_length(word) > 6) & (F.contains(word, F.lit("_")) | (F.char_length(T.replace_all(word, r"[^\p{Lu}]", "")) > 1) | word.rlike("(tion|ment|ing)$"))


def scored_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, k, word, n, importance): own weight, that of up to two words on either side, and frequency."""
    words = docs.select(key, F.posexplode(T.words(F.col(text))).alias("k", "word")).withColumn("c", F.lower(T.replace_all(F.col("word"), r"[^\p{L}\p{N}]", "")))
    c, order = F.col("c"), Window.partitionBy(key).orderBy("k")
    near = F.collect_list("word").over(order.rowsBetween(-2, 2))
    freq, n = F.count(F.lit(1)).over(Window.partitionBy(key, "c")), F.count(F.lit(1)).over(Window.partitionBy(key))
    rows = words.select("*", near.alias("near"), n.alias("n")).withColumn("freq", freq)
    own = F.coalesce(_lookup(IMPORTANT, c), F.least(F.lit(1.0), 0.3 + F.least(F.octet_length(c) * 0.02, F.lit(0.2)) + F.when(c.rlike(r"\p{N}"), 0.15).otherwise(0.0) + F.when(technical(c), 0.25).otherwise(0.0)))
    one = lambda w: F.when(w == c, 0.0).when(technical(c) & technical(w), 0.05).when(w.rlike(r"^\p{Lu}"), 0.02).otherwise(0.0)
    edge = F.when((F.col("k") == 0) | (F.col("k") == F.col("n") - 1), 0.1).otherwise(0.0)
    context = F.least(F.lit(0.3), F.aggregate(F.transform("near", one), edge, lambda a, x: a + x))
    return rows.select(key, "k", "word", "n", F.round(own + context + (F.log(F.col("freq") / F.col("n")) + 1) * 0.1, 6).alias("importance"))


def semantic_filter(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, filtered): words of at least the threshold's importance."""
    kept = scored_words(docs, key, text).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("importance") >= threshold, F.struct("k", "word")))), lambda x: x["word"]), " ").alias("filtered"))
    return docs.select(key).join(kept, key, "left").select(key, F.coalesce("filtered", F.lit("")).alias("filtered"))


def hypernyms(text: Column) -> Column:
    """Words in order, those of the dictionary replaced by what they're a kind of."""
    bare = lambda w: F.lower(T.replace_all(w, r"[^\p{L}\p{N}]", ""))
    return F.array_join(F.transform(T.words(text), lambda w: F.coalesce(_lookup(HYPERNYMS, bare(w)), w)), " ")


def hypernyms_to_target(docs: DataFrame, target: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, compressed): the share of 1 - target of words that matters most stays, of the others those in the dictionary are replaced."""
    scored = scored_words(docs, key, text)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("importance"), "k"))
    bare = F.lower(T.replace_all(F.col("word"), r"[^\p{L}\p{N}]", ""))
    out = F.when(F.col("r") > F.floor((1.0 - target) * F.col("n")), F.coalesce(_lookup(HYPERNYMS, bare), F.col("word"))).otherwise(F.col("word"))
    joined = scored.withColumn("r", rank).withColumn("word", out).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("compressed"))
    return docs.select(key).join(joined, key, "left").select(key, F.coalesce("compressed", F.lit("")).alias("compressed"))


def cjk_tokens(text: Column) -> Column:
    """Words; those with a CJK character in pieces of two."""
    return F.flatten(F.transform(T.words(text), lambda w: F.when(w.rlike(CJK), F.regexp_extract_all(w, F.lit(".{1,2}"), F.lit(0))).otherwise(F.array(w))))


def statistics(before: Column, after: Column) -> list[Column]:
    """Counts of characters and words, and the shares that a reduction took away."""
    cb, ca = F.char_length(before).cast("long"), F.char_length(after).cast("long")
    wb, wa = T.word_count(before), T.word_count(after)
    ratio = lambda a, b: F.when(b > 0, 1.0 - a / b).otherwise(0.0)
    return [ratio(ca, cb).alias("character_reduction"), ratio(wa, wb).alias("token_reduction"), cb.alias("original_characters"), ca.alias("reduced_characters"), wb.alias("original_tokens"), wa.alias("reduced_tokens")]


MARKDOWN_LINE = r"^\s*(#{1,6}\s|[-*+]\s|[0-9]+\.\s|\|)"


def moderate_markdown(text: Column, stopwords: list[str]) -> Column:
    """Stop words removed line by line, but not in fenced code, headings, lists and tables."""
    line = lambda x: F.when(x.rlike(MARKDOWN_LINE) | (F.trim(x) == ""), x).otherwise(remove_stopwords(x, stopwords))
    prose = lambda part: F.array_join(F.transform(F.split(light(part), "\n"), line), "\n")
    return F.array_join(F.transform(F.split(text, "```"), lambda part, i: F.when(i % 2 == 1, part).otherwise(prose(part))), "```")


LEVELS = ("off", "light", "moderate", "aggressive", "maximum")


def reduce_tokens(docs: DataFrame, level: str, stopwords: list[str], hypernym_target: float | None = None, key: str = "doc_id") -> DataFrame:
    """(key, reduced): each level does what the one before does, then more: light,
    stop words, then common words, sentence selection and the semantic filter,
    at last hypernyms if a target is given. Unknown levels are moderate."""
    level = level if level in LEVELS else "moderate"
    depth = LEVELS.index(level)
    if depth == 0:
        return docs.select(key, F.col("text").alias("reduced"))
    # Moderate cleans twice, once by itself and once for light.
    text = light(F.col("text")) if depth == 1 else moderate(light(F.col("text")), stopwords)
    out = docs.select(key, text.alias("text"))
    if depth >= 3:
        out = remove_common_words(out, key).withColumnRenamed("reduced", "text")
        out = select_sentences(out, key).withColumnRenamed("selected", "text")
        out = semantic_filter(out, THRESHOLD, key).withColumnRenamed("filtered", "text")
    if depth == 4 and hypernym_target is not None:
        out = hypernyms_to_target(out, hypernym_target, key).withColumnRenamed("compressed", "text")
    return out.select(key, F.col("text").alias("reduced"))
