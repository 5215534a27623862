"""Benchmark decontamination by template canonicalisation.

Each text is read twice. In the typed reading numbers, names (one or more
capitalised words) and units after a number are placeholders that remember their
value; a token's type depends on nothing but itself and, for a unit, the number
before it, so it doesn't matter what stands around a passage. In the plain
reading every token is a lower-case word, so that passages of few words, and
copies in other letter case, match as they stand.

Every window of ``WINDOW`` benchmark tokens is a template (placeholders without
their values). Texts are dealt into segments of bounded length; the four-token
grams of a segment meet the benchmark in a hash join, by one gram of each
template, and what meets is compared token by token. A match counts if the slots
are consistent: values repeat at the same places of both windows, so that one
renaming maps all slots of the one onto the other. A question with other numbers
or names is caught, a text that merely has the same wording around unrelated
values is not. Column expressions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fresh, table, texts

WINDOW = 12
#: Items of fewer tokens than WINDOW are one whole window; below LEAST tokens
#: they match nothing unless a caller asks for it, and only as they stand.
LEAST = 5
#: What the registered query and the pipeline ask for: every item that has a token.
SHORTEST = 1
#: A benchmark window is a template if at least half of its tokens are
#: words; others match only as they stand, values and all.
WORDS = 0.5
#: Tokens of a gram, and of a segment (besides those that its last windows reach into).
GRAM, SEGMENT = 4, 512
#: Benchmark templates up to this many (about 400 bytes each) are broadcast;
#: beyond it both sides are shuffled by gram.
BROADCAST_ROWS = 200_000
TYPED, PLAIN = 0, 1

# Unit words that are placeholders after a number, and numbers in words.
UNITS = "mm cm m km in ft mi inch inches foot feet mile miles meter meters metre metres mg g kg lb lbs oz gram grams kilogram kilograms ml l liter liters litre litres s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degrees mph kmh kph"
NUMBERS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"

#: Tokens. Java's possessive runs take no stack, however long a list of names or numbers is.
WORD = r"[0-9]+(?:[.,:/][0-9]+)++|[\p{L}\p{N}]+"
TOKEN = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*+|" + WORD


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: Catalyst would copy the expression
    to each place that uses it, and evaluate every copy."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digit(token: Column) -> Column:
    return F.substring(token, 1, 1).between("0", "9")


def typed(text: Column) -> Column:
    """Tokens of the typed reading; a slot is \\x01, its type (n, d or u), its value."""

    def tag(tokens: Column, x: Column, i: Column) -> Column:
        low, first = F.lower(x), F.substring(x, 1, 1)
        slot = lambda kind: F.concat(F.lit("\x01" + kind), low)
        unit = low.isin(*UNITS.split()) & F.coalesce(_digit(F.get(tokens, i - 1)), F.lit(False))
        name = (first != F.lower(first)) & (F.char_length(x) > 1)
        return F.when(_digit(x) | low.isin(*NUMBERS.split()), slot("d")).when(unit, slot("u")).when(name, slot("n")).otherwise(low)

    return _let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda a: F.transform(a, lambda x, i: tag(a, x, i)))


def plain(text: Column) -> Column:
    """Tokens of the plain reading: lower-case words and numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _slot(v: Column) -> Column:
    return F.startswith(v, F.lit("\x01"))


def _bare(v: Column) -> Column:
    """A slot's type without its value, a word as it is."""
    return F.when(_slot(v), F.substring(v, 1, 2)).otherwise(v)


def readings(df: DataFrame, *kept: str) -> DataFrame:
    """(kept..., kind, tokens): both readings of each text that has tokens."""
    both = F.array(*[F.struct(F.lit(kind).alias("kind"), read(F.col("text")).alias("tokens")) for kind, read in ((TYPED, typed), (PLAIN, plain))])
    return df.select(*kept, F.explode(both).alias("r")).select(*kept, "r.kind", "r.tokens").where(F.size("tokens") > 0)


def _grams(tokens: Column, length: int | Column) -> Column:
    """For each token, the hash of the gram of ``length`` tokens (GRAM at most) that
    it begins. One that reaches over the end is that of the tokens there."""
    part = lambda h, i, k: F.get(h, i + k) if isinstance(length, int) else F.when(F.lit(k) < length, F.get(h, i + k))
    most = length if isinstance(length, int) else GRAM
    return _let(F.transform(tokens, lambda x: F.xxhash64(_bare(x))), lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[part(h, i, k) for k in range(1, most)])))


def places(window: Column) -> Column:
    """For each token of a window, the place of its value's first occurrence there; 0 for a word."""
    return F.transform(window, lambda v: F.when(_slot(v), F.array_position(window, v)).otherwise(F.lit(0).cast("long")))


def templates(bench: DataFrame, size: int = WINDOW, least: int = LEAST, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(kind, gram, h, at, size, template, options): one row for each distinct template.
    h is the hash of its gram of ``gram`` tokens from place ``at`` on, the one whose words have the
    most letters; options are the (places, item_id) that it has in the
    benchmark, with the smallest item of each."""
    items = readings(texts(bench, item_col, text_col).select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    n = F.size("tokens")
    sized = items.withColumn("size", F.least(n, F.lit(size))).where(F.col("size") >= (F.when(F.col("kind") == PLAIN, least).otherwise(max(least, LEAST))))
    wins = sized.select("item_id", "kind", "size", F.explode(F.transform(F.sequence(F.lit(1), n - F.col("size") + 1), lambda i: F.slice("tokens", i, F.col("size")))).alias("window"))
    words = F.size(F.filter("window", lambda v: ~_slot(v)))
    wins = wins.where((F.col("kind") == PLAIN) | (words >= F.col("size") * WORDS))
    known = wins.select("item_id", "kind", "size", F.transform("window", _bare).alias("template"), places(F.col("window")).alias("places"))
    known = known.groupBy("kind", "size", "template", "places").agg(F.min("item_id").alias("item_id"))
    # A template's options are ways in which at most half of its tokens repeat.
    known = known.groupBy("kind", "size", "template").agg(F.sort_array(F.collect_list(F.struct("places", "item_id"))).alias("options"))
    gram = F.least(F.col("size"), F.lit(GRAM))
    letters = lambda i: F.aggregate(F.slice("template", i + 1, F.col("gram")), F.lit(0), lambda n, x: n + F.when(_slot(x), 0).otherwise(F.char_length(x)))
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.col("size") - F.col("gram")), lambda i: F.struct((-letters(i)).alias("few"), i.alias("at"))))
    at = known.withColumn("gram", gram).withColumn("at", best["at"])
    return at.select("kind", "gram", F.get(_grams(F.col("template"), F.col("gram")), F.col("at")).alias("h"), "at", "size", "template", "options")


def _segments(df: DataFrame, size: int) -> DataFrame:
    """``df`` with tokens dealt into segments: (..., seg, tokens), each with the tokens
    that windows beginning in its first SEGMENT tokens reach."""
    cut = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1, F.lit(SEGMENT)), lambda i: F.slice("tokens", i + 1, F.lit(SEGMENT + size - 1)))
    kept = [c for c in df.columns if c != "tokens"]
    return df.select(*kept, F.posexplode(cut).alias("seg", "tokens"))


def hits(docs: DataFrame, bench: DataFrame, size: int = WINDOW, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_hash, text_bytes, kind, item_id): one row for each window of each
    row that is a benchmark template; item_id is the smallest item whose slots are
    consistent with the window's, null if there is none."""
    known = templates(bench, size, least)
    # The benchmark's templates are a few rows an item; the count decides how they are met, not what is found.
    counted = known.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()  # GRAM rows at most
    small = sum(r.n for r in counted) <= broadcast_rows
    key = ["doc_id", "text_hash", "text_bytes"]
    rows = texts(docs, id_col, text_col).withColumns({"text_hash": F.xxhash64("text"), "text_bytes": F.octet_length("text")})
    parts = _segments(readings(rows, *key), size)
    found = None
    for g in sorted(r.gram for r in counted) or [GRAM]:
        source = parts if small else parts.select(*key, "kind", "seg", F.col("tokens"))
        # Where both sides are shuffled, tokens would be copied to every gram.
        carried = ["tokens"] if small else []
        grams = source.select(*key, "kind", "seg", *carried, _grams(F.col("tokens"), g).alias("grams"))
        # The outer form: Spark would filter by the other's input, and compute all grams twice for that.
        grams = grams.select(*key, "kind", "seg", *carried, F.posexplode_outer("grams").alias("pos", "h"))
        mine = known.where(F.col("gram") == g).drop("gram").withColumnRenamed("kind", "known_kind")
        met = grams.join(F.broadcast(mine) if small else mine, "h").where(F.col("kind") == F.col("known_kind"))
        met = met.withColumn("start", F.col("pos") - F.col("at")).where((F.col("start") >= 0) & (F.col("start") < SEGMENT))
        found = met if found is None else found.unionByName(met)
    if not small:
        # Equal rows have equal segments, so one of each does.
        place = [*key, "kind", "seg"]
        wanted = found.select(*place).distinct()
        same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"]) & (a["text_bytes"] == b["text_bytes"]) & (a["kind"] == b["kind"]) & (a["seg"] == b["seg"])
        again = parts.join(wanted, same(parts, wanted), "left_semi").groupBy(*place).agg(F.first("tokens").alias("tokens"))
        named = again.select(*[F.col(c).alias(f"again_{c}") for c in place], "tokens")
        found = found.join(named, F.col("doc_id").eqNullSafe(F.col("again_doc_id")) & (F.col("text_hash") == F.col("again_text_hash")) & (F.col("text_bytes") == F.col("again_text_bytes")) & (F.col("kind") == F.col("again_kind")) & (F.col("seg") == F.col("again_seg")))
    # Behind a generator the comparison can't become part of the join, which it would keep from being compiled.
    window = found.select(*key, "kind", "template", "options", F.explode(F.array(F.slice("tokens", F.col("start") + 1, F.col("size")))).alias("window"))
    window = window.where(F.transform("window", _bare) == F.col("template"))
    own = window.select(*key, "kind", "options", places(F.col("window")).alias("own"))
    return own.select(*key, "kind", F.array_min(F.transform(F.filter("options", lambda o: o["places"] == F.col("own")), lambda o: o["item_id"])).alias("item"), F.exists("options", lambda o: o["places"] == F.col("own")).alias("same"))


def contaminated(docs: DataFrame, bench: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_windows, n_other): one row for each document that shares
    a slot-consistent window with the benchmark. item_id is the smallest such
    item, n_windows the number of consistent windows in the reading that has more of
    them (of all rows of an id together), n_other that of templates that match but whose
    slots don't. Null and empty texts match nothing; rows of a null id are
    reported together under null; an empty table on either side gives no rows.
    A null item_id is found like any other, and reported as null if no other item is.
    Items of fewer than ``least`` tokens aren't searched, those below LEAST only as they stand.
    """
    found = hits(docs, bench, size, least, id_col, text_col, broadcast_rows)
    n = lambda kind, good: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("same") == good), 1)), F.lit(0)).cast("long")
    each = found.groupBy("doc_id").agg(F.min(F.when(F.col("same"), F.col("item"))).alias("item_id"), F.greatest(n(TYPED, True), n(PLAIN, True)).alias("n_windows"), n(TYPED, False).alias("n_other"))
    return each.where("n_windows > 0")


def decontaminate(docs: DataFrame, bench: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose text is contaminated.
    Rows are told by id and text, so that clean rows of a null or repeated id
    stay; null and empty texts stay."""
    bad_id, bad_hash, bad_bytes = fresh(docs, "bad_id", "bad_hash", "bad_bytes")
    bad = hits(docs, bench, size, least, id_col, text_col).where("same").groupBy("doc_id", "text_hash", "text_bytes").agg(F.count(F.lit(1)).alias("n"))
    bad = bad.select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash), F.col("text_bytes").alias(bad_bytes))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64(text) == F.col(bad_hash)) & (F.octet_length(text) == F.col(bad_bytes)), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=SHORTEST)


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL of contaminated() with op1's parameters, for tables whose ids are unique."""
    word = r"[0-9]+(?:[.,:/][0-9]+)+|[\p{L}\p{N}]+"
    listed = lambda values: ", ".join(f"'{v}'" for v in values.split())
    digit = lambda e: f"coalesce({e}[1] BETWEEN '0' AND '9', false)"
    tag = f"""CASE WHEN {digit('x')} OR lower(x) IN ({listed(NUMBERS)}) THEN chr(1) || 'd' || lower(x)
      WHEN lower(x) IN ({listed(UNITS)}) AND i > 1 AND {digit('raw[i - 1]')} THEN chr(1) || 'u' || lower(x)
      WHEN x[1] <> lower(x[1]) AND length(x) > 1 THEN chr(1) || 'n' || lower(x) ELSE lower(x) END"""
    both = lambda src, key: f"""SELECT {key}, {TYPED} AS kind, list_transform(raw, lambda x, i: {tag}) AS toks
        FROM (SELECT {key}, regexp_extract_all(coalesce(text, ''), '\\p{{Lu}}\\p{{L}}+(?: \\p{{Lu}}\\p{{L}}+)*|{word}') AS raw FROM {src})
      UNION ALL SELECT {key}, {PLAIN}, regexp_extract_all(lower(coalesce(text, '')), '{word}') FROM {src}"""  # noqa: E731
    bare = "list_transform(w, lambda x: CASE WHEN x[1] = chr(1) THEN x[1:2] ELSE x END)"
    spots = "list_transform(w, lambda x: CASE WHEN x[1] = chr(1) THEN list_position(w, x) ELSE 0 END)"
    return f"""
WITH items AS (SELECT *, least({WINDOW}, len(toks)) AS size FROM ({both('benchmark', 'item_id')}) WHERE len(toks) >= {SHORTEST}),
bw AS (SELECT item_id, kind, size, toks[i:i + size - 1] AS w FROM (SELECT *, unnest(range(1, len(toks) - size + 2)) AS i FROM items)),
b AS (SELECT kind, size, {bare} AS t, {spots} AS v, min(item_id) AS item_id FROM bw
  WHERE kind = {PLAIN} OR (size >= {LEAST} AND len(list_filter(w, lambda x: x[1] <> chr(1))) >= size * {WORDS}) GROUP BY ALL),
d AS ({both(docs, 'doc_id')}),
dw AS (SELECT doc_id, kind, size, i, toks[i:i + size - 1] AS w FROM (SELECT doc_id, kind, toks, size, unnest(range(1, len(toks) - size + 2)) AS i
  FROM d JOIN (SELECT DISTINCT kind, size FROM b) USING (kind) WHERE len(toks) >= size)),
hits AS (SELECT d.doc_id, d.kind, d.size, d.i, min(b.item_id) FILTER (d.v = b.v) AS item_id, bool_or(d.v = b.v) AS same
  FROM (SELECT doc_id, kind, size, i, {bare} AS t, {spots} AS v FROM dw) d JOIN b ON d.kind = b.kind AND d.size = b.size AND d.t = b.t GROUP BY ALL)
SELECT doc_id, min(item_id) FILTER (same) AS item_id, greatest(count(*) FILTER (same AND kind = {TYPED}), count(*) FILTER (same AND kind = {PLAIN})) AS n_windows,
  count(*) FILTER (NOT same AND kind = {TYPED}) AS n_other FROM hits GROUP BY doc_id HAVING bool_or(same)"""
