"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms of every text, over character classes and over common words, are compared with those of the languages
by the Jensen-Shannon distance (base 2, so 0 to 1). A text that is far from every language in either is rejected.
The language references are means over all documents of the table, one mean per language of ``COMMON_WORDS``; so they
are a few hundred numbers whatever the size of the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import SPACE, without

#: Common words by language (fixed values).
COMMON_WORDS = {
    "en": "the of and to in is that for".split(),
    "de": "der die und das den von zu mit".split(),
    "fr": "le la les de des et en un".split(),
    "es": "el la los las de en que y".split(),
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})

#: Character classes, tried in this order; what is left is the class "other".
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "white": SPACE, "symbol": "#*$%&|<>", "mark": ".,;:!?'\"()\\-"}

MIN_WORDS = 10
#: In hundredths of the words.
MAX_REPEATED = 20
#: Shorter texts are not judged by the histogram: too few draws for a distance to mean anything.
MIN_CHARS_JUDGED = 300
MIN_WORDS_JUDGED = 150
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.2


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` needs it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words covered by ``window``-word runs that occur twice or more in the array."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        same = F.transform(
            ordered,
            lambda x, k: F.when((F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]), x["i"]),
        )
        return F.array_sort(F.filter(same, lambda p: p.isNotNull()))

    def count(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        slow = _once(_once(ordered, places), covered)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(slow)

    return F.when(n < window, F.lit(0).cast("long")).otherwise(_once(hashes, count))


def histograms(docs: DataFrame) -> DataFrame:
    """``docs (text, …)`` with ``words``, ``n_words``, ``n_symbols`` and the two histograms, ``char_shares`` and
    ``word_shares`` (arrays of shares that sum to 1; null for a text without characters or words)."""
    # One class of characters is taken out after the other, so each pattern only sees what the earlier ones left.
    # Every step is a projection of its own, used twice by the next, which keeps it from being computed twice.
    out = docs.withColumn("left0", F.coalesce("text", F.lit("")))
    for i, members in enumerate(CLASSES.values()):
        out = out.withColumn(f"left{i + 1}", F.regexp_replace(f"left{i}", f"[{members}]+", ""))
    sizes = [F.char_length(f"left{i}") for i in range(len(CLASSES) + 1)]
    counts = [(a - b).cast("double") for a, b in zip(sizes, sizes[1:])] + [sizes[-1].cast("double")]
    out = out.select(
        *docs.columns,
        F.filter(F.split("left0", f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        sizes[0].alias("n_chars_in"),
        F.array(*counts).alias("chars"),
    )
    out = out.select(
        *docs.columns,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.get("chars", F.lit(list(CLASSES).index("symbol"))).cast("long").alias("n_symbols"),
        F.when(F.col("n_chars_in") > 0, F.transform("chars", lambda c: c / F.col("n_chars_in"))).alias("char_shares"),
        F.filter("words", lambda w: w.isin(VOCABULARY)).alias("common"),
    )
    found = [(F.size("common") - F.size(F.array_remove("common", w))).cast("double") for w in VOCABULARY]
    out = out.withColumn("found", F.array(*found, (F.col("n_words") - F.size("common")).cast("double")))
    shares = F.when(F.col("n_words") > 0, F.transform("found", lambda c: c / F.col("n_words")))
    return out.withColumn("word_shares", shares).drop("common", "found")


def with_counts(docs: DataFrame) -> DataFrame:
    """Output of ``histograms`` with the other base counts and ``base_failed``."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = docs.withColumn("lines", lines)
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    out = out.withColumn("word_chars", F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)))
    out = out.withColumn("n_repeat_words", repeated_words(F.col("words")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def references(found: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms by language over all documents; a few hundred numbers."""
    known = found.where(F.col("lang").isin(list(COMMON_WORDS)))
    parts = known.select("lang", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("char_shares").alias("s")), F.struct(F.lit(1).alias("kind"), F.col("word_shares").alias("s")))).alias("x"))
    cells = parts.select("lang", "x.kind", F.posexplode("x.s").alias("place", "share"))
    rows = cells.groupBy("lang", "kind", "place").agg(F.avg("share").alias("share")).orderBy("lang", "kind", "place").collect()
    refs: dict[str, tuple[list[float], list[float]]] = {}
    for r in rows:
        refs.setdefault(r["lang"], ([], []))[r["kind"]].append(r["share"])
    return {lang: r for lang, r in refs.items() if r[0] and r[1]}


def js_distance(shares: str, reference: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) between an array of shares and fixed ones."""
    q = F.array(*[F.lit(float(x)) for x in reference])

    def term(x: Column, y: Column) -> Column:
        middle = (x + y) / 2

        def part(v: Column) -> Column:
            return F.when(v > 0, v * F.log2(v / middle)).otherwise(0.0)

        return (part(x) + part(y)) / 2

    total = F.aggregate(F.zip_with(shares, q, term), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.col(shares).isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, kept``.

    The distances are those to the nearest language reference. Null and empty texts fail the base rules. A document of
    a language without a reference, or of a table where no language has one, is not judged by distance (null) and stays
    if it passes the base rules; a document without a language is held against all. Repeated rows are judged each on
    its own with the same result. Input columns with the names of new ones are replaced; an empty table stays empty.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    docs = without(docs, *new)
    # In a struct, columns that share a name with an intermediate one do no harm.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    found = histograms(packed)
    refs = references(found)
    judged = F.lit(bool(refs)) & (F.col("lang").isNull() | F.col("lang").isin(list(refs)))

    def nearest(shares: str, which: int) -> Column:
        found = [js_distance(shares, r[which]) for r in refs.values()]
        return F.when(judged, reduce(F.least, found) if found else F.lit(None).cast("double"))

    out = with_counts(found).withColumn("char_distance", nearest("char_shares", 0)).withColumn("word_distance", nearest("word_shares", 1))
    far = (F.col("char_distance") > MAX_CHAR_DISTANCE) & (F.col("word_chars") >= MIN_CHARS_JUDGED)
    far = far | ((F.col("word_distance") > MAX_WORD_DISTANCE) & (F.col("n_words") >= MIN_WORDS_JUDGED))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    # A one-row explode keeps a caller's filter on the verdict above all this. Pushed below, the filter would hold the
    # whole computation again, with the word array spelled out inside its lambdas.
    out = out.select("row", F.explode(F.array(F.struct(*new))).alias("found"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[F.col("found").getField(c).alias(c) for c in new])
