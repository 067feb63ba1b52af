"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histogram of character classes and of its language's common words are compared to
those of its language by Jensen-Shannon divergence (in bits). The language's reference is the mean
of its documents' own histograms, so a few long documents do not set it. Too short documents are not
judged by a histogram: their counts say too little.

Nulls: a null text has no words (and fails the base rules); documents with a null or rare language
are compared to the documents of that same language value, null being one. Repeated rows are judged
alike, and divergences at a bound pass. Texts of any length count whole. An empty table gives no rows; columns other than
``doc_id``, ``lang`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATOR_CLASS, SEPARATORS, text_or_empty, written

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Fewest words for a verdict by the histograms.
GUARD_WORDS = 50
#: A document fails beyond MAX_CHARACTER, or beyond both JOINT bounds: a short text's words may stray by chance, and
#: a clean one's numbers or links move its characters, but seldom both.
MAX_CHARACTER_DIVERGENCE = 0.09
JOINT_CHARACTER_DIVERGENCE, JOINT_WORD_DIVERGENCE = 0.02, 0.072
#: What each character class leaves when all else is taken away.
CLASSES = {
    "lower": "[^a-z]+",
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "space": r"[^\x20\x09-\x0D]+",
    "sentence": r"[^.,;:!?'\"()\-]+",
    "symbol": "[^#*$%&|<>]+",
}
#: Common words of four languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er sie nach bei um am aus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son lui".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}


def words(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``."""
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR_CLASS + "+"))


def features(documents: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, and counts of character classes and common words."""
    docs = documents.select("doc_id", "lang", text_or_empty().alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda c, p: F.regexp_replace(c, F.lit(p), F.lit(""))
    # The two large classes go first, so the others are sought in what is left; in steps, as one expression of them all is too long for the JVM to compile.
    step = docs.select("doc_id", "lang", words(F.col("text")).alias("words"), lines.alias("lines"), F.length("text").alias("n_all"), without("text", "[a-z]+").alias("rest"))
    step = step.withColumns({"c_lower": F.col("n_all") - F.length("rest"), "n_rest": F.length("rest"), "rest": without("rest", r"[\x20\x09-\x0D]+")})
    left = [k for k in CLASSES if k not in ("lower", "space")]
    step = step.withColumns({"c_space": F.col("n_rest") - F.length("rest"), **{f"c_{k}": F.length(without("rest", CLASSES[k])) for k in left}})
    left = list(CLASSES)
    common = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({w for v in COMMON.values() for w in v})
    n = F.size("words")
    hashes = F.when(n >= 3, F.transform(F.slice("words", F.lit(1), n - 2), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<long>"))
    step = step.select(
        "doc_id", "lang", "words", *(f"c_{k}" for k in left), "n_all",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        hashes.alias("hashes"),
        # Two spaces between words, so that each has its own on both sides.
        F.concat(F.lit(" "), F.array_join(F.filter("words", lambda w: w.isin(every)), "  "), F.lit(" ")).alias("used"),
    )
    # A repeated window has a repeated hash; where there is one, windows are ordered by hash and words and held to the words.
    window = lambda h, i: F.struct(h.alias("h"), F.get("words", i).alias("a"), F.get("words", i + 1).alias("b"), F.get("words", i + 2).alias("c"), i.alias("i"))
    placed = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", window)))
    own = F.coalesce(F.try_element_at(common, F.coalesce("lang", F.lit(""))), F.array().cast("array<string>"))
    gone = lambda w: F.length(F.replace("used", F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))
    hits = F.transform(own, lambda w: ((F.length("used") - gone(w)) / (F.length(w) + 2)).cast("long"))
    other = F.col("n_all") - sum((F.col(f"c_{k}") for k in left), F.lit(0))
    step = step.select(
        "doc_id", "lang", "n_words", "word_chars", F.col("c_symbol").cast("long").alias("n_symbols"), "n_dup_lines", placed.alias("placed"), hits.alias("hits"),
        F.array(*(F.col(f"c_{k}").cast("long") for k in left), other.cast("long")).alias("characters"),
    )
    # All other words are the histogram's first bin.
    others = F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x)
    step = step.withColumn("common", F.concat(F.array(others), F.col("hits"))).drop("hits")

    def same(x, j):
        y = F.get("placed", j)
        return F.coalesce((y["h"] == x["h"]) & (y["a"] == x["a"]) & (y["b"] == x["b"]) & (y["c"] == x["c"]), F.lit(False))

    spots = F.sort_array(F.transform(F.filter("placed", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    step = step.withColumn("spots", F.coalesce(F.when(F.col("placed").isNotNull(), spots), F.array().cast("array<int>"))).drop("placed")
    # A window adds its words up to the next repeated window's start.
    covered = F.aggregate(F.transform("spots", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("spots", j + 1), p + 3) - p)), F.lit(0), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", covered.cast("long")).drop("spots")


def shares(counts: Column) -> Column:
    """Counts over their sum; zeros where the sum is zero."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two histograms of shares, in bits."""
    part = lambda a, b: F.when(F.coalesce(a, F.lit(0.0)) > 0, 0.5 * a * F.log2(2 * a / (a + F.coalesce(b, F.lit(0.0))))).otherwise(F.lit(0.0))
    return F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda a, x: a + x)


def judged(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed, kept, and both divergences of every document."""
    found = written(spark, features(documents), "features")
    found = found.withColumn("lang", F.coalesce("lang", F.lit("")))
    found = found.withColumns({"p_characters": shares(F.col("characters")), "p_common": shares(F.col("common"))})
    full = F.col("n_words") >= GUARD_WORDS
    classes, listed = len(CLASSES) + 1, 1 + max(map(len, COMMON.values()))
    mean = lambda c, k, when: F.coalesce(F.avg(F.when(when, F.get(c, F.lit(k)))), F.lit(0.0))
    reference = found.groupBy("lang").agg(
        F.array(*(mean("p_characters", k, full) for k in range(classes))).alias("q_characters"),
        F.array(*(mean("p_common", k, full) for k in range(listed))).alias("q_common"),
    )
    both = found.join(reference, "lang")
    both = both.withColumns(
        {
            "character_divergence": F.when(full, divergence(F.col("p_characters"), F.col("q_characters"))),
            "word_divergence": F.when(full, divergence(F.col("p_common"), F.col("q_common"))),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
        }
    )
    character, word = F.coalesce("character_divergence", F.lit(0.0)), F.coalesce("word_divergence", F.lit(0.0))
    odd = (character > MAX_CHARACTER_DIVERGENCE) | (character > JOINT_CHARACTER_DIVERGENCE) & (word > JOINT_WORD_DIVERGENCE)
    return both.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~odd).alias("kept"), "character_divergence", "word_divergence",
    )
