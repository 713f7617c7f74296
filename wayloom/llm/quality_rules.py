"""Quality rules by distribution divergence, with DataFrame functions only and without a shuffle.

A document's histogram of character classes and its histogram of common words
are compared with the references of four languages by Jensen-Shannon distance
(square root of the divergence to base 2, 0 to 1); the nearest language counts,
so a wrong or missing language label does no harm. A document of at least
min_words words is rejected if its characters are further than far_chars away,
or if its characters and its words are further than near_chars and near_words.
Shorter documents have too few words for a histogram and pass this test, and so do
documents of which half the word characters or more are letters of a script that
no reference has (Greek, Cyrillic, Arabic, Chinese and others; see FOREIGN).

The references are measured, not taken from a linguistic source: they are what
quality_references.fitted gives, to about a unit of the fourth place, on the rows
of the generated documents table of scale 0.1 that are labelled good (quality 1),
at most 2,000 a language. For other corpora fit them again.

Before that the base rules apply: fewer than least_words words, or more than
repeat_percent per cent of the words in 5-word windows that occur twice.

Cases: a null text has no words and fails the base rules, as an empty one does;
digits are left out of the histograms, so that numbers don't count against a
text. Windows are compared by 64-bit hashes of their words. Other columns pass
through; columns with the names of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, bind, set_aside, words_of

# Fixed values, from quality_references.fitted: shares of lower-case a-z, A-Z, white space, punctuation, other ASCII and the rest, without digits,
# and of common words (as they are or capitalised, also before a full stop or comma), in prose of each language.
CLASSES = {
    "en": (0.7957, 0.0138, 0.1668, 0.0237, 0.0, 0.0),
    "de": (0.7731, 0.0123, 0.1547, 0.0218, 0.0, 0.0381),
    "fr": (0.7083, 0.0104, 0.1668, 0.0238, 0.0, 0.0907),
    "es": (0.7249, 0.0120, 0.1617, 0.0230, 0.0, 0.0784),
}
COMMON = {
    "en": {"the": 0.0629, "of": 0.0365, "and": 0.0264, "to": 0.02, "a": 0.0158, "in": 0.0139, "is": 0.0117, "that": 0.0106, "it": 0.0094, "for": 0.0085, "was": 0.0079, "on": 0.0073, "with": 0.0067, "as": 0.0059, "by": 0.0056, "be": 0.0055, "this": 0.0054, "are": 0.0051, "at": 0.0046, "from": 0.0043},
    "de": {"der": 0.0622, "die": 0.0366, "und": 0.0263, "in": 0.02, "den": 0.0162, "von": 0.0136, "zu": 0.0111, "das": 0.0109, "mit": 0.0094, "sich": 0.0084, "des": 0.0079, "auf": 0.0072, "für": 0.0066, "ist": 0.006, "im": 0.0056, "dem": 0.0056, "nicht": 0.0054, "ein": 0.005, "eine": 0.0049, "als": 0.004},
    "fr": {"de": 0.0625, "la": 0.0378, "le": 0.0253, "et": 0.0208, "les": 0.0164, "des": 0.014, "en": 0.0125, "un": 0.0108, "du": 0.0091, "une": 0.008, "que": 0.0077, "pour": 0.0074, "est": 0.0071, "dans": 0.0058, "qui": 0.0057, "par": 0.0052, "sur": 0.0051, "pas": 0.0049, "au": 0.0047, "avec": 0.0046},
    "es": {"de": 0.0622, "la": 0.0364, "que": 0.0255, "el": 0.0199, "en": 0.0163, "y": 0.0137, "los": 0.0116, "se": 0.0102, "las": 0.0095, "del": 0.0092, "un": 0.0081, "por": 0.0077, "con": 0.0067, "no": 0.0066, "una": 0.0057, "su": 0.0057, "para": 0.0056, "al": 0.0049, "es": 0.0049, "lo": 0.0038},
}
SYMBOLS = r"[#*$%&|<>]"
UPPER, DIGIT, PUNCTUATION, OTHER = "[A-Z]", "[0-9]", r"""[.,;:!?'"()\-]""", r"[#$%&*+/<=>@\[\\\]^_`{|}~]"
# Letters and syllables of scripts other than Latin, from Greek to Hangul, without phonetic and general symbols.
FOREIGN = "[\u0370-\u1dbf\u2c00-\u2c5f\u3041-\u318f\u3400-\ua4cf\uac00-\ud7a3\uf900-\ufaff]"
WINDOW = 5
PARAMETERS = {"least_words": 10, "repeat_percent": 20, "min_words": 30, "near_chars": 0.165, "near_words": 0.2, "far_chars": 0.4}
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def distance(counts: Column, total: Column, reference) -> Column:
    """Jensen-Shannon distance of the array counts / total from a reference; bins that both lack add nothing.

    Array functions keep the generated code small: a method too large for the
    JVM's compiler would be interpreted.
    """

    def term(count, q):
        p = count / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    terms = F.zip_with(counts, F.array(*[F.lit(float(q)) for q in reference]), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def repeated_words(windows: Column) -> Column:
    """Words that lie in windows found twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = bind(placed, lambda s: F.filter(s, lambda x, k: F.coalesce((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = bind(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered).cast("long")


def score(docs: DataFrame, text: str = "text", **changed) -> DataFrame:
    """docs with the counts, the distances and the verdict."""
    p = PARAMETERS | changed
    docs = docs.drop(*RESULTS)
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    written = [v + end for w in {w for words in COMMON.values() for w in words} for v in {w, w.capitalize()} for end in ("", ".", ",")]
    lines = F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    first = docs.select(*names, words_of(F.col(f"`{text}`")).alias("·w"), lines.alias("·l"), F.regexp_replace(whole, r"[a-z\x20\x09-\x0D]+", "").alias("·s"))
    words, few = F.col("·w"), F.col("·s")
    joined = F.array_join(F.filter(words, lambda w: w.isin(written)), "  ")
    common = F.concat(F.lit(" "), F.replace(F.replace(F.lower(joined), F.lit("."), F.lit("")), F.lit(","), F.lit("")), F.lit(" "))
    found = lambda pattern: F.regexp_count(few, F.lit(pattern)).cast("long")
    window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    second = first.select(
        *names,
        F.struct(
            F.size(words).cast("long").alias("n"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("chars"),
            (F.size("·l") - F.size(F.array_distinct("·l"))).cast("long").alias("dup"),
            *[found(x).alias(n) for n, x in (("upper", UPPER), ("digit", DIGIT), ("punct", PUNCTUATION), ("other", OTHER), ("symbols", SYMBOLS), ("foreign", FOREIGN))],
            (F.char_length(few) - F.char_length(F.regexp_replace(few, r"[^\x00-\x7F]+", ""))).cast("long").alias("rest"),
            F.char_length(whole).cast("long").alias("all"),
        ).alias("·b"),
        F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), window)).otherwise(F.array().cast("array<bigint>")).alias("·g"),
        common.alias("·t"),
    )
    b, t = F.col("·b"), F.col("·t")
    n, total = F.greatest(b["n"], F.lit(1)), F.greatest(b["all"] - b["digit"], F.lit(1))
    hits = {k: F.transform(F.array(*map(F.lit, ref)), lambda w: (F.octet_length(t) - F.octet_length(F.replace(t, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)) for k, ref in COMMON.items()}
    third = second.select(*names, "·b", repeated_words(F.col("·g")).alias("·r"), *[h.alias(f"·{k}") for k, h in hits.items()])
    counts = F.array(b["chars"] - b["upper"] - b["digit"] - b["punct"] - b["other"] - b["rest"], b["upper"], b["all"] - b["chars"], b["punct"], b["other"], b["rest"])
    by_chars = F.least(*[distance(counts, total, ref) for ref in CLASSES.values()])
    whole_of = lambda k: F.array_append(F.col(f"·{k}"), n - F.aggregate(F.col(f"·{k}"), F.lit(0.0), lambda a, x: a + x))
    by_words = F.least(*[distance(whole_of(k), n, [*ref.values(), 1 - sum(ref.values())]) for k, ref in COMMON.items()])
    fifth = third.select(*names, "·b", "·r", by_chars.alias("·c"), by_words.alias("·d"))
    failed = (b["n"] < p["least_words"]) | (100 * F.col("·r") > p["repeat_percent"] * b["n"])
    unlike = (b["n"] >= p["min_words"]) & (2 * b["foreign"] < b["chars"]) & ((F.col("·c") > p["far_chars"]) | ((F.col("·c") > p["near_chars"]) & (F.col("·d") > p["near_words"])))
    return fifth.select(*names, b["n"].alias("n_words"), b["chars"].alias("word_chars"), b["symbols"].alias("n_symbols"), b["dup"].alias("n_dup_lines"), F.col("·r").alias("n_repeat_words"), failed.alias("base_failed"), F.col("·c").alias("char_distance"), F.col("·d").alias("word_distance"), (~failed & ~unlike).alias("kept"))


def kept_documents(docs: DataFrame, text: str = "text", **changed) -> DataFrame:
    """The documents that are kept, with their own columns, also those that are named like a result.

    A filter would be pushed below the scores, and each name in it replaced by
    its whole formula, level by level; a generator stays where it is.
    """
    own, back = set_aside(docs, RESULTS)
    scored = score(own, text, **changed)
    names = [F.col(f"`{c}`") for c in own.columns]
    return scored.select(*names, F.explode(F.when(F.col("kept"), F.array(F.lit(1)))).alias("·k")).select(*back)
