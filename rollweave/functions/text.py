"""Text, identifier and similarity expressions (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode white space as Python's str.isspace sees it. Java's \s is ASCII only, so the
# class is spelled out and works the same with and without the (?U) flag.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    "           "
    "    　"
)
WS = "[ \\t\\n\\x0b\\f\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
NON_WS = "[^" + WS[1:]

CHECKSUM_RE = "^sha256:[0-9a-f]{64}$"


def strip(c: Column) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.btrim(c, F.lit(BLANKS))


def flat(c: Column) -> Column:
    """Every Unicode white space a plain blank, none in front: the form :func:`word` reads."""
    return F.ltrim(F.translate(c, BLANKS, " " * len(BLANKS)))


def word(c: Column, n: int) -> Column:
    """The ``n``-th word, from 0, of a text made by :func:`flat`; NULL where it has fewer."""
    for _ in range(n):
        c = F.ltrim(F.substring(c, F.length(F.substring_index(c, " ", 1)) + 1, F.length(c)))
    return blank_to_null(F.substring_index(c, " ", 1))


def squeeze(c: Column) -> Column:
    """Strip, and turn every white-space run into one blank."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def fold(c: Column) -> Column:
    """Case folding: lower-casing plus the one-to-many and variant letters it leaves."""
    low = F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    return F.translate(low, "µςſ", "μσs")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def zero_to_null(c: Column) -> Column:
    return F.when(c != 0, c)


def normalize_name(c: Column) -> Column:
    """Stripped, case-folded, white space squeezed; NULL becomes the empty string."""
    return F.coalesce(squeeze(fold(c)), F.lit(""))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the first 24 hex digits of sha256 over the ``|``-joined parts."""
    # concat_ws drops NULLs, the definition spells them as the word None.
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, 24))


def fingerprint(c: Column, salt: Column) -> Column:
    """struct(hash, last4) of an identifier; both NULL when it is missing or empty."""
    clean = F.regexp_replace(F.upper(c), WS + "+", "")
    present = c.isNotNull() & (c != "")
    return F.struct(
        F.when(present, F.sha2(F.concat(salt, F.lit(":"), clean), 256)).alias("hash"),
        F.when(present, F.right(clean, F.lit(4))).alias("last4"),
    )


def is_checksum(c: Column) -> Column:
    return F.coalesce(c.rlike(CHECKSUM_RE), F.lit(False))


def text_checksum(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def _summary(shown: Column, prefix: Column) -> Column:
    n = F.length(shown)
    return F.when(n <= 2, "short-query").otherwise(
        F.concat(F.lit("len:"), n.cast("string"), F.lit(" prefix:"), prefix)
    )


def query_summary(c: Column) -> Column:
    """Loggable summary of a search query: measured after normalising."""
    n = normalize_name(c)
    return _summary(n, F.substring(n, 1, 2))


def log_summary(c: Column) -> Column:
    """Loggable summary of a raw query: only white space is squeezed before measuring."""
    s = squeeze(c)
    return _summary(s, fold(F.substring(s, 1, 2)))


def client_identity(c: Column) -> Column:
    name = squeeze(F.coalesce(blank_to_null(c), F.lit("unknown-client")))
    return F.concat(F.lit("client:"), F.substring(F.sha2(fold(name), 256), 1, 16))


def client_key(c: Column, state_id: Column, ac_number: Column) -> Column:
    return F.concat(
        F.lit("search:"), client_identity(c), F.lit(":state:"), state_id,
        F.lit(":ac:"), ac_number.cast("string"),
    )


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of every word, a word being padded by two blanks and one.

    The words are laid out on one string and cut by a zero-width look-ahead, which keeps
    the whole expression in generated code; grams that would straddle two words (any
    character followed by two blanks) are skipped by the pattern.
    """
    words = F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{M}\\p{N}]+", " "))
    padded = F.concat(F.lit("  "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit("(?s)(?=(.(?!  )..))"), F.lit(1)))


def jaccard(common: Column, left: Column, right: Column) -> Column:
    """Similarity of two sets from their sizes, as a 4-byte float; 0 when both are empty."""
    union = left + right - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0)).cast("float")


def gram_similarity(a: Column, b: Column) -> Column:
    return jaccard(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Share of common trigrams of two texts, 4-byte precision."""
    return gram_similarity(trigrams(a), trigrams(b))


def at_least(score: Column, threshold: float) -> Column:
    """4-byte score against an 8-byte threshold, so 0.7 stored short is below 0.7."""
    return score.cast("double") >= F.lit(float(threshold))
