import hashlib
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rollweave.functions import glyphs, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_normalize_and_fingerprint(spark):
    rows = [("  Mixed   CASE  Name ",), ("",), (None,), ("STRASSE ß x",)]
    got = [r[0] for r in values(spark, rows, "n string", text.normalize_name(F.col("n")))]
    assert got == ["mixed case name", "", "", "strasse ss x"]
    ids = [(" mt/07 046/0000123 ",), ("",), (None,)]
    a = values(spark, ids, "i string", text.fingerprint(F.col("i"), F.lit("one")).alias("f"))
    b = values(spark, ids, "i string", text.fingerprint(F.col("i"), F.lit("two")).alias("f"))
    assert a[0][0]["hash"] == hashlib.sha256(b"one:MT/07046/0000123").hexdigest()
    assert a[0][0]["last4"] == "0123" and a[0][0]["hash"] != b[0][0]["hash"]
    assert a[1][0]["hash"] is None and a[2][0]["last4"] is None


def test_stable_id(spark):
    got = values(spark, [("IN-MH", 172, None)], "s string, n int, x string",
                 text.stable_id("ac", F.col("s"), F.col("n"), F.col("x")))
    assert got[0][0] == "ac_" + hashlib.sha256(b"IN-MH|172|None").hexdigest()[:24]


def test_query_summaries(spark):
    rows = [("Sample Voter Name",), ("Hidden Query",), ("  a  ",)]
    got = values(spark, rows, "q string", text.query_summary(F.col("q")), text.log_summary(F.col("q")))
    assert got == [("len:17 prefix:sa",) * 2, ("len:12 prefix:hi",) * 2, ("short-query",) * 2]


def plain_trigrams(s):
    words = "".join(ch if ch.isalnum() else " " for ch in s.lower()).split()
    return {f"  {w} "[i:i + 3] for w in words for i in range(len(w) + 1)}


def test_trigrams_against_plain_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab -é9 ") for _ in range(rng.randint(0, 14))) for _ in range(200)]
    got = values(spark, [(t,) for t in texts], "t string", "t", text.trigrams(F.col("t")))
    for t, grams in got:
        assert set(grams) == plain_trigrams(t) and len(grams) == len(set(grams)), t


def test_similarity_documented_value_and_threshold(spark):
    got = values(spark, [("word", "two words"), ("", "")], "a string, b string",
                 text.trigram_similarity(F.col("a"), F.col("b")))
    assert round(got[0][0], 6) == 0.363636 and got[1][0] == 0.0
    # 0.7 as a 4-byte number is below 0.7 as an 8-byte one.
    row = spark.range(1).select(text.at_least(F.lit(0.7).cast("float"), 0.7), text.at_least(F.lit(0.2).cast("float"), 0.2))
    assert tuple(row.first()) == (False, True)


# Glyph names, their Devanagari, and a part of their Latin form.
TRIPLES = [
    ("¶ÉäJÉ", "शेख", "shekh"), ("¨Éä½þiÉÉ", "मेहता", "mehta"[:3]), ("{ÉÉ]õÒ±É", "पाटील", "paat"),
    ("ºÉÉ´ÉÆiÉ", "सावंत", "saavant"), ("JÉÉiÉÖxÉ", "खातुन", "khaatun"), ("½þ±ÉÒ¨ÉÉ", "हलीमा", "haleemaa"),
    ("¨ÉÆMÉä¶É", "मंगेश", "mangesh"), ("Ê´É±ÉÉºÉ", "विलास", "vilaas"), ("¨ÉÉä½þ¨¨Énù", "मोहम्मद", "mohammad"[:3]),
    ("ÊxÉVÉÉ¨ÉÖqùÒxÉ", "निजामुद्दीन", "nijaamudd"), ("ºÉÉÊVÉnù+±ÉÒ", "साजिदअली", "saajid"),
    ("EòÉ®úJÉÉxÉÒºÉ", "कारखानीस", "kaar"), ("{ÉÖ¯û¹ÉÉäkÉ¨É", "पुरुषोत्तम", "purushottam"),
    ("Ê´ÉvÉÉxÉºÉ¦ÉÉ", "विधानसभा", "vidhaanasabhaa"), ("¨ÉiÉnùÉ®ô", "मतदार", "matadaar"),
    ("ÊSÉiÉ³äý", "चितळे", "chitale"), ("¶ÉÆEò®ú", "शंकर", "shankar"),
    ("{ÉÉ]õÒ±É +ÊxÉ±É ¶ÉÉ¨É®úÉ´É", "पाटील अनिल शामराव", "anil"), ("EòÉÆ¤É³äý", "कांबळे", "kaanbale"),
    ("VÉxÉÉnÇùxÉ", "जनार्दन", "janaardana"), ("ÊEòiÉÔ", "किर्ती", "kirtee"), ("MÉÉä{ÉÓxÉÉlÉ", "गोपीनाथ", "gopeenaath"),
    ("Eò´Éæ", "कवे", "kave"), ("MÉÉÆMÉÖbæ÷", "गांगुडे", "gaangude"), ("xÉÉb÷EòhÉÔ", "नाडकर्णी", "naadakarnee"),
    ("{ÉÚÌhÉ¨ÉÉ", "पूर्णमा", "poornama"),
]


def test_glyph_triples(spark):
    df = spark.createDataFrame([(g, d, latin) for g, d, latin in TRIPLES], "g string, d string, l string")
    got = df.select("g", "d", "l", glyphs.to_devanagari(F.col("g")).alias("dev")).withColumn(
        "latin", glyphs.devanagari_to_latin(F.col("dev"))).collect()
    for r in got:
        assert r.dev == r.d, (r.g, r.dev, r.d)
        assert r.l in r.latin, (r.g, r.latin)


def test_glyph_edges():
    # (input, expected): vowels, prefix marks without a consonant, conjuncts, stray signs
    cases = {
        "+": "अ", "+É": "आ", "+Éä": "ओ", "+ÉÉè": "औ", "<Ç": "ई", "<È": "ईं", "BÉä": "ऐ", "Ê": "ि", "Ç": "र्",
        "CiÉ": "क्त", "¨": "म्", "Êù": "ि", "12/ab": "12/ठ्ठ्ड्", "$&*": "ॐः।", "Î": "स्थि", "Ò": "Ò", "Eò": "क",
        "EòÉ": "का", "EòÉå": "काें", "EòÉä": "को", "EòÉÇ¨É": "कर्म", "¨ÉÇEò": "मर्क", "¨Ç": "र्म",
    }
    for glyph, dev in cases.items():
        assert glyphs.spell_glyphs(glyph) == dev, glyph


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="EòÉÊÇ¨ä®ú ÒÆ+<Bþ1{", max_size=12))
def test_words_are_independent(s):
    assert glyphs.spell_glyphs(s) == " ".join(glyphs.spell_glyphs(w) for w in s.split(" "))
