"""Truth tables for the text steps (T1-T15), with the original Cyrillic profile."""

from pyspark.sql import functions as F

from newsdigest.config import Config, latin_config
from newsdigest.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("o")).first()["o"]


def test_negation_bigram_cyrillic(spark):
    cfg = Config()
    assert one(spark, lambda c: T.negation_bigram(c, cfg), "не не слово не") == "не_не слово не"
    assert one(spark, lambda c: T.negation_bigram(c, cfg), "не не не x") == "не_не не_x"
    assert one(spark, lambda c: T.negation_bigram(c, cfg), "ане не") == "ане не"


def test_mask_lexicon_single_pass(spark):
    cfg = Config()
    # adjacent repeats: the second occurrence lost its leading space (single pass)
    assert one(spark, lambda c: T.mask_lexicon(c, cfg), " пять пять ").startswith(" _чсл пять")


def test_alphabet_filter_yo_splits(spark):
    cfg = Config()
    assert one(spark, lambda c: T.alphabet_filter(c, cfg), "ёлка") == " лка"


def test_clean_sentence_cyrillic(spark):
    cfg = Config()
    out = one(spark, lambda c: T.clean_sentence(c, cfg, stops=["и", "в"]),
              "Рабочие не вышли на смену 5 дней и 10 ночей в «Заводе»")
    # digits -> placeholder, collapsed; quoted word -> ORG; short words dropped; negation glued
    assert "не_вышли" in out
    assert "_орг" in out
    assert "_чсл" in out
    assert " и " not in f" {out} "


def test_paragraphs_head_and_sentences(spark):
    txt = "a. b!\n \n c?\nd\ne\nf"
    paras = one(spark, T.paragraphs, txt)
    assert paras == ["a. b!", " c?", "d", "e", "f"]
    assert one(spark, lambda c: T.head_text(c, 4), txt) == "a. b!  c? d e"
    assert one(spark, T.sentences, "One. Two! Three? four") == ["One.", "Two!", "Three?", "four"]


def test_head_pushdown_equals_clean_then_slice(spark):
    """Slicing 4 paragraphs before cleaning gives the same tokens as cleaning the whole
    text and keeping 4 lines (no rule crosses a newline)."""
    cfg = latin_config()
    txt = "The one cat. Was here\n\n two 12 dogs\nno way\n«Paris» is nice\nfifth line here"
    head = one(spark, lambda c: T.clean_text(c, cfg, head_n=4), txt)
    full_lines = one(spark, lambda c: F.transform(T.paragraphs(c), lambda p: T.clean_paragraph(p, cfg)), txt)
    assert head.split() == " ".join(full_lines[:4]).split()


def test_remove_stopwords_keeps_duplicates(spark):
    toks = spark.createDataFrame([(["a", "bb", "a", "cc"],)], "t array<string>")
    out = toks.select(T.remove_stopwords(F.col("t"), ["bb"]).alias("o")).first()["o"]
    assert out == ["a", "a", "cc"]


def test_candidate_text_and_fallback(spark):
    df = spark.createDataFrame([(None, "x", "", "feed"), ("t", None, "art", "feed")],
                               "title string, text string, article string, feed string")
    rows = df.select(T.candidate_text("title", "text").alias("c"),
                     T.text_fallback("article", "feed").alias("f")).collect()
    assert rows[0]["c"] == "\nx" and rows[0]["f"] == "feed"
    assert rows[1]["c"] == "t\n" and rows[1]["f"] == "art"
