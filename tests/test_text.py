import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from textyard.functions import text as tx
from textyard.functions.hashing import fnv1a_bucket, md5_bucket
from textyard.functions.stopwords import ENGLISH


def plain_clean(text):
    """The cleaner's definition, step by step."""
    if text is None or not text.strip():
        return ""
    text = re.sub(r"https?://\S+|www\.\S+", " ", text.lower())
    text = re.sub(r"<[^>]+>", " ", text)
    text = re.sub(r"[^a-z0-9\s]", " ", text)
    return " ".join(t for t in text.split() if t not in ENGLISH and len(t) > 1)


CASES = [
    None, "", "   \t\n", "You're an IDIOT!! Visit http://spam.com for more", "<p>a<b>bold</b> move</p> 1 22 x",
    "see www.example.org/a?b=c now", "été déjà vu", "link http://a.b/c next word", "http://x.y z tail",
    "http://x\x85keep", "a b c", "<<<>>> < > <not closed", "don't won't I'll couldn't", "tab\tand\x0bfeed",
    "WWW.Upper.COM end", "İstanbul K", "http only", "x < y > z",
]


def test_clean_matches_definition(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "id int, text string")
    got = {r.id: r.c for r in rows.select("id", tx.clean("text").alias("c")).collect()}
    for i, text in enumerate(CASES):
        assert got[i] == plain_clean(text), repr(text)
    assert got[3] == "idiot visit"


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aB1 <>/.:\t  éwhtp'", max_size=40), min_size=200, max_size=400))
def test_clean_on_random_texts(spark, texts):
    texts = texts + [t.replace("w", "www.").replace("h", "http://") for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    for r in rows.select("text", tx.clean("text").alias("c")).collect():
        assert r.c == plain_clean(r.text), repr(r.text)


def test_steps_equal_full_cleaner_and_repeat_is_harmless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = tx.normalise_space(tx.strip_nonalnum(tx.strip_html(tx.strip_urls(F.lower("text")))))
    kept = F.filter(F.split(steps, " "), lambda t: (F.length(t) > 1) & ~t.isin(*ENGLISH))
    both = docs.select(tx.clean("text").alias("a"), F.array_join(kept, " ").alias("b"))
    assert both.filter("a <> b").count() == 0
    assert both.filter(tx.clean("a") != F.col("a")).count() == 0


def test_trim_takes_every_kind_of_space(spark):
    row = spark.createDataFrame([(" \t x y \n ", None)], "a string, b string")
    assert row.select(tx.trim_space("a"), tx.trim_space("b")).first() == ("x y", "")


def test_ngrams(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "t array<string>")
    assert [r[0] for r in rows.select(tx.ngrams("t")).collect()] == [["a", "b", "c", "a b", "b c"], ["x"], []]
    assert [r[0] for r in rows.select(tx.ngrams("t", 2, 3)).collect()] == [["a b", "b c", "a b c"], [], []]
    with pytest.raises(ValueError):
        tx.ngrams("t", 2, 1)


def test_char_ngrams(spark):
    rows = spark.createDataFrame([("ab",), ("a",), ("stupid",)], "w string")
    got = [r[0] for r in rows.select(tx.char_ngrams("w")).collect()]
    for word, grams in zip(("ab", "a", "stupid"), got):
        m = f"<{word}>"
        assert grams == [m[i : i + n] for n in range(3, 7) for i in range(len(m) - n + 1)]


def test_bucket_functions(spark):
    import hashlib

    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    rows = spark.createDataFrame([("<st",), ("upid>",), ("<a>",)], "g string")
    for r in rows.select("g", fnv1a_bucket(F.col("g"), 1000).alias("f"), md5_bucket(F.col("g"), 1000).alias("m")).collect():
        assert r.f == fnv(r.g) % 1000
        assert r.m == int(hashlib.md5(r.g.encode()).hexdigest()[:15], 16) % 1000


def test_capitalise(spark):
    row = spark.createDataFrame([("distilBERT",)], "n string")
    assert row.select(tx.capitalise("n")).first()[0] == "Distilbert"


def test_stoplist_has_no_apostrophes_or_repeats():
    assert len(set(ENGLISH)) == len(ENGLISH)
    assert all(re.fullmatch("[a-z]+", w) for w in ENGLISH)
