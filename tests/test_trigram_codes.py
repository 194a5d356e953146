"""Trigrams as numbers tell texts apart exactly as trigrams as texts do."""

from pyspark.sql import functions as F

from noticemill.functions import text as X
from noticemill.plans.text_queries import text_similarity


def test_codes_count_like_texts(spark):
    texts = ["", "a", "ab", "\u0000ab", "abc", "abcabc", "采购公告采购", "😀😀😀😀", "😀a采", "aaaaab", "ba", "b", "\u0000", "\u0000\u0000"]
    rows = spark.createDataFrame([(x, y) for x in texts for y in texts], "t string, o string")
    plain = rows.select("t", "o", X.jaccard(X.char_ngrams(F.col("t"), 3), X.char_ngrams(F.col("o"), 3)).alias("j"))
    coded = rows.select("t", "o", X.trigram_jaccard("t", "o").alias("j"))
    assert sorted(map(tuple, coded.collect())) == sorted(map(tuple, plain.collect()))


def test_similarity_of_texts_cuts_no_strings(spark):
    plan = text_similarity(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # one per side before, the most of the time


def test_bigrams_and_trigrams_of_raw_texts(spark):
    texts = [None, "", "  ", " a", "ab\n", "\tabcab", "采购公告", " 😀a采"]
    rows = spark.createDataFrame([(x, y) for x in texts for y in texts], "t string, o string")
    t, o = F.col("t"), F.col("o")
    for n, coded in ((2, X.bigram_jaccard), (3, X.trigram_jaccard)):
        plain = X.jaccard(X.char_ngrams(t, n), X.char_ngrams(o, n))
        assert rows.where(plain != coded(t, o)).count() == 0
    assert text_similarity(spark, "/root/testdata/sf0.001").columns == ["doc_id", "bigram_jaccard", "jaccard"]
