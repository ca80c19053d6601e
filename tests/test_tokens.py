import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verbatix.functions import stats, terms
from verbatix.functions import tokens as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "column", "wanted"),
    [
        ("%1 %n %d %L2", T.qt_tokens, ["%1", "%n", "%L2"]),
        ("%1 %n %d %L2", T.printf_tokens, ["%d"]),
        ("A&&B &amp; &Save x& ", T.accelerator_tokens, ["&S", "&"]),
        ("第3頁 7", T.number_tokens, ["7"]),
        ("𠮷231", T.number_tokens, []),
        ("<b>x</b><foo>", T.tag_names, ["b", "b"]),
        ("&lt;&hellip;&nbsp;", T.entity_tokens, ["&lt;", "&nbsp;"]),
        (None, T.qt_tokens, []),
        ("a\nb\n", T.newline_count, 2),
        ("", T.newline_count, 0),
    ],
)
def test_extractors(spark, text, column, wanted):
    assert one(spark, text, column) == wanted


def test_bag_minus_is_a_multiset_difference(spark):
    rng = random.Random(1)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(6))], [rng.choice("abc") for _ in range(rng.randrange(6))]) for _ in range(200)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", F.expr(T.bag_minus_sql("a", "b")).alias("x")).collect()
    assert all(r.x == list((Counter(r.a) - Counter(r.b)).elements()) for r in got)  # tokens in first-seen order


def test_numbers_agree_with_python(spark):
    pattern, rng = re.compile(r"(?<![%\w])[-+]?\d+(?:[.,]\d+)?(?![%\w])"), random.Random(2)
    rows = [("".join(rng.choice("12%.,- aé𠮷第_+") for _ in range(14)),) for _ in range(500)]
    got = spark.createDataFrame(rows, "s string").select("s", T.number_tokens(F.col("s")).alias("x")).collect()
    assert all(r.x == pattern.findall(r.s) for r in got)


@pytest.mark.parametrize(("token", "wanted"), [("features", "feature"), ("boxes", "box"), ("queries", "query"), ("status", "status"), ("class", "class")])
def test_singular(spark, token, wanted):
    assert one(spark, token, terms.singular) == wanted


def test_canonical_is_the_singular_of_each_token(spark):
    rng = random.Random(5)
    rows = [(["".join(rng.choice("acehisuxyz") for _ in range(rng.randint(0, 4))) + rng.choice(["ies", "ches", "shes", "xes", "zes", "s", "ss", "us", "is", "a"]) for _ in range(rng.randint(0, 6))],) for _ in range(400)]
    got = spark.createDataFrame(rows, "t array<string>").select(terms.canonical(F.col("t")).alias("a"), F.transform("t", terms.singular).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_wilson(spark):
    rows = spark.createDataFrame([(5, 100), (0, 100), (0, 0)], "k int, n int").select(*stats.wilson(F.col("k"), F.col("n"))).collect()
    assert [tuple(round(100 * x, 4) for x in r) for r in rows] == [(2.1543, 11.1752), (0, 3.6995), (0, 0)]


def test_folding_and_splitting(spark):
    assert one(spark, "Straße &amp; Layers", terms.folded) == "strasse & layers"
    assert one(spark, "a | b；c;", terms.split_terms) == ["a", "b", "c"]
    assert one(spark, "nan", terms.split_terms) == [] and one(spark, " ; ", terms.split_terms) == [";"]
