"""Golden rows for text normalisation, sentence splitting and the two
amount extractors."""

import pytest
from pyspark.sql import functions as F

from lendframe.functions import text as T

BS = "\\"


def one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"v {typ}")
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("escape,replacement", [
    ("r", " "), ("n", " "), ("u2028", " "), ("t", " "), ("xa0", " "), ("u200b", " "),
    ("xad", ""), ("u2060", ""), ("u200e", " "), ("u200f", " "), (BS, " "), ("'", "'"),
])
def test_each_escape(spark, escape, replacement):
    got = one(spark, lambda c: T.normalize_text(c, lower=False), "a" + BS + escape + "b")
    want = ("a" + replacement + "b") if replacement != " " else "a b"
    assert got == want


def test_html_whitespace_trim_lower(spark):
    raw = "  <b>Hello</b> \t\u001cWorld <i>\nx</i>  <a\nhref>ÉTÉ "
    # the tag spanning a newline is not a tag ('.' does not cross newlines)
    got = one(spark, T.normalize_text, raw)
    assert got == "hello world x <a href>été"


def test_nested_tags_are_removed_innermost_first_non_greedy(spark):
    assert one(spark, T.normalize_text, "a<b<c>>d") == "a>d"


def test_null_stays_null(spark):
    assert one(spark, T.normalize_text, None) is None


def test_keep_case(spark):
    assert one(spark, lambda c: T.normalize_text(c, False), "Hello  World") == "Hello World"


def test_sentences_v2(spark):
    # "<br />" becomes a space, so ".<br />" is a sentence break too.
    got = one(spark, T.sentences_v2, "Needs 5 PHP.<br />Repays. Done.")
    assert got == ["Needs 5 PHP ", "Repays ", "Done. "]
    assert one(spark, T.sentences_v2, "a.b. c") == ["a.b ", "c "]


def test_sentences_v1_keeps_empty_pieces(spark):
    assert one(spark, T.sentences_v1, "a.b..") == ["a", "b", "", ""]


def amounts(spark, text, cur="PHP", version=2):
    df = spark.createDataFrame([(text, cur)], "t string, c string")
    fn = T.amounts_v2 if version == 2 else T.amounts_v1
    return df.select(fn(F.col("t"), F.col("c")).alias("a")).first()["a"]


@pytest.mark.parametrize("sentence,expected", [
    ("PHP 1,234,567 ", [1234567.0]),          # code, three groups
    ("PHP 12,345 ", [12345.0]),               # code, two groups
    ("PHP 123456789 ", [123456789.0]),        # code, plain digits
    ("PHP 1,234,567.50 ", [1234567.5]),       # code, three groups, decimals
    ("PHP 12,345.50 ", [12345.5]),            # code, two groups, decimals
    ("PHP 100.50 ", [100.5]),                 # code, plain digits, decimals
    ("x 1,234,567 PHP ", [1234567.0]),        # number then code
    ("x 12,345PHP ", [12345.0]),
    ("x 123456789 PHP ", [123456789.0]),
    ("x 1,234,567.50 PHP ", [1234567.5]),
    ("x 12,345.50 PHP ", [12345.5]),
    ("x 100.50 PHP ", [100.5]),
    ("PHP1 , 234 ", [1234.0]),                # spaces around the comma
    ("PHP 1234567890 ", []),                  # ten digits: no form fits
    ("PHP 12 PHP 34 ", [12.0, 34.0]),         # two amounts
    ("PHP 12 34 PHP ", [12.0]),               # the space after 12 is used up by the first match
    ("x 12 PHP 34 PHP ", [12.0, 34.0]),
    ("we are 12 people ", []),                # no code
    ("PHP 100.5 ", []),                       # one decimal digit: no match
])
def test_amount_v2_forms(spark, sentence, expected):
    assert amounts(spark, sentence) == expected


def test_amount_v1_takes_every_integer(spark):
    assert amounts(spark, " She asks for PHP 12,345 in 24 months", version=1) == [12345.0, 24.0]
    assert amounts(spark, " no currency 5", version=1) == []


def test_max_stated_amount_over_sentences(spark):
    df = spark.createDataFrame([("Needs 500 PHP. Was PHP 100.50 only", "PHP")], "t string, c string")
    got = df.select(T.max_stated_amount(T.sentences_v2(F.col("t")), F.col("c")).alias("m")).first()["m"]
    assert got == 500.0


def test_token_window_and_mask(spark):
    df = spark.createDataFrame([("a b c",)], "t string")
    r = df.select(T.token_window(T.words(F.col("t")), 5).alias("w"),
                  T.attention_mask(T.words(F.col("t")), 5).alias("m"),
                  T.token_window(T.words(F.col("t")), 2).alias("w2")).first()
    assert r["w"] == ["a", "b", "c", "", ""]
    assert r["m"] == [1, 1, 1, 0, 0]
    assert r["w2"] == ["a", "b"]


def test_amount_at_sentence_end_gets_its_trailing_space(spark):
    df = spark.createDataFrame([("Total PHP 100. Thanks", "PHP"), ("Total PHP 100", "PHP")], "t string, c string")
    got = [r["m"] for r in df.select(T.max_stated_amount(T.sentences_v2(F.col("t")), F.col("c")).alias("m")).collect()]
    assert got == [100.0, 100.0]


def test_amounts_by_the_marked_code_equal_those_by_its_own_pattern(spark):
    import random
    from lendframe.functions.fixed import AMOUNT_NUMBER_FORMS
    rng = random.Random(3)
    numbers = ["1,234,567", "12 , 345", "77", "1234567890", "1,234,567.25", "12, 345.50", "9.99", "1000.5", "3,4"]
    rows = []
    for i in range(3000):
        cur = rng.choice(["UGX", "KES", "USD", "AAA", "XAX", "ABAB", "usd", "E"])
        parts = [rng.choice([cur, cur + " ", " " + cur, rng.choice(numbers), " ", ". ", "x", "\x01", "\x02", cur[:2], cur[-1]]) for _ in range(rng.randint(1, 12))]
        rows.append((i, "".join(parts) + " ", cur))
    rows += [(9000 + k, f"{c}{n} or {n} {c} ", c) for k, (c, n) in enumerate((c, n) for c in ("KES", "XAX") for n in numbers)]
    df = spark.createDataFrame(rows, "i long, s string, c string")
    own = F.transform(F.regexp_extract_all("s", T.amount_pattern("c"), 0), lambda m: F.regexp_replace(m, "[^0-9.]", "").cast("double"))
    both = df.select("i", T.amounts_v2(F.col("s"), F.col("c")).alias("a"), F.when(F.contains(F.col("s"), F.col("c")), own).otherwise(
        F.array().cast("array<double>")).alias("b"))
    assert both.where("a <> b").count() == 0 and both.where("size(a) > 0").count() > 200
    assert len(AMOUNT_NUMBER_FORMS) == 6


def test_the_amount_search_sorts_nothing(spark):
    from conftest import SF_SMALL
    from lendframe.operators import amount as A
    from lendframe.sources import fixtures as fx
    plan = A.extract_local_amount(fx.loan(spark, SF_SMALL), version=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan
