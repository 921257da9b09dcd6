"""
each on hand-made rows."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from lendframe.functions.fixed import CATEGORY_VARIABLES_9, CATEGORY_VARIABLES_10
from lendframe.operators import amount as A
from lendframe.operators import category as C
from lendframe.operators import tags as TAGS
from lendframe.sources import files as FILES

CAT_SCHEMA = ("LOAN_ID long, ORIGINAL_LANGUAGE string, SECTOR_NAME string, ACTIVITY_NAME string, "
              "COUNTRY_CODE string, COUNTRY_NAME string, TOWN_NAME string, CURRENCY_POLICY string, "
              "CURRENCY_EXCHANGE_COVERAGE_RATE double, CURRENCY string, REPAYMENT_INTERVAL string, "
              "DISTRIBUTION_MODEL string")


def cat_rows(spark, rows):
    return spark.createDataFrame(rows, CAT_SCHEMA)


def test_n1_csv_null_tokens_in_every_column(spark, scratch):
    path = os.path.join(scratch, "loans.csv")
    header = FILES.LOAN_COLUMNS
    row = {c: "x" for c in header}
    row.update({"LOAN_ID": "7", "LOAN_AMOUNT": "250.0", "IMAGE_ID": "9", "COUNTRY_CODE": "NA",
                "COUNTRY_NAME": "Kenya", "TOWN_NAME": "", "CURRENCY_POLICY": "n/a",
                "CURRENCY_EXCHANGE_COVERAGE_RATE": "nan", "TAGS": "#Parent, #Elderly",
                "DESCRIPTION": "line one\nline two, \"quoted\""})
    row2 = dict(row, LOAN_ID="8", LOAN_AMOUNT="NULL", COUNTRY_CODE="KE", CURRENCY_EXCHANGE_COVERAGE_RATE="0.1")
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, fieldnames=header)
        w.writeheader()
        w.writerow(row)
        w.writerow(row2)
    got = {r["LOAN_ID"]: r for r in FILES.read_loans_csv(spark, path).collect()}
    a, b = got[7], got[8]
    assert a["COUNTRY_CODE"] is None            # the code "NA" is a null token
    assert a["TOWN_NAME"] is None and a["CURRENCY_POLICY"] is None
    assert a["CURRENCY_EXCHANGE_COVERAGE_RATE"] is None
    assert a["LOAN_AMOUNT"] == 250.0 and a["IMAGE_ID"] == 9
    assert a["DESCRIPTION"] == 'line one\nline two, "quoted"'   # multi-line field
    assert b["COUNTRY_CODE"] == "KE" and b["LOAN_AMOUNT"] is None
    assert b["CURRENCY_EXCHANGE_COVERAGE_RATE"] == 0.1


def test_n2_composite_is_null_if_any_part_is(spark):
    df = spark.createDataFrame([("A", None), ("A", "B")], "SECTOR_NAME string, ACTIVITY_NAME string")
    got = [r[0] for r in df.select(C.composite(["SECTOR_NAME", "ACTIVITY_NAME"])).collect()]
    assert got == [None, "A > B"]


def test_n3_missing_rate_is_the_text_nan(spark):
    df = spark.createDataFrame([("shared", None), (None, 0.1), ("shared", 0.0)],
                               "CURRENCY_POLICY string, CURRENCY_EXCHANGE_COVERAGE_RATE double")
    parts = ["CURRENCY_POLICY", "CURRENCY_EXCHANGE_COVERAGE_RATE"]
    got = [r[0] for r in df.select(C.composite(parts)).collect()]
    assert got == ["shared > nan", None, "shared > 0.0"]


def _loan(i, country_name, town="T", lang="English"):
    return (i, lang, "Food", "Bakery", "KE", country_name, town, "shared", 0.1, "KES", "monthly", "direct")


def test_n4_n5_null_values_get_an_id_and_unseen_values_get_zero(spark):
    train = cat_rows(spark, [_loan(1, None), _loan(2, "Kenya"), _loan(3, None)])
    d = C.fit_dictionary(train, num_partitions=4)
    rows = d.collect()
    ids = sorted(r["id"] for r in rows)
    assert ids == list(range(1, len(rows) + 1))
    # "KE" + null is null as a whole, and that null is a value with its own id
    null_name = [r for r in rows if r["variable"] == "COUNTRY_CODE > COUNTRY_NAME" and r["value"] is None]
    assert len(null_name) == 1
    null_country = [r for r in rows if r["variable"] == "COUNTRY_CODE > COUNTRY_NAME > TOWN_NAME"
                    and r["value"] is None]
    assert len(null_country) == 1
    assert len([r for r in rows if r["variable"] == "COUNTRY_CODE > COUNTRY_NAME"]) == 2
    test = cat_rows(spark, [_loan(4, None), _loan(5, "Kenya", lang="Klingon")])
    enc = {(r["LOAN_ID"], r["variable"]): r["id"] for r in C.encode_long(test, d).collect()}
    assert enc[(4, "COUNTRY_CODE > COUNTRY_NAME > TOWN_NAME")] == null_country[0]["id"]
    assert enc[(5, "ORIGINAL_LANGUAGE")] == 0
    assert all(v > 0 for (k, var), v in enc.items() if not (k == 5 and var == "ORIGINAL_LANGUAGE"))


def test_ids_are_ordered_by_variable_then_first_appearance(spark):
    train = cat_rows(spark, [_loan(5, "B", lang="Spanish"), _loan(2, "A", lang="French"),
                             _loan(9, "A", lang="English")])
    d = {(r["variable"], r["value"]): r["id"] for r in C.fit_dictionary(train, num_partitions=3).collect()}
    assert d[("ORIGINAL_LANGUAGE", "French")] == 1    # LOAN_ID 2 is the first
    assert d[("ORIGINAL_LANGUAGE", "Spanish")] == 2
    assert d[("ORIGINAL_LANGUAGE", "English")] == 3
    assert d[("SECTOR_NAME", "Food")] == 4
    assert max(d.values()) == len(d)


def test_nine_variable_family_merges_policy_and_rate(spark):
    train = cat_rows(spark, [_loan(1, "A")])
    vars_ = {r["variable"] for r in C.fit_dictionary(train, CATEGORY_VARIABLES_9).collect()}
    assert vars_ == set(CATEGORY_VARIABLES_9)
    assert "CURRENCY_POLICY" not in vars_ and len(CATEGORY_VARIABLES_10) == 10


def test_wide_columns_are_in_alphabetical_variable_order(spark):
    train = cat_rows(spark, [_loan(1, "A")])
    wide = C.encode_wide(train, C.fit_dictionary(train))
    names = [C.column_name(v) for v in sorted(CATEGORY_VARIABLES_10)]
    assert wide.columns == ["LOAN_ID"] + names


def test_n6_missing_tags_are_the_tag_na(spark):
    df = spark.createDataFrame([(1, None), (2, " #Parent,#parent , user_favorite")], "LOAN_ID long, TAGS string")
    rows = {r["LOAN_ID"]: r for r in TAGS.onehot(df).collect()}
    assert rows[1]["tag_na"] == 1.0 and rows[1]["tag_parent"] == 0.0
    assert rows[2]["tag_parent"] == 1.0 and rows[2]["tag_user_favorite"] == 1.0 and rows[2]["tag_na"] == 0.0
    assert sum(v for k, v in rows[2].asDict().items() if k.startswith("tag_")) == 2.0


def test_n8_zero_rate_gives_no_amount(spark):
    local = spark.createDataFrame([(1, "KES", 100.0), (2, "PHP", 50.0), (3, "XOF", 10.0)],
                                  f"LOAN_ID long, CURRENCY string, {A.LOCAL} double")
    rate = spark.createDataFrame([("KES", 0.0), ("PHP", 50.0)], "CURRENCY string, rate double")
    got = {r["LOAN_ID"]: r[A.DESC] for r in A.convert_usd(local, rate).collect()}
    assert got == {1: None, 2: 1.0, 3: None}


def test_n7_median_skips_missing_amounts(spark):
    local = spark.createDataFrame(
        [(1, "KES", 110.0, 1.0), (2, "KES", None, 1.0), (3, "KES", 330.0, 1.0), (4, "KES", 220.0, None)],
        f"LOAN_ID long, CURRENCY string, {A.LOCAL} double, LOAN_AMOUNT double")
    got = A.median_rate(local, num_partitions=2).collect()
    assert [(r["CURRENCY"], r["rate"]) for r in got] == [("KES", 220.0)]


@pytest.mark.parametrize("translated,original,expected", [
    (None, None, None),
    (None, "Pide KES 5000 ", 5000.0),
    ("No amount", "Pide KES 5000 ", None),
])
def test_n10_missing_text_yields_no_amount(spark, translated, original, expected):
    df = spark.createDataFrame([(1, "KES", translated, original)],
                               "LOAN_ID long, CURRENCY string, DESCRIPTION_TRANSLATED string, DESCRIPTION string")
    assert A.extract_local_amount(df, version=2).first()[A.LOCAL] == expected


def test_approximate_median_option_is_close(spark):
    from conftest import SF_ORACLE
    from lendframe.sources import fixtures as fx
    local = A.extract_local_amount(fx.loan(spark, SF_ORACLE), version=2, keep=["LOAN_AMOUNT"])
    exact = {r["CURRENCY"]: r["rate"] for r in A.median_rate(local).collect()}
    approx = {r["CURRENCY"]: r["rate"] for r in A.median_rate(local, approx_accuracy=100000).collect()}
    assert set(exact) == set(approx)
    for c, v in exact.items():
        assert abs(approx[c] - v) <= 0.01 * abs(v)
