"""Golden tables of the scalar functions, and the portable patterns on several scripts."""

import re

import pytest
from pyspark.sql import functions as F

from formloom.functions import geometry as G
from formloom.functions import normalise as N
from formloom.functions import patterns as P
from formloom.functions.script import detect_script
from formloom.operators import templates


def col(spark, values, f, **more):
    rows = [(k, *v) if isinstance(v, tuple) else (k, v) for k, v in enumerate(values)]
    names = ["k", *"abc"[: len(rows[0]) - 1]]
    return [r.out for r in spark.createDataFrame(rows, names).select("k", f.alias("out")).orderBy("k").collect()]


def test_dates(spark):
    given = ["14/03/2024", "14-03-24", "2024.03.14", "03/25/2024", "14 March 2024", "March 14, 2024", "१४/०३/२०२४", "14 मार्च 2024", "١٤/٠٣/٢٠٢٤", "someday", "31/02/2024", "14th Marzo, 2024", "", None, "14/03/45"]
    want = ["2024-03-14", "2024-03-14", "2024-03-14", "2024-03-25", "2024-03-14", "2024-03-14", "2024-03-14", "2024-03-14", "2024-03-14", "someday", "2024-02-31", "2024-03-14", "", "", "1945-03-14"]
    assert col(spark, given, N.normalise_date(F.col("a"))) == want


def test_numbers(spark):
    given = [("12,500.00", "Amount"), ("₹ 1,20,000", "Total"), ("12,50", "Price"), ("1.234.567,89", "Betrag"), ("+91 98765-43210", "Mobile No."), ("(022) 2345 6789", "Phone"), ("९८७६५४३२१०", "मोबाइल नंबर"), ("abc", "Qty"), ("", "Qty"), ("1+2+3", "tel"), ("12.", "Qty")]
    want = ["12500.00", "120000", "12.50", "1234567.89", "+919876543210", "02223456789", "9876543210", "abc", "", "+123", "12"]
    assert col(spark, given, N.normalise_number(F.col("a"), F.col("b"))) == want


def test_checkbox_and_choice(spark):
    assert col(spark, ["☑", "हाँ", "", "☐", "Yes ", "maybe", None], N.normalise_checkbox(F.col("a"))) == ["true", "true", "false", "false", "true", "maybe", "false"]
    options = F.array(F.lit("Male"), F.lit("Female"), F.lit("Other"))
    assert col(spark, ["☑ female", "fem", "", "x?"], N.normalise_choice(F.col("a"), options, False)) == ["Female", "Female", "", "x?"]


def test_labels_values_and_titles(spark):
    assert col(spark, [" 2) Father's Name :____ ", "जन्म तिथि:", "Name ( )"], N.show_label(F.col("a"))) == ["Father's Name", "जन्म तिथि", "Name"]
    assert col(spark, ["  2) Father's Name :__ ", "पता:", "• Ｎａｍｅ：", "(iv) Age"], N.match_label(F.col("a"))) == ["father's name", "पता", "name", "age"]
    kinds = [("________", "text"), ("  John@Example.COM ", "text"), ("x", "signature"), ("14/03/2024", "date"), ("1,000", "number")]
    assert col(spark, kinds, N.normalise_value(F.col("a"), F.col("b"), F.lit(""), F.array().cast("array<string>"), False)) == ["", "john@example.com", "", "2024-03-14", "1000"]
    assert col(spark, ["date of birth", "father's name", "e-mail", "PAN", "Full Name", "जन्म तिथि", "Date Of Birth"], N.title_case(F.col("a"))) == ["Date of Birth", "Father's Name", "E-Mail", "PAN", "Full Name", "जन्म तिथि", "Date of Birth"]


def test_fields_keep_raw_and_mark_unread_dates(spark):
    rows = [("f_1", "q", "DOB:", "जन्म तिथि:", "date", "14/03/2024", [], False), ("f_2", "q", "Date", "Date", "date", "next monday", ["a "], False)]
    f = spark.createDataFrame(rows, "field_id string, question string, label string, original_label string, type string, value string, options array<string>, needs_review boolean")
    a, b = N.normalise_fields(f).orderBy("field_id").collect()
    assert (a.value, a.raw_value, a.label, a.original_label, a.needs_review) == ("2024-03-14", "14/03/2024", "DOB", "जन्म तिथि", False)
    assert b.needs_review and b.options == ["a"]


def test_scripts_and_digits(spark):
    assert col(spark, ["नाम", "12 Name", "氏名", "...", "имя", "한글", ""], detect_script(F.col("a"))) == ["devanagari", "latin", "cjk", "unknown", "cyrillic", "hangul", "unknown"]
    assert col(spark, ["१२३٤٥٦"], N.ascii_digits(F.col("a"))) == ["123456"]


PROBES = ["Name:", "Name：", "____", "...", "– – –", "☐", "[x]", "( )", "☐ Yes", "नाम", "نموذج", "表格", "12/03/2024", "AB-12/x", "१२", "Page 3", "page 3 of 9", "é", "||", "l1I", "_", "?!", "Please fill", "कृपया भरें", "por favor"]


@pytest.mark.parametrize("name", ["COLON_END", "BLANK_LINE", "BOX_TOKEN", "GLUED", "VALUE_LIKE", "NOISE", "PAGE_NUMBER"])
def test_patterns_agree_with_python(spark, name):
    pattern = getattr(P, name)
    ours = re.compile(pattern.replace(r"\p{Nd}", r"\d").replace(r"[^\p{L}\p{N}_\s]", r"[^\w\s]").replace(r"\p{L}\p{N}_", r"\w"))
    assert col(spark, PROBES, F.col("a").rlike(pattern)) == [bool(ours.search(p)) for p in PROBES]


def test_keywords_stand_alone(spark):
    given = ["Application Form", "information", "APPLICATION", "آ نموذج ب", "please fill", "unfilled"]
    assert col(spark, given, F.col("a").rlike(P.any_word(P.TITLE_WORDS))) == [True, False, True, True, False, False]
    assert col(spark, given, F.col("a").rlike(P.any_word(P.INSTRUCTION_WORDS))) == [False, False, False, False, True, False]


def test_boxes(spark):
    b = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 10.0, 10.0), (0.0, 0.0, 1.0, 1.0, 2.0, 2.0, 1.0, 1.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    got = [r.v for r in b.select(G.iou([F.col(x) for x in "abcd"], [F.col(x) for x in "efgh"]).alias("v")).collect()]
    assert got == [pytest.approx(25 / 175), 0.0]


MATCHES = [
    ("Date of Birth:", "date_of_birth"), ("DOB", "date_of_birth"), ("जन्म तिथि", "date_of_birth"), ("Fecha de nacimiento", "date_of_birth"), ("出生日期", "date_of_birth"), ("تاريخ الميلاد", "date_of_birth"),
    ("Name", "full_name"), ("नाम", "full_name"), ("氏名", "full_name"), ("1. Mobile No.:", "mobile"), ("E-Mail", "email"), ("Signature of Applicant", "signature"), ("हस्ताक्षर", "signature"), ("Firma", "signature"),
    ("Gender", "gender"), ("PIN Code", "postal_code"), ("Date of Birth (DD/MM/YYYY)", "date_of_birth"), ("जन्म ताथी", "date_of_birth"), ("Date of Brith", "date_of_birth"), ("Adress", "address"), ("पनि कोड", "postal_code"),
    ("Please attach two passport-size photographs. Use black ink only.", None), ("", None),
]


def test_template_matches(spark):
    labels = spark.createDataFrame([(a,) for a, _ in MATCHES] + [("Только для служебного пользования",)], "label string")
    got = {r.label: r for r in templates.match(labels, templates.catalogue(spark)).collect()}
    assert {a: got[a].key for a, _ in MATCHES} == dict(MATCHES)
    assert got["Только для служебного пользования"].key != "gender"
    assert all(got[a].strength >= 0.45 for a, k in MATCHES if k)


def test_questions(spark):
    c = spark.createDataFrame([("Expected Salary", "", False), ("Hobbies ☐", "", True), ("Gender", "", False), ("Name", "", True)], "label string, value string, has_box boolean")
    got = {r.label: r for r in templates.questions(c, templates.catalogue(spark)).collect()}
    assert got["Expected Salary"].template_key is None and "Expected Salary" in got["Expected Salary"].question
    assert got["Hobbies ☐"].type == "checkbox" and got["Gender"].options == ["Male", "Female", "Other"] and got["Name"].type == "checkbox"
