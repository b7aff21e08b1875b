"""Rules on values: the ICAO specimen, edge cases of text, dates, comparisons, scores, files and faces."""

import datetime as dt
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docscreen.functions import dates, lookup, mrz, text
from docscreen.functions.register import register_functions
from docscreen.operators import classify, evaluate, extract, face, quality, reconcile, score, validate
from docscreen.plans import pipeline
from docscreen.sources import files, sinks

LINE1 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
LINE2 = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"


def one(spark, **cols):
    row = spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()
    return row[0] if len(cols) == 1 else row


def lit(s):
    return F.lit(s).cast("string")


@pytest.mark.parametrize(("value", "digit"), [("L898902C3", 6), ("740812", 2), ("120415", 9), ("", 0), ("<<<", 0)])
def test_check_digit(spark, value, digit):
    assert one(spark, a=mrz.check_digit(lit(value)), b=mrz.check_digit(lit(value), len(value) or 1)) == (digit, digit)


@settings(max_examples=15, deadline=None)
@given(place=st.integers(0, 8), other=st.sampled_from(mrz.VALUES))
def test_check_digit_sees_a_changed_digit(spark, place, other):
    before = "123456789"
    after = before[:place] + other + before[place + 1 :]
    same_value = (mrz.VALUES.index(other) - mrz.VALUES.index(before[place])) % 10 == 0
    a, b = one(spark, a=mrz.check_digit(lit(before)), b=mrz.check_digit(lit(after)))
    assert (a == b) == same_value


def test_specimen(spark):
    m = one(spark, m=mrz.parse(mrz.best_lines(lit(f"noise\n {LINE1}\n{LINE2.replace('UTO', '1UTO')}\n"))))
    assert (m.surname, m.given_name, m.passport_number, m.nationality) == ("ERIKSSON", "ANNA MARIA", "L898902C3", "UTO")
    assert (m.date_of_birth, m.date_of_expiry, m.gender, m.mrz_valid, m.mrz_validation_score) == ("1974-08-12", "2012-04-15", "F", True, 100.0)
    assert one(spark, m=mrz.parse(mrz.best_lines(lit("nothing")))) is None


def test_names(spark):
    assert one(spark, a=mrz.denoise_given(lit("LEE<KKKK<ANNAXX")), b=mrz.denoise_given(lit("LEE<KKKK<ANNAXX"), strict=True)) == ("L ANNA", "LEE ANNAXX")
    assert one(spark, a=mrz.denoise_given_legacy(lit("anna KKKKKKK")), b=mrz.denoise_given_legacy(lit("KKKKKKK")), c=mrz.denoise_given_legacy(lit(None))) == ("ANNA", "KKKKKKK", None)


@pytest.mark.parametrize(
    ("raw", "iso"),
    [("2020-02-31", "2020-02-31"), ("31/12/1999", "1999-12-31"), ("1.2.2003", "2003-02-01"), ("1999/1/2", "1999-01-02"), ("22MAY2023", "2023-05-22"), ("3 jan 49", "2049-01-03"), ("3 jan 50", "1950-01-03"), ("740812", "1974-08-12"), ("741399", None), ("31/02/2020", "31/02/2020"), ("n/a", None), ("", None), (None, None), ("soon", "SOON")],
)
def test_dates(spark, raw, iso):
    assert one(spark, a=dates.iso_or_null(lit(raw))) == iso


def test_dates_are_idempotent(spark):
    assert one(spark, a=dates.iso_or_null(dates.iso_or_null(lit("5/6/2007")))) == "2007-06-05"


def test_text(spark):
    assert one(spark, a=text.normalize_ocr(lit("  a   b \n\n\t\n c")), b=text.union_passes(lit(" x "), lit(None), lit(""), lit("y"))) == ("a b\nc", "x\n\ny")
    assert one(spark, a=text.find_first(lit("No: 12"), ["(zz)", "No: *([0-9]+)"]), b=text.find_first(lit("q"), ["(z)"])) == ("12", None)
    assert one(spark, a=text.full_name(lit("A"), lit(None)), b=text.full_name(lit(""), lit("B")), c=text.full_name(lit("A"), lit("B"))) == ("A", "B", "A B")
    assert one(spark, a=text.mask_id(lit("1234 5678 9012")), b=text.mask_id(lit("abcdef")), c=text.mask_id(lit("abc")), d=text.mask_id(lit(None))) == ("XXXX-XXXX-9012", "abXXef", "XXXX", None)
    assert one(spark, a=text.clean_engine_text(lit(" a \r\n\n b\t c ")), b=text.strip_filler(lit("AB<C<<")), c=text.full_name_skipping(lit(" "), lit("X"))) == ("a \n b c", "AB C", "X")


@settings(max_examples=10, deadline=None)
@given(st.text("0123456789 ", min_size=5, max_size=20))
def test_mask_shows_four_digits_at_most(spark, value):
    masked = one(spark, a=text.mask_id(lit(value)))
    assert sum(c.isdigit() for c in masked) <= 4


@pytest.mark.parametrize(("words", "label"), [("", "UNKNOWN"), ("ADVISABLE", "UNKNOWN"), ("a visa", "VISA"), ("TRAVEL DOCUMENT and PERMIT", "PERMIT"), ("visa, identity card", "NATIONAL_ID"), ("Republic of X", "PASSPORT"), ("government of india enrolment", "NATIONAL_ID"), ("government of india", "UNKNOWN")])
def test_classifier(spark, words, label):
    assert one(spark, a=classify.classify(lit(words))) == label


def test_detector_needs_no_word(spark):
    assert one(spark, a=classify.classify(lit("ADVISABLE"), "legacy_detector"), b=classify.route(lit("Residence card"))) == ("VISA", "permit")


def test_lookup(spark):
    assert one(spark, a=lookup.gender(lit("femme")), b=lookup.gender(lit("q")), c=lookup.gender(lit("both")), d=lookup.country_code(lit("Utopia")), e=lookup.nationality(lit(" france"))) == ("F", "Q", None, "UTO", "FRENCH")


def test_comparison(spark):
    s = lit("SEX F JONES 1974")
    c = lambda f, m, v: reconcile.compare_live(f, lit(m), lit(v), s)
    got = one(spark, a=c("surname", None, ""), b=c("surname", "JONES", None), c=c("surname", "SMITH", None), d=c("surname", None, "X"), e=c("surname", "ANNA LEE", "LEE ANN"), f=c("gender", "M", "F"), g=c("date_of_birth", "1974-08-12", None), h=c("date_of_birth", "1999-01-01", "02/02/2002"), i=c("nationality", "USA", None))
    assert tuple(got) == ("BOTH_MISSING", "MATCH", "MISSING_OCR", "MISSING_MRZ", "MATCH", "DIFFERENT", "MATCH", "DIFFERENT", "DIFFERENT")


def test_scores(spark):
    got = one(spark, a=score.confidence_combiner([F.lit(None).cast("boolean")], F.lit(50.0)), b=score.level(F.lit(80.0), "passport"), c=score.level(F.lit(79.99), "passport"), d=score.completeness("permit", F.lit(2)))
    assert tuple(got) == (0, "HIGH", "MEDIUM", 66.67)


def test_passport_record(spark):
    raw = f"PASSPORT\nSurname\nERIKSSON\nGiven Names\nANNA MARIA\nSex F\nDate of Birth 12/08/1974\nDate of Issue 16/04/2007\nDate of Expiry 15/04/2012\n{LINE1}\n{LINE2}"
    r = pipeline.screen(spark.createDataFrame([(1, raw), (2, None), (3, "")], "id int, raw_text string")).orderBy("id").collect()
    assert (r[0].document_type, r[0].status, r[0].identity.full_name, r[0].document.date_of_issue) == ("PASSPORT", "VERIFIED", "ANNA MARIA ERIKSSON", "2007-04-16")
    assert r[0].verification.mrz_valid and not r[0].manual_review_required and r[0].error_codes == []
    assert [x.document_type for x in r[1:]] == ["UNKNOWN", "UNKNOWN"] and r[1].manual_review_reasons[0] == "Overall confidence score is low (20.0%)"


def test_line_windows_agree_with_window_functions(spark):
    raw = "a\nKEY\nb\nc\nKEY\nd"
    ls = text.lines(lit(raw))
    by_arrays = one(spark, a=extract.indices(ls, lambda s: s == "KEY"), b=extract.above(ls, extract.indices(ls, lambda s: s == "KEY"), 3, lambda s: s != "KEY"))
    from pyspark.sql import Window

    rows = spark.range(1).select(F.posexplode(ls)).withColumn("before", F.lag("col").over(Window.orderBy("pos"))).where("col = 'KEY'").orderBy("pos").collect()
    assert by_arrays[0] == [r.pos for r in rows] and by_arrays[1] == rows[0].before


def test_evaluation(spark):
    truth = spark.createDataFrame([("f", "document_type", "X"), ("f", "name", "ANNA"), ("f", "number", "1"), ("g", "name", "B")], "filename string, field string, value string")
    predicted = spark.createDataFrame([("f", "name", "anna "), ("f", "number", "")], "filename string, field string, value string")
    compared = evaluate.compare(truth, predicted)
    assert {(r.filename, r.field): (r.is_match, r.cer) for r in compared.collect()} == {("f", "name"): (True, 0.0), ("f", "number"): (False, 100.0), ("g", "name"): (False, 100.0)}
    docs = spark.createDataFrame([("f", "X", "X", 10.0, True), ("g", "X", None, None, None)], "filename string, true_type string, document_type string, elapsed_ms double, review boolean")
    c = evaluate.corpus(evaluate.per_document(compared, docs)).first()
    assert (c.classification_accuracy_pct, c.field_accuracy_pct, c.manual_review_rate_pct, c.evaluated_documents, c.evaluated_accuracy_pct) == (50.0, 33.33, 50.0, 1, 100.0)


def bmp(width, height, gray):
    row = bytes([gray] * 3) * width
    row += b"\0" * (-len(row) % 4)
    size = 54 + len(row) * height
    return b"BM" + struct.pack("<IHHI", size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(row) * height, 0, 0, 0, 0) + row * height


def test_files_and_images(spark, tmp_path):
    (tmp_path / "a.bmp").write_bytes(bmp(8, 6, 255))
    (tmp_path / "b.PNG").write_bytes(b"not an image")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {r.path[-5:]: r for r in validate.validate_files(files.read_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.bmp", "b.PNG"} and got["a.bmp"].is_valid and got["b.PNG"].error == "ERR_MALICIOUS_PAYLOAD" and len(got["a.bmp"].file_hash) == 64
    s = quality.with_stats(files.read_images(spark, f"{tmp_path}/a.bmp")).first()
    assert (s.laplacian, s.brightness, s.glare, s.width, s.height) == (0.0, 255.0, 100.0, 8, 6)
    r = spark.range(1).select(quality.report(*[F.lit(x) for x in (s.laplacian, s.brightness, s.contrast, s.glare, s.width, s.height)]).alias("r")).first().r
    assert (r.quality_score, r.blur_status, r.is_acceptable, len(r.warnings)) == (20.0, "BLURRY", False, 2)


def test_strict_files(spark):
    rows = spark.createDataFrame([("/a.webp", 9, b"RIFF1234AVI "), ("/b.jpg", 9, b"BM123456"), ("/c.webp", 12, b"RIFF1234WEBP")], "path string, length long, content binary")
    assert [r.is_valid for r in validate.validate_files(rows).collect()] == [True, True, True]
    assert [r.is_valid for r in validate.validate_files(rows, strict=True).collect()] == [False, False, True]


def test_json_truth_and_sinks(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"a.jpg": {"document_type": "VISA", "name": "X"}}')
    (tmp_path / "bad.json").write_text("{")
    assert {tuple(r) for r in files.read_truth(spark, f"{tmp_path}/t.json").collect()} == {("a.jpg", "document_type", "VISA"), ("a.jpg", "name", "X")}
    assert files.read_json(spark, f"{tmp_path}/bad.json", "a string").first().a is None
    with pytest.raises(Exception):  # noqa: B017
        files.read_json(spark, f"{tmp_path}/bad.json", "a string", strict=True).collect()
    r = spark.createDataFrame([("123456789012", 1)], "id_number string, n int").select("id_number", F.struct(F.col("id_number").alias("vid")).alias("s"))
    sinks.write_records(r, f"{tmp_path}/out", masked=True)
    assert spark.read.json(f"{tmp_path}/out").first().s.vid == "XXXX-XXXX-9012"


def test_boxes_stay_inside(spark):
    b = spark.createDataFrame([(0, 0, 10, 10), (395, 290, 30, 40), (5, 5, 0, 0)], "x int, y int, w int, h int").select(face.pad_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(400), F.lit(300)).alias("b"))
    got = b.select("b.*", face.has_area(F.col("b"))).collect()
    assert all(0 <= r.x1 and r.x2 <= 400 and 0 <= r.y1 and r.y2 <= 300 for r in got) and [r[4] for r in got] == [True, True, False]


def test_backends(spark):
    none = F.lit(None).cast("struct<x:int,y:int,w:int,h:int>")
    flat = F.struct(F.lit(1).alias("x"), F.lit(1).alias("y"), F.lit(0).alias("w"), F.lit(5).alias("h"))
    got = one(spark, a=face.first_backend([("m", none), ("r", flat)], F.lit(40), F.lit(30)), b=face.first_backend([("m", none)], F.lit(40), F.lit(30)))
    assert (tuple(got.a), got.b.backend) == ((0, 0, 40, 30, "r"), "fallback_full_image")


def test_blinks(spark):
    ears = [0.1, 0.1, 0.3, 0.1, 0.3, 0.1, None, 0.1, 0.3, 0.1, 0.1]
    rows = [(1, dt.datetime(2024, 1, 1, 0, 0, i), 0.0 if e is None else e, e is not None) for i, e in enumerate(ears)]
    f = spark.createDataFrame(rows, "session_id long, ts timestamp, ear double, has_face boolean")
    assert [r.ts.second for r in face.blinks(f).orderBy("ts").collect()] == [2, 8]
    assert face.liveness(f).first().captured_at.second == 2


def test_match_of_missing_vectors(spark):
    none = F.lit(None).cast("array<float>")
    m = one(spark, m=face.match(none, none, 0.5))
    assert (m.status, m.risk_score, m.is_match) == ("ERROR", 50, False)


def test_sql_functions(spark):
    register_functions(spark)
    r = spark.sql("SELECT mrz_check_digit('L898902C3') a, mrz_check_digit('') b, mask_id('1234 5678 9012') c, mrz_date('740812', 40) d, viz_tokens('a-b') e, clean_mrz_line(' p<|x ') f").first()
    assert tuple(r) == (6, 0, "XXXX-XXXX-9012", "1974-08-12", "A B", "P<<X")
    assert spark.sql(f"SELECT kind FROM mrz_candidates('{LINE1}\\n{LINE2}\\nshort')").count() == 2
