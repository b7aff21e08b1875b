"""The query catalogue: every registered query over the driver's tables; ``oracles`` has its DuckDB twins."""

from __future__ import annotations

from inspect import isfunction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, lookup, mrz, text
from ..operators import classify, evaluate, extract, face, legacy, quality, reconcile, score, validate
from ..sources import sinks, variants
from ..sources.shared import written
from . import fixtures, oracles, oracles_legacy, oracles_screening, pipeline


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.frame(spark, d, fixtures.TEXT, "texts")


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.frame(spark, d, fixtures.MRZ, "mrz")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).transform(pipeline.with_text).transform(pipeline.with_type)


def _screened(spark: SparkSession, d: str) -> DataFrame:
    return written(spark, f"{d}|screened", [f"{d}/customer.parquet"], lambda: pipeline.screen(_texts(spark, d)))


# --- machine-readable zone -------------------------------------------------


def mrz_check_digits(spark, d):
    number = F.substring("line2", 1, 9)
    return _zones(spark, d).select("doc_id", number.alias("number"), mrz.check_digit(number).alias("by_fold"), mrz.check_digit(number, 9).alias("by_sum"), mrz.check_digit(F.substring("line2", 14, 6)).alias("birth_digit"))


def mrz_composite(spark, d):
    line = mrz.normalize_line2("line2")
    return _zones(spark, d).select("doc_id", line.alias("line")).select("doc_id", mrz.check_digit(mrz.composite_data(F.col("line"))).alias("composite"), F.substring("line", 44, 1).alias("given"))


def mrz_line2_repair(spark, d):
    return _zones(spark, d).select("doc_id", mrz.normalize_line2("line2").alias("line"), mrz.normalize_line1("line1").alias("first"))


def _parsed(spark, d, variant=mrz.LIVE):
    lines = mrz.best_lines(F.concat_ws("\n", F.lit("noise"), "line1", "line2", F.lit("P<XXX")), variant)
    return _zones(spark, d).select("doc_id", "code", lines.alias("lines")).select("doc_id", "code", "lines", mrz.parse(F.col("lines"), variant).alias("m"))


def mrz_validity_by_nation(spark, d):
    return _parsed(spark, d).where("m is not null").groupBy("m.nationality", "m.mrz_valid").agg(F.count("*").alias("n"), F.round(F.avg("m.mrz_validation_score"), 4).alias("avg_score"))


def mrz_best_candidate(spark, d):
    one, two = mrz.candidates(F.concat_ws("\n", F.lit("noise"), "line1", "line2", F.lit("P<XXX<<SHORT<NAME<<<<<<<")))
    return _zones(spark, d).select("doc_id", F.array_max(one).alias("a"), F.array_max(two).alias("b")).select("doc_id", F.col("a.line").alias("line1"), F.col("b.line").alias("line2"), F.col("a.score").alias("score1"), F.col("b.score").alias("score2"))


def mrz_full_parse(spark, d):
    return _parsed(spark, d).select("doc_id", *[F.col(f"m.{k}").alias(k) for k in ("surname", "given_name", "passport_number", "nationality", "date_of_birth", "gender", "date_of_expiry", "valid_passport_number", "valid_date_of_birth", "valid_date_of_expiry", "valid_composite_check", "mrz_valid", "mrz_validation_score")])


def mrz_name_denoise(spark, d):
    names = F.concat_ws("<", "given1", "given2", F.concat(F.lit("KEX"), "given1"), F.lit("KKKC"), F.lit("AABAB"), F.concat("family", F.lit("XK")))
    return _zones(spark, d).select("doc_id", mrz.denoise_given(names).alias("live"), mrz.denoise_given_legacy(F.translate(names, "<", " ")).alias("legacy"))


def mrz_legacy_variant(spark, d):
    p = _parsed(spark, d, mrz.LEGACY).where("lines is not null")
    p = p.withColumn("formats", mrz.format_checks(F.col("lines"))).withColumn("v", mrz.legacy_validity(F.col("formats"), F.col("m")))
    return p.select("doc_id", F.col("m.date_of_birth").alias("birth"), F.col("v.confidence").alias("confidence"), F.col("v.mrz_valid").alias("mrz_valid"), *[F.col(f"formats.{k}").alias(f"ok_{k}") for k in mrz.FORMATS])


# --- classification and routing --------------------------------------------


def _labels(spark, d):
    a = _texts(spark, d).select("doc_id", text.normalize_ocr("raw_text").alias("t"))
    return a.unionAll(_table(spark, d, "documents").select((-F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("t")))


def classify_live(spark, d):
    return _labels(spark, d).select("doc_id", classify.classify("t").alias("label"))


def classify_legacy_engine(spark, d):
    return _labels(spark, d).select("doc_id", classify.classify("t", "legacy_engine").alias("label"))


def classify_legacy_detector(spark, d):
    return _labels(spark, d).select("doc_id", classify.classify("t", "legacy_detector").alias("label"))


def route_types(spark, d):
    return _typed(spark, d).groupBy("truth_type", "processor").agg(F.count("*").alias("n"))


# --- extraction ------------------------------------------------------------


def _fields(kind):
    def query(spark, d):
        docs = _typed(spark, d).where(F.col("processor") == kind)
        docs = extract.licence(docs) if kind == "licence" else getattr(extract, kind)(docs)
        return docs.select("doc_id", *[F.col(f"f_{k}").alias(k) for k in oracles.EXTRACTED[kind]])

    return query


extract_visa, extract_permit, extract_travel, extract_licence, extract_national_id = (_fields(k) for k in ("visa", "permit", "travel", "licence", "national_id"))


def extract_passport_visual(spark, d):
    docs = extract.passport_visual(_typed(spark, d).where("processor = 'passport'"))
    return docs.select("doc_id", *[F.col(f"v_{k}").alias(k) for k in ("passport_number", "surname", "given_name", "nationality", "gender", "date_of_birth", "date_of_issue", "date_of_expiry", "place_of_birth", "place_of_issue")])


def line_window_above(spark, d):
    ls = text.lines("raw_text")
    at = extract.indices(ls, lambda s: s.rlike("DOB|Date of Birth"))
    return _texts(spark, d).select("doc_id", extract.above(ls, F.slice(at, 1, 1), 3, lambda s: s.rlike("[A-Z]")).alias("nearest"))


def line_state_machine(spark, d):
    ls = text.lines("raw_text")
    out = extract.between(ls, lambda s: s.startswith("VTC") | s.startswith("Sex"), lambda s: s.rlike("PIN|Birth"), lambda s: s.startswith("Mobile"), 5)
    return _texts(spark, d).select("doc_id", out.alias("stretch"))


# --- text ------------------------------------------------------------------


def ocr_normalize(spark, d):
    return _texts(spark, d).select("doc_id", text.normalize_ocr("raw_text").alias("normalized"))


def multi_pass_union(spark, d):
    return _texts(spark, d).select("doc_id", F.md5(text.union_passes("raw_text", F.lit("  "), F.col("family"), F.lit(None).cast("string"))).alias("digest"))


def viz_tokens(spark, d):
    return _texts(spark, d).select("doc_id", text.tokens("raw_text").alias("stream"))


def compare_keys(spark, d):
    c = F.concat(F.lit(" "), "family", F.lit("< "), "number")
    return _texts(spark, d).select("doc_id", text.compare_key_text(c).alias("a"), text.compare_key_compact(c).alias("b"), text.compare_key_alnum(c).alias("c"), text.strip_filler("number").alias("filler"))


def mask_pii(spark, d):
    ids = _texts(spark, d).select("doc_id", F.explode(F.array(F.concat(F.lit("1234 5678 "), F.lpad(F.col("doc_id").cast("string"), 4, "0")), F.concat(F.lit("123456789012"), F.lpad(F.col("doc_id").cast("string"), 4, "0")), "family", F.lit("abc"))).alias("id"))
    return ids.select("doc_id", "id", text.mask_id("id").alias("masked"))


def regroup_ids(spark, d):
    n = F.lpad(F.col("doc_id").cast("string"), 12, "7")
    return _texts(spark, d).select("doc_id", text.group_id(n).alias("id"), text.group_vid(F.concat(n, F.lit("1234"))).alias("vid"))


# --- dates and dictionaries ------------------------------------------------


def date_normalize_iso(spark, d):
    return fixtures.frame(spark, d, fixtures.DATES, "dates").select("id", dates.iso_or_null("raw").alias("iso"), dates.four_layouts("raw").alias("four"))


def mrz_date_pivots(spark, d):
    c = F.substring("line2", 14, 6)
    return _zones(spark, d).select("doc_id", *[dates.mrz_date(c, p, iso, ok).alias(n) for n, p, iso, ok in (("p50", 50, True, True), ("p40", 40, True, True), ("p30", 30, True, False), ("p50_dmy", 50, False, False))])


def month_dates(spark, d):
    return fixtures.frame(spark, d, fixtures.DATES, "dates").select("id", dates.month_date("raw").alias("dmy"), dates.slashes("raw").alias("slashed"))


def date_sort_assign(spark, d):
    found = F.regexp_extract_all("raw_text", F.lit(r"\b(\d{2}[/\-.]\d{2}[/\-.]\d{4})\b"))
    return _texts(spark, d).select("doc_id", dates.assign_dates(found).alias("a")).select("doc_id", "a.birth", "a.issue", "a.expiry")


def country_codes(spark, d):
    t = _texts(spark, d)
    return t.select("doc_id", lookup.country_code("nation").alias("alpha3"), lookup.nationality("code").alias("demonym"), lookup.compare_code("nation").alias("compare"), lookup.consistency_code("nation").alias("consistency"), lookup.same_nationality("nation", "code").alias("same"), lookup.gender("sex").alias("gender"))


def dictionary_join(spark, d):
    """The dictionaries as a dimension to join with must agree with the expressions."""
    t, table = _texts(spark, d), lookup.table(spark)
    j = t.join(F.broadcast(table), (table["dictionary"] == "alpha3") & (table["key"] == t["nation"]), "left")
    return j.select("doc_id", F.coalesce("value", F.substring("nation", 1, 3)).alias("by_join"), lookup.country_code("nation").alias("by_map"))


# --- reconciliation and scores ---------------------------------------------


def compare_legacy(spark, d):
    t = _texts(spark, d)
    other = F.when(F.col("corruption") < 3, F.lower("family")).when(F.col("corruption") < 5, F.lit(" ")).otherwise("given1")
    day = F.when(F.col("corruption") < 4, F.date_format("birth_iso", "dd/MM/yyyy")).otherwise(F.col("issue_iso"))
    return t.select("doc_id", reconcile.compare_legacy(other, F.col("family")).alias("name"), reconcile.compare_legacy(day, F.col("birth_iso"), True).alias("birth"), reconcile.compare_tristate(other, F.col("family")).alias("tristate"), reconcile.compare_engine(F.col("number"), F.translate("number", "<", "")).alias("engine"))


def compare_live(spark, d):
    c = _screened(spark, d).where("processor = 'passport' and verification.mrz_available").select("doc_id", F.explode("verification.field_comparisons").alias("field", "result"))
    return c.groupBy("field", "result").agg(F.count("*").alias("n"))


def merge_priority(spark, d):
    t = _texts(spark, d)
    m, v, ok = F.when(F.col("corruption") < 4, F.col("family")), F.when(F.col("corruption") % 2 == 0, F.col("given1")).otherwise(""), F.col("corruption") < 2
    p = reconcile.merge_provenance(m, v, ok)
    return t.select("doc_id", reconcile.merge_live(m, v).alias("live"), reconcile.merge_if_valid(ok, m, v).alias("if_valid"), p.alias("p")).select("doc_id", "live", "if_valid", "p.value", "p.source", "p.mrz_verified", "p.sources_match")


def completeness_by_type(spark, d):
    s = _screened(spark, d)
    return s.groupBy("document_type", F.col("verification.completeness_score").alias("score"), F.col("verification.confidence_level").alias("level")).agg(F.count("*").alias("n"))


def confidence_formulas(spark, d):
    c = F.col("corruption")
    mrz_score, complete, consistent, valid = (25.0 * (c % 5)).cast("double"), (100.0 - 10.0 * (c % 4)).cast("double"), (12.5 * c).cast("double"), c % 2 == 0
    checks = [F.when(c % 3 != 0, c % 2 == 0), F.when(c % 5 != 0, c < 4), F.when(c != 0, F.lit(True))]
    rows = _texts(spark, d).select(
        "doc_id",
        score.confidence_live(c < 6, mrz_score, complete, consistent).alias("live"),
        score.confidence_legacy(valid, complete, consistent, mrz_score).alias("legacy"),
        score.confidence_combiner(checks, mrz_score).alias("combiner"),
        score.confidence_points(mrz_score, valid, c < 3, c < 5, F.lit(True), c == 1).alias("points"),
    )
    return rows.select("*", score.level(F.col("live"), "passport").alias("live_level"), score.level(F.col("legacy"), "legacy").alias("legacy_level"), score.level(F.col("points"), "points").alias("points_level"), score.status_legacy(F.col("combiner") > 80, F.col("legacy")).alias("status"))


def field_confidence_long(spark, d):
    return _screened(spark, d).select("document_type", F.explode("field_confidence").alias("field", "confidence")).groupBy("document_type", "field").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 2).alias("avg_confidence"))


def manual_review_reasons(spark, d):
    return _screened(spark, d).select("document_type", F.explode("manual_review_reasons").alias("reason")).groupBy("document_type", "reason").agg(F.count("*").alias("n"))


def review_rate_by_type(spark, d):
    return _screened(spark, d).groupBy("truth_type").agg(F.count("*").alias("n"), F.sum(F.col("manual_review_required").cast("int")).alias("reviews"))


def screening_summary(spark, d):
    """Flagship: records by type and confidence level, with review rate."""
    s = pipeline.screen(_texts(spark, d))
    return s.groupBy("document_type", F.col("verification.confidence_level").alias("confidence_level")).agg(
        F.count("*").alias("n"),
        F.round(F.avg("verification.confidence_score"), 4).alias("avg_confidence"),
        F.round(F.avg(F.col("manual_review_required").cast("int")), 4).alias("review_rate"),
        F.sum((F.col("status") == "VERIFIED").cast("int")).alias("verified"),
    )


# --- evaluation ------------------------------------------------------------


def _truth(spark, d):
    pairs = F.explode(F.create_map(F.lit("surname"), F.col("family"), F.lit("date_of_birth"), F.col("birth_iso"), F.lit("document_number"), F.regexp_replace("number", "<", ""), F.lit("document_type"), F.col("truth_type")))
    return _texts(spark, d).where("truth_type <> 'UNKNOWN'").select(F.col("doc_id").alias("filename"), pairs.alias("field", "value"))


def _predicted(spark, d):
    pairs = F.explode(F.create_map(F.lit("surname"), F.col("identity.surname"), F.lit("date_of_birth"), F.col("identity.date_of_birth"), F.lit("document_number"), F.col("document.document_number")))
    return _screened(spark, d).select(F.col("doc_id").alias("filename"), pairs.alias("field", "value"))


def eval_cer(spark, d):
    p = _texts(spark, d)
    guess = F.when(F.col("corruption") == 0, F.lit(None)).when(F.col("corruption") < 4, F.translate("family", "AEI", "41")).otherwise(F.concat("given1", "family"))
    return p.select("doc_id", evaluate.cer(guess, F.col("family")).alias("cer"), text.distance(guess, "family").alias("distance"))


def _documents(spark, d):
    s = _screened(spark, d).where("truth_type <> 'UNKNOWN'")
    return s.select(F.col("doc_id").alias("filename"), F.regexp_replace("truth_type", "TRAVEL_AUTH", "TRAVEL_AUTHORIZATION").alias("true_type"), F.when(F.col("doc_id") % 50 != 0, F.col("document_type")).alias("document_type"), (F.col("doc_id") % 100).cast("double").alias("elapsed_ms"), F.col("manual_review_required").alias("review"))


def eval_document(spark, d):
    done = evaluate.per_document(evaluate.compare(_truth(spark, d), _predicted(spark, d)), _documents(spark, d))
    return done.select("filename", "document_type", "classification_correct", "fields_evaluated", "fields_correct", "field_accuracy_pct", "average_cer_pct")


def eval_corpus(spark, d):
    return evaluate.corpus(evaluate.per_document(evaluate.compare(_truth(spark, d), _predicted(spark, d)), _documents(spark, d)))


def eval_report(spark, d):
    """The one report: the corpus and, in order, each document's results."""
    done = evaluate.per_document(evaluate.compare(_truth(spark, d), _predicted(spark, d)), _documents(spark, d))
    r = evaluate.report(done, F.lit("2024-01-02 03:04:05").cast("timestamp"), most=1_000_000)
    each = F.array_join(F.transform("per_document_results", lambda x: F.concat_ws(":", x["filename"].cast("string"), x["document_type"], x["fields_correct"].cast("string"), x["fields_evaluated"].cast("string"))), ",")
    return r.select("total_documents_tested", "classification_accuracy_pct", "field_accuracy_pct", "average_cer_pct", F.size("per_document_results").alias("n_documents"), F.md5(each).alias("documents"))


# --- older extractors, records, readers -----------------------------------


def legacy_engine_fields(spark, d):
    return legacy.extract_engine(_texts(spark, d)).select("doc_id", "engine_type", F.explode("extracted").alias("field", "value"))


def legacy_engine_scores(spark, d):
    e = legacy.extract_engine(_texts(spark, d))
    return e.select("doc_id", legacy.engine_confidence("extracted").alias("confidence"), legacy.engine_completeness("extracted", "engine_type").alias("completeness"))


def legacy_engine_records(spark, d):
    r = legacy.engine_record(_texts(spark, d).withColumn("input_file", F.concat(F.lit("/in/"), "truth_type")), F.lit("2024-01-02T03:04:05"))
    j = r.select("doc_id", sinks.record_json(F.col("record")).alias("j"))
    return j.select("doc_id", *[F.get_json_object("j", f"$.{p}").alias(n) for p, n in (("document_type", "document_type"), ("status", "status"), ("metadata.input_file", "input_file"), ("metadata.image_width", "image_width"), ("metadata.ocr_engine", "ocr_engine"), ("metadata.preprocessing[5]", "last_step"), ("metadata.ocr_passes", "passes"))], F.md5(F.get_json_object("j", "$.normalized_text")).alias("text"))


def legacy_passport_line(spark, d):
    return _texts(spark, d).select("doc_id", legacy.passport_line("raw_text").alias("p")).select("doc_id", "p.*")


def legacy_text(spark, d):
    middle = F.when(F.col("corruption") % 2 == 0, F.lit("  ")).otherwise(F.col("given2"))
    crlf = F.replace("raw_text", F.lit("\n"), F.lit(" \r\n\t"))
    return _texts(spark, d).select("doc_id", text.full_name_skipping("given1", middle, "family").alias("name"), text.blank_to_null(middle).alias("safe"), F.md5(text.clean_engine_text(crlf)).alias("cleaned"), text.snippet("raw_text", 30).alias("snippet"))


def consistency_checks(spark, d):
    c = F.col("corruption")
    ocr = {"passport_number": F.when(c < 6, F.lower(F.replace("number", F.lit("<"), F.lit("")))), "nationality": F.col("nation"), "gender": F.when(F.col("sex") != "<", F.lower("sex"))}
    zone = {"passport_number": F.replace("number", F.lit("<"), F.lit("")), "nationality": F.col("code"), "gender": F.col("sex")}
    other = F.when(c < 3, F.lower("family")).when(c < 5, F.lit(" ")).otherwise("given1")
    compared = F.create_map(F.lit("surname"), reconcile.compare_legacy(other, F.col("family")), F.lit("date_of_birth"), reconcile.compare_legacy(F.when(c < 4, F.col("birth_iso")).otherwise(F.col("issue_iso")), F.col("birth_iso"), True))
    kind = F.when(c % 4 == 0, "P").when(c % 4 == 1, "P<").when(c % 4 == 2, "TD2").otherwise("V")
    return _texts(spark, d).select("doc_id", reconcile.consistency(ocr, zone).alias("x"), score.consistency_legacy(compared).alias("consistency"), lookup.mrz_type(kind).alias("mrz_type")).select("doc_id", "x.*", "consistency", "mrz_type")


def json_access(spark, d):
    inner = F.concat(F.lit('{"surname": "'), "family", F.lit('"'))
    c = F.col("corruption")
    j = F.when(c < 3, F.concat(F.lit('{"extracted_data": '), inner, F.lit('}, "surname": "other"}'))).when(c < 5, F.concat(inner, F.lit("}"))).when(c == 5, F.concat(inner, F.lit(', "extracted_data": "none"}'))).when(c == 6, F.lit(""))
    flat = legacy.flatten(F.struct(F.col("family").alias("surname"), F.lit("").alias("gender"), F.lit("1").alias("n")), F.struct(F.when(c % 2 == 0, F.col("city")).alias("place"), F.lit("2").alias("n")))
    rows = _texts(spark, d).select("doc_id", legacy.nested_or_flat(j).alias("m"), flat.alias("f"))
    return rows.select("doc_id", F.try_element_at("m", F.lit("surname")).alias("surname"), F.size("m").alias("n_fields"), F.array_join(F.array_sort(F.transform(F.map_entries("f"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("flat"))


def json_variants(spark, d):
    """The fields of JSON records of several shapes, with their own types."""
    c, name = F.col("corruption"), F.concat(F.lit('"surname": "'), "family", F.lit('"'))
    whole = F.concat(F.lit('{"extracted_data": {'), name, F.lit(', "year": 2024, "tags": ["a", 1]}, "surname": "other"}'))
    j = F.when(c < 3, whole).when(c < 5, F.concat(F.lit("{"), name, F.lit(', "year": 1.5}'))).when(c == 5, F.lit('{"extracted_data": "none", "year": "n/a"}')).when(c == 6, F.lit("{"))
    rows = _texts(spark, d).select("doc_id", F.try_parse_json(j).alias("value"))
    found = variants.fields(rows.select("doc_id", variants.get(F.col("value"), "year", "double").alias("year"), variants.record(F.col("value")).alias("value")), "value")
    return found.select("doc_id", "key", F.to_json("field").alias("field"), "year")


def final_records(spark, d):
    f = pipeline.final_record(_screened(spark, d), F.col("doc_id").cast("string"), F.lit("2024-01-02 03:04:05").cast("timestamp"), F.concat(F.lit("/in/"), "truth_type"), F.sha2("raw_text", 256))
    return f.select("module", "module_version", "schema_version", "request_id", "input_file", "file_hash_sha256", "document_type", "status", "manual_review_required", F.col("identity.full_name").alias("full_name"), F.col("document.document_number").alias("document_number"), F.md5("raw_ocr_text").alias("snippet"), F.array_join("error_codes", ",").alias("codes"))


def record_template(spark, d):
    """The empty record beside each type that is routed."""
    t = _typed(spark, d).select("detected_type").distinct().select("detected_type", pipeline.template(F.col("detected_type")).alias("t"))
    return t.select("detected_type", "t.document_type", "t.status", "t.manual_review_required", F.size("t.manual_review_reasons").alias("n_reasons"), "t.identity.full_name", "t.document.document_number", "t.face_extraction.face_detected", "t.image_quality.quality_score", "t.image_quality.blur_status", "t.image_quality.resolution", "t.verification.confidence_level", F.size("t.verification.field_comparisons").alias("n_comparisons"), F.size("t.field_confidence").alias("n_fields"))


def error_records(spark, d):
    f = fixtures.frame(spark, d, fixtures.FILES, "files").withColumn("content", F.when(F.col("length") > 0, F.unhex("header")))
    e = pipeline.error_record(validate.validate_files(f), F.col("id").cast("string"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    return e.select("request_id", "input_file", "document_type", "status", "manual_review_required", F.array_join("manual_review_reasons", ";").alias("reasons"), F.array_join("error_codes", ";").alias("codes"))


def summary_view(spark, d):
    return sinks.summary(_screened(spark, d)).groupBy("document_type", "status", "bar", "decision").agg(F.count("*").alias("n"), F.max("document_number").alias("last_number"))


def mask_nested(spark, d):
    n = F.lpad(F.col("doc_id").cast("string"), 12, "7")
    rows = _texts(spark, d).select("doc_id", F.array(F.struct(n.alias("id_number"), F.col("family").alias("name")), F.struct(F.concat(n, F.lit("1234")).alias("id_number"), F.lit("x").alias("name"))).alias("holders"), F.create_map(F.lit("vid"), F.concat(n, F.lit("1234")), F.lit("city"), F.col("city")).alias("more"))
    m = validate.mask_columns(rows)
    return m.select("doc_id", F.array_join(F.transform("holders", lambda h: F.concat_ws(":", h["id_number"], h["name"])), ",").alias("holders"), F.element_at("more", "vid").alias("vid"), F.element_at("more", "city").alias("city"))


def mrz_reader_records(spark, d):
    names = {"type": F.when(F.col("corruption") < 4, "P<").otherwise("TD2"), "number": F.concat(F.lit(" "), "number"), "surname": F.col("family"), "names": F.concat("given1", F.lit("  "), "given2", F.lit("<<")), "nationality": F.col("code"), "date_of_birth": F.when(F.col("corruption") != 2, F.col("birth")).otherwise("x"), "sex": F.col("sex"), "expiration_date": F.col("expiry"), "valid_score": F.lit(90.0), "valid_number": F.col("corruption") != 3, "valid_date_of_birth": F.lit(True), "valid_expiration_date": F.lit(True)}
    r = F.when(F.col("corruption") != 7, F.struct(*[v.alias(k) for k, v in names.items()]))
    return _zones(spark, d).select("doc_id", mrz.reader_record(r).alias("r")).select("doc_id", "r.*")


def national_id_fallbacks(spark, d):
    """Names where no relation line, and where no birth line is left to find them by."""
    t = _texts(spark, d).where("truth_type = 'NATIONAL_ID' and corruption < 4").withColumn("raw_text", F.regexp_replace("raw_text", "S/O [^\n]*\n", ""))
    t = t.withColumn("raw_text", F.when(F.col("corruption") % 2 == 0, F.replace("raw_text", F.lit("DOB"), F.lit("Born"))).otherwise(F.col("raw_text")))
    return extract.national_id(pipeline.with_text(t)).select("doc_id", F.col("f_full_name").alias("full_name"), F.col("f_date_of_birth").alias("date_of_birth"))


# --- files and audit -------------------------------------------------------


def validate_files(spark, d):
    f = fixtures.frame(spark, d, fixtures.FILES, "files").withColumn("content", F.when(F.col("length") > 0, F.unhex("header")))
    return validate.validate_files(f).select("id", "is_valid", "error", "error_code", "message", "file_hash")


def file_hash_dedupe(spark, d):
    h = _table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return h.groupBy("file_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def error_code_lookup(spark, d):
    f = validate_files(spark, d).where("error is not null")
    return f.join(F.broadcast(validate.error_table(spark).drop("code")), "error", "left").groupBy("error", "error_code", "description").agg(F.count("*").alias("n"))


def audit_events(spark, d):
    s = _screened(spark, d).select(F.col("doc_id").cast("string").alias("request_id"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("at"), F.concat(F.lit("/in/"), "truth_type", F.lit(".jpg")).alias("path"), F.lit(None).cast("string").alias("file_hash"), "document_type", "status", F.col("verification.confidence_score").alias("confidence_score"), F.col("verification.confidence_level").alias("confidence_level"), F.col("manual_review_reasons").alias("reasons"), F.lit(None).cast("string").alias("error"))
    return validate.audit_events(s).groupBy("event_type", "audit_date", "input_file_name", "document_type", "file_hash_sha256").agg(F.count("*").alias("n"))


# --- faces, frames, images -------------------------------------------------


def face_prominent(spark, d):
    return face.prominent(fixtures.frame(spark, d, fixtures.BOXES, "boxes")).select("image_id", "pos", "x", "y", "w", "h")


def face_box_pad(spark, d):
    b = fixtures.frame(spark, d, fixtures.BOXES, "boxes")
    pads = [face.pad_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("img_w"), F.col("img_h"), r) for r in (face.PAD_DOCUMENT, face.PAD_LIVE)]
    return b.select("image_id", "pos", pads[0].alias("a"), pads[1].alias("b")).select("image_id", "pos", "a.x1", "a.y1", "a.x2", "a.y2", F.col("b.x1").alias("lx1"), F.col("b.y2").alias("ly2"), face.has_area(F.col("a")).alias("has_area"))


def face_backends(spark, d):
    b = fixtures.frame(spark, d, fixtures.BOXES, "boxes")
    box = F.struct("x", "y", "w", "h")
    first = face.first_backend([("mtcnn", F.when(F.col("pos") % 3 == 0, box)), ("retinaface", F.when(F.col("pos") % 2 == 0, box))], F.col("img_w"), F.col("img_h"))
    return b.select("image_id", "pos", first.alias("b"), face.large_enough(F.col("w"), F.col("h")).alias("large")).select("image_id", "pos", "b.*", "large")


def _pairs(spark, d):
    e = _table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("live"), F.col("label").alias("live_label"))
    return e.join(n, "vec_id")


def face_similarity(spark, d):
    m = face.match(F.col("embedding"), F.col("live"), 0.6)
    return _pairs(spark, d).select("vec_id", (F.col("label") == F.col("live_label")).alias("same"), m.alias("m")).select("vec_id", "same", "m.status", "m.is_match", "m.similarity_percentage", "m.cosine_distance", "m.risk_score")


def face_risk(spark, d):
    v = F.col("vec_id")
    r = face.case_risk(v % 7 != 0, F.when(v % 3 == 0, v % 2 == 0), v % 5 != 0, F.col("m"))
    p = _pairs(spark, d).select("vec_id", face.match(F.col("embedding"), F.col("live"), 0.6).alias("m"))
    return p.select(r.alias("r")).groupBy("r.status", "r.risk_score").agg(F.count("*").alias("n"))


def eye_aspect(spark, d):
    e = F.col("event_id")
    points = F.array(*[F.struct((((e * (7 + k)) % 100) / 100).alias("x"), (((e * (11 + 3 * k)) % 100) / 100).alias("y")) for k in range(6)])
    return _table(spark, d, "events").select("event_id", points.alias("p")).select("event_id", F.round(face.eye_aspect_ratio(F.col("p"), F.lit(640), F.lit(480)), 6).alias("ear"))


def blink_runs(spark, d):
    return face.blinks(fixtures.frame(spark, d, fixtures.FRAMES, "frames"))


def liveness(spark, d):
    return face.liveness(fixtures.frame(spark, d, fixtures.FRAMES, "frames"))


def auto_capture(spark, d):
    f = fixtures.frame(spark, d, fixtures.FRAMES, "frames")
    return face.auto_capture(f, timeout=20 * 86400.0, stable=12)


def quality_rules(spark, d):
    q = fixtures.frame(spark, d, fixtures.STATS, "stats")
    r = quality.report(*[F.col(k) for k in ("laplacian", "brightness", "contrast", "glare", "width", "height")])
    return q.select("id", r.alias("r")).select("id", "r.quality_score", "r.blur_status", "r.glare_percentage", "r.resolution", "r.is_acceptable", F.array_join("r.warnings", "; ").alias("warnings"))


def skew_rules(spark, d):
    q = fixtures.frame(spark, d, fixtures.STATS, "stats")
    return q.select("id", quality.skew_angle(F.col("brightness") * 0.7 - 90.0, F.col("laplacian")).alias("angle"))


def deskew_pages(spark, d):
    """Pages drawn for the parts, each turned by its key: the skew found, and what is left of it once the page is straightened."""
    from ..operators import deskew

    found = deskew.with_skew(fixtures.pages(spark, d))
    left = deskew.with_skew(found, name="left", turned="skew_angle", pixels=False)
    return left.select("id", F.round("skew_angle").cast("int").alias("degrees"), ((F.col("skew_angle") == 0) | (F.abs("left_angle") <= 0.5)).alias("straight"))


def _session_events(spark, d):
    """The frames of blink_runs as a stream in event time: six arrivals, a third of the frames one arrival late."""
    from ..streaming import sessions

    def run():
        f = fixtures.frame(spark, d, fixtures.FRAMES, "frames")
        late = (F.xxhash64("session_id", "ts") % 3 == 0).cast("int")
        f = f.withColumn("arrival", F.greatest(F.lit(0), F.least(F.lit(5), F.floor(F.datediff("ts", F.lit("2024-01-01")) / 6).cast("int") + late)))
        return sessions.run_table(spark, f, "13 days", sessions.Rules(timeout=20 * 86400.0, stable=12, idle=40 * 86400.0))

    return written(spark, f"{d}|session_events", [f"{d}/events.parquet"], run)


def blink_stream(spark, d):
    """The streaming twin of blink_runs."""
    return _session_events(spark, d).where("kind = 'blink'").select("session_id", "ts")


def liveness_stream(spark, d):
    """The streaming twin of liveness: told when a session is closed."""
    return _session_events(spark, d).where("kind = 'closed'").select("session_id", F.col("captured").alias("liveness_verified"), F.col("ts").alias("captured_at"))


def auto_capture_stream(spark, d):
    """The streaming twin of auto_capture; a timer ends a loop whose time is up, so none ends for want of frames."""
    return _session_events(spark, d).where("kind = 'capture'").select("session_id", "ended_by", "captured", "frame")


def ingest_records(spark, d):
    """Files made of the screening texts through the ingest stream: some with a wrong header, some empty, each tenth twice."""
    from ..operators import slots
    from ..streaming import ingest

    header = F.unhex(F.when(F.col("doc_id") % 13 == 0, "47494638").otherwise({k: m for m, k in validate.MAGIC.items()}["PNG"]))
    content = F.when(F.col("doc_id") % 17 == 0, F.unhex(F.lit(""))).otherwise(F.concat(header, F.col("raw_text").cast("binary")))
    names = F.when(F.col("doc_id") % 10 == 9, F.array(F.lit(".png"), F.lit("_again.png"))).otherwise(F.array(F.lit(".png")))
    f = _texts(spark, d).select("doc_id", content.alias("content"), F.explode(names).alias("name"))
    f = f.select(F.concat(F.lit("/inbox/"), "doc_id", "name").alias("path"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("modificationTime"), F.octet_length("content").cast("long").alias("length"), "content")
    out = ingest.run_table(spark, f, slots.Model("text after the header", lambda: lambda values: [[v[8:].decode()] for v in values], 500))
    records = ingest.written(spark, out, "records").select(F.col("file_hash_sha256").alias("name"), "document_type", "status", "manual_review_required", F.lit("").alias("code"))
    errors = ingest.written(spark, out, "errors").select(F.col("input_file").alias("name"), "document_type", "status", "manual_review_required", F.col("error_codes")[0].alias("code"))
    return records.unionAll(errors)


def queries() -> dict:
    """The functions of this module that are not helpers."""
    return {k: v for k, v in globals().items() if isfunction(v) and v.__module__ == __name__ and not k.startswith("_") and k not in ("queries", "oracle_sql")}


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES | oracles_screening.SCREENING | oracles_legacy.LEGACY
