"""Sources, sinks, slots for models and the command line, on small files."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from docscreen.functions.register import points, register_functions
from docscreen.operators import face, quality, slots, validate
from docscreen.plans import pipeline
from docscreen.sources import files, shared, sinks

PNG = bytes.fromhex("89504E470D0A1A0A") + b"rest"


@pytest.fixture
def folder(tmp_path):
    for name, data in {"a.png": PNG, "b.JPG": b"\xff\xd8\xff\xe0", "c.png": b"GIF8", "d.bmp": b"", "e.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    with open(tmp_path / "big.png", "wb") as f:
        f.truncate(validate.MAX_BYTES + 1)
    return tmp_path


WANT = {"a.png": None, "b.JPG": None, "c.png": "ERR_MALICIOUS_PAYLOAD", "d.bmp": "ERR_EMPTY_FILE", "big.png": "ERR_FILE_TOO_LARGE"}


def test_scan_isolates_errors(spark, folder):
    found = files.scan(spark, str(folder))
    assert {os.path.basename(r.path): r.error for r in found.collect()} == WANT
    assert found.where("error = 'ERR_FILE_TOO_LARGE' and content is null").count() == 1
    records = pipeline.error_record(found, F.lit("id"), F.current_timestamp()).collect()
    assert {(os.path.basename(r.input_file), r.status, *r.error_codes) for r in records} == {(k, "ERROR", v) for k, v in WANT.items() if v}
    assert {os.path.basename(r.path): r.error for r in files.uploads(found.drop("error", "is_valid", "message", "file_hash", "error_code")).collect()}["d.bmp"] == "ERR_EMPTY_FILE"


def test_scan_survives_bad_files(spark, tmp_path, monkeypatch):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for name, data in {"good.png": PNG, "deep/er/also.PNG": PNG, "empty.jpg": b"", "deep/gone.png": PNG, "deep/broken.png": PNG, "notes.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    listed = files.list_files(spark, str(tmp_path))
    assert {os.path.basename(r.path): r.length for r in listed.collect()} == {"good.png": 12, "also.PNG": 12, "empty.jpg": 0, "gone.png": 12, "broken.png": 12}
    # Between the listing and the reading one file goes, and another becomes something that can't be read.
    (tmp_path / "deep" / "gone.png").unlink()
    (tmp_path / "deep" / "broken.png").unlink()
    (tmp_path / "deep" / "broken.png").mkdir()
    found = validate.validate_files(files.open_files(listed))
    got = {os.path.basename(r.path): (r.error, (r.read_error or "").partition(":")[0]) for r in found.collect()}
    assert got == {"good.png": (None, ""), "also.PNG": (None, ""), "empty.jpg": ("ERR_EMPTY_FILE", ""), "gone.png": ("ERR_FILE_NOT_FOUND", "FileNotFoundError"), "broken.png": ("ERR_FILE_READ", got["broken.png"][1])} and got["broken.png"][1]
    records = pipeline.error_record(found, F.lit("id"), F.current_timestamp())
    assert {r.error_codes[0] for r in records.collect()} == {"ERR_EMPTY_FILE", "ERR_FILE_NOT_FOUND", "ERR_FILE_READ"}
    assert {os.path.basename(r.path) for r in files.scan(spark, f"{tmp_path}/[ge]*").collect()} == {"good.png", "empty.jpg"}
    assert [(r.error, r.content) for r in files.scan(spark, str(tmp_path / "nowhere.png")).collect()] == [("ERR_FILE_NOT_FOUND", None)]
    assert files.scan(spark, f"file://{tmp_path}/deep/er").first().file_hash == files.scan(spark, str(tmp_path / "good.png")).first().file_hash


def test_landing_stream_keeps_files_that_are_too_large(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    stream = validate.validate_files(files.landing_stream(spark, f"{folder}/*.[pbJ]*"))
    stream.select("path", "error").writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    # Spark's stream source leaves empty files out.
    assert {os.path.basename(r.path): r.error for r in spark.read.parquet(out).collect()} == {k: v for k, v in WANT.items() if k != "d.bmp"}


def test_json_readers(spark, tmp_path):
    (tmp_path / "truth.json").write_text(json.dumps({"f.jpg": {"surname": "X", "n": "1"}}))
    assert {tuple(r) for r in files.read_truth(spark, str(tmp_path / "truth.json")).collect()} == {("f.jpg", "surname", "X"), ("f.jpg", "n", "1")}
    (tmp_path / "bad.json").write_text("{")
    assert files.read_json(spark, str(tmp_path / "bad.json"), "a string").collect()[0].a is None
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json(spark, str(tmp_path / "bad.json"), "a string", strict=True).collect()


def test_json_as_variants(spark, tmp_path):
    from docscreen.sources import variants

    for name, text in {"a": '{"extracted_data": {"n": 3, "t": ["a", 1]}, "n": 9}', "b": '{"n": 2.5, "extracted_data": "none"}', "c": "{", "d": "[1]", "e": ""}.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = variants.read_variants(spark, str(tmp_path))
    v = F.col("value")
    got = {os.path.basename(r.path): (r.n, r.t, r.damaged) for r in rows.select("path", variants.get(v, "n", "double").alias("n"), variants.get(v, "t", "array<string>").alias("t"), "damaged").collect()}
    got.pop("e.json", None)  # Spark's text source leaves empty files out
    assert got == {"a.json": (3.0, ["a", "1"], None), "b.json": (2.5, None, None), "c.json": (None, None, "{"), "d.json": (None, None, None)}
    each = variants.fields(rows.select("path", "value", variants.record(v).alias("record")), "record")
    assert each.columns == ["path", "value", "record", "key", "field"]
    found = sorted((os.path.basename(r.path), r.key, r.j, r.kind) for r in each.select("path", "key", F.to_json("field").alias("j"), F.schema_of_variant("field").alias("kind")).collect())
    assert found == [("a.json", "n", "3", "BIGINT"), ("a.json", "t", '["a",1]', "ARRAY<VARIANT>"), ("b.json", "extracted_data", '"none"', "STRING"), ("b.json", "n", "2.5", "DECIMAL(2,1)")]
    assert [(r.value, r.damaged) for r in variants.read_variants(spark, f"{tmp_path}/none.json").collect()] == [(None, None)]


def test_slots(spark):
    docs = spark.createDataFrame([(1, b"one"), (2, b""), (3, None)], "doc_id int, content binary")

    def ocr(data):
        return [data.decode(), str(1 // len(data))]

    got = {r.doc_id: (r.ocr, r.ocr_error) for r in slots.fill(docs, "ocr", slots.each("plain", ocr)).collect()}
    assert got == {1: (["one", "0"], None), 2: (None, "ZeroDivisionError: integer division or modulo by zero"), 3: (None, None)}
    empty = slots.fill(slots.fill(docs, "faces"), "zone_record", keep_content=False)
    assert [f"{n} {t}" for n, t in empty.dtypes] == ["doc_id int", "faces " + slots.SLOTS["faces"].replace(" ", ""), "faces_error string", "zone_record " + slots.SLOTS["zone_record"], "zone_record_error string"]
    texts = spark.createDataFrame([(1, "raw", "P<ZONE"), (2, "raw", None)], "doc_id int, raw_text string, zone_text string")
    assert [r.raw_text for r in pipeline.with_zone_text(texts).orderBy("doc_id").collect()] == ["raw\nP<ZONE", "raw"]


def test_slots_load_a_model_once_and_feed_it_lists(spark, tmp_path):
    log = str(tmp_path / "log")

    def load():
        with open(log, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def run(values):
            with open(log, "a") as f:
                f.write(f"batch {len(values)}\n")
            if b"bad" in values:
                raise RuntimeError("bad page")
            return [None if v == b"none" else [len(v)] if v == b"odd" else [len(v) / 2] for v in values]

        return run

    rows = [(i, b"bad" if i == 17 else b"none" if i == 18 else b"x" * (i + 1)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id int, content binary").repartition(8, "doc_id")
    got = {r.doc_id: (r.v, r.v_error) for r in slots.fill(docs, "embedding", slots.Model(f"counted {tmp_path}", load, 16), name="v", keep_content=False).collect()}
    assert got == {i: ([(i + 1) / 2], None) if i not in (17, 18) else (None, "RuntimeError: bad page" if i == 17 else None) for i in range(400)}
    lines = [x.split() for x in open(log)]
    loads, sizes = [p for k, p in lines if k == "load"], [int(n) for k, n in lines if k == "batch"]
    assert len(loads) == len(set(loads)) <= 8 and max(sizes) == 16 and sum(n > 1 for n in sizes) >= 24
    # What can't be loaded, or gives another type or number of results, fails for its own values only.
    broken = slots.Model(f"broken {tmp_path}", lambda: 1 / 0)
    assert {r.v_error for r in slots.fill(docs.limit(3), "embedding", broken, name="v").collect()} == {"ZeroDivisionError: division by zero"}
    short = slots.fill(docs.limit(3), "embedding", slots.Model(f"short {tmp_path}", lambda: lambda values: []), name="v").collect()
    assert all(r.v is None and "0 results for 1 values" in r.v_error for r in short)
    words = slots.fill(docs.limit(2), "embedding", slots.each(f"words {tmp_path}", lambda v: "text"), name="v").collect()
    assert all(r.v is None and "Arrow" in r.v_error for r in words)


def test_png_of_crops():
    import zlib

    pixels = np.random.default_rng(0).integers(0, 256, (3, 5, 3), dtype=np.uint8)
    file = slots.png(pixels)
    assert file[:8] == bytes.fromhex("89504E470D0A1A0A") and file[12:16] == b"IHDR" and file[-8:-4] == b"IEND"
    size = int.from_bytes(file[33:37], "big")
    raw = np.frombuffer(zlib.decompress(file[41 : 41 + size]), np.uint8).reshape(3, 16)
    assert (raw[:, 0] == 0).all() and (raw[:, 1:].reshape(3, 5, 3) == pixels[:, :, ::-1]).all()


def test_crop_and_statistics(spark):
    pixels = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    image = spark.createDataFrame([(("o", 4, 5, 3, 16, bytes(pixels.tobytes())),)], "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    box = face.pad_box(F.lit(1), F.lit(1), F.lit(2), F.lit(2), F.lit(5), F.lit(4), 0.0)
    outside = face.pad_box(F.lit(9), F.lit(1), F.lit(2), F.lit(2), F.lit(5), F.lit(4))
    cut = slots.with_crop(image.select("image", F.lit(7).alias("id"), box.alias("box"))).unionByName(slots.with_crop(image.select("image", F.lit(8).alias("id"), outside.alias("box"))))
    files_ = {r.id: r.face_png for r in cut.collect()}
    assert bytes(files_[7]) == slots.png(pixels[1:3, 1:3]) and files_[8] is None and "image" not in cut.columns
    r = np.random.default_rng(1)
    gray = r.integers(0, 256, (30, 40, 1), dtype=np.uint8)
    lap, mean, deviation, glare = quality.pixel_stats(gray.tobytes(), 30, 40, 1)
    g = gray[..., 0].astype(float)
    at = lambda y, x: g[abs(y) if y < 30 else 58 - y, abs(x) if x < 40 else 78 - x]
    plain = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * g[y, x] for y in range(30) for x in range(40)]
    assert np.allclose([lap, mean, deviation, glare], [np.var(plain), g.mean(), g.std(), (g >= 245).mean() * 100])


def test_sinks(spark, tmp_path):
    texts = spark.createDataFrame([(1, "GOVERNMENT OF INDIA\nAADHAAR\nAda Berg\nS/O Otto Berg\nDOB: 01/02/1980\nMALE\n1234 5678 9012"), (2, None)], "doc_id int, raw_text string")
    screened = pipeline.screen(texts)
    sinks.write_records(screened, str(tmp_path / "r"), masked=True)
    text = "".join(p.read_text() for p in (tmp_path / "r").glob("*.json"))
    assert "XXXX-XXXX-9012" in text and len(text.splitlines()) == 2
    events = screened.select(F.col("doc_id").cast("string").alias("request_id"), F.lit("2024-01-02").cast("timestamp").alias("at"), F.lit("/x/y.jpg").alias("path"), F.lit(None).cast("string").alias("file_hash"), "document_type", "status", F.lit(1.0).alias("confidence_score"), F.lit("LOW").alias("confidence_level"), F.col("manual_review_reasons").alias("reasons"), F.lit(None).cast("string").alias("error"))
    for _ in range(2):
        sinks.append_audit(validate.audit_events(events), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 4 and (tmp_path / "audit" / "audit_date=20240102").is_dir()
    sinks.write_report(screened.groupBy("document_type").count(), screened.select("doc_id"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "documents")).count() == 2
    assert "verification" in sinks.schema_json(screened) and screened.select(sinks.record_json(F.struct("status", "identity")).alias("j")).first().j.startswith('{"status":')


def test_a_stream_is_screened_like_a_table(spark, tmp_path):
    rows = [(1, "RESIDENCE PERMIT\nName: ADA BERG\nPermit No: RP00000001"), (2, "nothing"), (3, "AADHAAR\nAda Berg\nS/O Otto Berg")]
    texts = spark.createDataFrame(rows, "doc_id int, raw_text string")
    texts.write.parquet(str(tmp_path / "in"))
    names = ["doc_id", "document_type", "status", "identity.full_name", "manual_review_reasons"]
    stream = pipeline.screen(spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))).select(*names)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    table = pipeline.screen(texts)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, table.select(*names).collect()))
    # Each branch reads its own part of what was classified once.
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(processor") == len(pipeline.PROCESSORS) and "rlike AADHAAR" not in plan


def test_shared_folder(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    make = lambda: spark.read.parquet(str(tmp_path / "in"))
    assert shared.written(spark, "k", [str(tmp_path / "in")], make).count() == 3
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "in"))
    assert shared.written(spark, "k", [str(tmp_path / "in")], make).count() == 5

    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="share"):
        shared.shared_dir(Elsewhere)


def test_table_function_drops_weak_second_lines(spark):
    register_functions(spark)
    text = "P<INDBERG<<ADA<<<<<<<<<<<<<<<<<<<<<<<<<<<<<<\nA0000001<51IND8002012F3001019<<<<<<<<<<<<<<04\nTHE QUICK BROWN FOX JUMPS OVER"
    rows = spark.sql(f"SELECT * FROM mrz_candidates('{text}')").collect()
    from docscreen.functions import mrz

    one, two = mrz.candidates(F.lit(text))
    want = spark.range(1).select(F.transform(one, lambda x: x["line"]).alias("a"), F.transform(two, lambda x: x["line"]).alias("b"), F.transform(two, lambda x: x["score"]).alias("s")).first()
    assert [r.line for r in rows if r.kind == "first"] == want.a and [r.line for r in rows if r.kind == "second"] == want.b and [points(x) for x in want.b] == want.s


def test_a_run_written_twice_is_there_once(spark, tmp_path):
    rows = spark.createDataFrame([("20240101", "a", "123456789012"), ("20240102", "b", None)], "audit_date string, x string, id_number string")
    for run, part in (("one", rows), ("two", rows), ("one", rows), ("one", rows.limit(1))):
        sinks.write_run(part, str(tmp_path / "audit"), run, ("audit_date",))
    back = spark.read.json(str(tmp_path / "audit")).collect()
    assert sorted((r.run, r.x, r.id_number) for r in back) == [("one", "a", "XXXX-XXXX-9012"), ("two", "a", "XXXX-XXXX-9012"), ("two", "b", None)]
    assert sorted(p.name for p in (tmp_path / "audit" / "run=one").glob("audit*")) == ["audit_date=20240101"]


def test_evaluation_report(spark, tmp_path):
    from docscreen.operators import evaluate

    (tmp_path / "truth.json").write_text(json.dumps({"a.png": {"document_type": "PERMIT", "full_name": "ADA BERG", "nationality": "IND"}, "b.png": {"document_type": "VISA", "surname": "X"}}))
    record = {"input_file": "/in/a.png", "document_type": "PERMIT", "manual_review_required": True, "identity": {"full_name": "Ada Berg", "nationality": None}, "document": {"document_number": "1", "nationality": "IDN"}}
    (tmp_path / "records.json").write_text(json.dumps(record) + "\n")
    truth, records = files.read_truth(spark, str(tmp_path / "truth.json")), spark.read.json(str(tmp_path / "records.json"))
    assert {tuple(r) for r in evaluate.fields(records).collect()} == {("a.png", "full_name", "Ada Berg"), ("a.png", "document_number", "1"), ("a.png", "nationality", "IDN")}
    done = evaluate.evaluate(truth, records)
    sinks.write_single_report(evaluate.report(done, F.current_timestamp()), str(tmp_path / "report"))
    (file,) = (tmp_path / "report").glob("*.json")
    r = json.loads(file.read_text())
    assert (r["total_documents_tested"], r["evaluated_documents"], r["classification_accuracy_pct"], r["field_accuracy_pct"], r["manual_review_rate_pct"]) == (2, 1, 50.0, 33.33, 50.0)
    a, b = r["per_document_results"]
    assert (a["filename"], a["fields_correct"], a["fields_evaluated"], a["average_cer_pct"]) == ("a.png", 1, 2, 33.34) and b["document_type"] is None and b["fields_correct"] == 0
    with pytest.raises(ValueError, match="one report"):
        evaluate.report(done, F.current_timestamp(), most=1)


def test_command_line(tmp_path, folder):
    texts = tmp_path / "texts.json"
    texts.write_text(json.dumps({"doc_id": 1, "raw_text": "RESIDENCE PERMIT\nPermit No: RP00000001"}) + "\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    (tmp_path / "records.json").write_text(json.dumps({"input_file": "/in/a.png", "document_type": "PERMIT", "manual_review_required": True, "identity": {"full_name": "ADA"}}) + "\n")
    (tmp_path / "truth.json").write_text(json.dumps({"a.png": {"document_type": "PERMIT", "full_name": "ADA"}}))
    evaluation = ["evaluate", str(tmp_path / "records.json"), str(tmp_path / "truth.json"), str(tmp_path / "report")]
    for args in (["screen", str(texts), str(tmp_path / "out")], ["check", str(folder), str(tmp_path / "errors")], evaluation):
        subprocess.run([sys.executable, "-m", "docscreen", *args], env=env, check=True, timeout=200, capture_output=True)
    assert '"document_type":"PERMIT"' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json")) and "ERR_EMPTY_FILE" in "".join(p.read_text() for p in (tmp_path / "errors").glob("*.json"))
    assert '"field_accuracy_pct":100.0' in "".join(p.read_text() for p in (tmp_path / "report").glob("*.json"))
