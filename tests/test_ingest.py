"""Files in, records out: errors set apart, copies dropped, and a stop between writing and commit."""

import json
import os

import pytest

from docscreen.operators import slots
from docscreen.sources import files
from docscreen.streaming import ingest

PNG = bytes.fromhex("89504E470D0A1A0A")
PERMIT = b"RESIDENCE PERMIT\nName: ADA BERG%c"
AADHAAR = b"GOVERNMENT OF INDIA\nAADHAAR\nAda Berg\nS/O Otto Berg\nDOB: 01/02/1980\nMALE\n1234 5678 9012"


def reader(log=None):
    def read(values):
        if log:
            with open(log, "a") as f:
                f.write("x" * len(values))
        if any(b"SMUDGE" in v for v in values):
            raise RuntimeError("smudged")
        return [[v[len(PNG) :].decode(), ""] for v in values]

    return slots.Model(f"reader {log}", lambda: read, 8)


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    files_ = {f"p{k}.png": PNG + PERMIT % (65 + k) for k in range(4)} | {"copy.png": PNG + PERMIT % 66, "id.png": PNG + AADHAAR, "bad.png": b"GIF8", "also_bad.png": b"GIF8", "smudge.png": PNG + b"SMUDGE", "note.pdf": PNG}
    for name, data in files_.items():
        (folder / name).write_bytes(data)
    return folder


def start(spark, tmp_path, log, per_batch=6):
    stream = files.landing_stream(spark, str(tmp_path / "in"), per_batch)
    return ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "state"), reader(log), copies_within="1 day")


def rows(tmp_path, part):
    return [json.loads(line) for p in sorted((tmp_path / "out" / part).rglob("*.json")) for line in p.read_text().splitlines()]


def test_ingest_and_restart(spark, landing, tmp_path, monkeypatch):
    log, write, stops = str(tmp_path / "log"), ingest.write_batch, []

    def stop_after_writing(df, number, *rest):
        write(df, number, *rest)
        if number == 1 and not stops:
            stops.append(number)
            raise KeyError("stopped before the commit")

    monkeypatch.setattr(ingest, "write_batch", stop_after_writing)
    with pytest.raises(Exception, match="stopped before the commit"):
        start(spark, tmp_path, log).awaitTermination()
    assert stops == [1]
    start(spark, tmp_path, log).awaitTermination()
    records, errors, audit = rows(tmp_path, "records"), rows(tmp_path, "errors"), rows(tmp_path, "audit")
    permits = sorted(r["identity"]["full_name"] for r in records if r["document_type"] == "PERMIT")
    assert permits == [f"ADA BERG{k}" for k in "ABCD"] and len(records) == 5  # the copy is no record of its own
    assert [r["identity"]["full_name"] for r in records if r["document_type"] != "PERMIT"] == ["Ada Berg"]
    got = sorted((os.path.basename(r["input_file"]), r["status"], r["error_codes"][0]) for r in errors)
    assert got == [("also_bad.png", "ERROR", "ERR_MALICIOUS_PAYLOAD"), ("bad.png", "ERROR", "ERR_MALICIOUS_PAYLOAD"), ("note.pdf", "ERROR", "ERR_INVALID_EXTENSION"), ("smudge.png", "ERROR", "ERR_OCR_ENGINE_FAILURE")]
    smudged = next(r for r in errors if "smudge" in r["input_file"])
    assert smudged["manual_review_reasons"] == ["RuntimeError: smudged"] and smudged["error_code"] == "E004"
    assert sorted(e["request_id"] for e in audit) == sorted(r["request_id"] for r in records + errors) and len({e["request_id"] for e in audit}) == 9
    assert not (tmp_path / "out" / "staged").exists() or not any((tmp_path / "out" / "staged").rglob("*.parquet"))
    # Later files, one a copy of an earlier file: one more record, nothing again.
    (landing / "late.png").write_bytes(PNG + PERMIT % 90)
    (landing / "late_copy.png").write_bytes(PNG + PERMIT % 67)
    start(spark, tmp_path, log).awaitTermination()
    assert len(rows(tmp_path, "records")) == 6 and len(rows(tmp_path, "errors")) == 4
    assert ingest.written(spark, str(tmp_path / "out"), "audit").count() == 10
