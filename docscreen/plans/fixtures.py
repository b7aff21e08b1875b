"""Deterministic screening inputs made from the driver's tables.

Each is SQL that Spark and DuckDB both run, so that both see the same rows; ``{customer}``
and the like stand for the tables. ASCII text and integer arithmetic only.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import written

VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GIVEN = "ANNA,BORIS,CLARA,DAVID,EMMA,FELIX,GRETA,HUGO,IRIS,JONAS,MIRA"
FAMILY = "SMITH,JONES,MUELLER,DUPONT,GARCIA,ROSSI,NOVAK,SILVA,TANAKA,KUMAR,BERG,OLSEN,HALL"
CODES = "IND,USA,GBR,CAN,AUS,NOR,DEU,FRA"
NATIONS = "INDIAN,AMERICAN,BRITISH,CANADIAN,AUSTRALIAN,NORWEGIAN,GERMAN,FRENCH"
CITIES = "HYDERABAD,MUMBAI,DELHI,CHENNAI,PUNE"


def pick(names: str, index: str) -> str:
    return f"split_part('{names}', ',', CAST({index} AS INT) % {len(names.split(','))} + 1)"


def digit(text: str, length: int) -> str:
    """Check digit of a text of known length, as an unrolled sum."""
    terms = [f"{(7, 3, 1)[i % 3]} * greatest(instr('{VALUES}', substr({text}, {i + 1}, 1)) - 1, 0)" for i in range(length)]
    return f"CAST(({' + '.join(terms)}) % 10 AS STRING)"


def two(n: str) -> str:
    return f"lpad(CAST({n} AS STRING), 2, '0')"


MRZ = f"""
    WITH base AS (
        SELECT c_custkey AS doc_id, c_custkey % 7 AS kind, c_custkey % 8 AS corruption,
            {pick(CODES, "c_nationkey")} AS code, {pick(NATIONS, "c_nationkey")} AS nation,
            {pick(GIVEN, "c_custkey")} AS given1, {pick(GIVEN, "c_custkey * 3 + 5")} AS given2, {pick(FAMILY, "c_custkey * 5 + 1")} AS family,
            rpad(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(c_custkey % 26 AS INT) + 1, 1) || lpad(CAST(c_custkey AS STRING), 7, '0'), 9, '<') AS number,
            {two("50 + c_custkey % 50")} AS yb, {two("c_custkey % 12 + 1")} AS bm, {two("c_custkey % 28 + 1")} AS bd,
            {two("20 + c_custkey % 10")} AS ey, {two("(c_custkey * 7) % 12 + 1")} AS em, {two("(c_custkey * 11) % 28 + 1")} AS ed,
            {pick("M,F,X,<", "c_custkey")} AS sex, {pick(CITIES, "c_custkey")} AS city
        FROM {{customer}}
    ), parts AS (
        SELECT *, yb || bm || bd AS birth, CAST(CAST(ey AS INT) + 11 AS STRING) || em || ed AS expiry FROM base
    ), digits AS (
        SELECT *, {digit("number", 9)} AS d1, {digit("birth", 6)} AS d2, {digit("expiry", 6)} AS d3 FROM parts
    ), composite AS (
        SELECT *, {digit("(number || d1 || birth || d2 || expiry || d3 || '<<<<<<<<<<<<<<<')", 39)} AS d4 FROM digits
    ), whole AS (
        SELECT *, rpad('P<' || code || family || '<<' || given1 || '<' || given2, 44, '<') AS line1,
            number || CASE WHEN corruption = 3 THEN CAST((CAST(d1 AS INT) + 1) % 10 AS STRING) ELSE d1 END
                || CASE WHEN corruption = 4 THEN '1' ELSE '' END
                || CASE WHEN corruption = 5 THEN replace(code, 'I', '1') ELSE code END
                || birth || d2 || sex || expiry || d3 || '<<<<<<<<<<<<<<<' || CASE WHEN corruption = 6 THEN '<' ELSE d4 END AS line2w
        FROM composite
    ), mrz AS (
        SELECT *, CASE WHEN corruption = 7 THEN substr(line2w, 1, 30) ELSE line2w END AS line2 FROM whole
    )"""

_FULL = "given1 || ' ' || family"
_TITLE = "substr(given1, 1, 1) || lower(substr(given1, 2, 20)) || ' ' || substr(family, 1, 1) || lower(substr(family, 2, 20))"
_BORN = "bd || '/' || bm || '/19' || yb"
_ISSUED = "ed || '/' || em || '/20' || ey"
_ENDS = "ed || '/' || em || '/20' || CAST(CAST(ey AS INT) + 11 AS STRING)"
_EOL = "chr(10)"


def _text(*lines: str) -> str:
    return f" || {_EOL} || ".join(lines)


TEXT = (
    MRZ
    + f""", texts AS (
        SELECT doc_id, kind, corruption,
            {pick("PASSPORT,VISA,NATIONAL_ID,DRIVING_LICENSE,PERMIT,TRAVEL_AUTH,UNKNOWN", "kind")} AS truth_type,
            CASE kind
            WHEN 0 THEN {_text("'  REPUBLIC  OF  SOMEWHERE '", "''", "'PASSPORT'", "'Surname'", "family", "'Given Names'", "given1 || ' ' || given2", "'Nationality ' || nation", "'Sex ' || sex", f"'Date of Birth ' || {_BORN}", f"'Date of Issue ' || {_ISSUED}", f"'Date of Expiry ' || {_ENDS}", "'Place of Birth ' || city", "'Place of Issue'", pick(CITIES, "doc_id + 2"), "line1", "line2")}
            WHEN 1 THEN {_text("'VISA'", "'Visa No: V' || lpad(CAST(doc_id AS STRING), 8, '0')", "'Visa Type: C' || CAST(corruption AS STRING)", "'Issuing Post: ' || city", "CASE WHEN corruption = 2 THEN 'Holder ' || given1 || ' ' || family ELSE 'Surname: ' || family END", "CASE WHEN corruption = 2 THEN '---' ELSE 'Given Names: ' || given1 END", "'Passport No: ' || replace(number, '<', '')", "'Nationality: ' || nation", "'Sex: ' || replace(sex, '<', 'X')", f"'Date of Birth: ' || {_BORN}", f"'Valid From: ' || {_ISSUED}", f"'Valid Until: ' || {_ENDS}", "'Entries: MULT'", "'Duration of Stay: ' || CAST(30 + corruption AS STRING) || ' DAYS'")}
            WHEN 2 THEN {_text("'GOVERNMENT OF INDIA'", "'AADHAAR'", f"CASE WHEN corruption < 4 THEN {_TITLE} ELSE 'To' END", f"CASE WHEN corruption < 4 THEN 'S/O ' || {_TITLE.replace('given1', 'given2')} ELSE {_TITLE} END", f"'DOB: ' || {_BORN}", "CASE WHEN sex = 'F' THEN 'FEMALE' ELSE 'MALE' END", "'1234 5678 ' || lpad(CAST(doc_id % 10000 AS STRING), 4, '0')", "'12-34 Main Street'", "'VTC: Town ' || CAST(corruption AS STRING)", "'Mobile: none'", "'State: North'", "'PIN Code: 500001'", "'VID: 9123 4567 8901 ' || lpad(CAST(doc_id % 10000 AS STRING), 4, '0')")}
            WHEN 3 THEN {_text("'DRIVING LICENCE'", "'DL No: TS' || lpad(CAST(doc_id AS STRING), 13, '0')", f"'Name : ' || {_FULL}", f"'Date of Birth : ' || {_BORN}", f"CASE WHEN corruption = 1 THEN 'stamp ' || replace({_ISSUED}, '/', ':') ELSE 'Issue Date: ' || {_ISSUED} END", f"'seen ' || {_ENDS}", "'Blood Group: ' || CASE WHEN corruption < 4 THEN 'O+' ELSE 'AB-' END", "'S/O: ' || given2 || ' ' || family", "'Sex: ' || CASE WHEN sex = 'F' THEN 'F' ELSE 'M' END")}
            WHEN 4 THEN {_text("'RESIDENCE PERMIT'", "'Permit No: RP' || lpad(CAST(doc_id AS STRING), 8, '0')", "'Permit Type: ' || CASE WHEN corruption < 4 THEN 'WORK' ELSE 'STUDENT' END", f"'Name: ' || {_FULL}", "'Nationality: ' || code", f"'DOB: ' || {_BORN}", f"'Valid From: ' || {_ISSUED}", f"CASE WHEN corruption = 3 THEN 'no end' ELSE 'Valid Until: ' || {_ENDS} END", "'Issued By: HOME OFFICE'")}
            WHEN 5 THEN {_text("'ELECTRONIC TRAVEL AUTHORIZATION'", "'Application Number: TA' || lpad(CAST(doc_id AS STRING), 9, '0')", "'Status: APPROVED'", f"'Applicant Name: ' || {_FULL}", "'Passport Number: ' || replace(number, '<', '')", "'Country of Citizenship: ' || nation", f"'DOB: ' || {_BORN}", f"'Date of Issue: ' || {_ISSUED}", f"'Expiry Date: ' || {_ENDS}")}
            ELSE {_text("'Meeting  notes  of the day'", "''", "'  nothing to see here   '", "'total ' || CAST(doc_id AS STRING)")}
            END AS raw_text,
            family, given1, given2, nation, code, number, sex, city,
            '19' || yb || '-' || bm || '-' || bd AS birth_iso, '20' || ey || '-' || em || '-' || ed AS issue_iso,
            '20' || CAST(CAST(ey AS INT) + 11 AS STRING) || '-' || em || '-' || ed AS expiry_iso
        FROM mrz
    )"""
)

#: Dates in seven layouts, with days that don't exist, placeholders and blanks.
DATES = """
    WITH d AS (
        SELECT o_orderkey AS id, CAST(year(o_orderdate) AS STRING) AS y, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS m,
            lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd, o_orderkey % 11 AS k FROM {orders}
    ), dates AS (
        SELECT id, k, CASE k WHEN 0 THEN y || '-' || m || '-' || dd WHEN 1 THEN dd || '/' || m || '/' || y WHEN 2 THEN dd || '-' || m || '-' || y
            WHEN 3 THEN dd || '.' || m || '.' || y WHEN 4 THEN y || '/' || m || '/' || dd
            WHEN 5 THEN dd || ' ' || split_part('JAN,FEB,MAR,APR,MAY,JUN,JUL,AUG,SEP,OCT,NOV,DEC', ',', CAST(m AS INT)) || ' ' || y
            WHEN 6 THEN substr(y, 3, 2) || m || dd WHEN 7 THEN '31/02/' || y WHEN 8 THEN ' n/a ' WHEN 9 THEN '' ELSE 'about ' || y END AS raw FROM d
    )"""

#: Files with headers in hexadecimal, extensions and sizes.
FILES = """
    WITH files AS (
        SELECT p_partkey AS id, '/inbox/' || CAST(p_partkey AS STRING) || split_part('.jpg,.JPEG,.png,.bmp,.webp,.tif,.gif,.pdf', ',', CAST(p_partkey % 8 AS INT) + 1) AS path,
            split_part('FFD8FFE0,89504E470D0A1A0A,424D0000,5249464600000000574542502020,49492A00,4D4D002A,00000000,5249464600000000', ',', CAST(p_partkey % 9 % 8 AS INT) + 1) AS header,
            CASE p_partkey % 13 WHEN 0 THEN 0 WHEN 1 THEN 26214401 WHEN 2 THEN NULL ELSE p_partkey * 10 END AS length FROM {part}
    )"""

#: Boxes, frames and image statistics from the event stream.
BOXES = """
    WITH boxes AS (
        SELECT user_id AS image_id, CAST(event_id AS INT) AS pos, CAST((event_id * 13) % 300 AS INT) AS x, CAST((event_id * 7) % 200 AS INT) AS y,
            CAST(20 + (event_id * 29) % 200 AS INT) AS w, CAST((event_id * 31) % 150 AS INT) AS h, ((event_id * 37) % 100) / 100.0 AS conf, 400 AS img_w, 300 AS img_h FROM {events}
    )"""
FRAMES = """
    WITH frames AS (
        SELECT user_id AS session_id, ts, CAST((event_id * 37) % 50 AS DOUBLE) / 100.0 AS ear, event_id % 11 <> 0 AS has_face,
            CASE WHEN event_id % 97 = 0 THEN 'q' WHEN event_id % 89 = 0 THEN ' ' END AS "key" FROM {events}
    )"""
STATS = """
    WITH stats AS (
        SELECT event_id AS id, CAST((event_id * 17) % 300 AS DOUBLE) AS laplacian, CAST((event_id * 23) % 256 AS DOUBLE) AS brightness, CAST(event_id % 90 AS DOUBLE) AS contrast,
            CAST((event_id * 3) % 300 AS DOUBLE) / 10.0 AS glare, CAST(300 + (event_id * 19) % 500 AS INT) AS width, CAST(200 + (event_id * 41) % 400 AS INT) AS height FROM {events}
    )"""

IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


@lru_cache(maxsize=128)
def draw_page(degrees: float, width: int = 240, height: int = 200, lines: int = 5) -> bytes:
    """Gray pixels of a page with lines of text, as bars, turned clockwise by so many degrees."""
    import numpy as np

    y, x = np.mgrid[0:height, 0:width]
    x, y, a = x - width // 2, y - height // 2, np.radians(degrees)
    along, down = x * np.cos(a) + y * np.sin(a), y * np.cos(a) - x * np.sin(a) + 7 * lines
    ink = (np.abs(along) < 75) & (down >= 0) & (down < 14 * lines) & (down % 14 < 8)
    return np.where(ink, 40, 225).astype(np.uint8).tobytes()


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, image): a page for each part, turned by the part's key."""
    import pyarrow as pa

    from ..sources.packaging import ship

    ship(spark)

    def run(batches):
        kind = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                images = [{"origin": f"/pages/{key}", "height": 200, "width": 240, "nChannels": 1, "mode": 0, "data": draw_page(degrees)} for key, degrees in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(images, kind)], ["id", "image"])

    parts = spark.sql(f"SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 83 - 41 AS DOUBLE) AS degrees FROM parquet.`{sf_dir}/part.parquet`")
    return parts.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, f"id long, {IMAGE}")


TABLES = ("customer", "orders", "part", "events", "nation", "documents")


def duck(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})


def frame(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """The table ``name`` that a fixture defines, over the Parquet files of sf_dir."""
    if sql in (MRZ, TEXT):
        return written(spark, f"{sf_dir}|{name}", [f"{sf_dir}/customer.parquet"], lambda: _frame(spark, sf_dir, sql, name))
    return _frame(spark, sf_dir, sql, name)


def _frame(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    text = sql.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}).replace('"key"', "`key`")
    return spark.sql(f"{text} SELECT * FROM {name}")
