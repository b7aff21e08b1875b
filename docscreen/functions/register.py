"""SQL surface: functions as Catalyst-inlined SQL expressions, and a table function for zone candidates."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .mrz import VALUES

#: name, arguments, result, expression.
SQL_FUNCTIONS = (
    (
        "mrz_check_digit",
        "v STRING",
        "INT",
        f"CASE WHEN v = '' THEN 0 ELSE CAST(aggregate(transform(split(v, ''), (c, i) -> greatest(instr('{VALUES}', c) - 1, 0) * element_at(array(7, 3, 1), CAST(i % 3 + 1 AS INT))), 0, (a, x) -> a + x) % 10 AS INT) END",
    ),
    ("clean_mrz_line", "v STRING", "STRING", "regexp_replace(translate(upper(v), '«‹›|', '<<<<'), '[^A-Z0-9<]', '')"),
    ("viz_tokens", "v STRING", "STRING", "array_join(regexp_extract_all(upper(v), '([A-Z0-9]+)'), ' ')"),
    (
        "mask_id",
        "v STRING",
        "STRING",
        "CASE length(regexp_replace(v, '[ \\t\\n]+', '')) WHEN 12 THEN concat('XXXX-XXXX-', right(regexp_replace(v, '[ \\t\\n]+', ''), 4)) WHEN 16 THEN concat('XXXX-XXXX-XXXX-', right(regexp_replace(v, '[ \\t\\n]+', ''), 4)) "
        "ELSE CASE WHEN length(v) > 4 THEN concat(left(v, 2), repeat('X', length(v) - 4), right(v, 2)) ELSE 'XXXX' END END",
    ),
    (
        "mrz_date",
        "v STRING, pivot INT",
        "STRING",
        "CASE WHEN v RLIKE '^[0-9]{6}$' THEN date_format(try_to_date(concat(CASE WHEN CAST(left(v, 2) AS INT) >= pivot THEN '19' ELSE '20' END, v), 'yyyyMMdd'), 'yyyy-MM-dd') END",
    ),
)


def points(line: str) -> int:
    """The score of a repaired second line, by the rules of ``mrz.score_line2``."""
    import re

    def checked(a: int, b: int) -> bool:
        total = sum((7, 3, 1)[i % 3] * max(0, VALUES.find(c)) for i, c in enumerate(line[a:b]))
        return line[b].isdigit() and total % 10 == int(line[b])

    formats = ((10, "[A-Z0-9<]{9}", 0), (10, "[0-9]", 9), (15, "[A-Z]{3}", 10), (15, "[0-9]{6}", 13), (10, "[MFX<]", 20), (15, "[0-9]{6}", 21))
    score = 10 + sum(n for n, pattern, at in formats if re.match(pattern, line[at:]))
    return score + 30 * sum(checked(a, b) for a, b in ((0, 9), (13, 19), (21, 27)))


@udtf(returnType="pos int, kind string, line string")
class MrzCandidates:
    """Rows of a text's possible machine-readable lines, for ``SELECT * FROM mrz_candidates(text)``."""

    def eval(self, text: str):
        import re

        if text:
            for i, raw in enumerate(text.splitlines()):
                line = re.sub("[^A-Z0-9<]", "", raw.upper().translate(str.maketrans("«‹›|", "<<<<")))
                if len(line) < 20:
                    continue
                if line.startswith("P<"):
                    yield i, "first", line.ljust(44, "<")[:44]
                    continue
                if re.match("[A-Z0-9<]{9}[0-9][1I][A-Z]{3}", line):
                    line = line[:10] + line[11:]
                line = (line[:10] + line[10:13].replace("1", "I") + line[13:]).ljust(44, "<")[:44]
                if points(line) > 20:
                    yield i, "second", line


def register_functions(spark: SparkSession) -> None:
    """Register all of them for the session."""
    for name, args, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    spark.udtf.register("mrz_candidates", MrzCandidates)
