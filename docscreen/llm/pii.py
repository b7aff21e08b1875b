"""PII: format-preserving Feistel pseudonyms for validated numbers and dates.

Found values are checked (Luhn, IBAN remainder, octets, calendar, number ranges), read as a
number below the size of their format, permuted there by a keyed Feistel network and
written back in the same format. The permutation depends on the key and the kind alone, so
equal values get equal pseudonyms in every document whatever their separators, different
values get different ones, and who holds the key can invert them. Values that fail their
check, such as 16 digits with a wrong check digit, are left alone.

Kinds: email (local part), phone, ip, card, iban, ssn, date, secret (hexadecimal tokens).
Addresses that differ in the case of A-Z have one pseudonym, each in its own case; an IBAN may be all in lower case, without spaces; the date of a time stamp
(2020-12-25T10:00:00) counts, its time stays. Phone numbers begin with "+"; all spellings of one number have one pseudonym, since what is
permuted are the digits after the country code. Numbers without "+" are left alone. Dates
are read day first; one that is valid only month first is left alone. A letter of any script is permuted among the letters of its case nearby in Unicode. A token in upper case gets its lower-case form's pseudonym in upper case. One in mixed case
keeps its pattern of digits and cases instead, since a digit can't carry the case back.

Defined results: a null text stays null, an empty one empty; repeated rows are each
rewritten alike; other columns pass unchanged if named in ``keep``, else are left out.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lower_ascii, map_arrow

KINDS = ("email", "phone", "ip", "card", "iban", "ssn", "date", "secret")
ROUNDS = 8
#: Characters of a value that is permuted as one number.
LONG = 64
DATE_FROM, DATE_TO = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


class Permutation:
    """Keyed permutations of range(n): a balanced Feistel network over the next even power of two, walking its cycle back below n."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _round(self, tweak: str, i: int, half: int, bits: int) -> int:
        """bits of key stream: as many digests as they take."""
        seed = hashlib.blake2b(f"{tweak}|{i}|{half:x}".encode(), key=self.key, digest_size=64).digest()
        out = seed if bits <= 512 else b"".join(hashlib.blake2b(seed + k.to_bytes(4, "big"), key=self.key, digest_size=64).digest() for k in range(-(-bits // 512)))
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def __call__(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        if n < 2:
            return x
        bits = ((n - 1).bit_length() + 1) // 2
        mask, tweak = (1 << bits) - 1, f"{tweak}|{n:x}"
        while True:
            a, b = x >> bits, x & mask
            if back:
                for i in reversed(range(ROUNDS)):
                    a, b = b ^ self._round(tweak, i, a, bits), a
            else:
                for i in range(ROUNDS):
                    a, b = b, a ^ self._round(tweak, i, b, bits)
            x = a << bits | b
            if x < n:
                return x

    def shift(self, x: list[int], radix: list[int], tweak: str, back: bool = False) -> list[int]:
        """Permute a list of digits of these radices, of any length in linear time: a Feistel network of two halves, each shifted digit by digit by a key stream of the other."""
        x, half = list(x), len(x) // 2
        halves = (range(half), range(half, len(x)))
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            to, of = halves[i % 2], halves[1 - i % 2]
            seed = hashlib.blake2b(f"{tweak}|{len(x)}|{i}|".encode() + ",".join(str(x[k]) for k in of).encode(), key=self.key, digest_size=64).digest()
            stream = b"".join(hashlib.blake2b(seed + k.to_bytes(8, "big"), key=self.key, digest_size=64).digest() for k in range(-(-len(to) // 8)))
            for at, k in enumerate(to):
                by = int.from_bytes(stream[8 * at : 8 * at + 8], "big")
                x[k] = (x[k] - by if back else x[k] + by) % radix[k]
        return x


#: Character classes that a value's format keeps.
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS_OF = {c: k for k in _CLASSES for c in k}


@lru_cache(4096)
def class_of(c: str) -> str:
    """The characters that c may become: a letter, digit or mark of its kind and case, from the least stretch of Unicode around it that has several. Others stay."""
    if c in _CLASS_OF or unicodedata.category(c)[0] not in "LMN":
        return _CLASS_OF.get(c, c)
    kind = unicodedata.category(c)
    for size in (0x40, 0x100, 0x1000, 0x10000):
        first = ord(c) // size * size
        near = "".join(chr(x) for x in range(max(0x80, first), first + size) if unicodedata.category(chr(x)) == kind)
        if len(near) > 1:
            return near
    return c


def by_class(value: str, permute: Permutation, tweak: str, back: bool = False, classes: Callable[[str], str] = class_of) -> str:
    """Permute a string among those with the same character class at each place. A long one isn't read as one number, whose arithmetic would grow with its square."""
    radix = [classes(c) for c in value]
    if len(value) > LONG:
        new = permute.shift([r.index(c) for c, r in zip(value, radix)], [len(r) for r in radix], f"{tweak}|{hashlib.sha256('|'.join(r[0] + str(len(r)) for r in radix).encode()).hexdigest()}", back)
        return "".join(r[k] for r, k in zip(radix, new))
    x, n = 0, 1
    for c, r in zip(value, radix):
        x, n = x * len(r) + r.index(c), n * len(r)
    x = permute(x, n, f"{tweak}|{[r[0] + str(len(r)) for r in radix]}", back)
    out = []
    for r in reversed(radix):
        x, k = divmod(x, len(r))
        out.append(r[k])
    return "".join(reversed(out))


def refill(value: str, digits: str) -> str:
    """value with its digits replaced in order; separators stay."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_number(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4]))


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def _email(v: str, p: Permutation, back: bool) -> str | None:
    local, _, domain = v.rpartition("@")
    new = by_class(lower_ascii(local), p, "email", back)
    return "".join(n.upper() if "A" <= c <= "Z" else n for c, n in zip(local, new)) + "@" + domain


#: Country calling codes of one and two digits; all others have three.
_COUNTRY = re.compile("1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")


def _phone(v: str, p: Permutation, back: bool) -> str | None:
    digits = _digits(v)
    country = _COUNTRY.match(digits)
    if not country or not 8 <= len(digits) <= 15:
        return None
    number = digits[country.end() :]
    x = p(int(number), 10 ** len(number), f"phone|{country[0]}|{len(number)}", back)
    return refill(v, f"{country[0]}{x:0{len(number)}d}")


def _ip(v: str, p: Permutation, back: bool) -> str | None:
    parts = [int(x) for x in v.split(".")]
    if max(parts) > 255:
        return None
    x = p(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _card(v: str, p: Permutation, back: bool) -> str | None:
    d = _digits(v)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    x = p(int(d[:-1]), 10 ** (len(d) - 1), f"card|{len(d)}", back)
    payload = f"{x:0{len(d) - 1}d}"
    return refill(v, payload + luhn_digit(payload))


def _iban(v: str, p: Permutation, back: bool) -> str | None:
    s = v.replace(" ", "").upper()
    if not 15 <= len(s) <= 34 or iban_number(s) % 97 != 1:
        return None
    body = by_class(s[4:], p, "iban|" + s[:2], back)
    check = 98 - iban_number(s[:2] + "00" + body) % 97
    new = f"{s[:2]}{check:02d}{body}"
    it = iter(new.lower() if v.islower() else new)
    return "".join(c if c == " " else next(it) for c in v)


def _ssn(v: str, p: Permutation, back: bool) -> str | None:
    area, group, serial = map(int, v.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x = p(x, 898 * 99 * 9999, "ssn", back)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    area += 1 + (area >= 665)
    return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(v: str, p: Permutation, back: bool) -> str | None:
    sep = next(c for c in v if not c.isdigit())
    parts = v.split(sep)
    year_first = len(parts[0]) == 4
    y, m, d = parts if year_first else reversed(parts)
    try:
        day = dt.date(int(y), int(m), int(d))
    except ValueError:
        return None
    if not DATE_FROM <= day <= DATE_TO:
        return None
    x = p((day - DATE_FROM).days, (DATE_TO - DATE_FROM).days + 1, "date", back)
    new = DATE_FROM + dt.timedelta(x)
    wide = len(m) == 2 and len(d) == 2
    m, d = (f"{new.month:02d}", f"{new.day:02d}") if wide else (str(new.month), str(new.day))
    return sep.join((f"{new.year}", m, d) if year_first else (d, m, f"{new.year}"))


_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}
_MIXED_HEX = {c: k for k in ("0123456789", "abcdef", "ABCDEF") for c in k}


def _secret(v: str, p: Permutation, back: bool) -> str | None:
    if not re.search("[0-9]", v) or not re.search("[a-fA-F]", v):
        return None
    if v not in (v.lower(), v.upper()):
        return by_class(v, p, "secret|mixed", back, _MIXED_HEX.__getitem__)
    new = by_class(v.lower(), p, "secret", back, _HEX.__getitem__)
    return new.upper() if v.isupper() else new


_RULES: dict[str, Callable[[str, Permutation, bool], str | None]] = {
    "email": _email, "phone": _phone, "ip": _ip, "card": _card, "iban": _iban, "ssn": _ssn, "date": _date, "secret": _secret,
}

_EMAIL = re.compile(r"(?<![\w.%+-])(?P<email>[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?![A-Za-z0-9-])")
#: Tried in this order at a place where a value can begin.
_NUMBERS = re.compile(
    r"""(?<![\w.+-])(?:
      (?P<secret>[0-9a-fA-F]{32,64})(?!\w)
    | (?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,3})(?![\w-])
    | (?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w-]|\.\d)
    | (?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])
    | (?P<date>(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{1,2}\.\d{1,2}\.\d{4}))(?!(?!T\d\d:)[\w-]|\.\d)
    | (?P<card>\d(?:[ -]?\d){12,18})(?![\w-]|\.\d)
    | (?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?|[a-z]{2}\d{2}[a-z0-9]{11,30})(?!\w)
    )""",
    re.X | re.ASCII,
)
_DIGIT = re.compile("[0-9]")


def rewrite(text: str | None, permute: Permutation, back: bool = False) -> tuple[str | None, Counter]:
    """The text with pseudonyms for its valid values, and how many of each kind."""
    found: Counter = Counter()
    if not text:
        return text, found

    def put(m: re.Match) -> str:
        kind = m.lastgroup
        new = _RULES[kind](m[0], permute, back)
        if new is None:
            return m[0]
        found[kind] += 1
        return new

    if _DIGIT.search(text):
        if "@" in text:  # an address's digits aren't looked at as numbers
            parts = _EMAIL.split(text)
            text = "".join(_NUMBERS.sub(put, x) if i % 2 == 0 else x for i, x in enumerate(parts))
        else:
            text = _NUMBERS.sub(put, text)
    if "@" in text:
        text = _EMAIL.sub(put, text)
    return text, found


def pseudonymize(docs: DataFrame, key: bytes, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", back: bool = False) -> DataFrame:
    """The keep columns, text with pseudonyms, and n_<kind> for each kind; one row for each row of docs, no shuffle.

    back: invert the pseudonyms instead.
    """
    docs = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("text"))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = Permutation(key)
        for b in batches:
            texts, counts = [], []
            for x in b.column(len(keep)):
                text, found = rewrite(x.as_py(), permute, back)
                texts.append(text)
                counts.append([found[k] for k in KINDS])
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), *numbers], schema.names)

    return map_arrow(docs, run, schema)
