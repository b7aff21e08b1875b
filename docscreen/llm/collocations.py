"""Phrase collocation mining: phrases of 2 to 5 words that occur far more often than their parts would by chance.

1. Words are counted within tasks and summed. Words of a language that occur ``least`` times get a number, those of all languages from one range, so a number names its language as well.
2. Texts become arrays of numbers. All else ends a piece: punctuation, rare words (no phrase that holds one can occur ``least`` times) and the end of a text are zeros.
3. For each length k, the n-grams of numbers are packed into fixed-width binary keys of 4k bytes, sorted by radix within a task and run-length counted, dealt out by range of keys, sorted again where a range's runs meet, and run-length counted.
   Beyond two words only n-grams are packed whose two parts of k - 1 words are frequent, by a bit table of at most ``BITS`` bits; a false hit there costs a count and changes no result.
4. Candidates are scored by joins on the keys of their parts, dropped if a longer candidate explains them, ranked, and only then spelled out.

An n-gram that is very frequent arrives at its range once from each task's sort, not once for each occurrence. Ranges are cut at the quantiles of a
sample of ``SAMPLE`` positions, which decides nothing but the sizes of groups. The dictionary is broadcast while it has at most
``DICTIONARY_WORDS`` words and ``DICTIONARY_BYTES`` bytes; a larger one goes to the texts by joins: texts are written in blocks, each block's distinct words
are joined with the dictionary, and a block and its words meet by its number. Bit tables and cuts are of bounded size.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows count each; texts of any length are worked on in stretches
without losing n-grams at their ends; scores are exact up to products of 38 digits. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.packaging import ship
from .common import map_arrow, materialize, split_bytes
from .hashing import gram_hashes

LONGEST = 5
#: Words counted in a task before it hands their counts on; numbers in a row of the coded table; keys sorted at once.
WORDS, ROW, KEYS = 300_000, 1 << 19, 1 << 21
#: Occurrences that a range of keys is meant to hold; positions sampled for the cuts; bits of a level's table at most.
RANGE, SAMPLE, BITS = 1 << 20, 100_000, 1 << 27
DICTIONARY_WORDS, DICTIONARY_BYTES = 500_000, 16_000_000
#: Bytes of text in a block, if the dictionary is joined.
BLOCK = 4_000_000

#: Stands for any of .,;:!? and \x0A-\x0D; no UTF-8 text has this byte.
_STOP = b"\xff"
#: A-Z are lower-cased; words are [^\x20\x09]+, so other control characters belong to them.
_FOLD = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def fold(raw: bytes) -> bytes:
    """Words and stops between spaces."""
    return raw.translate(_FOLD).replace(_STOP, b" \xff ")


# --- 1: words ----------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) of batches of (lang, text)."""
    counts: defaultdict = defaultdict(Counter)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, c in counts.items():
            c.pop(_STOP, None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "f"])
        counts.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            for words in split_bytes(fold(text.as_buffer().to_pybytes())):
                counts[lang].update(words)
            if sum(map(len, counts.values())) > WORDS:
                yield from out()
    yield from out()


def number(words: DataFrame) -> DataFrame:
    """lang, word, f and id from 1 on, without gaps. words: a written table; the order is its files'."""
    placed = materialize(words.withColumn("p", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "collocation-words")
    parts = sorted((r.p, r["count"]) for r in placed.groupBy("p").count().collect())  # a row for each partition
    if sum(n for _, n in parts) >= 1 << 32:
        raise ValueError("the dictionary has more words than keys of four bytes can tell apart")
    before = [(p, sum(n for _, n in parts[:i])) for i, (p, _) in enumerate(parts)]
    starts = words.sparkSession.createDataFrame(before, "p int, start long")
    return placed.join(F.broadcast(starts), "p").select("lang", "word", "f", (F.col("start") + F.col("k") + 1).alias("id"))


# --- 2: texts as numbers -----------------------------------------------------


class Coder:
    """Collects numbers and cuts them into rows of ROW. A row that goes on where another ended begins with the last ``lead`` numbers of that one."""

    def __init__(self):
        self.parts, self.size, self.lead = [], 0, 0

    def add(self, ids: list[int]) -> Iterator[pa.RecordBatch]:
        self.parts.append(np.array(ids, np.uint32))
        self.size += len(ids)
        if self.size >= ROW:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size > self.lead:
            ids = np.concatenate(self.parts)
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([self.lead], pa.int32())], ["ids", "lead"])
            tail = ids[-(LONGEST - 1) :]
            self.parts, self.size, self.lead = [tail], len(tail), len(tail)


def _coded(numbers: dict[str, dict[bytes, int]], texts: Iterator[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """(ids, lead) of folded texts."""
    coder = Coder()
    for lang, raw in texts:
        get = numbers.get(lang, {}).get
        for words in split_bytes(raw):
            yield from coder.add([get(w, 0) for w in words])
        yield from coder.add([0])
    yield from coder.flush()


def _by_lang(t: pa.Table | pa.RecordBatch) -> dict[str, dict[bytes, int]]:
    numbers: dict = defaultdict(dict)
    for lang, word, i in zip(t["lang"].to_pylist(), t["word"].cast(pa.binary()).to_pylist(), t["id"].to_pylist()):
        numbers[lang][word] = i
    return numbers


def code_by_broadcast(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(ids, lead), the dictionary sent to all tasks."""
    given = docs.sparkSession.sparkContext.broadcast(dictionary.select("lang", "word", "id").toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _by_lang(given.value)
        yield from _coded(numbers, ((lang, fold(text.as_buffer().to_pybytes())) for b in batches for lang, text in zip(b.column(0).to_pylist(), b.column(1))))

    return map_arrow(docs, run, "ids binary, lead int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lang, text, words) of batches of (lang, text): folded texts of one language, BLOCK bytes or one text each, and their distinct words."""
    from pyspark import TaskContext

    held: defaultdict = defaultdict(list)
    size, at = Counter(), TaskContext.get().partitionId() << 32

    def out(lang: str) -> pa.RecordBatch:
        nonlocal at
        text = (b" " + _STOP + b" ").join(held.pop(lang))
        size.pop(lang)
        at += 1
        words = {w for part in split_bytes(text) for w in part} - {_STOP}
        columns = [pa.array([at]), pa.array([lang], pa.string()), pa.array([text], pa.binary()), pa.array([[w.decode() for w in words]], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["block", "lang", "text", "words"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            held[lang].append(fold(text.as_buffer().to_pybytes()))
            size[lang] += len(held[lang][-1])
            if sum(size.values()) >= BLOCK:
                yield out(size.most_common(1)[0][0])
    for lang in list(held):
        yield out(lang)


def code_by_join(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(ids, lead), each block of texts meeting its own words' numbers."""
    blocks = materialize(map_arrow(docs, _blocks, "block long, lang string, text binary, words array<string>"), "collocation-blocks")
    known = blocks.select(F.col("block").alias("of"), "lang", F.explode("words").alias("word")).join(dictionary, ["lang", "word"]).toDF("lang", "word", "of", "f", "id")

    def meet(texts: pa.Table, words: pa.Table) -> pa.Table:
        pairs = zip(texts["lang"].to_pylist(), texts["text"].to_pylist())
        return pa.Table.from_batches(_coded(_by_lang(words), pairs), pa.schema([("ids", pa.binary()), ("lead", pa.int32())]))

    ship(docs.sparkSession)
    return blocks.select("block", "lang", "text").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(meet, "ids binary, lead int")


# --- 3: n-grams --------------------------------------------------------------


def pack(keys: np.ndarray) -> np.ndarray:
    """Rows of numbers as fixed-width binary keys whose byte order is the numbers' order."""
    return np.ascontiguousarray(keys.astype(">u4")).view(np.uint8).reshape(len(keys), 4 * keys.shape[1])


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The byte order of fixed-width keys: stable radix sorts by two bytes from the last on."""
    order = np.arange(len(keys))
    digits = keys.view(">u2")
    for column in reversed(range(digits.shape[1])):
        digit = digits[:, column].astype(np.uint16)
        if (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = radix_order(keys)
    keys = keys[order]
    words = keys.view(np.uint32)
    first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts[order], first)
    return keys[first], sums.astype(np.int64)


def as_strings(keys: np.ndarray) -> np.ndarray:
    """Keys, all of one width, as values that numpy orders by their bytes."""
    return np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel()


def bit_of(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def starts(ids: np.ndarray, lead: int, k: int, bits: np.ndarray | None) -> np.ndarray:
    """Where an n-gram of k numbers begins that can be frequent and isn't counted in the row before."""
    if len(ids) < k:
        return np.zeros(0, np.int64)
    if k == 2 or bits is None:
        ok = np.ones(len(ids) - k + 1, bool)
        for j in range(k):
            ok &= ids[j : len(ids) - k + 1 + j] > 0
    else:
        part = bit_of(bits, gram_hashes(ids.astype(np.uint64), k - 1))
        for j in range(k - 1):
            part &= ids[j : len(ids) - k + 2 + j] > 0
        ok = part[:-1] & part[1:]
    ok[: max(0, lead - k + 1)] = False
    return np.flatnonzero(ok)


def grams(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray | None) -> Iterator[np.ndarray]:
    """Keys of the n-grams of k numbers of each row that can be frequent."""
    for b in batches:
        for raw, lead in zip(b.column(0), b.column(1).to_pylist()):
            ids = np.frombuffer(raw.as_buffer(), np.uint32)
            at = starts(ids, lead, k, bits)
            yield pack(ids[at[:, None] + np.arange(k)])


def _dealt(k: int, bits: np.ndarray | None, cuts: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, keys, counts): a task's runs, cut by range."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        keys, counts = runs(np.concatenate(held))
        part = np.searchsorted(cuts, as_strings(keys), side="right")
        edge = np.flatnonzero(np.diff(part, prepend=-1))
        pieces = [slice(a, b) for a, b in zip(edge, np.append(edge[1:], len(keys)))]
        columns = [pa.array(part[edge].astype(np.int32)), pa.array([keys[p].tobytes() for p in pieces], pa.binary()), pa.array([counts[p].tobytes() for p in pieces], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "keys", "counts"])

    for keys in grams(batches, k, bits):
        held.append(keys)
        size += len(keys)
        if size >= KEYS:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _merged(k: int, least: int, t: pa.Table) -> pa.Table:
    """(key, f, h) of a range's n-grams that occur often enough; h is what the next level's bit table is addressed by."""
    keys, counts = runs(np.frombuffer(b"".join(t["keys"].to_pylist()), np.uint8).reshape(-1, 4 * k), np.frombuffer(b"".join(t["counts"].to_pylist()), np.int64))
    keys, counts = keys[counts >= least], counts[counts >= least]
    hashes = gram_hashes(keys.view(">u4").astype(np.uint64).ravel(), k)[::k] if len(keys) else np.zeros(0, np.uint64)
    return pa.table({"key": pa.array([x.tobytes() for x in keys], pa.binary()), "f": counts, "h": hashes.astype(np.int64)})


def bit_table(frequent: DataFrame, n: int) -> np.ndarray:
    """A bit for the hash of each frequent n-gram, at least 16 bits an n-gram up to BITS in all: 16 MB at most, however many there are."""
    size = min(BITS, 1 << max(16, (16 * n - 1).bit_length()))
    slot = F.col("h").bitwiseAND(size - 1)
    rows = frequent.groupBy(F.shiftright(slot, 15).alias("at")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("bits")).collect()
    out = np.zeros(max(size // 8, 4096), np.uint8)
    for r in rows:
        out[4096 * r["at"] : 4096 * (r["at"] + 1)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out[: size // 8]


def frequent_grams(coded: DataFrame, k: int, bits: np.ndarray | None, sample: np.ndarray, step: int, least: int) -> DataFrame:
    """(key, f, h) of the n-grams of k numbers that occur ``least`` times. sample: every step-th position's numbers."""
    apart = np.pad(sample, ((0, 0), (0, 1))).ravel()
    at = starts(apart, 0, k, bits)
    drawn = np.sort(as_strings(pack(sample[at[at % (LONGEST + 1) == 0] // (LONGEST + 1), :k])))
    many = max(1, math.ceil(len(drawn) * step / RANGE))
    cuts = np.unique(drawn[np.arange(1, many) * len(drawn) // many])
    spark = coded.sparkSession
    given = spark.sparkContext.broadcast((bits, cuts))
    dealt = map_arrow(coded, lambda b: _dealt(k, *given.value, b), "part int, keys binary, counts binary")
    return dealt.groupBy("part").applyInArrow(lambda t: _merged(k, least, t), "key binary, f long, h long")


def _sampled(step: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Five numbers from every step-th position of a row on, its first one chosen by the row's bytes."""
    for b in batches:
        for raw, lead in zip(b.column(0), b.column(1).to_pylist()):
            ids = np.append(np.frombuffer(raw.as_buffer(), np.uint32), np.zeros(LONGEST - 1, np.uint32))
            at = np.arange(lead + int(ids.sum(dtype=np.uint64) % np.uint64(step)), len(ids) - LONGEST + 1, step)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([ids[at[:, None] + np.arange(LONGEST)].tobytes()], pa.binary())], ["ids"])


# --- 4: candidates -----------------------------------------------------------


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int | None = 2000, explained: int = 100, joined: bool | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases (all if top is None).

    least: occurrences of a candidate. explained: percent of a phrase's occurrences within a longer candidate from which it is dropped.
    joined: give the dictionary to the texts by joins; None: if it is too large to broadcast.
    """
    docs = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = materialize(map_arrow(docs, _counted, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")), "collocation-counts")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    dictionary = number(counted.where(F.col("f") >= least))
    size = dictionary.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).alias("b"), F.coalesce(F.sum("f"), F.lit(0)).alias("f")).first()
    if joined is None:
        joined = size.n > DICTIONARY_WORDS or size.b > DICTIONARY_BYTES
    coded = materialize((code_by_join if joined else code_by_broadcast)(docs, dictionary), "collocation-codes")
    step = max(1, size.f // SAMPLE)
    drawn = map_arrow(coded, lambda b: _sampled(step, b), "ids binary").collect()  # 20 bytes for each of about SAMPLE positions
    sample = np.frombuffer(b"".join(bytes(r.ids) for r in drawn), np.uint32).reshape(-1, LONGEST)

    levels, bits = [], None
    for k in range(2, LONGEST + 1):
        level = materialize(frequent_grams(coded, k, bits, sample, step, least), f"collocation-{k}")
        levels.append(level.select(F.lit(k).alias("k"), "key", "f"))
        if k < LONGEST:
            bits = bit_table(level, level.count())
    found = levels[0]
    for level in levels[1:]:
        found = found.unionAll(level)
    return ranked(found, dictionary, totals, top, explained)


def _number_at(key: str, i: int) -> Column:
    """The i-th number of a key."""
    return F.conv(F.hex(F.substring(key, 4 * i + 1, 4)), 16, 10).cast("long")


def ranked(found: DataFrame, dictionary: DataFrame, totals: DataFrame, top: int | None, explained: int) -> DataFrame:
    """Candidates (k, key, f) scored, those within a longer one dropped, ranked and spelled out."""
    one = dictionary.select("lang", F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "f", "id", "word")
    known = one.select("key", "f").unionAll(found.select("key", "f"))
    part = lambda start, n: F.expr(f"substring(key, 4 * ({start}) + 1, 4 * ({n}))")
    cuts = found.select("key", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("left", part("0", "cut")).withColumn("right", part("cut", "k - cut"))
    cuts = cuts.join(known.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.withColumn("first", part("0", "1")).join(one.select(F.col("key").alias("first"), "lang"), "first").join(totals, "lang")
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    score = F.call_function("div", whole("a", 17) * 1000 * whole("n", 17), whole("l", 18) * whole("r", 18))
    scored = cuts.withColumn("score", score).groupBy("lang", "key", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    scored = scored.select("lang", "key", "k", "a", "n", "b.score", "b.l", "b.r")

    inner = found.where("k > 2").select("key", "k", "f", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m")).select("key", "f", "m", F.explode(F.sequence(F.lit(0), F.col("k") - F.col("m"))).alias("at"))
    longer = inner.select(part("at", "m").alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, "key", "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(explained) * F.col("a"), F.lit(True)))

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    if top is not None:  # all that ties could still bring in; then their words are needed
        kept = kept.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place")
    ids = F.array(*[F.when(F.col("k") > i, F.struct(F.lit(i).alias("i"), _number_at("key", i).alias("id"))) for i in range(LONGEST)])
    spelled = kept.select("key", F.inline(F.filter(ids, lambda x: x.isNotNull()))).join(one.select("id", "word"), "id").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = kept.join(spelled, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
