"""Pivot index, source divergence and collocations against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docscreen.llm import collocations, pivot_index, source_divergence
from docscreen.llm.common import split_bytes

VECTORS = "vec_id long, embedding array<float>, label int, size int, node string, v int"


def reach(pairs, ids):
    """Least id reachable from each."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            if (x := todo.pop()) not in out:
                out[x] = i
                todo += near[x]
    return out


def plain_links(rows, least):
    good = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1], np.float32).astype(float) for k in good}
    unit = {k: v / math.sqrt((v * v).sum()) for k, v in unit.items()}
    links = [(a, b) for a in good for b in good if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    n = Counter(k for p in links for k in p)
    top = reach([(rows[a][0], rows[b][0]) for a, b in links], {r[0] for r in rows if r[0] is not None})
    return Counter((i, n[k], top.get(i), i == top.get(i)) for k, (i, _, _) in enumerate(rows))


def cluster(rng, d, n, noise):
    base = rng.normal(size=d)
    return [(base + noise * rng.normal(size=d)).tolist() for _ in range(n)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    many = [v for _ in range(12) for v in cluster(rng, 24, 9, 0.2)] + cluster(rng, 24, 70, 0.15) + rng.normal(size=(80, 24)).tolist()
    rows = [(1000 + i, v, i % 2) for i, v in enumerate(many)]
    rows += [(5, many[0], 0), (7, many[0], 0), (7, many[0], 0), (8, many[0], 1), (8, many[30], 0), (9, [2 * x for x in many[0]], 0)]
    rows += [(20, None, 0), (21, [], 0), (22, [0.0] * 24, 0), (23, [*many[0][:-1], None], 0), (24, [*many[0][:-1], math.nan], 0), (25, [*many[0][:-1], math.inf], 0), (26, many[0], None), (None, many[0], 0)]
    rows += [(30, many[0][:23], 0), (31, many[0][:23], 0), (32, [1.0], 0), (33, [3.0], 0), (34, [-1.0], 0)]
    return rows


def linked(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)
    return Counter(map(tuple, pivot_index.near_duplicates(df, **options).collect()))


def test_links_equal_brute_force(spark, vectors):
    want = plain_links(vectors, 0.93)
    assert sum(r[1] > 0 for r in want) > 100
    assert linked(spark, vectors) == want


def test_long_lists_are_dealt_in_blocks(spark, vectors, monkeypatch):
    want = plain_links(vectors, 0.93)
    assert linked(spark, vectors, block=16) == want
    monkeypatch.setattr(pivot_index, "LONG_LISTS", 0)
    assert linked(spark, vectors, block=16) == want


def test_vectors_without_rows_or_links(spark):
    assert not linked(spark, [])
    assert linked(spark, [(1, None, 0), (2, [0.0], None)]) == Counter([(1, 0, 1, True), (2, 0, 2, True)])


def test_recall_at_the_threshold():
    """Pairs whose cosine is just above 0.93, of random directions, that meet in the index by number of pivots."""
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(3000, 64)))
    z = rng.normal(size=a.shape)
    b = 0.9305 * a + math.sqrt(1 - 0.9305**2) * unit(z - (z * a).sum(axis=1, keepdims=True) * a)
    for many in (64, 450, pivot_index.PIVOTS_MOST):
        p = pivot_index.farthest_first(unit(rng.normal(size=(pivot_index.SAMPLE, 64))), many)
        common = (pivot_index.nearest(a, p)[:, :, None] == pivot_index.nearest(b, p)[:, None, :]).sum(axis=(1, 2))
        assert (common >= pivot_index.SHARED).mean() > 0.98, many


# --- divergence --------------------------------------------------------------

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, term string, s long, n long"


def documents(spark, rows):
    """rows: (text, lang, source)."""
    return spark.createDataFrame([(i, *r, 1, "x", 2, 3) for i, r in enumerate(rows)], DOCUMENTS)


def plain_audit(rows, least_docs, top):
    by = defaultdict(Counter)
    holders, total, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        by[lang, source].update(words)
        total[lang].update(words)
        holders[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [w for w in total[lang] if holders[lang][w] >= least_docs]
        v = len(kept)

        def p(counts, w):
            return 1 + 10**9 * (counts[w] + 2) // (sum(counts[x] for x in kept) + 2 * v)

        f = lambda x, y: (x - y) ** 2 // (x + y)
        mine = {w: p(by[lang, source], w) for w in kept}
        pairs = [(-sum(f(mine[w], p(by[lang, other], w)) for w in kept), other) for la, other in groups if la == lang and other != source]
        apart = [(-f(mine[w], q), w) for w in kept if by[lang, source][w] and mine[w] > (q := p(total[lang], w))]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(apart, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -value, r) for r, (value, item) in enumerate(found, 1)]
    return Counter(out)


def test_divergence_equals_plain(spark):
    r = random.Random(3)
    words = [f"{a}{b}" for a in "aeiou" for b in "bcdéßÉ語"]
    rows = [(" ".join(r.choice(words[k % 5 :: 2]) + r.choice(["", ",", "1", "\n"]) for _ in range(30)), "en" if k % 3 else "fr", f"s{k % 5}") for k in range(60)]
    rows += [rows[0]] * 4 + [(None, "en", "s1"), ("", None, None), ("Aé", None, "s0"), ("rare terms only", "xx", "a"), (None, "xx", "b"), ("alone", "yy", "a"), (" ".join(words * 400), "en", None)]
    want = plain_audit(rows, 3, 4)
    got = Counter(map(tuple, source_divergence.audit(documents(spark, rows), least_docs=3, top=4).collect()))
    assert got == want and any(x[2] == "pair" and x[4] == 0 for x in want) and any(x[2] == "term" for x in want)
    none = source_divergence.audit(documents(spark, []))
    assert none.count() == 0 and none.dtypes[4:] == [("value", "bigint"), ("rank", "int")]


def test_counts_leave_a_task_in_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(source_divergence, "TERMS", 3)
    texts = [b"one two three", b"two three four", b"five two"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(["s"] * 3), pa.array(texts, pa.binary())], ["lang", "source", "text"])
    parts, sums = list(source_divergence._counted([batch, batch])), Counter()
    for p in parts:
        for term, n, docs in zip(*(p[c].to_pylist() for c in ("term", "n", "docs"))):
            sums[term] += n
            assert n == docs or term == ""
    assert len(parts) > 1 and sums == Counter({"one": 2, "two": 6, "three": 4, "four": 2, "five": 2, "": 0})


def test_joint_tally_of_dense_and_sparse_rows():
    r = random.Random(4)
    table = [[r.choice([0, 0, 1, 2, 10**12]) for _ in range(6)] for _ in range(50)]
    flat = [(i, s, n) for i, row in enumerate(table) for s, n in enumerate(row) if n]
    got = source_divergence.joint_tally(*(np.array(c, np.int64) for c in zip(*flat)))
    want = Counter((s, t, row[s], row[t]) for row in table for s in range(6) for t in range(s + 1, 6) if row[s] and row[t])
    assert {tuple(map(int, x[:4])): int(x[4]) for x in zip(*got)} == want
    assert all(len(x) == 0 for x in source_divergence.joint_tally(*(np.zeros(0, np.int64),) * 3))


# --- collocations ------------------------------------------------------------


def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        scored = []
        for p, a in found.items():
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if inside[p] < a:
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


@pytest.fixture(scope="module")
def phrases():
    r = random.Random(9)
    words = ["a", "b", "c", "dé", "E", "f\x01", "語", "x" * 30]
    rows = [("".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(r.choice([3, 40, 300]))), r.choice(["en", "fr", None]), "s") for _ in range(60)]
    return rows + [rows[0]] * 3 + [("a b " * 5000, "en", "s"), ("same again. " * 50, "und", "s"), (None, "en", "s"), ("", None, "s"), ("z" * 100_000, "de", "s"), ("rare words only", "es", "s")]


def mined(spark, rows, **options):
    return Counter(map(tuple, collocations.collocations(documents(spark, rows), least=20, **options).collect()))


def test_collocations_equal_plain(spark, phrases):
    want = plain_collocations(phrases, 20, 40)
    assert len({x[0] for x in want}) == 3 and max(x[2].count(" ") for x in want) == 4
    assert mined(spark, phrases, top=40) == want
    assert mined(spark, phrases, top=None) == plain_collocations(phrases, 20, None)
    assert not mined(spark, []) and not mined(spark, [(None, None, None)])


def test_collocations_in_small_rows_and_ranges(spark, phrases, monkeypatch):
    for name, value in (("ROW", 50), ("KEYS", 300), ("RANGE", 200), ("WORDS", 3), ("BLOCK", 2000), ("BITS", 1 << 16)):
        monkeypatch.setattr(collocations, name, value)
    want = plain_collocations(phrases, 20, 40)
    assert mined(spark, phrases, top=40, joined=True) == want
    monkeypatch.setattr(collocations, "split_bytes", lambda raw: split_bytes(raw, 60))
    batches = list(collocations._coded({"en": {b"a": 1, b"b": 2}}, [("en", b"a b a \xff b a" * 200)]))
    assert len(batches) > 5
    for k in range(2, 6):
        seen = [g.tobytes() for b in collocations.grams(batches, k, None) for g in b]
        whole = np.concatenate([np.frombuffer(b["ids"][0].as_py(), np.uint32)[b["lead"][0].as_py() :] for b in batches])
        assert sorted(seen) == sorted(collocations.pack(whole[i : i + k][None])[0].tobytes() for i in range(len(whole) - k + 1) if whole[i : i + k].all())


def test_full_tables_of_bits_change_nothing(spark, phrases, monkeypatch):
    monkeypatch.setattr(collocations, "bit_of", lambda bits, hashes: np.ones(len(hashes), bool))
    assert mined(spark, phrases, top=40) == plain_collocations(phrases, 20, 40)


def test_radix_runs():
    rng = np.random.default_rng(2)
    rows = rng.choice([1, 255, 256, 65535, 65536, 2**32 - 1], size=(4000, 3)).astype(np.uint32)
    keys, counts = collocations.runs(collocations.pack(rows))
    want = Counter(map(tuple, rows.tolist()))
    assert [tuple(np.frombuffer(k.tobytes(), ">u4").tolist()) for k in keys] == sorted(want) and counts.tolist() == [want[k] for k in sorted(want)]


def test_scores_pass_64_bits(spark):
    found = spark.createDataFrame([(2, bytes([0, 0, 0, 1, 0, 0, 0, 2]), 9 * 10**13)], "k int, key binary, f long")
    words = spark.createDataFrame([("en", "a", 10**14, 1), ("en", "b", 95 * 10**12, 2)], "lang string, word string, f long, id long")
    totals = spark.createDataFrame([("en", 10**16)], "lang string, n long")
    r = collocations.ranked(found, words, totals, 10, 100).first()
    assert (r.phrase, r.score) == ("a b", 1000 * 9 * 10**13 * 10**16 // (10**14 * 95 * 10**12))


def test_split_bytes_in_parts():
    raw = b"aa bbbb  cc " + b"d" * 50 + b" e" + b"f" * 30
    for size in (1, 3, 7, 40, 1000):
        assert [w for part in split_bytes(raw, size) for w in part] == raw.split()
    assert list(split_bytes(b"")) == []
