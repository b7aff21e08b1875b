"""MinHash near-dedup by a multi-index Hamming join over b-bit signatures.

A document's set of five-word shingles gets a signature of SYMBOLS min-hashes of 16 bits.
Two signatures under the distance threshold (MAX_DISTANCE symbols differ) have, when cut
into CHUNKS parts, a part with at most one differing symbol. So each part is looked up once
for each symbol that may differ, by the others: every pair under the threshold meets in
some bucket. At a Jaccard index of 0.85 a pair exceeds the threshold with a probability of
about 4e-6, at 0.80 of about 1.4e-4.

Documents with equal sets form a class and go on as one. Pairs aren't listed:

1. A bucket gives the spanning edges of those under the threshold. In a bucket of more than
   HOT members each is compared with the least of them; if more than HOT are too far from it,
   the bucket is dealt out anew by a second part (where at most two of the symbols left to
   differ fall, if the first has none or one), else those few are joined to the rest without a
   test, which loses nothing. What is connected so is a cluster.
2. Links are confirmed on full sets. Each member of a cluster is compared with the least one,
   in groups of at most BLOCK members; a cluster whose members are all linked to it is done.
3. In the others, the members that aren't linked to the least one are compared with each
   other and with those that are, block by block, two blocks to a task.

Defined results: texts without a word are linked with nothing; rows with a null id are
linked with nothing and kept; rows that repeat an id count as one document with several
texts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, sized
from .components import components
from .hashing import gram_hashes, mix, word_hashes

SHINGLE = 5
SYMBOLS, CHUNKS, WIDTH = 32, 8, 4
#: With one error allowed in each of CHUNKS parts, fewer than 2 * CHUNKS errors can't miss.
MAX_DISTANCE = 2 * CHUNKS - 1
HOT, BLOCK = 512, 500
#: Rows of classes, and of buckets, for a task.
TASK_ROWS = 500_000
_U = np.uint64
_FACTORS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | _U(1)
_STEP = 1 << 15


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    w, _, _ = word_hashes((text or "").encode(), fold=True)
    if not len(w):
        return w
    return np.unique(gram_hashes(w, min(SHINGLE, len(w))) if len(w) >= SHINGLE else gram_hashes(w, len(w)) ^ _U(len(w)))


def signature(s: np.ndarray) -> np.ndarray:
    """SYMBOLS values of 16 bits."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), _STEP):
        np.minimum(least, (s[i : i + _STEP, None] * _FACTORS).min(0), out=least)
    return (mix(least) >> _U(48)).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        n, digest, sig = [], [], []
        for text in b.column(1):
            s = shingle_set(text.as_py())
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])


def _symbols(column) -> np.ndarray:
    """Signatures [row, symbol]."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _key(part: np.ndarray, name: int | np.ndarray) -> np.ndarray:
    """A hash of some symbols of each row and of what they are."""
    k = np.zeros(len(part), np.uint64) + np.asarray(name, np.uint64)
    for i in range(part.shape[1]):
        k = mix(k * _U(SYMBOLS + 1) + part[:, i].astype(np.uint64))
    return k.view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of each signature: for each part and each symbol of it that may differ, a hash of the others."""
    for b in batches:
        sig = _symbols(b.column(1))
        keys = np.empty((len(sig), CHUNKS * WIDTH), np.int64)
        for c in range(CHUNKS):
            for skip in range(WIDTH):
                at = [c * WIDTH + i for i in range(WIDTH) if i != skip]
                keys[:, c * WIDTH + skip] = _key(sig[:, at], c * WIDTH + skip)
        rep = np.repeat(b.column(0).to_numpy(), CHUNKS * WIDTH)
        part = np.tile(np.repeat(np.arange(CHUNKS, dtype=np.int8), WIDTH), len(sig))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep), pa.array(part)], ["key", "rep", "part"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, rep, part, sig, least, center): whether the signature is under the threshold to the center's."""
    for b in batches:
        far = (_symbols(b.column(3)) != _symbols(b.column(5))).sum(1) > MAX_DISTANCE
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(far)], ["key", "rep", "part", "sig", "least", "far"])


def _second_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of a hot bucket's members by another part and two of its symbols that may differ. A pair
    that has no errors or one in the first part has two or fewer in the best of the others."""
    pairs = [(i, j) for i in range(WIDTH) for j in range(i)]
    for b in batches:
        first, rep, part, sig = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _symbols(b.column(3))
        for c in range(CHUNKS):
            on = part != c
            for n, (i, j) in enumerate(pairs):
                key = _key(sig[on][:, [c * WIDTH + i, c * WIDTH + j]], mix(first[on].view(np.uint64)) + _U(c * len(pairs) + n))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep[on])], ["key", "rep"])


def _span(adjacent: np.ndarray) -> np.ndarray:
    """The least index that each row of a symmetric adjacency matrix reaches."""
    label = np.arange(len(adjacent))
    while True:
        new = np.where(adjacent, label[None, :], len(adjacent)).min(1)
        new = np.minimum(label, new)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, rep, sig) sorted by key: star edges of what is connected under the threshold within each bucket."""

    def edges(key: np.ndarray, rep: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
        size = np.diff(start, append=len(key))
        two = start[size == 2]
        near = two[(sig[two] != sig[two + 1]).sum(1) <= MAX_DISTANCE]
        a, b = [rep[near]], [rep[near + 1]]
        for s, n in zip(start[size > 2], size[size > 2]):
            g, r = sig[s : s + n], rep[s : s + n]
            far = np.zeros((n, n), np.uint8)
            for k in range(SYMBOLS):
                far += g[:, k, None] != g[None, :, k]
            label = _span(far <= MAX_DISTANCE)
            other = np.flatnonzero(label != np.arange(n))
            a.append(r[other])
            b.append(r[label[other]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    rest: tuple | None = None
    for batch in batches:
        key, rep, sig = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _symbols(batch.column(2))
        if rest:
            key, rep, sig = (np.concatenate(x) for x in zip(rest, (key, rep, sig)))
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on; it has at most HOT rows
        yield edges(key[:cut], rep[:cut], sig[:cut])
        rest = key[cut:], rep[cut:], sig[cut:]
    if rest:
        yield edges(*rest)


def linked(sets: list[np.ndarray], ids: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, least id of its group) of what is linked: 100 * intersection >= percent * union."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        adjacent = np.full((2, 2), 100 * common >= percent * (size.sum() - common))
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
        _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[place] > 1
        columns, place = np.unique(place[shared], return_inverse=True)
        owner = owner[shared]
        order = np.argsort(place, kind="stable")
        place, owner = place[order], owner[order]
        common = np.zeros((n, n), np.float32)
        step = max(256, 4_000_000 // n)
        for low in range(0, len(columns), step):
            i, j = np.searchsorted(place, (low, low + step))
            m = np.zeros((n, min(step, len(columns) - low)), np.float32)
            m[owner[i:j], place[i:j] - low] = 1
            common += m @ m.T
        adjacent = np.array([100 * c >= percent * (k + size - c) for c, k in ((c.astype(np.int64), k) for c, k in zip(common, size))])
    label = _span(adjacent)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return ids, least[label]


def _sets(batches: Iterator[pa.RecordBatch], heads: int) -> Iterator[tuple]:
    """The first columns, and the set of the packed text in the last."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for head, packed in zip(zip(*(b.column(k).to_pylist() for k in range(heads))), b.column(heads)):
            yield head, shingle_set(unpack(packed.as_py()).decode())


def _stars(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (cluster, salt, rep, packed), the cluster's least member first: which of the others are linked to it."""
        group, center, rows = None, [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.bool_()))], ["cluster", "rep", "ok"])

        for (cluster, salt, rep), s in _sets(batches, 3):
            if (cluster, salt) != group:
                group, center = (cluster, salt), []
            if rep == cluster:
                center.append(s)  # several only if rows repeat its id
                continue
            common = [len(np.intersect1d(c, s, assume_unique=True)) for c in center]
            rows.append((cluster, rep, any(100 * n >= percent * (len(c) + len(s) - n) for n, c in zip(common, center))))
            if len(rows) == 10_000:
                yield out()
                rows.clear()
        if rows:
            yield out()

    return run


def _pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (cluster, i, j, rep, packed) sorted by the first three: confirmed star edges within each pair of blocks."""
        group, ids, sets = None, [], []

        def out() -> pa.RecordBatch:
            a, b = linked(sets, np.array(ids, np.int64), percent) if len(sets) > 1 else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

        for (*head, rep), s in _sets(batches, 4):
            if head != group:
                if group:
                    yield out()
                group, ids, sets = head, [], []
            ids.append(rep)
            sets.append(s)
        if group:
            yield out()

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack((x.as_py() or "").encode()) for x in b.column(1)], pa.binary())], ["doc_id", "packed"])


def _shared(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Star edges between the classes that hold texts of one doc_id."""
    texts = signed.where("doc_id is not null and digest is not null").select("doc_id", "digest")
    several = texts.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("low"), F.max(F.xxhash64("digest")).alias("high")).where("low <> high").select("doc_id")
    held = texts.join(several, "doc_id").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
    least = held.groupBy("doc_id").agg(F.min("rep").alias("least"))
    return held.join(least, "doc_id").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))


def _candidates(classes: DataFrame, n: int, hot: int, partitions: int) -> DataFrame:
    """Edges (a, b) that connect all classes (rep, sig) whose signatures are under the threshold."""

    def bucketed(keys: DataFrame) -> DataFrame:
        met = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1")
        return keys.join(met, "key")

    def cold(meets: DataFrame) -> DataFrame:
        signed = meets.where(F.col("n") <= hot).select("key", "rep").join(classes, "rep").select("key", "rep", "sig")
        return map_arrow(signed.repartition(partitions, "key").sortWithinPartitions("key"), _bucket_edges, "a long, b long")

    star = F.col("rep").alias("a"), F.col("least").alias("b")
    meets = materialize(sized(bucketed(map_arrow(classes, _keys, "key long, rep long, part byte")), CHUNKS * n / TASK_ROWS), "buckets")
    edges = cold(meets)
    if not meets.where(F.col("n") > hot).limit(1).count():
        return edges
    center = classes.select(F.col("rep").alias("least"), F.col("sig").alias("center"))
    full = meets.where(F.col("n") > hot).join(classes, "rep").join(center, "least").select("key", "rep", "part", "sig", "least", "center")
    full = materialize(sized(map_arrow(full, _near, "key long, rep long, part byte, sig binary, least long, far boolean"), CHUNKS * n / TASK_ROWS), "hot-buckets")
    far = full.groupBy("key").agg(F.count_if("far").alias("n_far"))
    edges = edges.unionAll(full.where("not far").select(*star)).unionAll(full.where("far").join(far.where(F.col("n_far") <= hot), "key").select(*star))
    again = bucketed(map_arrow(full.join(far.where(F.col("n_far") > hot), "key").select("key", "rep", "part", "sig"), _second_keys, "key long, rep long"))
    again = materialize(sized(again, CHUNKS * n / TASK_ROWS), "second-buckets")
    return edges.unionAll(cold(again)).unionAll(again.where(F.col("n") > hot).select(*star))


def near_duplicates(docs: DataFrame, percent: int = 85, hot: int = HOT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = materialize(map_arrow(texts, _sign, "doc_id long, n_shingles long, digest binary, sig binary"), "signatures")
    n = signed.count()
    classes = signed.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = materialize(sized(classes, n / TASK_ROWS), "classes")
    clusters = materialize(components(_candidates(classes.select("rep", "sig"), n, hot, partitions), most=n), "clusters")
    packed = map_arrow(texts.join(clusters.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi"), _pack, "doc_id long, packed binary")
    members = clusters.join(packed, clusters["node"] == packed["doc_id"]).select(F.col("node").alias("rep"), F.col("component").alias("cluster"), "packed")
    members = materialize(sized(members, clusters.count() / 20_000), "members")

    # Each member with its cluster's least one, which goes to each of the cluster's groups.
    groups = members.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("n_groups"))
    own = F.pmod(F.xxhash64("rep"), F.col("n_groups")).cast("int")
    salts = F.when(F.col("rep") == F.col("cluster"), F.sequence(F.lit(0), F.col("n_groups") - 1)).otherwise(F.array(own))
    dealt = members.join(groups, "cluster").select("cluster", F.explode(salts).alias("salt"), "rep", "packed")
    dealt = dealt.repartition(partitions, "cluster", "salt").sortWithinPartitions("cluster", "salt", F.col("rep") != F.col("cluster"))
    tested = materialize(sized(map_arrow(dealt, _stars(percent), "cluster long, rep long, ok boolean").groupBy("cluster", "rep").agg(F.max("ok").alias("ok")), n / TASK_ROWS), "stars")
    edges = tested.where("ok").select(F.col("rep").alias("a"), F.col("cluster").alias("b")).unionAll(_shared(signed, classes))

    # What is left to compare in a cluster: the loose members with one another and with the linked ones.
    blocks = lambda k: F.ceil(F.count_if(F.col("ok") == F.lit(k)) / block).cast("int")
    left = tested.groupBy("cluster").agg(blocks(False).alias("n_loose"), blocks(True).alias("n_linked"), F.count("*").alias("size")).where("n_loose > 0 and size > 1")
    left = materialize(sized(tested.join(left.drop("size"), "cluster"), n / TASK_ROWS), "loose")
    if left.limit(1).count():
        number = lambda k: F.pmod(F.xxhash64("rep"), F.col(k)).cast("int")
        mine = F.when(F.col("ok"), F.col("n_loose") + number("n_linked")).otherwise(number("n_loose"))
        last = F.when(F.col("ok"), F.col("n_loose")).otherwise(F.col("n_loose") + F.col("n_linked")) - 1
        placed = left.select("cluster", "rep", mine.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
        placed = placed.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep")
        placed = placed.join(members.select("rep", "packed"), "rep").select("cluster", "i", "j", "rep", "packed")
        placed = placed.repartition(partitions, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        edges = edges.unionAll(map_arrow(placed, _pairs(percent), "a long, b long"))
    links = components(edges, most=n)
    found = classes.select("digest", "rep").join(links.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    result = signed.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return sized(result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), n / TASK_ROWS)
