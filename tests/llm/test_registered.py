"""The registered queries and the pipeline's stages as they are called, on small tables."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from docscreen.llm import decontamination, near_dedup, pii, sentencepiece_codec, substring_dedup, suffix_dedup, toxicity
from docscreen.llm.queries import model_path

from test_operators import SCHEMA, make, plain_base, plain_components, plain_sets, plain_substring, plain_suffix, prose

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
sha = lambda b: hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    passage, item = prose(800, 70), prose(801, 30)
    docs = [(i, f"{prose(700 + i, 90)}{' idiot scum' if i % 7 == 0 else ''}") for i in range(40)]
    docs += [(50, docs[1][1]), (51, f"{passage} {prose(851, 20)}"), (52, f"{prose(852, 20)} {passage}"), (53, f"x {item}"), (54, None), (55, ""), (56, "mail a7@b.example.com or +1 555 123 4567"), (57, prose(857, 30_000)), (58, "Released under the MIT License.")]
    path = str(tmp_path_factory.mktemp("tables"))
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    write([(i, t, "en", "s", 1) for i, t in docs], DOCUMENTS, "documents")
    write([(i, int(i % 7 == 0), 1) for i in range(40)], "doc_id long, toxic int, quality int", "labels")
    write([(1, item)], "item_id long, text string", "benchmark")
    write([(1, "u", "<p>a</p>"), (2, "v", "<p>a</p>"), (3, "w", None)], "page_id long, url string, html string", "pages")
    return path, docs


def run(spark, name, path):
    return __spark_entry__.queries()[name](spark, path)


def test_all_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "sentencepiece"]


def test_digests_of_repeats(spark, tables):
    path, docs = tables
    one, six = run(spark, "op1_suffix_dedup", path), run(spark, "op6_substring_dedup", path)
    assert one.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and six.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = plain_suffix(docs, 200)
    assert {r[0]: [tuple(r[1:5])] for r in one.collect()} == {k: [(n, g, s, sha(b)) for n, g, s, b in v] for k, v in want.items()}
    assert {r[0]: tuple(r[1:4]) for r in six.collect()} == {k: (n, g, sha(t)) for k, (n, g, t) in plain_substring(docs, 50).items()}


def test_digests_of_codec(spark, tables):
    import sentencepiece

    path, docs = tables
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    ids = {i: sp.encode(t or "") for i, t in docs}
    got = run(spark, "op2_sentencepiece_codec", path)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r[1:4]) for r in got.collect()} == {i: (len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for i, x in ids.items()}


def test_other_digests(spark, tables):
    path, docs = tables
    found = {r.doc_id: r for r in run(spark, "op3_decontamination", path).collect()}
    assert [i for i, r in found.items() if r.contaminated] == [53] and found[53].item_ids == [1] and len(found) == len(docs)
    scores = run(spark, "op4_toxicity", path).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scores) and len(scores) == len(docs)
    assert {r.held_out for r in scores} == {True, False}
    new = {r.doc_id: r for r in run(spark, "op5_pii", path).collect()}
    assert new[56].n_replaced == 2 and "a7@" not in new[56].text and all(new[i].text == t for i, t in docs if i != 56)
    near = {r.doc_id: r for r in run(spark, "op7_near_dedup", path).collect()}
    assert {i: r.component_id for i, r in near.items()} == plain_components(docs) and near[50].component_id == 1 and not near[50].kept
    assert {i: r.n_shingles for i, r in near.items()} == {i: len(s[0]) for i, s in plain_sets(docs).items()}
    pages = {r.page_id: r for r in run(spark, "op8_warc", path).collect()}
    assert [(pages[k].payload_bytes, pages[k].record_type, pages[k].refers_to) for k in (1, 2, 3)] == [(8, "revisit", 2), (8, "response", None), (0, "response", None)]
    assert {r.doc_id: r.license for r in run(spark, "op9_licenses", path).collect()}[58] == "MIT"
    ten = run(spark, "op10_quality_rules", path)
    assert ten.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert all(tuple(r[1:6]) == plain_base(dict(docs)[r[0]]) and not (r.base_failed and r.kept) for r in ten.collect())


def test_empty_tables(spark):
    none = make(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (suffix_dedup.remove_repeats(none), substring_dedup.remove_repeats(none), sentencepiece_codec.encode_decode(none, model_path()), decontamination.find(none, bench), near_dedup.near_duplicates(none), pii.pseudonymize(none, b"k"), toxicity.score(none, toxicity.fit(none, labels))):
        assert df.count() == 0


def test_stages_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCUMENTS), ("labels", "doc_id long, toxic int, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = [(1, "some words here", "en", "s", 1), (1, "some words here", "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("score", F.lit(1.0)).withColumn("matches", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() == 4


def test_repeated_rows_and_null_ids(spark):
    rows = [(3, "again idiot 4111 1111 1111 1111"), (3, "again idiot 4111 1111 1111 1111"), (None, prose(1, 80)), (None, prose(1, 80)), (None, prose(2, 80)), (4, prose(1, 80)), (5, "é" * 40_000 + " 4111 1111 1111 1111")]
    docs = make(spark, rows)
    coded = Counter(tuple(r) for r in sentencepiece_codec.encode_decode(docs, model_path()).collect())
    assert sum(coded.values()) == 7 and max(coded.values()) == 2
    hidden = [r for r in pii.pseudonymize(docs, b"k").collect() if r.n_card]
    assert len(hidden) == 3 and len({r.text[-19:] for r in hidden}) == 1
    scores = [r.score for r in toxicity.score(docs, toxicity.Model(toxicity.prior_weights())).where("doc_id = 3").collect()]
    assert len(scores) == 2 and len(set(scores)) == 1
    gone = Counter((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    assert gone == Counter([(3, 0), (3, 0), (None, 80), (None, 80), (None, 0), (4, 0), (5, 0)])
    out = [(r.doc_id, r.n_removed > 0) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert Counter(out) == Counter([(3, False), (3, False), (None, True), (None, True), (None, False), (4, True), (5, True)])
    assert SCHEMA.startswith("doc_id")


def test_pieces_of_batches():
    import pyarrow as pa

    from docscreen.llm.common import PIECE_BYTES, pieces

    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array(["x" * 1_000_000] * 11)], ["i", "t"])
    parts = list(pieces([batch, batch.slice(0, 0), batch.slice(3, 1)]))
    assert [i for p in parts for i in p.column(0).to_pylist()] == [*range(11), 3] and max(p.nbytes for p in parts) <= PIECE_BYTES + 1000
