"""The registered queries on the small tables, against brute force, libraries or held-out rows, and the pipeline."""

import os
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_texts import plain_components, plain_fingerprint, plain_passages, plain_removal
from test_vectors import plain_links, plain_parts, plain_rule, plain_top

from jobscope.llm import queries

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="no test tables")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()


def test_every_operator_is_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in found) for i in range(1, 14)] == [1] * 13 and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_op1_equals_sql_and_brute_force(spark):
    got = sorted(tuple(r) for r in queries.op1_topk(spark, MEDIUM).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{MEDIUM}/embeddings.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["op1_topk"]).fetchall())
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()]
    assert got == plain_top(rows)


def test_op2_finds_notices(spark):
    lines = {"Apache-2.0": "Apache License", "MIT": "MIT License", "GPL-3.0": "GNU General Public License, version 3", "CC-BY-NC-4.0": "CC BY-NC 4.0"}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = {r.doc_id: set(r.families) for r in queries.op2_licences(spark, MEDIUM).collect()}
    assert got == {i: {f for f, s in lines.items() if s in t} for i, t in text.items()}


def test_op3_packs_all(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    found = queries.op3_packing(spark, SMALL).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d in docs:
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for n, r in enumerate(sorted(by_doc[d.doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and (r.length == 1024 or n == 0)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(r.length for r in found) // 1024) * 1.02 + 2


def test_op4_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op4_embedding_dedup(spark, SMALL).collect()), key=repr)
    assert got == plain_links(rows)


def test_op5_equals_the_library(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.op5_sentencepiece(spark, SMALL).collect()}
    for d in docs:
        ids = np.array(library.encode(d.text or ""), dtype="<u4")
        r = got[d.doc_id]
        assert (r.n_ids, r.ids_crc32, r.same) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_op6_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = queries.op6_language(spark, MEDIUM).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.99 * len(held)


def test_op7_equals_brute_force(spark, docs):
    fps = [plain_fingerprint(d.text) for d in docs]
    roots = plain_components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {r: min(d.doc_id for d, s in zip(docs, roots) if s == r) for r in roots}
    got = {tuple(r) for r in queries.op7_simhash(spark, SMALL).collect()}
    assert got == {(d.doc_id, f"{f:016x}", least[r]) for d, f, r in zip(docs, fps, roots)}


def test_op8_rules(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    got = queries.op8_url_filter(spark, MEDIUM).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = plain_parts(pages[r.page_id])
        verdict, rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ([verdict] if verdict else ["allow", "block"])


def test_op9_equals_brute_force(spark, docs):
    got = {r.doc_id: tuple(r)[1:5] for r in queries.op9_suffix_dedup(spark, SMALL).collect()}
    want = plain_removal([d.text for d in docs], 400)
    assert [got[d.doc_id] for d in docs] == want and any(w[1] for w in want)


def test_op9_text_has_no_repeated_passages(spark, docs):
    """Passages of over 50 words go from ``text`` where they are too short for the other columns."""
    found = {r.doc_id: r for r in queries.op9_suffix_dedup(spark, SMALL).collect()}
    texts = [d.text for d in docs]
    for name, want in (("text", plain_passages(texts, 400, 51)), ("kept", plain_passages(texts, 400, 10**9))):
        assert [found[d.doc_id][name] for d in docs] == [w[3].decode("utf-8", "ignore") for w in want]
    assert any(r.n_removed == 0 and len(r.text.encode()) < r.n_bytes for r in found.values())


def test_op10_held_out_accuracy(spark):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    got = [r for r in queries.op10_quality(spark, MEDIUM).collect() if r.held_out and r.doc_id in quality]
    good, bad = ([r.score for r in got if quality[r.doc_id] == q] for q in (1, 0))
    assert sum(s >= 0.3 for s in good) >= 0.98 * len(good)
    assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from jobscope.llm.common import stored

    frames = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], SMALL), name))
    raw, good, sure, single, cut, packed = frames
    assert all(f.columns == raw.columns for f in frames[:-1])
    scores = {r.doc_id: r.score for r in queries.op10_quality(spark, SMALL).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.3}
    assert sure.count() == good.count()
    rows = sure.collect()
    roots = plain_components([plain_fingerprint(r.text) for r in rows], lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {root: min(r.doc_id for r, s in zip(rows, roots) if s == root) for root in roots}
    kept = sorted(single.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in kept] == sorted(least.values())
    after = {r.doc_id: r for r in cut.collect()}
    for r, (size, removed, _, _) in zip(kept, plain_removal([r.text for r in kept], 400)):
        text = after[r.doc_id].text
        assert after[r.doc_id].n_chars == len(text) and size - removed - 6 <= len(text.encode()) <= size - removed
        assert removed or text == r.text
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(after.keys())
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
