"""Tokenizer alignment, quality rules and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from conftest import docs_frame

from jobscope.llm import alignment, queries, rules, spelling

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# Alignment


@pytest.fixture(scope="module")
def files():
    return (
        Path(queries.tokenizer_path("byte_bpe_50k.json")).read_text(encoding="utf-8"),
        Path(queries.tokenizer_path("piece_bpe_32k.model")).read_bytes(),
    )


def plain_alignment(texts, files):
    """Every pair of occurrences is compared by its byte range."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_str(files[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbol = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}

    def ranges(ids, data):
        out, at = [], 0
        for i, d in zip(ids, data):
            out.append((i, at, at + len(d)))
            at += len(d)
        return out

    def piece(i):
        name = second.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if second.is_byte(i) else name.replace("▁", " ").encode()

    rows, found = [], []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        data_a, data_b = [bytes(symbol[c] for c in first.id_to_token(i)) for i in a], [piece(i) for i in b]
        if b"".join(data_a) != whole or b"".join(data_b) != whole:
            a, b, data_a, data_b = [], [], [], []
        a, b = ranges(a, data_a), ranges(b, data_b)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, taken, done = [], ([], []), [0, 0]
        for end in ends:
            for side, ids in zip((a, b), taken):
                while len(ids) < len(side) and side[len(ids)][2] <= end:
                    ids.append(str(side[len(ids)][0]))
            groups.append("|".join(",".join(ids[n:]) for ids, n in zip(taken, done)))
            done = [len(ids) for ids in taken]
        links, low = [], 0
        for i, s, e in a:
            while b[low][2] <= s:
                low += 1
            at = low
            while at < len(b) and b[at][1] < e:
                links.append((i, b[at][0]))
                at += 1
        found.append(links)
        rows.append((len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for links in found for p in set(links))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [(*r[:4], sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), r[4]) for r, links in zip(rows, found)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_op11_equals_brute_force(spark, files):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = dict(zip((d.doc_id for d in docs), plain_alignment([d.text for d in docs], files)))
    got = queries.op11_alignment(spark, SMALL)
    assert {f.name: f.dataType.simpleString() for f in got.schema if f.name != "groups_sha256"} == dict.fromkeys(("doc_id", *COLUMNS[:-1]), "bigint")
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got.collect()} == want


def test_alignment_of_odd_texts(spark, files, monkeypatch):
    texts = [
        None, "", " ", "  ", "a", " lead", "trail ", "two  spaces", "tab\tand\nline\r\n", "▁ is a space to one side", "x▁y",
        "<|endoftext|> and </s> <s> <0x0A> <unk>", "日本語のテキスト と 漢字", "😀😀 emoji 👩‍👩‍👧", "naïve café ﬁ ﬀ Å Å", "\x00\x01 control \x7f",
        "same words same words same words", "same words same words same words", "word" * 400, "é" * 50, "   \n\n   ", "ﷺ nbsp　wide",
    ]
    texts += [t + " " + u for t in texts[10:16] for u in texts[4:9]]
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = alignment.alignments(frame(spark, [(i if i % 5 else None, t) for i, t in enumerate(texts)]), *files)
        got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == Counter((i if i % 5 else None, *r) for i, r in enumerate(plain_alignment(texts, files)))


def test_alignment_of_odd_rows(spark, files, odd_docs, odd_rows, no_docs):
    found = alignment.alignments(odd_docs, *files)
    assert [c for c in odd_docs.columns if c != "text"] == [c for c in found.columns if c not in COLUMNS]
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in found.collect())
    texts = [t for _, t, _, _ in odd_rows]
    assert got == Counter((row[0], *r) for row, r in zip(odd_rows, plain_alignment(texts, files)))
    assert alignment.alignments(no_docs, *files).count() == 0
    clash = frame(spark, [(1, "some text")]).selectExpr("doc_id", "text", "1 AS n_a", "2 AS block", "3 AS nth", "4 AS `x.y`")
    assert alignment.alignments(clash, *files).columns == ["doc_id", "block", "nth", "x.y", *COLUMNS[:4], "groups_sha256", "n_best", "count_sum"]


# Quality rules


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def plain_failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def plain_path(forest, tree, row):
    node = 0
    while forest.ratio[tree, node] >= 0:
        node = 2 * node + 1 + int(row[forest.ratio[tree, node]] > forest.border[tree, node])
    return forest.path[tree, node]


def test_counts():
    rng = random.Random(3)
    texts = [None, "", " ", "a b c", "a b c a b c", "x\n x\nx\n\n\n", "né ñ #|", "a a a a", "a b a b a b a"]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 40))) + rng.choice(["", "\n", "\x1c b", " c"]) for _ in range(300)]
    texts += ["\n".join(rng.choice(["a b", " ", "a b ", "c\r", "#<>"]) for _ in range(8)) for _ in range(50)]
    for t in texts:
        assert rules.counts(None if t is None else t.encode()) == plain_counts(t), t


def test_expected_path():
    rng = np.random.default_rng(0)
    data = rng.random((256, 1))
    forest = rules.Forest.grow(data, [0], rng, trees=300)
    assert abs(forest.path[forest.path > 0].min() - 1) < 1
    # On uniform data the mean score of the sample's own rows lies near one half, and a far row scores higher.
    assert 0.4 < forest.score(data).mean() < 0.6 < forest.score(np.array([[1000.0]]))[0] + 0.15
    assert forest.score(np.array([[50.0]]))[0] > forest.score(np.array([[0.5]]))[0]


def test_op12_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    counts = {i: plain_counts(t) for i, t in docs.items()}
    got = queries.op12_quality_rules(spark, MEDIUM)
    assert got.columns == ["doc_id", *rules.COUNTS, "base_failed", "kept", "score"]
    stats = rules.statistics(spark.read.parquet(f"{MEDIUM}/documents.parquet"), keep=["doc_id"])
    model = rules.train(stats, labels)
    assert model.cuts and len(model.forests) == len(rules.RATIOS) + 1
    rows = {r.doc_id: r for r in got.collect()}
    assert set(rows) == set(docs)
    for i, c in counts.items():
        assert tuple(rows[i][k] for k in rules.COUNTS) == c and rows[i].base_failed == plain_failed(c)
        if plain_failed(c):
            assert not rows[i].kept
    for i in list(docs)[::7]:
        row = rules.ratios(np.array([counts[i]]))[0]
        scores = [2 ** (-np.mean([plain_path(f, t, row) for t in range(rules.TREES)]) / f.scale) for f in model.forests]
        cut = any(int(scores[f] * rules.STEPS + 1e-9) >= least for f, least in model.cuts)
        assert rows[i].kept == (not plain_failed(counts[i]) and not cut)
    open_ = [i for i in docs if not rows[i].base_failed and i in quality]
    good, bad = ([rows[i].kept for i in open_ if quality[i] == q] for q in (1, 0))
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05


def test_best_cut():
    found = [(0, 10, 0, 5), (0, 9, 1, 3), (0, 8, 50, 0), (1, 10, 2, 5), (1, 5, 97, 3)]
    assert rules.best_cut(found, 100, 10, 0.05) == (0.8 - 0.01, 0, 9, 0.01)
    assert rules.best_cut(found, 100, 10, 0.0) == (0.5, 0, 10, 0.0)
    assert rules.best_cut([(0, 3, 4, 0)], 4, 1, 0.0) is None


def test_rules_on_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0), (8, None), (99, 0)], "doc_id bigint, quality int")
    got = rules.judge(odd_docs, labels)
    want = Counter((i, *plain_counts(t), plain_failed(plain_counts(t))) for i, t, _, _ in odd_rows)
    assert Counter((r.doc_id, *(r[c] for c in rules.COUNTS), r.base_failed) for r in got.collect()) == want
    assert not any(r.kept and r.base_failed for r in got.collect())
    for texts, marks in ((no_docs, labels), (odd_docs, labels.limit(0)), (no_docs, labels.limit(0))):
        rows = rules.judge(texts, marks).collect()
        assert len(rows) == texts.count() and all(r.kept == (not r.base_failed) for r in rows)
    clash = docs_frame(spark, odd_rows).withColumnRenamed("score", "n_words").withColumnRenamed("kept", "steps")
    assert Counter(r.n_words for r in rules.statistics(clash).collect()) == Counter(plain_counts(t)[0] for _, t, _, _ in odd_rows)


# Spelling


def plain_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def variant_rows(df):
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


def test_op13_equals_sql_and_brute_force(spark):
    for folder in (SMALL, MEDIUM):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        want = con.execute(queries.ORACLES["op13_spelling"]).fetchall()
        got = variant_rows(queries.op13_spelling(spark, folder))
        assert len(got) == len(want) and set(got) == set(want)
        if folder == SMALL:
            rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
            assert set(got) == plain_variants(rows)
    assert any(r[1] for r in got) and max(r[4] for r in got) > 1


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_variants_equal_brute_force(spark, partitions):
    """Crowded words over few letters, chains of forms and long common prefixes, in few and many ranges."""
    rng = random.Random(partitions)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(250)}
    words |= {"a" * n for n in range(6, 14)} | {"prefix" * 30 + c for c in "abcdefgxyzÿ"} | {"z" * 300, "z" * 299 + "y", "z" * 301}
    rows = []
    for w in sorted(words):
        rows += [(len(rows) + k, w.upper() if k % 2 and w.isascii() else w) for k in range(rng.choice([4, 5, 6, 30, 200]))]
    rows += [(None, "unknown id")] * 7 + [(3, None), (4, "")] + [(5, "abcabc,abcabd")] * 9
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = variant_rows(spelling.variants(frame(spark, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(set(got)) and set(got) == plain_variants(rows)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_variants_of_odd_rows(odd_docs, odd_rows, no_docs):
    assert set(variant_rows(spelling.variants(odd_docs))) == plain_variants([(i, t) for i, t, _, _ in odd_rows])
    assert spelling.variants(no_docs).count() == 0
