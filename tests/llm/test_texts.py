"""Operators on documents: odd inputs, empty tables, and brute-force versions."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from jobscope.llm import language, licences, packing, pieces, quality, simhash, suffixes  # noqa: E402
from jobscope.llm.queries import tokenizer_path  # noqa: E402


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# SimHash


def plain_fingerprint(text, width=3):
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(nodes))]


def test_fingerprints(odd_rows):
    for _, text, _, _ in odd_rows:
        if text is None or len(text) < 10000:
            assert simhash.fingerprint(text.encode() if text else None, 3) == (plain_fingerprint(text),)


def test_every_link_meets_at_an_anchor():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 31, 2000)
    y = x ^ (1 << rng.integers(0, 31, 2000))
    home, _, _ = simhash.anchors(x)
    near, rows, more = simhash.anchors(y)
    visits = defaultdict(set)
    for r, a in [*enumerate(near.tolist()), *zip(rows.tolist(), more.tolist())]:
        visits[r].add(a)
    assert all(home[i] in visits[i] for i in range(2000))
    assert max(map(len, visits.values())) == 16


@pytest.mark.parametrize("block", [4096, 3])
def test_links_equal_brute_force(spark, block):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:12]:
        for _ in range(25):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5))))
    fps = sorted(fps)
    found = plain_components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    links = [(r.a, r.b) for r in simhash.links(frame, block=block).collect()]
    place = {s: i for i, s in enumerate(signed)}
    pairs = {(place[a], place[b]) for a, b in links} | {(place[b], place[a]) for a, b in links}
    got = plain_components(list(range(len(fps))), lambda a, b: (a, b) in pairs)

    def groups(c):
        out = defaultdict(set)
        for i, r in enumerate(c):
            out[r].add(i)
        return sorted(map(sorted, out.values()))

    assert groups(got) == groups(found)


def test_near_duplicates_of_odd_rows(odd_docs, odd_rows, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    fps = [plain_fingerprint(t) if t is None or len(t) < 10000 else simhash.fingerprint(t.encode(), 3)[0] for _, t, _, _ in odd_rows]
    roots = plain_components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    least = {r: min((row[0] for row, s in zip(odd_rows, roots) if s == r and row[0] is not None), default=None) for r in roots}
    want = Counter((row[0], f, least[r]) for row, f, r in zip(odd_rows, fps, roots))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def plain_groups(rows):
    """The row that stays of each group of (doc_id, text) rows whose fingerprints link: least id, then least fingerprint."""
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    out = defaultdict(list)
    for (i, _), f, r in zip(rows, signed, roots):
        out[r].append((i is None, i or 0, f))
    return Counter(None if min(m)[0] else min(m)[1] for m in out.values())


def test_keep_one(spark, odd_docs, odd_rows, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(i, t) for i, t, _, _ in odd_rows if t is None or len(t) < 10000]
    assert Counter(r.doc_id for r in kept.collect()) == plain_groups(rows) + Counter([8])
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_of_groups(spark):
    """Groups of edited copies with repeated, missing and hot ids: one row of each stays, equal to brute force."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for n in range(25):
        base = [word() for _ in range(150)]
        for c in range(rng.randint(1, 5)):
            text = " ".join(base + [word() for _ in range(c // 2)])
            rows.append((rng.choice([n, 100 - n, None, 7]), text))
    rows += [(7, "the same row")] * 40 + [(None, "nobody's row")] * 5
    got = [(r.doc_id, r.text) for r in simhash.keep_one(frame(spark, rows)).collect()]
    assert Counter(i for i, _ in got) == plain_groups(rows) and set(got) <= set(rows)
    fps = [plain_fingerprint(t) for _, t in got]
    assert all(bin(a ^ b).count("1") > 3 for n, a in enumerate(fps) for b in fps[:n])


# Suffixes


def plain_removal(texts, window):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                mark[i : i + window] = b"\1" * window
        kept = bytes(b for b, m in zip(t, mark) if not m)
        spans = sum(1 for i in range(len(t)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(t), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [1 << 18, 300])
@pytest.mark.parametrize("seed", [0, 1])
def test_removal_equals_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "RUN_LENGTHS", (5, 1))
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 120))) for _ in range(6)]
    texts = [None, "", "ab" * 60, "a" * 90, "x" * 39]
    for _ in range(60):
        texts.append("".join(rng.choice(passages)[: rng.randint(10, 120)] if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))) for _ in range(4)))
    texts += texts[10:14]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(frame(spark, rows), window=40).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, 40)


def test_removal_of_odd_rows(odd_docs, odd_rows, no_docs):
    short = [r for r in odd_rows if r[1] is None or len(r[1]) < 10000]
    got = suffixes.remove_repeats(odd_docs).where("n_bytes < 10000")
    assert "a.b" in got.columns and got.columns.count("kept") == 1
    want = Counter((r[0], *x) for r, x in zip(short, plain_removal([r[1] for r in short], 400)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert suffixes.remove_repeats(no_docs).count() == 0


def test_texts_with_one_checksum_stay_apart(spark):
    """Different texts without a doc_id, or with the id -1, are judged each, even if their checksums agree."""
    rng = random.Random(30)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage, other = letters(60), letters(60)
    seen, pair = {}, None
    while pair is None:
        tail = letters(12)
        for body in (passage + tail, other + tail):
            seen.setdefault(zlib.crc32(body.encode()), set()).add(body)
            found = seen[zlib.crc32(body.encode())]
            if len({b[:60] for b in found}) == 2:
                pair = sorted(found)
    texts = [*pair, passage + letters(20)]
    for ids in ([None, None, None], [None, -1, 5]):
        got = suffixes.remove_repeats(frame(spark, list(zip(ids, texts))), window=40).collect()
        assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(plain_removal(texts, 40))


def plain_passages(texts, window, passage):
    """What is left when passages of words go as well as strings of bytes."""
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    words = [[m for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    runs = [[tuple(m[0] for m in w[i : i + passage]) for i in range(len(w) - passage + 1)] for w in words]
    times = Counter(r for found in runs for r in found)
    out = []
    for t, w, found in zip(texts, words, runs):
        mark = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                mark[i : i + window] = b"\1" * window
        covered = {k for i, r in enumerate(found) if times[r] > 1 for k in range(i, i + passage)}
        for k in covered:
            low, high = w[k].start(), w[k + 1].start() if k + 1 in covered else w[k].end()
            mark[low:high] = b"\1" * (high - low)
        spans = sum(1 for i in range(len(t)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(t), sum(mark), spans, bytes(b for b, m in zip(t, mark) if not m)))
    return out


@pytest.mark.parametrize("chunk", [1 << 18, 40])
def test_removal_of_passages_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    shared = [[word() for _ in range(rng.randint(8, 30))] for _ in range(6)]
    texts = [None, "", " \n", "a " * 60, "b\n" * 12, "a" * 200, "c " * 5 + "d" * 90, "d" * 90]
    for _ in range(60):
        parts = [rng.choice(shared)[rng.randint(0, 3) : rng.randint(6, 30)] if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 20))] for _ in range(4)]
        texts.append("".join(w + rng.choice([" ", " ", "\n", " \t", "\u00a0 "]) for p in parts for w in p))
    texts += texts[10:13]
    want = plain_passages(texts, 60, 11)
    assert want != plain_passages(texts, 60, 1000) and want != plain_passages(texts, 1000, 11)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(frame(spark, list(enumerate(texts))), window=60, passage=11).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_pipeline_cuts_passages_of_over_50_words(spark):
    """Passages of 51 words go, in less than 400 bytes and across other line ends; those of 50 words stay."""
    rng = random.Random(6)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    passage, short = words(51), words(50)
    assert len(" ".join(passage)) < 400
    rows = [(1, "one " + " ".join(passage) + " two"), (2, "three\n" + "\n".join(passage) + "\nfour"), (3, "five " + " ".join(short)), (4, " ".join(short) + " six"), (5, None)]
    docs = spark.createDataFrame([(i, t, t and len(t)) for i, t in rows], "doc_id bigint, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert got == {1: ("one  two", 8), 2: ("three\n\nfour", 11), **{i: (t, t and len(t)) for i, t in rows[2:]}}


def test_kept_text_has_whole_characters(spark):
    shared = "é" + "b" * 50
    rows = [(1, "x" + shared), (2, "ç" + shared[1:])]
    got = suffixes.remove_repeats(frame(spark, rows), window=51, kept="text").collect()
    assert {r.doc_id: r.kept for r in got} == {1: "x", 2: "ç"} or all(r.kept is not None for r in got)


# Packing


@pytest.fixture(scope="module")
def definition():
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def test_ids_equal_the_library(definition, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(definition)
    encode = packing.byte_bpe_encoder(definition)
    rng = random.Random(2)
    texts = [t for _, t, _, _ in odd_rows if t and len(t) < 10000]
    texts += ["a  b   c", " x", "x ", "a\n b", "a \nb\t c", "don't we'll", "x\xa0 y \xa0z", "<|endoftext|> a", "é" * 30]
    texts += ["".join(rng.choice("ab '\n\t 12,.é日　") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for text in texts:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [0, 1, 7, 500, 20000])
def test_plans_place_every_piece(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(1024, 1 + rng.lognormal(6, 1, n).astype(int))
    counts = np.bincount(lengths, minlength=1025)
    chosen = packing.plan(counts)
    placed = Counter()
    for pattern, times in chosen.items():
        assert sum(pattern) <= 1024 and times > 0
        for length in pattern:
            placed[length] += times
    assert all(placed[i] == counts[i] for i in range(1, 1025))
    assert sum(chosen.values()) <= -(-int(lengths.sum()) // 1024) * 1.02 + 2


def test_packing_of_odd_rows(spark, definition, odd_docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_COUNTER", 3)
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(definition)
    found = packing.pack(odd_docs, definition, with_ids=True).collect()
    whole = Counter()
    by_doc = defaultdict(list)
    for r in found:
        assert 1 <= r.length <= 1024 and zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append(r)
        assert r.start == 0 or r.length == 1024
    want = Counter()
    for i, text, _, _ in odd_rows:
        want[i] += len(library.encode(text or "", add_special_tokens=False).ids) + 1
    assert {i: sum(r.length for r in rows) for i, rows in by_doc.items()} == dict(want)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id] += 1
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(no_docs, definition).count() == 0


# SentencePiece


@pytest.fixture(scope="module")
def piece_model():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def test_pieces_equal_the_library(piece_model, odd_rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
    transducer = pieces.Transducer(pieces.Model.parse(piece_model))
    rng = random.Random(3)
    texts = [t for _, t, _, _ in odd_rows if t and len(t) < 10000] + ["", " ", "  a  b ", "<s> </s>", "A" * 60, " " * 40, "▁x", "\0a"]
    texts += ["".join(rng.choice("abcdefghij  ABCéßЖ.,12\n\t日😀") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    want = library.encode(texts, num_threads=1)
    for text, ids in zip(texts, want):
        assert transducer.encode(text) == ids, repr(text)
        assert transducer.decode(ids) == library.decode(ids)


def test_unigram_paths_are_shortest():
    vocabulary = {"a": -2.0, "b": -2.5, "ab": -3.0, "abc": -7.0, "c": -1.0, "bc": -2.2, "▁": -1.5, "▁a": -2.6}
    model = pieces.Model([("<unk>", 0.0, pieces.UNKNOWN)] + [(p, s, pieces.NORMAL) for p, s in vocabulary.items()])
    transducer = pieces.Transducer(model)
    names = ["<unk>", *vocabulary]

    def best(text):
        if not text:
            return 0.0, ()
        options = []
        for n in range(1, len(text) + 1):
            if text[:n] in vocabulary:
                rest = best(text[n:])
                options.append((rest[0] - vocabulary[text[:n]], (names.index(text[:n]), *rest[1])))
        return min(options)

    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        ids = transducer.encode(text)
        assert sum(-vocabulary[names[i]] for i in ids) == pytest.approx(best("▁" + text)[0])
    assert transducer.encode("axx") == [names.index("▁a"), 0]


def test_round_trips_of_odd_rows(odd_docs, no_docs, piece_model):
    got = pieces.round_trip(odd_docs, piece_model).collect()
    assert len(got) == 14 and all(r.same for r in got)
    encoded = pieces.encode(odd_docs, piece_model, keep=["doc_id", "text"])
    back = pieces.decode(encoded, piece_model).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert pieces.round_trip(no_docs, piece_model).count() == 0


# Language and quality


def test_languages(spark, odd_docs, odd_rows, no_docs):
    words = {"en": "the house and river of tree", "fr": "le monde est une maison de", "de": "der baum und das haus ist"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(30)), lang) for i in range(120) for lang in [("en", "fr", "de")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs)
    held = [r.doc_id for r in docs.where(language.held_out()).collect()]
    assert held == [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in rows)
    odd = language.predict(odd_docs, model)
    assert "a.b" in odd.columns and odd.columns.count("score") == 1
    for r in odd.collect():
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    # Unseen words fall back to ever shorter n-grams.
    assert model.predictor()([b"housetree riverhouse"])[0] == ["en"]
    empty = language.train(no_docs)
    assert {r.lang_pred for r in language.predict(odd_docs, empty).collect()} == {"und"}
    assert language.predict(no_docs, model).count() == 0


def plain_language(rows, texts, known_words):
    """Predictions recomputed word by word from rows (lang, text) that are all learned from."""
    import math
    import re

    words = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    languages = sorted({lang for lang, _ in rows})
    counts = {lang: Counter() for lang in languages}
    for lang, text in rows:
        counts[lang] += words(text)
    keep = {lang: sorted(c.items(), key=lambda x: (-x[1], x[0]))[: known_words[lang]] for lang, c in counts.items()}
    tables = [{lang: Counter(dict(k)) for lang, k in keep.items()}]
    grams = lambda w, n: [w2[i : i + n] for w2 in [f"^{w}$" if n > 1 else w] for i in range(len(w2) - n + 1)]
    for n in range(1, 5):
        tables.append({lang: sum((Counter({g: grams(w, n).count(g) * k for g in set(grams(w, n))}) for w, k in c.items()), Counter()) for lang, c in counts.items()})
    names = [set().union(*t.values()) for t in tables]

    def rate(table, entry):
        return [math.log((tables[table][lang][entry] + 0.5) / (sum(tables[table][lang].values()) + 0.5 * len(names[table]))) for lang in languages]

    out = []
    for text in texts:
        found = words(text)
        if not found:
            out.append(("und", 0.0))
            continue
        total = [0.0] * len(languages)
        for w, k in found.items():
            rows_ = [rate(0, w)] if w in names[0] else next((r for n in range(4, 0, -1) if (r := [rate(n, g) for g in grams(w, n) if g in names[n]])), [[0.0] * len(languages)])
            for i in range(len(languages)):
                total[i] += k * sum(r[i] for r in rows_) / len(rows_)
        mean = [x / sum(found.values()) for x in total]
        weight = [math.exp((m - max(mean)) * min(sum(found.values()), language.EVIDENCE_WORDS)) for m in mean]
        out.append((languages[mean.index(max(mean))], max(weight) / sum(weight)))
    return out


def test_predictions_equal_plain_sums(spark, monkeypatch):
    """Known and unseen words, short ones and foreign letters, with a small memory for unseen words."""
    monkeypatch.setattr(language, "REMEMBERED", 5)
    monkeypatch.setattr(language, "LEAST_WORDS", 6)
    rng = random.Random(3)
    stems = {"en": "th ing er on house", "fr": "le eau que ion maison", "de": "der sch ung ein haus"}
    text = lambda lang: " ".join(rng.choice(stems[lang].split()) + rng.choice(["", *stems[lang].split()]) for _ in range(rng.randint(1, 12)))
    rows = [(i, text(lang), lang) for i in range(90) for lang in [("en", "fr", "de")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = [(r.lang, r.text) for r in docs.where(~language.held_out()).collect()]
    model = language.train(docs, known_words=18)
    assert len(model.words) <= 18
    texts = [t for _, t, _ in rows] + ["HOUSE maison", "x", "日本", "日本 house", None, "123", "zzz eau"]
    got = model.predictor()([None if t is None else t.encode() for t in texts])
    want = plain_language(learned, texts, {lang: 6 for lang in stems})
    assert got[0] == [w[0] for w in want] and np.allclose(got[1], [w[1] for w in want], atol=1e-4)


def test_a_rare_language_is_learned(spark):
    """One language has a thousandth of the rows, and another nearly all words of the sample."""
    rng = random.Random(4)
    common = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    rows = [(i, common(), "big") for i in range(8000)] + [(9000 + i, "ko te whare me te awa o te rangi", "mi") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs, sample_rows=1000, known_words=2000)
    assert model.languages == ["big", "mi"] and "whare" in model.words
    names, scores = model.predictor()([b"te awa me te whare", b"abcdef fedcba hgfedc"])
    assert names == ["mi", "big"] and scores[0] > 0.9


def test_shares():
    assert language._shares({"a": 5, "b": 1000, "c": 1000}, 300, 10) == {"a": 5, "b": 147, "c": 148}
    assert language._shares({str(i): 50 for i in range(100)}, 300, 10) == {str(i): 10 for i in range(100)}


def test_quality(spark, odd_docs, no_docs):
    rng = random.Random(6)
    clean = lambda: " ".join(rng.choice("one two three four five six seven eight nine ten".split()) for _ in range(60)) + "."
    rows = [(i, clean() if i % 4 else "".join(rng.choice("$%# &*!A") for _ in range(300))) for i in range(1200)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(0, 1200, 3)] + [(None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == bool(i % 4) for i in held) / len(held) > 0.98
    odd = quality.score(odd_docs, model).collect()
    assert len(odd) == 14 and all(0 <= r.score <= 1 for r in odd)
    scores = {r.text: r.score for r in odd}
    assert scores[None] == scores[""]
    assert quality.score(no_docs, quality.train(no_docs, labels)).count() == 0
    nothing = quality.train(docs, labels.where("quality = 0"))
    assert {r.score for r in quality.score(odd_docs, nothing).collect()} == {0.5}


# Licences


def test_licences(spark, odd_docs, no_docs):
    notices = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3."]
    rng = random.Random(7)
    filler = lambda n: " ".join(rng.choice("wind rain the of under work license stone sea hill version".split()) for _ in range(n))
    rows = [(i, "\n".join([filler(20), notices[i % 3] if i % 2 else filler(8), filler(30)])) for i in range(200)]
    docs = frame(spark, rows)
    model = licences.train(docs)
    got = {r.doc_id: r for r in licences.scan(docs, model).collect()}
    names = ["MIT", "CC-BY-NC-4.0", "GPL-3.0"]
    for i, text in rows:
        assert got[i].families == ([names[i % 3]] if i % 2 else [])
        for m in got[i].matches:
            assert text[m.start : m.end] == notices[i % 3] and m.probability >= 0.5
    assert {len(r.matches) for r in licences.scan(odd_docs, model).collect()} == {0}
    assert licences.scan(no_docs, licences.train(no_docs)).count() == 0


def test_wrapped_and_dual_licences(spark):
    """Notices wrapped in comments, two in a line, and two licences in one sentence; look-alikes stay what they are."""
    import textwrap

    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice("wind rain stone sea hill river tree".split()) for _ in range(n))
    model = licences.train(frame(spark, [(i, filler(30)) for i in range(100)]))
    wrap = lambda text, sign, width=70: "\n".join(sign + x for x in textwrap.wrap(text, width))
    rows, want = [], {}
    longest = {f: max(n, key=len) for f, n in licences.NOTICES.items()}
    for family, notice in longest.items():
        for sign in ("", " * ", "# ", "// "):
            body = wrap(notice, sign, 40)
            rows.append((len(rows), f"{filler(9)}\n{sign.rstrip()}\n{body}\n{sign}\n{filler(20)}"))
            want[len(rows) - 1] = [family]
    extra = [
        ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
        ("This project is licensed under the MIT License or the Apache License 2.0.", ["Apache-2.0", "MIT"]),
        (wrap(longest["GPL-3.0"] + " " + longest["MIT"], "; "), ["GPL-3.0", "MIT"]),
        ("Permission is hereby granted, free\n\nof charge, to any person obtaining a copy", []),
        ("wind sea Licensed under CC BY-SA 4.0. stone", ["CC-BY-SA-4.0"]),
    ]
    for text, families in extra:
        rows.append((len(rows), text))
        want[len(rows) - 1] = families
    found = {r.doc_id: r for r in licences.scan(frame(spark, rows), model).collect()}
    assert {i: r.families for i, r in found.items()} == want
    for i, text in rows[: 4 * len(longest)]:
        (match,) = found[i].matches
        assert licences.words_of(text[match.start : match.end]) == licences.words_of(max(licences.NOTICES[want[i][0]], key=len))


def test_longest_piece_by_three_characters(piece_model):
    """A longer beginning rules out more pieces, and none that the model has."""
    transducer = pieces.Transducer(pieces.Model.parse(piece_model))
    assert all(transducer.reach[p[:3]] >= len(p) for p in transducer.arcs)
    assert any(len(start) == 3 for start in transducer.reach) and min(transducer.reach.values()) >= 2
