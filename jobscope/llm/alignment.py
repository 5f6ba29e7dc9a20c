"""Alignment of two tokenizers over the same bytes, in Arrow columns.

A batch of texts is one Arrow table per tokenizer: the lists of ids are flattened with their parents' numbers, token
lengths are looked up, and a cumulative sum per text gives the byte at which each token ends.  An Acero full outer
join on (text, end) brings the two tables together.  Sorted by that key, every row is a stretch of bytes that
belongs to one token of each side: filled upwards, it is a link; where both sides end, a group ends.

How often a pair of ids is linked is a count over the corpus.  Each batch hands in its own counts
(``Table.group_by``), Spark merges them, and each batch gets back the counts of the pairs that it has.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobscope.llm.common import bounded_batches, col, once_per_process, small, stored
from jobscope.llm.packing import _byte_of_symbol, byte_bpe_encoder
from jobscope.llm.pieces import SPACE, Model

#: Words whose ids a task remembers.
REMEMBERED = 200_000
#: Bytes of text that are aligned at once, and the bit that parts a text's number from a byte's.
CHUNK_BYTES = 1 << 20
END_BITS = 40

SUMS = ("n_a", "n_b", "n_groups", "n_links")


def byte_level(definition: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """Encoder and token bytes of the byte-level BPE in ``definition`` (JSON); special tokens are ordinary text."""
    data = json.loads(definition)
    special = {t["content"] for t in data.get("added_tokens", ())}
    vocabulary = data["model"]["vocab"]
    data["model"]["vocab"] = {t: i for t, i in vocabulary.items() if t not in special}
    data["added_tokens"] = []
    symbols = _byte_of_symbol()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in data["model"]["vocab"].items():
        tokens[i] = bytes(symbols[c] for c in token)
    return byte_bpe_encoder(json.dumps(data)), tokens


def piece_level(model: bytes) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """Encoder and token bytes of the SentencePiece model, by its library.

    A model without a character map, in which no piece goes on behind a letter with a space, treats each word
    (from one single space to the next) by itself; words are then remembered.
    """
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    parsed = Model.parse(model)
    tokens = []
    for piece, _, _ in parsed.pieces:
        tokens.append(piece.replace(SPACE, " ").encode("utf-8"))
    for i in range(len(tokens)):
        if library.is_byte(i):
            tokens[i] = bytes([int(parsed.pieces[i][0][3:5], 16)])
        elif library.is_control(i) or library.is_unknown(i):
            tokens[i] = b""
    by_word = parsed.dummy_prefix and not parsed.drop_extra_spaces
    by_word = by_word and all(SPACE not in p.lstrip(SPACE) for p, _, _ in parsed.pieces)
    if not by_word:
        return library.encode, tokens

    class Words(dict):
        def __missing__(self, word):
            if len(self) >= REMEMBERED:
                self.clear()
            ids = self[word] = library.encode(word)
            return ids

    words = Words()

    def ids_of(text: str) -> list[int]:
        if "  " in text or text[:1] == " " or text[-1:] == " " or SPACE in text:
            return library.encode(text)
        return list(chain.from_iterable(map(words.__getitem__, text.split(" "))))

    return ids_of, tokens


def _lists(rows: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


class Side:
    """One tokenizer: its encoder, and its vocabulary as Arrow columns."""

    def __init__(self, encode: Callable[[str], list[int]], tokens: list[bytes]):
        self.encode = encode
        self.bytes = pa.array(tokens, pa.binary())
        self.length = pc.binary_length(self.bytes).cast(pa.int64())
        self.name = pa.array([str(i) for i in range(len(tokens))])

    def joined(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of all tokens of each list."""
        parts = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), self.bytes.take(ids.flatten()).cast(pa.large_binary()))
        return pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))

    def ends(self, ids: pa.ListArray, name: str) -> pa.Table:
        """(key, ``name``): the text and byte where each token ends, and the token's place among all of the batch."""
        flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids).cast(pa.int64())
        total = pc.cumulative_sum(self.length.take(flat))
        # What the texts before have summed up to is taken off each text's own tokens.
        until = pa.concat_arrays([pa.array([0], pa.int64()), total])
        before = until.take(ids.offsets.slice(0, len(ids)))
        end = pc.subtract(total, before.take(parent))
        key = pc.bit_wise_or(pc.shift_left(parent, pa.scalar(END_BITS, pa.int64())), end)
        return pa.table({"key": key, name: pa.array(np.arange(len(flat), dtype=np.int64))})

    def names(self, ids: pa.Array, ends: pa.Array) -> pa.Array:
        """The decimal ids of each group, joined by commas; ``ends`` are the places behind each group's last token."""
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends])
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, self.name.take(ids).cast(pa.large_string())), pa.scalar(",", pa.large_string()))


def links(a: pa.ListArray, b: pa.ListArray, left: Side, right: Side) -> pa.Table:
    """(text, a, b, both): one row per pair of occurrences that overlap, in order; places of the two tokens in their
    flattened lists, and whether both end here.  The lists of a text must have the same bytes."""
    joined = left.ends(a, "a").join(right.ends(b, "b"), keys="key", join_type="full outer", use_threads=False).combine_chunks()
    joined = joined.sort_by("key")
    places = [joined["a"].combine_chunks(), joined["b"].combine_chunks()]
    both = pc.and_(pc.is_valid(places[0]), pc.is_valid(places[1]))
    # The last row of a text ends tokens of both sides, so nothing is filled from one text into another.
    filled = [pc.fill_null_backward(p) for p in places]
    text = pc.shift_right(joined["key"].combine_chunks(), pa.scalar(END_BITS, pa.int64()))
    return pa.table({"text": text, "a": filled[0], "b": filled[1], "both": both})


def _per_text(column: pa.Array, number: int) -> np.ndarray:
    """How many rows each text has."""
    out = np.zeros(number, dtype=np.int64)
    if len(column):
        found = pa.table({"text": column}).group_by("text", use_threads=False).aggregate([([], "count_all")])
        out[found["text"].to_numpy()] = found["count_all"].to_numpy()
    return out


def align(texts: list[bytes | None], left: Side, right: Side) -> tuple[dict, pa.Table]:
    """Sums and the hash of the groups per text, and (text, pair, times): the id pairs that each text links.

    A pair is ``a id * size of b's vocabulary + b id``.  Null and empty texts, and texts that one of the tokenizers does not give
    back byte by byte, have no tokens.
    """
    plain = [t.decode("utf-8", "replace") if t else "" for t in texts]
    a = _lists([left.encode(" " + t) if t else [] for t in plain])
    b = _lists([right.encode(t) if t else [] for t in plain])
    spaced = pa.array([b" " + t if t else b"" for t in texts], pa.large_binary())
    whole = pc.and_(pc.equal(left.joined(a), spaced), pc.equal(right.joined(b), spaced))
    if not pc.all(whole).as_py():
        keep = whole.to_numpy(zero_copy_only=False)
        a, b = (_lists([r if k else [] for r, k in zip(side.to_pylist(), keep)]) for side in (a, b))
    found = links(a, b, left, right)
    number = len(texts)
    flat_a, flat_b = a.flatten(), b.flatten()
    ended = found.filter(found["both"])
    n_groups = _per_text(ended["text"].combine_chunks(), number)
    sums = {
        "n_a": pc.list_value_length(a).to_numpy().astype(np.int64),
        "n_b": pc.list_value_length(b).to_numpy().astype(np.int64),
        "n_groups": n_groups,
        "n_links": _per_text(found["text"].combine_chunks(), number),
    }
    after = [pc.add(ended[c].combine_chunks(), 1) for c in ("a", "b")]
    groups = pc.binary_join_element_wise(left.names(flat_a, after[0]), right.names(flat_b, after[1]), pa.scalar("|", pa.large_string()))
    edges = pa.array(np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int64))
    written = pc.binary_join(pa.LargeListArray.from_arrays(edges, groups.cast(pa.large_string())), pa.scalar(";", pa.large_string()))
    sums["groups_sha256"] = [hashlib.sha256(w.as_buffer()).hexdigest() if n else "" for w, n in zip(written, n_groups.tolist())]
    pair = pc.add(pc.multiply(flat_a.take(found["a"].combine_chunks()).cast(pa.int64()), len(right.bytes)), flat_b.take(found["b"].combine_chunks()).cast(pa.int64()))
    pairs = pa.table({"text": found["text"].combine_chunks(), "pair": pair})
    return sums, pairs.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["text", "pair", "times"])


def _chunks(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    chunk, size = [], 0
    for t in texts:
        if chunk and size + len(t or b"") > CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
        chunk.append(t)
        size += len(t or b"")
    if chunk:
        yield chunk


def _ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))


_BLOCK = "block long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups_sha256 string, nth array<int>, times array<int>, pairs array<long>, texts array<int>"


def _blocks(docs: DataFrame, key: str, sides: Callable[[], tuple[Side, Side]]) -> DataFrame:
    """A row per text: its other columns as __c0, __c1, ..., block, sums and pairs (their place in the block's list, and how often).

    A block is one Arrow batch; its first row also lists the block's pairs with the number of its texts that have them.
    """
    names = [f"__c{i}" for i in range(len(docs.columns) - 1)]
    carried = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        left, right = once_per_process(key, sides)
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.num_columns - 1).to_pylist()
            sums: list[dict] = []
            tables, before = [], 0
            for chunk in _chunks(texts):
                found, pairs = align(chunk, left, right)
                sums.append(found)
                tables.append(pairs.set_column(0, "text", pc.add(pairs["text"], before)))
                before += len(chunk)
            rows = pa.concat_tables(tables).combine_chunks()
            known = rows.group_by("pair", use_threads=False).aggregate([([], "count_all")])
            nth = pc.index_in(rows["pair"], value_set=known["pair"].combine_chunks()).to_numpy()
            text = rows["text"].to_numpy()
            order = np.argsort(text, kind="stable")
            lengths = np.bincount(text, minlength=len(texts))
            first = np.zeros(len(texts), dtype=np.int64)
            first[0] = len(known)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(np.full(len(texts), at)),
                    *[pa.array(np.concatenate([s[c] for s in sums])) for c in SUMS],
                    pa.array([h for s in sums for h in s["groups_sha256"]]),
                    _ragged(nth[order], lengths, pa.int32()),
                    _ragged(rows["times"].to_numpy()[order], lengths, pa.int32()),
                    _ragged(known["pair"].to_numpy(), first, pa.int64()),
                    _ragged(known["count_all"].to_numpy(), first, pa.int32()),
                ],
                names=[*names, "block", *SUMS, "groups_sha256", "nth", "times", "pairs", "texts"],
            )
            at += 1

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, carried)] + T.StructType.fromDDL(_BLOCK).fields)
    data = docs.select(*[col(f.name).alias(n) for n, f in zip(names, carried)], F.col("text").cast("binary").alias("__text"))
    return data.mapInArrow(run, schema)


def _looked_up(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """``n_best`` and ``count_sum`` of the texts of one block from the counts of its pairs (nth, count, best)."""
    order = np.argsort(counts["nth"].to_numpy())
    count, best = counts["count"].to_numpy()[order], counts["best"].to_numpy()[order]
    texts = texts.combine_chunks()
    nth, times = (pc.list_flatten(texts[c]).to_numpy() for c in ("nth", "times"))
    parent = pc.list_parent_indices(texts["nth"]).to_numpy()

    def summed(values):
        out = np.zeros(texts.num_rows, dtype=np.int64)
        np.add.at(out, parent, values)
        return pa.array(out)

    kept = texts.drop_columns(["block", "nth", "times"])
    return kept.append_column("n_best", summed(times * best[nth])).append_column("count_sum", summed(times * count[nth]))


def alignments(docs: DataFrame, definition: str, model: bytes, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text by default) and the alignment of each text: ``SUMS``, n_best, count_sum,
    groups_sha256.

    Every row is a document of its own, also where ids repeat or are null.  Null and empty texts, and texts that
    one of the tokenizers does not give back byte by byte, have no tokens: zeros, and an empty hash.  An input column that has the
    name of a result is dropped.
    """
    bounded_batches(docs.sparkSession)
    results = (*SUMS, "n_best", "count_sum", "groups_sha256")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (*results, "text")]

    def sides():
        return Side(*byte_level(definition)), Side(*piece_level(model))

    size = len(Model.parse(model).pieces)
    key = hashlib.sha256(definition.encode("utf-8") + model).hexdigest()
    blocks = stored(_blocks(docs.select(*map(col, kept), "text"), key, sides), "blocks")
    listed = blocks.where(F.size("pairs") > 0).select("block", F.posexplode(F.arrays_zip("pairs", "texts")).alias("nth", "p"))
    listed = listed.select("block", "nth", F.col("p.pairs").alias("pair"), F.col("p.texts").alias("texts"))
    counts = stored(listed.groupBy("pair").agg(F.sum("texts").alias("count")), "pairs")
    # At most one row per id of the first vocabulary.
    a_id = F.expr(f"int(pair div {size})")
    most = stored(counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("most")), "most")
    ranked = counts.withColumn("a", a_id).join(small(most), "a").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    known = listed.select(F.col("block").alias("of"), "nth", "pair").join(ranked, "pair").select("of", "nth", "count", "best")
    plain = blocks.drop("pairs", "texts")
    fields = [f for f in plain.schema.fields if f.name not in ("block", "nth", "times")]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])
    found = plain.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_looked_up, schema)
    return found.toDF(*kept, *schema.names[len(kept) :])
