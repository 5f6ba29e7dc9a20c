"""The registered queries of this subpackage; each applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm import alignment, language, licences, packing, pieces, polytope, quality, rules, simhash, spelling, suffixes, topk, urls
from jobscope.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs), keep=["doc_id"])
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    found = quality.score(docs, model, keep=["doc_id"])
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", predicted)


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 400-byte strings, in ``kept`` without characters cut in half.

    ``text`` is what is left without repeated passages of over 50 words too, which may be shorter than 400 bytes.
    """
    docs = table(spark, sf_dir, "documents")
    return suffixes.remove_repeats(docs, keep=["doc_id"], kept="text", passage=suffixes.PASSAGE_WORDS, apart="text")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    definition = Path(tokenizer_path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    return packing.pack(table(spark, sf_dir, "documents"), definition)


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector."""
    return polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op1_topk"] = """
WITH usable AS (
  SELECT row_number() OVER () AS number, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND q.number <> c.number
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), Path(tokenizer_path("piece_bpe_32k.model")).read_bytes())


@query
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.train(docs), keep=["doc_id"])


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


# The checksum is the usual reflected CRC-32: its table follows from the polynomial 0xEDB88320.
ORACLES["op13_spelling"] = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b)
  )
), runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents
  ) WHERE length(run) >= 6 GROUP BY doc_id, run
), marked AS (
  SELECT run, times, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(1, octet_length(bytes) + 1), lambda i: CAST(('0x' || hex(array_slice(bytes, i, i))) AS BIGINT))),
      lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT *, encode(doc_id || ':' || run) AS bytes FROM runs), crc_table
), words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM marked
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), skips AS (
  SELECT word, n, i, substr(word, 1, i - 1) AS before, substr(word, i + 1) AS after FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM skips a JOIN skips b ON a.before = b.before AND a.after = b.after AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, w.word, w.n FROM skips a JOIN words w ON a.before || a.after = w.word
  UNION SELECT DISTINCT w.word, a.word, a.n FROM skips a JOIN words w ON a.before || a.after = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS other, max(n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), chain AS (
  SELECT word, word AS reached, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and verdicts of every document."""
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers meet in every document."""
    definition = Path(tokenizer_path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    model = Path(tokenizer_path("piece_bpe_32k.model")).read_bytes()
    return alignment.alignments(table(spark, sf_dir, "documents"), definition, model, keep=["doc_id"])
