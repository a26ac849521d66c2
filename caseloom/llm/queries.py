"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import bpe, chaining, exact, language, lemp, neighbours, packing, sharding, simhash, suffix, toxicity, vantage, variants
from caseloom.llm.blocks import finite
from caseloom.llm.common import crc_of_id, default_vocabulary, documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    path = default_vocabulary()
    docs = documents(spark, folder).select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    pieces = packing.with_crc(packing.pack(documents(spark, folder), default_vocabulary()))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose fingerprints differ in three bits or fewer."""
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", simhash.as_hex("print").alias("fingerprint"), "component_id")


@query
def op3_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the copy of its text that stays."""
    found = exact.deduplicate(documents(spark, folder))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL["op3_exact"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY body) AS n,
             first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g"""


@query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in eight shards of near equal bytes, equal texts together."""
    found = sharding.assign(documents(spark, folder))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from two thirds of the ids."""
    docs = documents(spark, folder)
    held_out = crc_of_id() % 3 == 1
    found = language.identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op9_suffix(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the strings of 200 bytes that occur more than once."""
    found = suffix.remove_repeats(documents(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.9 or more."""
    found = neighbours.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"),
                        "recall")


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of four fifths of the ids."""
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").where(crc_of_id() % 5 != 0)
    network = toxicity.train(docs.select("doc_id", "text"), labels=labels)
    scored = toxicity.score(docs.select("doc_id", "text"), network)
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op5_chaining(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the fuzzy passages it shares with others."""
    found = chaining.shared_passages(documents(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", "class_id", "partner_id", "n_words", "n_bytes", "n_removed", "n_spans",
                        F.sha2("kept", 256).alias("kept_sha256"))


@query
def op12_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants among the words of all documents, of which a stated share loses a code point."""
    runs = variants.letter_runs(documents(spark, folder))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = (h % F.length("run")).cast("int")
    word = F.when(h % 31 == 0, variants.without(F.col("run"), place, F.lit(1))).otherwise(F.col("run"))
    return variants.variants(variants.counted(runs.select(word.alias("word"))))


SQL["op12_variants"] = r"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS (SELECT id, run, count(*) AS m, hex(encode(id || ':' || run)) AS x FROM r GROUP BY ALL),
-- the crc, bit by bit
h AS (SELECT run, m, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
        range(0, length(x) // 2), lambda i: list_transform(range(0, 8), lambda b: ((instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1)
        * 16 + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1) >> b & 1)))),
        lambda c, bit: xor(c >> 1, xor(c & 1, bit) * 3988292384)), 4294967295) AS h FROM k),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
             ELSE run END AS word, m FROM h),
v AS (SELECT word, sum(m)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
      FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
e AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, a.n, b.word, b.n FROM v a JOIN d b ON a.word = b.rest
      UNION SELECT b.word, b.n, a.word, a.n FROM v a JOIN d b ON a.word = b.rest),
o AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k, count(*) OVER (PARTITION BY word) AS c
      FROM e),
f AS (SELECT v.word, v.n, coalesce(c, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form,
             CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN o ON v.word = o.word AND k = 1),
t AS (SELECT word, word AS here, 0 AS step FROM f UNION ALL
      SELECT t.word, f.form, step + 1 FROM t JOIN f ON t.here = f.word WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(here, step) AS root FROM t GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON f.word = z.word"""


@query
def op11_vantage(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 vectors of largest inner product for every twentieth vector, by vantage-point trees."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return vantage.nearest(vectors, F.col("vec_id") % 20 == 0)


SQL["op11_vantage"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
c AS (SELECT DISTINCT vec_id, x FROM v WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0
      AND len(list_filter(x, lambda y: y <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
      FROM c q JOIN c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
      FROM s)
SELECT * FROM r WHERE rank <= 20"""


@query
def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, with whole components and some labels moved on."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").where(finite("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return lemp.hard_negatives(vectors.select("vec_id", label.alias("label"), whole.alias("embedding")), F.col("id") % 100 == 0)


SQL["op13_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding::DOUBLE[], lambda c: floor(256 * c)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding::DOUBLE[], lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER
       AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""
