"""The numbered queries: each operator over the whole of its table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import collocations, covertree, decontaminate, fingerprint, jaccard, licenses, line_dedup, mixing, periodic, secrets, substring, tokens, toxicity
from rolecall.llm.storage import Staging


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(*kinds: str) -> Column:
    return F.filter("s", lambda x: x["kind"].isin(*kinds))


def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = documents(spark, folder).select("doc_id", secrets.secrets("text").alias("s"))
    count = [F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    base = _of_kind(*secrets.BASE_KINDS)
    return found.select("doc_id", *count, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = toxicity.fit_model(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~toxicity.held_out("doc_id"))
    scored = docs.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), toxicity.toxicity("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.edited_fingerprints(documents(spark, folder))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    n = tokens.n_tokens("text", str(path))
    counted = documents(spark, folder).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    done = line_dedup.drop_repeated_lines(docs, Staging(spark, "lines"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), veto=False)


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "source", F.char_length("text").alias("length"))
    return mixing.mix_sources(docs, size="length").select("doc_id", "source", "mix_block", "mix_at", "mix_slot")


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    done = licenses.scan_licenses(documents(spark, folder).select("doc_id", "text"))
    return done.select("doc_id", *[F.col(f"licenses.{c}").alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = substring.drop_repeats(documents(spark, folder).select("doc_id", "text"), Staging(spark, "substrings"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.component_ids(documents(spark, folder).select("doc_id", "text"), Staging(spark, "jaccard"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), "component_id")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    found = collocations.collocations(documents(spark, folder).select("text", "lang"), Staging(spark, "collocations"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", periodic.looped("text", "doc_id").alias("text"))
    found = docs.select("doc_id", periodic.periodic_runs("text").alias("p")).select("doc_id", "p.*")
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*",
        F.expr("best.length * 1000L div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return covertree.top_k(vectors, Staging(spark, "top_k"), F.col("vec_id") % 50 == 0)


_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
owner AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE o.first IS NOT NULL AND o.first <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.first IS NULL OR o.first = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN owner o ON length(keyed.key) >= 10 AND o.key = keyed.key
GROUP BY doc_id
"""

_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (
  SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM split, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
counts AS (
  SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 100),
inner_phrases AS (
  SELECT lang, a, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase FROM candidates WHERE k > 2),
held AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY lang, phrase),
cuts AS (
  SELECT c.lang, c.phrase, c.a, n, x.f AS l, y.f AS r, cut, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM candidates) c
  JOIN total USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:c.k], ' ')
  LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase
  WHERE h.most IS NULL OR 100 * h.most < 100 * c.a),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

_NEAREST = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_fingerprints, op4_token_counts, op5_line_dedup, op6_decontamination, op7_source_mixing, op8_license_scan, op9_substring_dedup, op10_jaccard_join, op11_collocations, op12_periodic_runs, op13_top_k)}
SQL = {"op5_line_dedup": _LINES, "op11_collocations": _PHRASES, "op13_top_k": _NEAREST}
