"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat import render_chat
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.language import held_out, identify, learn_profiles
from tidemark.llm.mixing import copies
from tidemark.llm.packing import pack
from tidemark.llm.periods import find_runs, planted, run_digest
from tidemark.llm.quality import judge
from tidemark.llm.simhash import near_groups
from tidemark.llm.substrings import remove_repeats
from tidemark.llm.tokens import count_tokens
from tidemark.llm.vectors import near_vectors
from tidemark.llm.whitening import whiten
from tidemark.llm.wrappers import extract_main_text


class Case(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def _table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def op1_substrings(spark: SparkSession, base: str) -> DataFrame:
    return remove_repeats(_table(spark, base, "documents"), digest=True)


OP1_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS run FROM (SELECT *, unnest(range(1, len(words) - 18)) AS i FROM texts)
), firsts AS (
  SELECT run, min({'d': doc_id, 'i': i}) AS f FROM windows GROUP BY run
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM windows JOIN firsts USING (run) WHERE f.d < doc_id OR (f.d = doc_id AND f.i < i)
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM texts
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS rest, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""


def op2_vectors(spark: SparkSession, base: str) -> DataFrame:
    return near_vectors(_table(spark, base, "embeddings"))


OP2_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT r.a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a)::BIGINT AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM reached r GROUP BY r.a
"""


def op3_chat(spark: SparkSession, base: str) -> DataFrame:
    return render_chat(_table(spark, base, "conversations"))


OP3_SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt,
         md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), chained AS (
  SELECT conv_id, role, txt, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
         string_agg(digest, ',') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest)
), wholes AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_logged FROM chained WHERE n = total GROUP BY prefix
), kept AS (
  SELECT conv_id, n_logged FROM wholes WHERE prefix NOT IN (SELECT prefix FROM chained WHERE n < total)
)
SELECT conv_id, max(total)::BIGINT AS n_turns, max(n_logged)::BIGINT AS n_logged,
       string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(txt, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY n) AS rendered
FROM chained JOIN kept USING (conv_id) GROUP BY conv_id
"""


def op4_token_counts(spark: SparkSession, base: str) -> DataFrame:
    return count_tokens(_table(spark, base, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_language_id(spark: SparkSession, base: str) -> DataFrame:
    docs = _table(spark, base, "documents")
    learned = learn_profiles(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, base: str) -> DataFrame:
    return pack(_table(spark, base, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, base: str) -> DataFrame:
    return near_groups(_table(spark, base, "documents"))


def op8_quality(spark: SparkSession, base: str) -> DataFrame:
    return judge(_table(spark, base, "documents"), _table(spark, base, "labels"))


def op9_main_text(spark: SparkSession, base: str) -> DataFrame:
    return extract_main_text(_table(spark, base, "pages"))


def op10_leaks(spark: SparkSession, base: str) -> DataFrame:
    return find_leaks(_table(spark, base, "documents"), _table(spark, base, "benchmark"))


def op11_runs(spark: SparkSession, base: str) -> DataFrame:
    return run_digest(find_runs(planted(_table(spark, base, "documents"))))


def op12_whitening(spark: SparkSession, base: str) -> DataFrame:
    return whiten(_table(spark, base, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_mix(spark: SparkSession, base: str) -> DataFrame:
    taken = copies(_table(spark, base, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP13_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM documents
), sources AS (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)
), levels AS (
  SELECT 0 AS n, (SELECT sum(source_size)::DOUBLE / sum(w)::DOUBLE FROM sources) AS level
  UNION ALL
  SELECT n + 1, (SELECT (sum(source_size)::BIGINT - coalesce(sum(CASE WHEN source_size * 3 < w * level THEN source_size * 3 END), 0)::BIGINT)::DOUBLE
                  / sum(CASE WHEN source_size * 3 < w * level THEN 0 ELSE w END)::DOUBLE FROM sources)
  FROM levels WHERE n < 60
), targets AS (
  SELECT source, source_size, CASE WHEN source_size * 3 < w * level THEN (source_size * 3)::DOUBLE ELSE w * level END AS target
  FROM sources, (SELECT arg_max(level, n) AS level FROM levels)
), rated AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS part
  FROM (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM targets)
), placed AS (
  SELECT s.doc_id, s.source, size, u, source_size, target, whole, part, size > source_size * 0.001::DOUBLE AS large
  FROM sizes s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
), alike AS (
  SELECT source, doc_id, size, u, part, size * count(*) AS total, row_number() OVER (PARTITION BY source ORDER BY size DESC, u, doc_id NULLS FIRST) AS n
  FROM placed WHERE large GROUP BY source, doc_id, size, u, part
), draws AS (
  SELECT source, doc_id, size, n, u * total < part * total AS drawn, part * total - CASE WHEN u * total < part * total THEN total ELSE 0 END AS owed FROM alike WHERE n = 1
  UNION ALL
  SELECT a.source, a.doc_id, a.size, a.n, a.u * total < d.owed + part * total,
         d.owed + part * total - CASE WHEN a.u * total < d.owed + part * total THEN total ELSE 0 END
  FROM draws d JOIN alike a ON a.source IS NOT DISTINCT FROM d.source AND a.n = d.n + 1
)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * (whole + CASE WHEN large THEN drawn::INTEGER ELSE (p.u < part)::INTEGER END))::BIGINT AS taken
FROM placed p LEFT JOIN draws d ON large AND p.source IS NOT DISTINCT FROM d.source AND p.doc_id IS NOT DISTINCT FROM d.doc_id AND p.size = d.size
"""


CASES: dict[str, Case] = {
    "op1_substrings": Case(op1_substrings, OP1_SQL),
    "op2_vectors": Case(op2_vectors, OP2_SQL),
    "op3_chat": Case(op3_chat, OP3_SQL),
    "op4_token_counts": Case(op4_token_counts),
    "op5_language_id": Case(op5_language_id),
    "op6_packing": Case(op6_packing),
    "op7_simhash": Case(op7_simhash),
    "op8_quality": Case(op8_quality),
    "op9_main_text": Case(op9_main_text),
    "op10_leaks": Case(op10_leaks),
    "op11_runs": Case(op11_runs),
    "op12_whitening": Case(op12_whitening),
    "op13_mix": Case(op13_mix, OP13_SQL),
}
