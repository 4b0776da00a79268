"""The queries of this subpackage for the driver, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import contamination, jaccard, mixing, quality, sharding, substrings, suffixes, tokens, toxicity, urls
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, with the probabilities of the chain's categories: low quality, then toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    categories = {"low_quality": F.when(F.col("quality") == 0, 1).otherwise(0), "toxic": F.col("toxic")}
    chain = toxicity.train(docs, labels, categories)
    return toxicity.score(docs, chain, list(categories)).where("toxic")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contamination.Decontaminator(docs, benchmark).matches(docs)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=16)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def queries() -> dict:
    import corpus_pipeline

    own = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return own | {"pipeline": corpus_pipeline.run}


WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP3_SQL = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
late AS (SELECT doc_id, i FROM win JOIN (SELECT g, min(doc_id) AS m FROM win GROUP BY g) USING (g) WHERE doc_id > m),
gone AS (SELECT doc_id, list(j) AS js FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM late) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(js, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)"""

#: The risk, the chance of a miss and the weight of harm are quality.certified_cutoffs' own.
OP4_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang AS stratum, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM g WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^A-Z!]+', '', 'g')) AS BIGINT) AS n_shout,
CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
CAST(least(20, greatest(CASE WHEN n_words > 0 THEN 20 * n_symbols // n_words ELSE 0 END, CASE WHEN n_lines > 0 THEN 20 * n_dup_lines // n_lines ELSE 0 END, CASE WHEN n_words > 0 THEN 20 * n_repeat_words // n_words ELSE 0 END, CASE WHEN word_chars > 0 THEN 20 * n_shout // word_chars ELSE 0 END)) AS INTEGER) AS rule_bin FROM m),
j AS (SELECT stratum, rule_bin AS bin, q FROM b JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
c AS (SELECT stratum, bin, sum(sum(CASE WHEN q > 0 THEN 1 ELSE 0 END)) OVER s AS k_good, sum(sum(CASE WHEN q <= 0 THEN 1 ELSE 0 END)) OVER s AS k_bad, sum(sum(CASE WHEN q > 0 THEN 1 ELSE 0 END)) OVER (PARTITION BY stratum) AS n_good, sum(sum(CASE WHEN q <= 0 THEN 1 ELSE 0 END)) OVER (PARTITION BY stratum) AS n_bad FROM j GROUP BY stratum, bin WINDOW s AS (PARTITION BY stratum ORDER BY bin DESC)),
p AS (SELECT *, list_sum(list_transform(range(0, CAST(k_good AS BIGINT) + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(0.01) + (n_good - i) * ln(0.99)))) AS tail FROM c WHERE bin > 0 AND k_good < n_good * 0.01),
cut AS (SELECT stratum, arg_max(bin, (CASE WHEN n_bad > 0 THEN k_bad / n_bad ELSE 0 END - 20 * k_good / n_good) * 1000000 + bin * 0.0001) AS cut FROM p WHERE tail <= 0.05 / ((SELECT count(*) FROM (SELECT DISTINCT stratum FROM j)) * 20) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rule_bin < coalesce(cut, 21) AS kept, rule_bin, CAST(coalesce(cut, 21) AS INTEGER) AS cut
FROM b LEFT JOIN cut ON b.stratum IS NOT DISTINCT FROM cut.stratum"""

OP7_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can say: windows, counts and sets. The trees, chains, vectors, hashes and draws it can't."""
    return {"op3_substring_dedup": OP3_SQL, "op4_quality_rules": OP4_SQL, "op7_jaccard_join": OP7_SQL}
