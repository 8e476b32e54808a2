"""Quality rules of documents and of their hosts; DataFrame expressions only.

Each document gets counts. The base rules (few words, repeated words) reject it by themselves; the soft rules (many symbols,
repeated lines, odd word lengths) do so only where its host is doubtful. A document that fails any rule is a failure of its
host (the source). Each host's failure rate is shrunk to the overall rate m by a beta prior fitted by moments, and its lower
posterior bound (mean less z deviations) gives the host's verdict: bad where it exceeds the middle of m and 1, doubtful
where it exceeds m, else good. All documents of a bad host go, those that fail a soft rule on a doubtful one, and only those
that fail a base rule on a good one. Hosts that are alike are therefore all good, however poor the corpus is.

Counts are combined before the shuffle, so a host may hold any share of the rows; verdicts are joined back by broadcast, or
with the heavy hosts' rows spread. Null and empty texts have no words and fail. A null source is a host of its own. Texts of
any length are judged whole, each within its row. Ties and repeated rows count each. Empty tables give no rows. ``keep``
keeps all columns, whatever their names; ``quality_rules`` returns columns of its own only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import Stages, join_back, quoted, table, unused

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Soft rules: symbols in 100 letters of words, repeated lines in 100 lines, mean letters of a word.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT, WORD_LENGTHS = 10, 30, (3, 12)
HOST_Z = 3.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(grams: Column) -> Column:
    """grams: sorted (hash, position). Positions whose hash stands beside them again, in order."""
    n = F.size(grams)
    again = F.filter(grams, lambda x, i: (F.get(grams, i + 1)["h"] == x["h"]) & (i + 1 < n) | (F.get(grams, i - 1)["h"] == x["h"]) & (i > 0))
    return F.array_sort(F.transform(again, lambda x: x["p"]))


def with_counts(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """Adds the counts and n_lines under names that docs do not have; gives their columns. All lists of a text are made within its row."""
    names = [*COUNTS, "n_lines"]
    t, w, l, g, d, *own = unused(docs, "_t", "_w", "_l", "_g", "_d", *names)
    kept = [quoted(c) for c in docs.columns]
    name = dict(zip(names, own, strict=True))
    docs = docs.withColumn(t, F.coalesce(F.col(quoted(text)), F.lit("")))
    docs = docs.select(
        *kept,
        F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias(w),
        F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias(l),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias(name["word_chars"]),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias(name["n_symbols"]),
    )
    words = F.col(w)
    gram = F.when(F.size(words) >= 3, F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p"))))
    docs = docs.select(
        *kept,
        name["word_chars"],
        name["n_symbols"],
        F.size(w).cast("long").alias(name["n_words"]),
        F.size(l).cast("long").alias(name["n_lines"]),
        (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias(name["n_dup_lines"]),
        F.sort_array(gram).alias(g),
    )
    docs = docs.withColumn(d, _repeat_words(F.col(g)))
    p = F.col(d)
    # the window at p covers p, p+1, p+2, up to the next window's start
    covered = F.aggregate(F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.lit(3), F.get(p, i + 1) - x)).otherwise(3)), F.lit(0), lambda s, x: s + x)
    docs = docs.withColumn(name["n_repeat_words"], F.coalesce(covered, F.lit(0)).cast("long")).drop(g, d)
    return docs, {n: F.col(c) for n, c in name.items()}


def base_rules(c: dict[str, Column]) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def soft_rules(c: dict[str, Column]) -> Column:
    low, high = WORD_LENGTHS
    return (
        (100 * c["n_symbols"] > MAX_SYMBOL_PERCENT * c["word_chars"])
        | (100 * c["n_dup_lines"] > MAX_DUP_LINE_PERCENT * c["n_lines"])
        | (c["word_chars"] < low * c["n_words"])
        | (c["word_chars"] > high * c["n_words"])
    )


def host_verdicts(counts: DataFrame, stages: Stages, z: float = HOST_Z) -> DataFrame:
    """counts: _h, n and k (failures). Adds host_bound and host_verdict: bad, doubtful or good."""
    counts, total = stages.measured(counts, "sums", k=F.coalesce(F.sum("k"), F.lit(0.0)), of=F.coalesce(F.sum("n"), F.lit(0.0)))
    m = F.lit((total["k"] + 0.5) / (total["of"] + 1.0))
    over = (F.col("k") - F.col("n") * m) * (F.col("k") - F.col("n") * m) / (F.col("n") * m * (1.0 - m)) - 1.0
    rho = F.sum(over) / F.nullif(F.sum(F.col("n") - 1.0), F.lit(0.0))
    w = counts.agg(1.0 / F.greatest(F.least(F.coalesce(rho, F.lit(0.5)), F.lit(0.5)), F.lit(0.001)) - 1.0).first()[0]
    a, b = F.col("k") + w * m, F.col("n") - F.col("k") + w * (1.0 - m)
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0)))
    verdict = F.when(bound > (1.0 + m) / 2.0, "bad").when(bound > m, "doubtful").otherwise("good")
    return counts.select("_h", "n", bound.alias("host_bound"), verdict.alias("host_verdict"))


def _judged(counted: DataFrame, stages: Stages, host: str, base: str, soft: str, verdict: str, z: float) -> DataFrame:
    """Adds the host's verdict to written rows that know what they fail."""
    sums = counted.groupBy(F.col(quoted(host)).alias("_h")).agg(F.count("*").cast("double").alias("n"), F.count_if(F.col(base) | F.col(soft)).cast("double").alias("k"))
    hosts = stages.keyed(host_verdicts(sums, stages, z).select("_h", "n", F.col("host_verdict").alias(verdict)), "verdicts", "_h", "n")
    return join_back(counted, (hosts[0].withColumnRenamed("_h", host), hosts[1]), host, "n", verdict)


def kept(base: Column, soft: Column, verdict: Column) -> Column:
    return ~base & (verdict != "bad") & ~(soft & (verdict == "doubtful"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", z: float = HOST_Z) -> DataFrame:
    """key, host, the counts, base_failed, soft_failed, host_verdict and kept of each document.

    The counts are written once to the shared folder, as they feed both the hosts' sums and the result.
    """
    counted, c = with_counts(docs.select(F.col(quoted(key)).alias("_key"), F.col(quoted(host)).alias("_host"), F.col(quoted(text)).alias("_text")), "_text")
    counted = counted.select("_key", "_host", *COUNTS, base_rules(c).alias("base_failed"), soft_rules(c).alias("soft_failed"))
    stages = Stages(docs.sparkSession, "quality")
    judged = _judged(stages.write(counted, "counts"), stages, "_host", "base_failed", "soft_failed", "host_verdict", z)
    verdict = kept(F.col("base_failed"), F.col("soft_failed"), F.col("host_verdict"))
    return judged.select(F.col("_key").alias(key), F.col("_host").alias(host), *COUNTS, "base_failed", "soft_failed", "host_verdict", verdict.alias("kept"))


def keep(docs: DataFrame, text: str = "text", host: str = "source", z: float = HOST_Z) -> DataFrame:
    """The documents that the rules keep, as they are. Documents and their failures are written once, then read with the verdicts."""
    counted, c = with_counts(docs, text)
    base, soft, verdict = unused(counted, "_base", "_soft", "_verdict")
    own = [quoted(x) for x in docs.columns]
    stages = Stages(docs.sparkSession, "quality")
    counted = stages.write(counted.select(*own, base_rules(c).alias(base), soft_rules(c).alias(soft)), "failures")
    judged = _judged(counted, stages, host, base, soft, verdict, z)
    return judged.filter(kept(F.col(base), F.col(soft), F.col(verdict))).select(*own)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "soft_failed", "host_verdict")


def counts_sql(source: str) -> str:
    """DuckDB SQL of doc_id, source and the counts of a table of documents."""
    return f"""
SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words
FROM (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM {source})) d
LEFT JOIN (
  SELECT id, count(DISTINCT q) AS n FROM (
    SELECT id, unnest([p, p + 1, p + 2]) AS q FROM (
      SELECT id, p, count(*) OVER (PARTITION BY id, a, b, c) AS k FROM (
        SELECT doc_id AS id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM (
          SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {source})))) WHERE k > 1)
  GROUP BY id) r ON d.doc_id = r.id"""


def kept_sql(source: str) -> str:
    low, high = WORD_LENGTHS
    return f"""
WITH c AS MATERIALIZED ({counts_sql(source)}),
c1 AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars OR 100 * n_dup_lines > {MAX_DUP_LINE_PERCENT} * n_lines OR word_chars < {low} * n_words OR word_chars > {high} * n_words AS soft_failed FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR soft_failed)::DOUBLE AS k FROM c1 GROUP BY source),
h1 AS (SELECT *, (sum(k) OVER () + 0.5) / (sum(n) OVER () + 1.0) AS m FROM h),
h2 AS (SELECT *, 1.0 / greatest(least(coalesce((SELECT sum((k - n * m) * (k - n * m) / (n * m * (1.0 - m)) - 1.0) / nullif(sum(n - 1.0), 0.0) FROM h1), 0.5), 0.5), 0.001) - 1.0 AS w FROM h1),
h3 AS (SELECT source, m, k + w * m AS a, n - k + w * (1.0 - m) AS b FROM h2),
h4 AS (SELECT source, m, a / (a + b) - {HOST_Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0))) AS bound FROM h3),
h5 AS (SELECT source, CASE WHEN bound > (1.0 + m) / 2.0 THEN 'bad' WHEN bound > m THEN 'doubtful' ELSE 'good' END AS host_verdict FROM h4)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_verdict <> 'bad' AND NOT (soft_failed AND host_verdict = 'doubtful') AS kept, soft_failed, host_verdict
FROM c1 LEFT JOIN h5 ON c1.source IS NOT DISTINCT FROM h5.source"""


SQL = kept_sql("documents")
