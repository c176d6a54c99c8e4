"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are in the target.

The words of a text are unrolled with their positions; ``lead`` over a document's positions puts the words that follow
beside each, and joining them gives the runs of each order. Features are hashed into buckets, grouped and counted by
document; a bucket's gain compares its share of the target with its share of the corpus, and documents join gains by
bucket. A document's score is its mean gain plus Gumbel noise of its id, so that taking the highest scores is a draw
without replacement, with odds that grow by the gain.

The texts are shuffled once, before they are unrolled, and lie in the order in which the windows want their words; what
is written are the buckets of each position. The table of gains has one row for each bucket, so that its size is a
parameter. The order of the draw is numbered by ranges of scores.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import ranges
from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: every ASCII character but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORDERS, BUCKETS = 2, 10_000
SHARE, LEAST_WORDS = 25, 20
SEED = "7"
#: Bytes of text that a task unrolls and sorts, which takes some twelve times as much; beyond so many tasks they are larger.
PART_BYTES, MOST_PARTS = 8 << 20, 100_000


def _small(word: Column) -> Column:
    """A-Z made small and nothing else. ``lower`` is the fast way, right for words of ASCII only."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def position_ngrams(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, b1, ..., bN): for each position of a text the buckets of the runs of 1 to N words that begin there.

    A bucket is null where the run would reach past the text's end; a text without words has one row, all null. ``row``
    tells the rows of ``docs`` apart, whose other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, min(-(-size // PART_BYTES), MOST_PARTS))
    rows = rows.repartition(parts, "row").select("row", "id", F.posexplode_outer(F.array_remove(F.split("text", BETWEEN), "")).alias("pos", "word"))
    table = rows.withColumn("word", _small(F.col("word")))
    at = Window.partitionBy("row").orderBy("pos")
    table = table.withColumns({f"_{k}": F.lead("word", k).over(at) for k in range(1, orders)})
    runs = [F.col("word")]
    for k in range(1, orders):
        runs.append(F.concat(runs[-1], F.lit(" "), F.col(f"_{k}")))
    return table.select("row", "id", *((F.crc32(run) % buckets).cast("int").alias(f"b{k}") for k, run in enumerate(runs, 1)))


def _buckets(features: DataFrame) -> Column:
    return F.explode(F.array(*(c for c in features.columns if re.fullmatch(r"b\d+", c)))).alias("bucket")


def bucket_counts(features: DataFrame) -> DataFrame:
    """(bucket, total) over all texts."""
    return features.select(_buckets(features)).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("total"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: a thousand times the log of its smoothed share of the target over that of the
    corpus, rounded down. ``corpus`` and ``target`` are (bucket, total), of ``buckets`` rows at most."""
    all_s, all_t = (counts.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0] for counts in (corpus, target))
    rows = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = rows.join(corpus.withColumnRenamed("total", "s"), "bucket", "left").join(target.withColumnRenamed("total", "t"), "bucket", "left").fillna(0, ["s", "t"])
    d = lambda c, plus: F.col(c).cast("double") + float(plus)
    ratio = d("t", 1) * (float(all_s) + float(buckets)) / (d("s", 1) * (float(all_t) + float(buckets)))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def noise(id_: Column, seed: str = SEED) -> Column:
    """A thousand times standard Gumbel noise, rounded down, fixed by the id; a null id is written as nothing."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of ``docs``; rank is null for rows that are not drawn.

    ``share`` percent, rounded down, of the rows with ``least_words`` words are drawn: the highest scores, of equals the
    smaller id, null last. Rows with an equal id are documents of their own; among equal scores of theirs the one with
    fewer features comes first. Null and empty texts have weight 0 and are not drawn. Other columns are ignored. An empty
    target gives every bucket the gain that its smoothed share has; an empty table gives an empty result.
    """
    features = materialize(position_ngrams(docs, orders, buckets, id_col, text_col), "features")
    aims = position_ngrams(target.select(F.lit(0).alias("_i"), F.col(target_text_col).alias("_t")), orders, buckets, "_i", "_t")
    counts = [materialize(bucket_counts(f), "counts") for f in (features, aims)]
    worth = materialize(gains(*counts, buckets), "gains")
    found = features.select("row", "id", _buckets(features)).join(F.broadcast(worth), "bucket", "left")
    found = found.groupBy("row", "id").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("_gain"))
    weight = F.when(F.col("n_features") > 0, F.expr("(_gain - pmod(_gain, n_features)) div n_features")).otherwise(0)
    # Runs of all orders in a text of that many words; more words have more runs.
    least = sum(max(least_words - k, 0) for k in range(orders))
    scored = found.withColumn("weight", weight.cast("bigint")).withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("able", F.col("n_features") >= least)
    scored = materialize(scored.drop("_gain"), "scored")
    n = scored.filter("able").count()
    order = [F.desc("able"), F.desc("score"), F.col("id").asc_nulls_last(), "n_features", "row"]
    drawn = F.when(F.col("n") <= share * n // 100, F.col("n"))
    return ranges.numbered(scored, order, "n").select(F.col("id").alias(id_col), "n_features", "weight", "score", drawn.alias("rank"))


def oracle_sql(orders: int = ORDERS, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: str = SEED) -> str:
    """DuckDB SQL for ``resample`` of the table documents towards the table benchmark; crc32 is written out by bytes."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    runs = " UNION ALL ".join(f"SELECT rid, unnest(list_transform(range(1, len(w) - {k} + 1), lambda i: array_to_string(w[i:i + {k}], ' '))) AS f FROM {{0}}" for k in range(orders))
    return f"""
WITH RECURSIVE bits AS (SELECT range AS b, range AS c, 0 AS i FROM range(256) UNION ALL SELECT b, {step}, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE i = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents), a AS (SELECT row_number() OVER () AS rid, {words} AS w FROM benchmark),
df AS (SELECT rid, f, count(*) AS n FROM ({runs.format("d")}) GROUP BY ALL), af AS (SELECT f, count(*) AS n FROM ({runs.format("a")}) GROUP BY ALL),
fs AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM af)),
fb AS (SELECT f, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295), 4294967295) % {buckets} AS bucket FROM fs, crc),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN fb USING (f) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM af JOIN fb USING (f) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + {buckets}.0::DOUBLE) / ((s + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + {buckets}.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS gain FROM df JOIN fb USING (f) JOIN g USING (bucket) GROUP BY 1),
e AS (SELECT doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features, CAST(CASE WHEN n > 0 THEN (gain - ((gain % n) + n) % n) // n ELSE 0 END AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (rid)),
r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM e),
k AS (SELECT *, row_number() OVER (ORDER BY (n_words >= {least_words}) DESC, score DESC, doc_id NULLS LAST) AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN n <= {share} * (SELECT count(*) FROM r WHERE n_words >= {least_words}) // 100 THEN n END AS rank FROM k
"""
