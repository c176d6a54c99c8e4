"""Mixing sources to target weights. Built-in functions only.

The words of a source, its documents in the order of a digest, are packed into blocks of ``BLOCK`` words. A source's
target gives it a number of slots in the output. Output shards draw how many blocks of each source they hold: every slot
is dealt to a shard by a hash, which makes a source's counts over the shards one multinomial draw with the source's
total kept, so that targets are met and not only expected; a shard's size varies by the square root of its mean. From
there on only the counts are used: their running sums number the slots of a source by shard, slot i stands for block
perm(i mod blocks), where perm is the source's own pseudorandom permutation of block indices (swap-or-not rounds, which
need no table and no retries), and slots are joined with the blocks that each document fills by block index. As slots
number at most ``CAP`` times the blocks and perm is one to one, no block, so no document, is taken more than ``CAP``
times.

Offsets inside a source come from sums over 4096 ranges of the digest and a running sum inside each range, those of
shards from sums over ranges of 4096 shards, so no task sees a whole source. Only the table of sources, one row each, is
ranked in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize, words_of

BLOCK = 128
SHARD = 4096
ROUNDS = 8
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
SEED = "mix-1"
#: Hexadecimal digits of the digest, and bits of the shard's number, that name a range.
RANGE_DIGITS, SHARD_BITS = 3, 12
#: One or more words with the white space before them.
_WORD = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++)"


def _hash(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts, joined by a colon."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def row_key(id_col: str, text_col: str, source_col: str) -> Column:
    """STRUCT<id, source, digest>: what a row is known by. The digest (128 bits of id, source and text) is its place in
    the order; rows with equal keys have the same id and source and, but for a collision of MD5, the same text."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.coalesce(F.col(source_col), F.lit("-")), F.coalesce(F.col(text_col), F.lit(""))))
    return F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), digest.alias("digest"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(key, source, size): the row's key and number of words, without the text."""
    return docs.select(row_key(id_col, text_col, source_col).alias("key"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("bigint").alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """(sid, source, source_size, target, blocks, slots, shards, keys) for each source of ``sizes``.

    Sources are numbered by code point, null last. Weighted shares of SHARE times all words stop at CAP times the
    source's words and the excess is shared anew; the fixed point is a common level times the weight, found by going
    through the sources by the level at which they fill up. shards is the number of output shards, the same for all.
    """
    by_name, all_ = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    level = Window.orderBy("full", "sid")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name).cast("bigint") - 1).withColumn("weight", weight)
    rows = rows.withColumn("full", F.lit(float(CAP)) * F.col("source_size") / F.col("weight")).withColumn("total", F.lit(SHARE) * F.sum("source_size").over(all_))
    open_ = F.col("total") - F.lit(float(CAP)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.withColumn("level", open_ / F.sum("weight").over(rest)).withColumn("capped", F.col("level") > F.col("full"))
    rows = rows.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(all_))
    rows = rows.withColumn("target", F.when(F.col("capped"), F.lit(float(CAP)) * F.col("source_size")).otherwise(F.col("level") * F.col("weight")))
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(BLOCK)).cast("bigint"))
    slots = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(F.lit(0))
    rows = rows.withColumn("slots", F.least(slots.cast("bigint"), CAP * F.col("blocks")))
    rows = rows.withColumn("shards", F.greatest(F.ceil(F.sum("slots").over(all_) / F.lit(SHARD)), F.lit(1)).cast("bigint"))
    keys = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: _hash(F.lit(SEED), F.col("sid").cast("string"), r.cast("string")) % F.greatest(F.col("blocks"), F.lit(1)))
    return rows.select("sid", "source", "source_size", "target", "blocks", "slots", "shards", keys.alias("keys"))


def _permuted(x: Column) -> Column:
    """Swap-or-not: in each round x trades places with key - x, or not, by a bit of the greater one's hash."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.element_at("keys", r) + F.col("blocks") - x, F.col("blocks"))
        bit = F.substring(F.md5(F.concat_ws(":", F.lit(SEED), F.col("sid").cast("string"), r.cast("string"), F.greatest(x, other).cast("string"))), 1, 1)
        return F.when(bit >= "8", other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap)


def shard_counts(sources: DataFrame) -> DataFrame:
    """(sid, shard, n): how many blocks of each source an output shard draws. Large sources are split before their
    slots are unrolled; counts are made before the shuffle where a task has several slots of one shard."""
    pieces = sources.filter("slots > 0").select("sid", "slots", "shards", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1, F.lit(SHARD).cast("bigint"))).alias("from"))
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tickets = pieces.repartition(parts, "sid", "from").withColumn("ticket", F.explode(F.sequence("from", F.least(F.col("from") + (SHARD - 1), F.col("slots") - 1))))
    shard = _hash(F.lit(SEED), F.lit("shard"), F.col("sid").cast("string"), F.col("ticket").cast("string")) % F.col("shards")
    return tickets.select("sid", shard.alias("shard")).groupBy("sid", "shard").agg(F.count("*").alias("n"))


def slots(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """(sid, shard, block): a row for each block that a shard holds, as often as ``counts`` tells."""
    rows = counts.withColumn("range", F.shiftright("shard", SHARD_BITS))
    sums = rows.groupBy("sid", "range").agg(F.sum("n").alias("in_range"))
    upto = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("sid", "range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "range", F.coalesce(F.sum("in_range").over(upto), F.lit(0)).alias("before"))
    rows = rows.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, ["sid", "range"])
    first = F.col("before") + F.col("ahead")
    # A row of counts stands for thousands of slots, so a few small partitions of them would be a few long tasks.
    rows = rows.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid", "shard")
    numbered = rows.select("sid", "shard", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot")).join(sources.select("sid", "blocks", "keys"), "sid")
    return numbered.select("sid", "shard", _permuted(F.col("slot") % F.col("blocks")).alias("block"))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with sid and offset, the number of its source's words before it."""
    rows = sizes.join(sources.select("sid", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("range", F.substring("key.digest", 1, RANGE_DIGITS))
    sums = rows.groupBy("sid", "range").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    within = Window.partitionBy("sid", "range").orderBy("key.digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(sums, ["sid", "range"]).withColumn("offset", F.col("start") + F.col("ahead")).drop("range", "start", "ahead")


def _pieces(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, offset, size, block, words, shards): rows by the blocks that they fill, with how many of the block's words are
    theirs and the shards that hold the block (an array, with repeats, of at most CAP).

    A row with words is known by sid and offset, so its key need not be carried through these shuffles.

    The merge hint is needed: by its statistics the unrolled table of slots is as small as the table of sources, and
    would be broadcast.
    """
    held = slots(sources, materialize(shard_counts(sources), "draw")).groupBy("sid", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))
    first, last = F.floor(F.col("offset") / BLOCK), F.floor((F.col("offset") + F.col("size") - 1) / BLOCK)
    parts = rows.filter("size > 0").select("sid", "offset", "size", F.explode(F.sequence(first, last)).alias("block")).join(held.hint("merge"), ["sid", "block"], "left")
    words = F.least((F.col("block") + 1) * BLOCK - F.col("offset"), F.col("size")) - F.greatest(F.col("block") * BLOCK - F.col("offset"), F.lit(0))
    return parts.withColumns({"words": words, "shards": F.coalesce("shards", F.array().cast("array<bigint>"))})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, n_shards, places_md5) for every row of ``docs``.

    n_shards is the number of output shards with words of the row; places_md5 the digest of its (shard:block) places.
    Null text has size 0; null is a source of its own, ranked last. Rows without words are returned with taken 0.
    Repeated rows count as often as they come. Other columns are ignored; an empty table gives an empty result.
    """
    sizes = materialize(sized(docs, id_col, text_col, source_col), "sizes")
    sources = materialize(targets(sizes), "sources")
    rows = materialize(placed(sizes, sources), "placed")
    own = F.transform("shards", lambda s: F.concat_ws(":", s.cast("string"), F.col("block").cast("string")))
    taken = _pieces(rows, sources).groupBy("sid", "offset").agg(F.sum(F.col("words") * F.size("shards")).alias("taken"), F.flatten(F.collect_list(own)).alias("places"))
    taken = taken.join(rows.filter("size > 0").select("sid", "offset", "key", "size").hint("merge"), ["sid", "offset"])
    empty = rows.filter("size = 0").select("sid", "key", "size", F.lit(0).cast("bigint").alias("taken"), F.array().cast("array<string>").alias("places"))
    made = taken.select("sid", "key", "size", "taken", "places").unionByName(empty)
    shards = F.array_distinct(F.transform("places", lambda p: F.substring_index(p, ":", 1)))
    made = made.withColumns({"n_shards": F.size(shards).cast("bigint"), "places_md5": F.md5(F.array_join(F.array_sort("places"), ","))})
    return made.join(sources.select("sid", "source_size", "target"), "sid").select(F.col("key.id").alias(id_col), "size", "source_size", "target", "taken", "n_shards", "places_md5")


def _by_blocks(text: Column, offset: Column) -> Column:
    """``text`` cut where its source's blocks end: substrings of whole words with the white space before them.

    The pattern has no alternatives to try again, so it takes time in proportion to the text.
    """
    head = F.call_function("regexp_extract", text, F.concat(F.lit("^(" + _WORD + "{1,"), (F.lit(BLOCK) - offset % BLOCK).cast("string"), F.lit("})")), F.lit(1))
    rest = F.substring(text, F.length(head) + 1, F.length(text))
    return F.concat(F.array(head), F.regexp_extract_all(rest, F.lit("(" + _WORD + "{1," + str(BLOCK) + "})"), F.lit(1)))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = None, shard_col: str | None = None) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each time that words of a document are taken.

    A row has the words taken that time, in order and with the white space between them as it was; where these are all,
    the text as it was. With ``shard_col`` a row has only the words of one output shard, named by a column of that name
    (which replaces one of ``docs``). ``length_col`` names a column to be set to the new text's length.

    Rows that agree in id, text and source count as repeats of one row; their other columns are taken from one of them.
    Null and empty texts have no words and are left out. Columns may have any names. An empty table gives none.
    """
    sizes = materialize(sized(docs, id_col, text_col, source_col), "sizes")
    sources = materialize(targets(sizes), "sources")
    rows = materialize(placed(sizes, sources), "placed")
    pieces = _pieces(rows, sources).filter(F.size("shards") > 0)
    piece = F.struct("block", "words", "shards")
    picks = pieces.groupBy("sid", "offset").agg(F.sort_array(F.collect_list(piece)).alias("picks")).join(rows.filter("size > 0").select("sid", "offset", "key", "size").hint("merge"), ["sid", "offset"])
    texts = docs.select(F.struct(*docs.columns).alias("row"), row_key(id_col, text_col, source_col).alias("key")).dropDuplicates(["key"])
    again = texts.join(picks.select("key", "offset", "size", "picks"), "key").withColumn("text", F.col("row")[text_col])
    n_words = F.aggregate("picks", F.lit(0).cast("bigint"), lambda n, p: n + p["words"])
    whole = n_words == F.col("size")
    full = F.lit(shard_col is None) & whole & F.forall("picks", lambda p: F.size(p["shards"]) == F.size(F.col("picks")[0]["shards"]))
    # Unrolling also keeps the blocks a column of their own; inside the expression below the text would be cut for each.
    again = again.withColumn("cuts", F.when(~full, _by_blocks(F.col("text"), F.col("offset"))))
    first = F.floor(F.col("offset") / BLOCK)
    if shard_col is None:
        taken = lambda n: F.filter("picks", lambda p: F.size(p["shards"]) >= n)
        ways = F.filter(F.array(*map(taken, range(1, CAP + 1))), lambda own: F.size(own) > 0)
    else:
        every = F.flatten(F.transform("picks", lambda p: F.transform(p["shards"], lambda s: F.struct(s.alias("shard"), p.alias("pick")))))
        named = F.array_distinct(F.transform(every, lambda e: e["shard"]))
        ways = F.transform(named, lambda s: F.struct(s.alias("shard"), F.transform(F.filter(every, lambda e: e["shard"] == s), lambda e: e["pick"]).alias("own")))
    again = again.select("row", "text", "size", "cuts", first.alias("first"), F.explode(ways).alias("way"))
    own = F.col("way") if shard_col is None else F.col("way.own")
    some = F.array_join(F.transform(own, lambda p: F.get("cuts", (p["block"] - F.col("first")).cast("int"))), "")
    all_ = F.aggregate(own, F.lit(0).cast("bigint"), lambda n, p: n + p["words"]) == F.col("size")
    made = F.when(all_ & F.lit(shard_col is None), F.col("text")).otherwise(some)
    again = again.select("row", "way", made.alias("made"))
    replaced = {text_col: F.col("made")}
    if length_col is not None:
        replaced[length_col] = F.length("made").cast(docs.schema[length_col].dataType)
    if shard_col is not None:
        replaced[shard_col] = F.col("way.shard")
    columns = [replaced.pop(c, F.col("row")[c]).alias(c) for c in docs.columns]
    return again.select(*columns, *(v.alias(c) for c, v in replaced.items()))


def oracle_sql() -> str:
    """DuckDB SQL for ``mix`` over the table documents."""
    h = lambda x: f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"
    rounds, last = [], "s0"
    for r in range(1, ROUNDS + 1):
        key = f"({h(f"concat_ws(':', '{SEED}', sid, {r})")} % blocks)"
        rounds.append(
            f"o{r} AS (SELECT *, ({key} + blocks - x) % blocks AS y FROM {last}), s{r} AS (SELECT sid, blocks, shard, "
            f"CASE WHEN substr(md5(concat_ws(':', '{SEED}', sid, {r}, greatest(x, y))), 1, 1) >= '8' THEN y ELSE x END AS x FROM o{r})"
        )
        last = f"s{r}"
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(source, '-'), coalesce(text, ''))) AS h
  FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
b AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM a),
c AS (SELECT *, CASE sid % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM b),
e AS (SELECT *, CAST({CAP} AS DOUBLE) * source_size / weight AS "full", CAST({SHARE} AS DOUBLE) * sum(source_size) OVER () AS total FROM c),
f AS (SELECT *, (total - CAST({CAP} AS DOUBLE) * coalesce(sum(source_size) OVER (ORDER BY "full", sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY "full", sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM e),
g AS (SELECT *, max(CASE WHEN lv <= "full" THEN lv END) OVER () AS level FROM f),
t AS (SELECT sid, source, source_size, CASE WHEN lv > "full" THEN CAST({CAP} AS DOUBLE) * source_size ELSE level * weight END AS target,
  CAST(ceil(source_size / CAST({BLOCK} AS DOUBLE)) AS BIGINT) AS blocks FROM g),
u AS (SELECT *, least(CASE WHEN source_size > 0 THEN CAST(floor(target * blocks / source_size + CAST(0.5 AS DOUBLE)) AS BIGINT) ELSE 0 END, {CAP} * blocks) AS slots FROM t),
m AS (SELECT greatest(CAST(ceil(sum(slots) / CAST({SHARD} AS DOUBLE)) AS BIGINT), 1) AS shards FROM u),
draw AS (SELECT sid, blocks, {h(f"concat_ws(':', '{SEED}', 'shard', sid, ticket)")} % shards AS shard, count(*) AS n
  FROM (SELECT sid, blocks, unnest(range(slots)) AS ticket FROM u WHERE slots > 0), m GROUP BY ALL),
sums AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM draw),
s0 AS (SELECT sid, blocks, shard, CAST((ahead + j) % blocks AS BIGINT) AS x FROM (SELECT *, unnest(range(n)) AS j FROM sums)),
{", ".join(rounds)},
held AS (SELECT sid, x AS block, shard FROM {last}),
p AS (SELECT d.*, sid, row_number() OVER () AS rid, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
q AS (SELECT *, unnest(range(CAST(o // {BLOCK} AS BIGINT), CAST((o + size - 1) // {BLOCK} + 1 AS BIGINT))) AS block FROM p WHERE size > 0),
k AS (SELECT rid, sum(least((q.block + 1) * {BLOCK} - o, size) - greatest(q.block * {BLOCK} - o, 0)) AS taken, count(DISTINCT shard) AS n_shards,
  string_agg(shard || ':' || q.block, ',' ORDER BY shard || ':' || q.block) AS places
  FROM q JOIN held ON q.sid = held.sid AND q.block = held.block GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(n_shards, 0) AS n_shards, md5(coalesce(places, '')) AS places_md5
FROM p JOIN u USING (sid) LEFT JOIN k USING (rid)
"""
