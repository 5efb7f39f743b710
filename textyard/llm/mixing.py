"""Mixing sources to target weights with Sainte-Laguë apportionment of equal-token blocks.

Targets follow the weights, no source above ``REPEATS`` times its words. The mix is counted in blocks of
``BLOCK`` words, that of small sources word by word: blocks go to sources, and a source's blocks to its shards, by highest quotients, which gives
whole quotas that sum up exactly. A shard lays its documents end to end in a seeded order; its quota is made
of whole passes over the shard and of a seeded choice of its blocks: those of the lowest tickets, so the last chosen
ticket of each shard tells every document which of its blocks are chosen. Words of the chosen blocks are taken.
Everything is a window or a join over small rows; texts move once, where the mix itself is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textyard.llm.common import few, stored

BLOCK = 64
# Sources of a smaller target, in blocks, are counted in single words.
COARSE = 64
SHARD = 1 << 22
REPEATS = 3
SEED = 17
# One row per source is broadcast up to this number; beyond it the rows are joined by a shuffle.
FEW_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """Add rank, weight (1, 2, 3, repeating over sources in code point order, null last) and target to (source, source_size).

    The targets sum up to all words. A source's share stops at ``REPEATS`` times its size; what is left over goes
    to the others by weight. Ordered by size over weight, the sources that stop are the first ones: the level is
    that of the first source whose own stop is not below it. One row per source: a window without keys is small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", (1 + (F.col("rank") - 1) % 3).cast("bigint"))
    everyone = Window.partitionBy()
    by_stop = Window.orderBy("stop", "rank").rowsBetween(Window.unboundedPreceding, -1)
    room = F.coalesce(F.sum(REPEATS * F.col("source_size")).over(by_stop), F.lit(0))
    heavy = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(by_stop), F.lit(0))
    leveled = (
        ranked.withColumn("stop", REPEATS * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("level", (F.col("total") - room) / heavy)
    )
    place = F.row_number().over(Window.orderBy("stop", "rank"))
    leveled = leveled.withColumn("place", place).withColumn("turn", F.min(F.when(F.col("level") <= F.col("stop"), F.col("place"))).over(everyone))
    level = F.max(F.when(F.col("place") == F.col("turn"), F.col("level"))).over(everyone)
    target = F.when(F.col("place") < F.col("turn"), (REPEATS * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level)
    return leveled.select("source", "source_size", "rank", "weight", "total", target.alias("target"))


def sainte_lague(parties: DataFrame, by: list[str], order: str, votes: str, total: str, house: str) -> DataFrame:
    """Add ``seats``: ``house`` seats of each group ``by`` go to the highest quotients votes / 1, 3, 5, ...

    ``total`` is the sum of votes of the group; ties go to the lower ``order``. Rounding votes over the mean
    votes per seat gives all but a few seats; the d-th best next quotient then bounds which further seats
    (or, if too many were given, which given seats) come into question, so few rows are ranked.
    """
    group = Window.partitionBy(*by)
    base = parties.withColumn("_s", F.when((F.col(total) > 0) & (F.col(house) > 0), F.floor(F.col(votes) / (F.col(total) / F.col(house)) + 0.5)).otherwise(0))
    base = base.withColumn("_d", F.when(F.col(total) > 0, F.col(house)).otherwise(0) - F.sum("_s").over(group))
    add = F.col("_d") > 0
    edge = F.when(add, F.col(votes) / (2 * F.col("_s") + 1)).when((F.col("_d") < 0) & (F.col("_s") > 0), F.col(votes) / (2 * F.col("_s") - 1))
    base = base.withColumn("_e", edge)
    sign = F.when(add, F.col("_e")).otherwise(-F.col("_e"))
    nth = F.row_number().over(group.orderBy(sign.desc_nulls_last(), F.col(order)))
    base = base.withColumn("_n", nth)
    base = base.withColumn("_q", F.max(F.when(F.col("_n") == F.abs("_d"), F.col("_e"))).over(group))
    near = F.floor((F.col(votes) / F.col("_q") - 1) / 2)
    first = F.when(add, F.col("_s")).otherwise(F.greatest(near, F.lit(0)))
    last = F.when(add, near + 1).otherwise(F.col("_s") - 1)
    keys = [*by, order]
    moved = base.where("_d <> 0 and _e is not null").where(last >= first).select(*keys, "_d", F.col(votes).alias("_v"), F.explode(F.sequence(first, last)).alias("_k"))
    moved = moved.withColumn("_e", F.col("_v") / (2 * F.col("_k") + 1))
    best = F.row_number().over(group.orderBy(F.when(F.col("_d") > 0, -F.col("_e")).otherwise(F.col("_e")), F.when(F.col("_d") > 0, F.col(order)).otherwise(-F.col(order)), F.col("_k")))
    moved = moved.withColumn("_r", best).where("_r <= abs(_d)").groupBy(*keys).agg(F.sum(F.signum("_d")).cast("bigint").alias("_m"))
    joined = base.join(moved, keys, "left")
    return joined.withColumn("seats", (F.col("_s") + F.coalesce("_m", F.lit(0))).cast("bigint")).drop("_s", "_d", "_e", "_n", "_q", "_m")


def plan(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, passes, ranges.

    ``taken`` counts the words that the mix takes of the document, repeats included; it is ``passes`` whole
    copies and the words of ``ranges``, an array of (from, to) word positions. A null text has no words. Rows
    that share a doc_id are taken one by one. Only doc_id, source and text are read.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key")
    sized = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), key))
    quotas = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    quotas = quotas.withColumn("unit", F.when(F.col("target") < COARSE * block, 1).otherwise(block).cast("bigint"))
    alike = Window.partitionBy("unit")
    quotas = quotas.withColumn("total", F.sum("target").over(alike)).withColumn("house", F.greatest(F.round(F.col("total") / F.col("unit")), F.lit(1)).cast("bigint"))
    quotas = sainte_lague(quotas, ["unit"], "rank", "target", "total", "house")
    quotas = stored(quotas.select("source", "source_size", "rank", "target", "unit", F.col("seats").alias("quota"), F.greatest(F.ceil(F.col("source_size") / shard), F.lit(1)).alias("shards")))
    named = quotas.withColumnRenamed("source", "_source")
    if quotas.count() <= FEW_SOURCES:
        named = F.broadcast(named)
    known = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # texts without words take nothing and would crowd one place of a shard's line
    placed = known.where("size > 0").withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint"), "shards"))
    line = Window.partitionBy("rank", "shard")
    placed = stored(
        placed.withColumn("stop_at", F.sum("size").over(line.orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start_at", F.col("stop_at") - F.col("size"))
        .drop("key", "shards")
    )
    shards = placed.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("quota").alias("quota"), F.first("unit").alias("unit"))
    shards = sainte_lague(shards, ["rank"], "shard", "words", "source_size", "quota")
    n = F.expr("(words + unit - 1) div unit")
    shards = shards.withColumn("blocks", n).withColumn("seats", F.least("seats", REPEATS * F.col("blocks")))
    shards = stored(shards.where("blocks > 0").select("rank", "shard", "blocks", F.expr("seats div blocks").alias("passes"), F.expr("seats % blocks").alias("extra")))
    ticket = lambda block: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rank"), F.col("shard"), block))
    # dealt out before they are listed: a task lists and ranks the blocks of its own shards, and no block is shuffled
    spark = docs.sparkSession
    drawn = shards.where("extra > 0").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rank", "shard")
    drawn = drawn.select("rank", "shard", "extra", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")).withColumn("ticket", ticket(F.col("block")))
    last = drawn.withColumn("r", F.row_number().over(line.orderBy("ticket", "block"))).where("r = extra").select("rank", "shard", F.struct("ticket", "block").alias("last"))
    chosen = few(stored(shards.select("rank", "shard", "passes").join(last, ["rank", "shard"], "left")))
    met = placed.join(chosen, ["rank", "shard"], "left")
    blocks = F.filter(F.expr("sequence(start_at div unit, (stop_at - 1) div unit)"), lambda b: F.struct(ticket(b).alias("ticket"), b.alias("block")) <= F.col("last"))
    span = lambda b: F.struct((F.greatest(b * F.col("unit"), F.col("start_at")) - F.col("start_at")).alias("from"), (F.least((b + 1) * F.col("unit"), F.col("stop_at")) - F.col("start_at")).alias("to"))
    by_doc = met.withColumn("ranges", F.transform(blocks, span))
    picked = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda a, x: a + x["to"] - x["from"])
    out = by_doc.withColumn("taken", F.coalesce(F.col("passes"), F.lit(0)) * F.col("size") + picked)
    empty = known.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"), F.lit(0).cast("bigint").alias("passes"), F.lit(None).cast(by_doc.schema["ranges"].dataType).alias("ranges"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", F.coalesce("passes", F.lit(0).cast("bigint")).alias("passes"), "ranges").union(empty)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: ``passes`` rows of each whole document, and one with the words
    of its ranges, if any. White space inside a range stays as it is; n_chars is counted anew. Documents
    without words stay once, as they take nothing from the mix."""
    names = docs.columns
    turns = plan(docs, **settings).select("doc_id", "source", "size", "passes", "ranges")
    kind = turns.schema["ranges"].dataType
    # the caller's columns may have any names: they stay in a struct until the end
    mine = docs.select(F.struct(*names).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"))
    every = mine.withColumns({"own": F.lit(1), "passes": F.lit(None).cast("bigint"), "ranges": F.lit(None).cast(kind)})
    every = every.unionByName(turns.withColumns({"row": F.lit(None).cast(mine.schema["row"].dataType), "own": F.lit(0)}))
    # a text comes right after the turn of its number; both windows keep to the doc_id, so texts are shuffled once
    alike = ["doc_id", "source", "size"]
    every = every.repartition("doc_id").withColumn("no", F.row_number().over(Window.partitionBy(*alike, "own").orderBy("own")))
    before = Window.partitionBy(*alike, "no").orderBy("own")
    every = every.withColumns({c: F.lag(c).over(before) for c in ("passes", "ranges")})
    joined = every.where("own = 1")
    whole = F.when(F.col("size") == 0, F.array(F.lit(None).cast(kind))).otherwise(F.array_repeat(F.lit(None).cast(kind), F.col("passes").cast("int")))
    part = F.when(F.size("ranges") > 0, F.array("ranges")).otherwise(F.array().cast(f"array<{kind.simpleString()}>"))
    rows = joined.select("row", F.explode(F.concat(whole, part)).alias("part"))
    text = F.when(F.col("part").isNull(), F.col("row.text")).otherwise(word_ranges(F.col("row.text"), F.col("part")))
    rows = rows.withColumn("cut", text)
    columns = {n: F.col("row").getField(n) for n in names} | {"text": F.col("cut")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("part").isNull(), columns["n_chars"]).otherwise(F.length("cut").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(columns[n].alias(n) for n in names))


def word_ranges(text: Column, ranges: Column) -> Column:
    """The words at the positions of ascending ranges, adjoining ranges as one; others are joined by a line break."""

    def cut(words):
        def piece(r, i):
            own = F.array_join(F.slice(words, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")), "")
            after = F.get(ranges, i + 1)["from"]
            return F.when(after == r["to"], own).otherwise(F.concat(F.rtrim(own, F.lit(SPACES)), F.when(after.isNull(), "").otherwise("\n")))

        return F.array_join(F.transform(ranges, piece), "")

    # each word with the space after it; bound once, as a lambda's body may be computed for every range
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    return F.get(F.transform(F.array(words), cut), F.lit(0))
