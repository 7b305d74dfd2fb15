"""Operator 9: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stash

#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST = 3
#: The texts are cut into about so many blocks; a block has the total's words over this, 1 at least.
BLOCKS = 65536
#: Shards that get quotas of their own.
SHARDS = 16
#: Cells by hash in which the documents of a source are laid out, and the parts of each, which follow one another in its order.
CELLS, PARTS = 256, 16
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(*parts: Column) -> Column:
    """A number below 2^32 that the seed and the parts decide, the same in every engine that has MD5."""
    joined = F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(skey, source_size, target) from (skey, source_size), a row for each source.

    Sharing the total by weight, with the excess over MOST times a source's size shared again by weight until none is
    above, ends at target = min(MOST * size, level * weight). The level is found at once: in the order of
    MOST * size / weight, a source is capped while what the rest could share among them lies above its own cap.
    """
    everything = Window.partitionBy(F.lit(0))
    in_order = Window.partitionBy(F.lit(0)).orderBy("null_last", "skey")
    by_cap = Window.partitionBy(F.lit(0)).orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.withColumn("null_last", (F.substring("skey", 1, 1) == "n").cast("int")).withColumn("weight", weight)
    s = s.withColumn("cap", F.lit(float(MOST)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    left = F.col("total") - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0))
    s = s.withColumn("level", left / weights_left)
    s = s.withColumn("level_all", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything))
    target = F.when(F.col("level_all").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level_all") * F.col("weight")))
    return s.select("skey", "source_size", target.alias("target"), "total")


def apportion(rows: DataFrame, seats: str, weight: str, most: str, within: list[str]) -> DataFrame:
    """Sainte-Lague: ``rows`` with the column quota; within each group the highest quotients weight / (2k + 1) get its seats.

    ``most`` bounds a row's quota. Seats that are certain aren't listed: a row's exact share less half the number of
    rows times its part of the weight, less 2, is below what it gets; so the candidates are two for each row besides
    that slack, whatever the number of seats.
    """
    group = Window.partitionBy(*within)
    r = rows.withColumn("_all", F.sum(weight).over(group)).withColumn("_n", F.count(F.lit(1)).over(group))
    part = F.when(F.col("_all") > 0, F.col(weight) / F.col("_all")).otherwise(F.lit(0.0))
    r = r.withColumn("_share", part * F.col(seats)).withColumn("_slack", F.ceil(part * F.col("_n") / 2) + 2)
    r = r.withColumn("_sure", F.least(F.greatest(F.floor(F.col("_share")) - F.col("_slack"), F.lit(0)), F.col(most)).cast("long"))
    last = F.least(F.floor(F.col("_share")) + F.col("_slack"), F.col(most) - 1).cast("long")
    r = r.withColumn("_last", F.when(F.col(weight) > 0, last).otherwise(F.lit(-1)))
    seat = F.when(F.col("_last") >= F.col("_sure"), F.sequence("_sure", "_last")).otherwise(F.array().cast("array<long>"))
    columns = [*rows.columns, "_sure"]
    c = r.withColumn("_open", F.col(seats) - F.sum("_sure").over(group)).select(*columns, "_open", F.explode_outer(seat).alias("_k"))
    quotient = F.when(F.col("_k").isNotNull(), F.col(weight) / (2 * F.col("_k") + 1)).otherwise(F.lit(-1.0))
    tie = [x for x in rows.columns if x not in (seats, weight, most, *within)]
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("_q"), *tie, "_k"))
    c = c.withColumn("_q", quotient).withColumn("_rank", rank)
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_open")), 1).otherwise(0))
    return c.groupBy(*rows.columns, "_sure").agg(won.alias("_won")).withColumn("quota", F.col("_sure") + F.col("_won")).drop("_sure", "_won")


def _laid(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: tuple[str, ...], size_col: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their seeded order, the words of each source's cells, and the sources' targets."""
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    rows = stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("skey"), (F.col(size_col) if size_col else word_count(F.col(text_col))).alias("size"), *carry), "mix-rows")
    rows = rows.withColumn("draw", _draw(F.col("doc_id"))).withColumn("cell", F.pmod("draw", F.lit(CELLS)) * PARTS + F.floor(F.col("draw") / ((1 << 32) // PARTS)))
    cells = rows.groupBy("skey", "cell").agg(F.sum("size").alias("cell_size"))
    return rows, cells, source_targets(cells.groupBy("skey").agg(F.sum("cell_size").alias("source_size")))


def _given(table: DataFrame, sources: DataFrame) -> DataFrame:
    """``table``, of a row for each source and each block, broadcast if there are no more sources than blocks."""
    return F.broadcast(table) if sources.count() <= BLOCKS else table


def _ends(rows: DataFrame, cells: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """The rows with the column end: the words of their source up to and with their own, in seeded order."""
    start = F.coalesce(F.sum("cell_size").over(Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("skey", "cell", start.alias("cell_start"))
    end = F.sum("size").over(Window.partitionBy("skey", "cell").orderBy("draw", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end).join(cells, ["skey", "cell"]).withColumn("end", F.col("end") + F.col("cell_start"))


def whole(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), size_col: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies, then the columns named in carry): how often the mix takes each document, always whole.

    Sources get whole words by the highest quotients (``mix`` with blocks of one word). Each document is taken as often
    as the quota holds its source; of what remains, in seeded order, each document whose middle lies within it is taken
    once more. So a source's words are within a word or so and half of one document of its target, whatever the size of
    the source or of the table, and no document is cut. Documents without words are taken 0 times; a source that is one
    document of more than twice its target is left out. Otherwise as ``mix``; rows alike in doc_id and size are in order
    of the columns in carry.
    """
    rows, cells, sources = _laid(docs, id_col, text_col, source_col, carry, size_col)
    s = sources.select("skey", "source_size", "target", (F.col("source_size") * MOST).alias("most"), F.col("total").cast("long").alias("seats"), F.lit(0).alias("one"))
    s = apportion(s, "seats", "target", "most", ["one"]).select("skey", "source_size", "target", "quota")
    s = stash(s, "mix-sources")
    d = _ends(rows, cells, carry).join(_given(s, s), "skey")
    rounds = F.floor(F.col("quota") / F.col("source_size"))
    middle = 2 * F.col("end") - F.col("size")
    copies = rounds + (middle <= 2 * (F.col("quota") - rounds * F.col("source_size"))).cast("long")
    return d.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long").alias("copies"), *carry)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (), size_col: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, then the columns named in carry): how many words of each document the mix takes, repeats counted.

    Each source's words, its documents in seeded order end to end, are cut into blocks of equal words (the last may be
    shorter). Sources get whole words by the highest quotients, then each source's words are apportioned to the shards by
    the words that they hold of it; within shard and source, blocks are taken in seeded order, round after round, MOST
    times at most, the last one as far as the quota goes. So a source's words are within a word or so of its target, however
    small it is beside a block. A document's ``taken`` is the sum over the blocks that it lies in, so it is at most
    MOST times its size, and reruns agree.

    Null text has size 0 and is taken 0 words; null sources are one source, last in order; an empty source name is a
    source like others. Null or repeated doc_ids are rows like others. Extra columns are ignored. If nothing has words,
    targets are 0. An empty table gives an empty one. ``size_col`` names a column that has the words counted already.

    Blocks are broadcast if there are at most BLOCKS sources, so 2 * BLOCKS rows at most; else they are joined by source and block.
    A window over all sources has one row of each. A hot source is laid out in CELLS * PARTS parts.
    """
    rows, cells, sources = _laid(docs, id_col, text_col, source_col, carry, size_col)
    sources = stash(sources.withColumn("block", F.greatest(F.ceil(F.col("total") / BLOCKS), F.lit(1)).cast("long")), "mix-sources")

    # Whole words for the sources, by the highest quotients.
    held = F.ceil(F.col("source_size") / F.col("block")).cast("long")
    s = sources.select("skey", "source_size", "target", "block", held.alias("held"), (F.col("source_size") * MOST).alias("most"), F.col("total").cast("long").alias("seats"), F.lit(0).alias("one"))
    s = apportion(s, "seats", "target", "most", ["one"]).drop("seats", "most", "one").withColumnRenamed("quota", "source_quota")

    # Each source's blocks, at most BLOCKS and one for each source; every shard's part of the quota; the seeded order.
    b = s.where("held > 0").select("skey", "source_size", "block", "source_quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("held") - 1)).alias("b"))
    b = b.withColumn("order", _draw(F.col("skey"), F.col("b"))).withColumn("shard", F.pmod("b", F.lit(SHARDS)))
    b = b.withColumn("length", F.least(F.col("block"), F.col("source_size") - F.col("b") * F.col("block")))
    q = b.groupBy("skey", "shard", "source_quota").agg(F.sum("length").alias("words")).withColumn("weight", F.col("words").cast("double")).withColumn("most", F.col("words") * MOST)
    q = apportion(q, "source_quota", "weight", "most", ["skey"]).select("skey", "shard", "words", "quota")
    # All blocks so many times, and what remains of the quota from the first ones, of the last of these a part.
    earlier = Window.partitionBy("skey", "shard").orderBy("order", "b").rowsBetween(Window.unboundedPreceding, -1)
    b = b.join(q, ["skey", "shard"]).withColumn("times", F.floor(F.col("quota") / F.col("words")).cast("long"))
    left = F.pmod("quota", "words") - F.coalesce(F.sum("length").over(earlier), F.lit(0))
    b = b.withColumn("part", F.greatest(F.least("length", left), F.lit(0)).cast("long"))
    before = F.sum(F.col("times") * F.col("length") + F.col("part")).over(Window.partitionBy("skey").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    b = stash(b.select("skey", "b", "times", "part", F.coalesce(before, F.lit(0)).alias("before")), "mix-blocks")

    # A document lies from start to end in its source's words; what is taken of it is the difference of two sums.
    d = _ends(rows, cells)
    d = d.join(sources.select("skey", "source_size", "target", "block"), "skey")
    d = d.withColumn("first", F.floor((F.col("end") - F.col("size")) / F.col("block"))).withColumn("last", F.floor((F.col("end") - 1) / F.col("block")))

    def at(side: str) -> DataFrame:
        return _given(b.select("skey", F.col("b").alias(side), F.col("times").alias(f"{side}_times"), F.col("part").alias(f"{side}_part"), F.col("before").alias(f"{side}_before")), sources)

    def upto(side: str, offset: Column) -> Column:
        return F.col(f"{side}_before") + F.col(f"{side}_times") * offset + F.least(F.col(f"{side}_part"), offset)

    d = d.join(at("first"), ["skey", "first"], "left").join(at("last"), ["skey", "last"], "left")
    upto_end = upto("last", F.col("end") - F.col("last") * F.col("block"))
    upto_start = upto("first", F.col("end") - F.col("size") - F.col("first") * F.col("block"))
    words = F.when(F.col("size") > 0, upto_end - upto_start).otherwise(F.lit(0)).cast("long")
    return d.select("doc_id", "size", "source_size", "target", words.alias("taken"), *carry)
