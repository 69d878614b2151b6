"""Mix sources to target weights by Sainte-Lague apportionment. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, boxed, content_key, keep, small_join, unboxed


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, src, source_size, source_rows, target) from (source, size).

    src numbers the sources by code point, null last; weights repeat in that order. The targets
    share all sizes by weight, but none is above max_epochs times its source's size; the excess
    goes to the others by weight. With sources in the order of that limit per weight, those at
    their limit come first, so running sums give the level that the others share.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    everything = Window.partitionBy()
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sums = sums.withColumn("src", number).withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")))
    sums = sums.withColumn("limit", F.lit(max_epochs) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("w"), "src")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(below), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0))))
    full = F.col("limit") <= F.col("level") * F.col("w")
    level = F.min(F.when(~full, F.struct(F.col("limit") / F.col("w"), "src", "level"))).over(everything)["level"]
    target = F.when(full, F.col("limit").cast("double")).otherwise(level * F.col("w"))
    return sums.select("source", "src", "source_size", "source_rows", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add `won`: of `seats` seats in each group, those with the highest votes / (s + 1/2) win.

    parties: one row per party with votes (double) and its group's seats (long). Rounding
    votes / d for the divisor d that fills the seats moves each party by half a seat at most,
    so d lies between V / (T + n/2) and V / (T - n/2). Seats that the upper divisor grants are
    certain; only those between the two are ranked, at most about two for each party.
    """
    g = Window.partitionBy(*group)
    p = parties.withColumn("_v", F.sum("votes").over(g)).withColumn("_n", F.count("*").over(g))
    low = F.when(F.col("seats") > F.col("_n") / 2, F.floor(F.col("votes") * (F.col("seats") - F.col("_n") / 2) / F.col("_v") + 0.5) - 1).otherwise(0)
    high = F.floor(F.col("votes") * (F.col("seats") + F.col("_n") / 2) / F.col("_v") + 0.5) + 1
    p = p.withColumn("_low", F.when(F.col("_v") > 0, F.greatest(low, F.lit(0))).otherwise(0).cast("long"))
    p = p.withColumn("_high", F.when(F.col("votes") > 0, F.greatest(high, F.col("_low") + 1)).otherwise(F.col("_low")).cast("long"))
    p = p.withColumn("_left", F.col("seats") - F.sum("_low").over(g))
    seat = F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence("_low", F.col("_high") - 1)))
    q = p.withColumn("_s", seat).withColumn("_q", F.col("votes") / (F.col("_s") + 0.5))
    q = q.withColumn("_rank", F.row_number().over(g.orderBy(F.col("_q").desc_nulls_last(), *order, "_s")))
    keys = [c for c in parties.columns]
    won = F.first("_low") + F.sum(F.when(F.col("_s").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    return q.groupBy(*keys).agg(won.cast("long").alias("won"))


def mix_plan(docs: DataFrame, block_words: int = 64, shard_words: int = 1 << 19, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7) -> DataFrame:
    """What the mix takes of each row of docs (doc_id, text, source).

    Returns doc_id, rk, source, size, source_size, target, taken, epochs and pieces: the mix
    takes the whole document `epochs` times and, beside that, the word ranges in pieces.

    A source's documents are dealt to shards of about shard_words words, as many as its own size
    asks for, by a seeded hash. They stand in seeded order in their shard, and its shards follow
    one another, so a source is one sequence of words; every block_words of it are a block, and
    only its last block can be shorter. The mix takes a source whole as often as its target holds
    it; seats (blocks) for what is left of the targets go to sources by Sainte-Lague, and a
    source's seats to runs of about shard_words words of its sequence by Sainte-Lague on their
    blocks, which never gives a run more seats than blocks. A run's blocks are taken in seeded
    order. So a source's taken words differ from its target by about a block, at any table size.

    Defined cases: a null text has size 0 and is never taken; a null source is a source of its
    own, the last one; repeated rows are taken each for itself; an empty table gives no rows.
    """
    sized = keep(docs.select("doc_id", content_key(docs).alias("rk"), "source", word_count("text").alias("size")), "mix-sizes")
    targets = keep(source_targets(sized, weights, max_epochs), "mix-targets")
    rows = small_join(sized, targets, ["source"])
    # empty texts have no words but are rows of a window all the same
    shards = F.greatest(F.ceil((F.col("source_size") + F.col("source_rows")) / shard_words), F.lit(1)).cast("long")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "rk"), shards)).drop("source_rows")
    place = Window.partitionBy("src", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "rk"), "doc_id", "rk")
    rows = keep(rows.withColumn("off", F.coalesce(F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "mix-rows")
    before = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("src", "shard").agg(F.sum("size").alias("_words"))
    starts = keep(starts.select("src", "shard", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("start")), "mix-starts")

    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("int")
    left = targets.select("src", "source_size", epochs.alias("epochs"), F.greatest(F.col("target") - epochs * F.col("source_size"), F.lit(0.0)).alias("votes"))
    left = left.withColumn("votes", F.when(F.col("epochs") < max_epochs, F.col("votes")).otherwise(0.0)).withColumn("all", F.lit(0))
    left = left.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy("all")) / block_words).cast("long"))
    quotas = sainte_lague(left, ["all"], ["src"]).withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    quotas = keep(quotas.select("src", "epochs", "blocks", F.least("won", "blocks").alias("rest")), "mix-quotas")

    run = max(1, shard_words // block_words)
    runs = quotas.filter("rest > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / run).cast("long"))))
    runs = runs.select("src", "run", F.least(F.lit(run), F.col("blocks") - F.col("run") * run).cast("double").alias("votes"), F.col("rest").alias("seats"))
    chosen = sainte_lague(runs, ["src"], ["run"]).filter("won > 0")
    chosen = chosen.withColumn("block", F.explode(F.sequence(F.col("run") * run, F.col("run") * run + F.col("votes").cast("long") - 1)))
    chosen = chosen.withColumn("_r", F.row_number().over(Window.partitionBy("src", "run").orderBy(F.xxhash64(F.lit(seed + 2), "src", "block"), "block")))
    # written, so that the join below knows its true size
    chosen = keep(chosen.filter(F.col("_r") <= F.col("won")).select("src", "block"), "mix-blocks")

    rows = small_join(rows, starts, ["src", "shard"], "left").withColumn("off", F.col("off") + F.col("start")).drop("start")
    rows = small_join(rows, quotas.select("src", "epochs", "rest"), ["src"], "left")
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    rows = keep(rows, "mix-placed")
    last = F.floor((F.col("off") + F.col("size") - 1) / block_words)
    touch = rows.filter("size > 0 and rest > 0").select("_n", "src", "off", "size", F.explode(F.sequence(F.floor(F.col("off") / block_words), last)).alias("block"))
    touch = touch.join(chosen, ["src", "block"])
    start = F.greatest(F.col("block") * block_words - F.col("off"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_words - F.col("off"), F.col("size"))
    parts = touch.groupBy("_n").agg(F.sum(end - start).alias("part"), F.array_sort(F.collect_list(F.struct(start.alias("start"), end.alias("end")))).alias("pieces"))
    out = rows.join(parts, "_n", "left")
    epochs = F.coalesce("epochs", F.lit(0))
    taken = epochs * F.col("size") + F.coalesce("part", F.lit(0))
    return out.select("doc_id", "rk", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), epochs.alias("epochs"), "pieces")


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus itself: docs' columns, one row per copy that the mix takes.

    Whole copies keep their text; a partial copy holds the words of its chosen blocks, joined by
    single spaces. n_chars, if docs has it, is set anew. Documents that the mix takes nothing of
    have no row. Equal rows (maps aside) count once for each row, and other columns may have any name.
    """
    plan = mix_plan(docs, **params).filter("taken > 0")
    whole = F.array_repeat(F.array(F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))), F.col("epochs"))
    cast = F.transform("pieces", lambda p: F.struct(p["start"].cast("long").alias("start"), p["end"].cast("long").alias("end")))
    copies = F.when(F.col("pieces").isNotNull(), F.concat(whole, F.array(cast))).otherwise(whole)
    takes = plan.select("doc_id", "rk", copies.alias("copies")).groupBy("doc_id", "rk").agg(F.flatten(F.collect_list("copies")).alias("copies"))
    keyed = boxed(docs, id2=F.col("doc_id"), rk2=content_key(docs), text=F.col("text")).dropDuplicates(["id2", "rk2"])
    out = keyed.join(takes, F.col("id2").eqNullSafe(F.col("doc_id")) & (F.col("rk2") == F.col("rk")))
    # a Generate of one row: the text is split here, once, and not again for each of its pieces
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    some = F.exists("copies", lambda c: F.element_at(c, 1)["start"] >= 0)
    out = out.withColumn("words", F.explode(F.array(F.when(some, words)))).withColumn("copy", F.explode("copies"))
    cut = F.flatten(F.transform("copy", lambda p: F.slice(F.col("words"), (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))))
    out = out.withColumn("text", F.when(F.element_at("copy", 1)["start"] >= 0, F.array_join(cut, " ")).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast("long")
    return unboxed(out, docs.columns, **new)
