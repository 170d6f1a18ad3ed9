"""Sharding by balanced label propagation.

Method: documents that are linked (here: those of equal texts, through their group) vote for shards; in each round joins
carry the votes to the documents, which move to the shard that most of their neighbours are in, as far as that shard's quota
of linked rows allows. Groups above a quota are placed before, largest first: they fill one shard after another. The others vote
among the shards with room; a group whose shards are all full goes to one with room, by its hash. What is left over evens out exactly: shards over their size hand their last rows, unlinked ones first,
to shards below it. Rounds go on until no link is cut, or until PATIENCE of them in turn have not lessened the cut links (a
row outside the shard of most of its group is one). Native Spark expressions; the driver sees at most shards x shards numbers.

Law ``rows``: numbers of rows are at most one apart. Defined cases: a null text is empty, and all empty texts are one group;
null and repeated doc_ids are rows of their own; a group over a shard's size is split; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import fingerprint, settle, table, text_of

SHARDS, PATIENCE, PER_BUCKET = 8, 2, 20_000


def cut_links(placed: DataFrame, shard_col: str = "shard") -> DataFrame:
    """(linked, cut) of rows(_g1, _g2, shard): rows in groups of two or more, and those outside the shard of most of their group."""
    by = placed.groupBy("_g1", "_g2", shard_col).agg(F.count("*").alias("_n")).groupBy("_g1", "_g2").agg(F.sum("_n").alias("_all"), F.max("_n").alias("_most")).where("_all > 1")
    return by.agg(F.coalesce(F.sum("_all"), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("_all") - F.col("_most")), F.lit(0)).alias("cut"))


def propagate(members: DataFrame, shards: int, quota: int) -> DataFrame:
    """Label propagation over (_row, _g1, _g2, _size, _label); _size is the group's rows.

    A group within a sixteenth of the quota moves or stays as one, chosen by a hash of the group; larger ones by row.
    A group above the quota is dealt by row to the shards that it fills, and takes no part in the rounds."""
    big = members.where(F.col("_size") > quota).groupBy("_g1", "_g2").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_g1", "_g2").collect()  # fewer than shards + 1 rows
    taken, fixed = [0] * shards, None
    if big:
        place, at = F.lit(0), 0  # the row's number in all big groups one after another, then the shard that holds it
        cuts = []
        for g in big:
            cuts.append(at)
            at += g["_n"]
        for s in range(shards):
            taken[s] = max(0, min(quota, at - s * quota))
        for g, cut in zip(big, cuts, strict=True):
            share = F.pmod(F.xxhash64("_row", F.lit(3)), F.lit(1 << 30)).cast("double") / float(1 << 30) * g["_n"] + cut
            place = F.when((F.col("_g1") == g["_g1"]) & (F.col("_g2") == g["_g2"]), share).otherwise(place)
        label = F.least(F.floor(place / quota), F.lit(shards - 1)).cast("int")
        fixed = settle(members.where(F.col("_size") > quota).withColumn("_label", label))
        members = settle(members.where(F.col("_size") <= quota))
    least, since = None, 0
    for r in count():
        votes = members.groupBy("_g1", "_g2", "_label").agg(F.count("*").alias("_n"))
        held = list(taken)
        for f in members.groupBy("_label").agg(F.count("*").alias("_n")).collect():  # a row per shard
            held[f["_label"]] += f["_n"]
        free = [max(0, quota - held[s]) for s in range(shards)]
        # A group votes among the shards with room, and for the full one that holds all of it; where none is left, for one by its hash in proportion to the room.
        open_ = F.element_at(F.array(*[F.lit(x > 0) for x in free]), F.col("_label") + 1)
        whole = F.max("_n") == F.sum("_n")
        spot, other, filled = F.pmod(F.xxhash64("_g1", F.lit(r + 100)), F.lit(max(1, sum(free)))), F.max_by("_label", "_n"), 0
        for s in range(shards):
            other = F.when((spot >= filled) & (spot < filled + free[s]), F.lit(s)).otherwise(other)
            filled += free[s]
        among = F.max_by(F.when(open_, F.col("_label")), F.struct(open_, F.col("_n"), F.xxhash64("_g1", "_label")))
        best = settle(votes.groupBy("_g1", "_g2").agg(F.when(whole, F.max_by("_label", "_n")).otherwise(F.coalesce(among, other)).cast("int").alias("_want"), (F.sum("_n") - F.max("_n")).alias("_cut")))
        cut = best.agg(F.sum("_cut")).first()[0] or 0
        since = 0 if least is None or cut < least else since + 1
        least = cut if least is None else min(cut, least)
        if not cut or since >= PATIENCE:
            break
        asked = members.join(best.drop("_cut"), ["_g1", "_g2"])
        flows = asked.groupBy("_label", "_want").agg(F.count("*").alias("_n")).collect()  # shards x shards rows at most
        wanted = [0] * shards
        for f in flows:
            if f["_want"] != f["_label"]:
                wanted[f["_want"]] += f["_n"]
        if not any(wanted):
            break
        room = F.array(*[F.lit(min(1.0, max(0.0, (quota - held[s]) / wanted[s])) if wanted[s] else 0.0) for s in range(shards)])
        mover = F.when(F.col("_size") * 16 <= quota, F.xxhash64("_g1", F.lit(r))).otherwise(F.xxhash64("_row", F.lit(r)))
        chance = F.pmod(mover, F.lit(1 << 30)).cast("double") / float(1 << 30)
        moves = (F.col("_want") != F.col("_label")) & (chance < F.element_at(room, F.col("_want") + 1))
        members = settle(asked.select("_row", "_g1", "_g2", "_size", F.when(moves, F.col("_want")).otherwise(F.col("_label")).alias("_label")))
    return members if fixed is None else members.unionByName(fixed)


def shard_rows(docs: DataFrame, *, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(_row, doc_id, size, text_crc32, linked, shard, slot): slot counts from 0 in each shard, without gaps.

    _row is ``row_col``, distinct longs, or a number given here. Slots are numbered in buckets of about PER_BUCKET rows, so no task sorts a whole shard."""
    utf8 = F.encode(text_of(text_col), "UTF-8")
    g1, g2 = fingerprint(text_of(text_col))
    rows = settle(docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row"), F.col(id_col).alias("_id"), (F.octet_length(utf8) + 1).cast("long").alias("_bytes"), F.crc32(utf8).alias("_crc"), g1.alias("_g1"), g2.alias("_g2")))
    groups = rows.groupBy("_g1", "_g2").agg(F.count("*").alias("_size")).where("_size > 1")
    first = F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("null")), "_g1"), F.lit(shards)).cast("int")
    members = settle(rows.join(groups, ["_g1", "_g2"]).select("_row", "_g1", "_g2", "_size", first.alias("_label")))
    total = rows.count()
    members = propagate(members, shards, max(1, total // shards)).select(F.col("_row").alias("_mrow"), F.col("_label").alias("_mlabel"))

    buckets = max(1, total // (shards * PER_BUCKET))
    placed = rows.join(members, F.col("_row") == F.col("_mrow"), "left").select(
        "_row", "_id", "_bytes", "_crc", F.coalesce("_mlabel", first).alias("_label"), F.col("_mlabel").isNull().cast("int").alias("_single"),
        F.pmod(F.xxhash64("_row", F.lit(7)), F.lit(buckets)).alias("_bucket"),
    )
    placed = settle(placed)
    part = ["_label", "_single", "_bucket"]
    sizes = placed.groupBy(*part).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_label").orderBy("_single", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy(*part).orderBy("_row")))
    slotted = ranked.join(offsets, part).withColumn("_slot", F.col("_off") + F.col("_rank") - 1)

    held = [0] * shards
    for r in sizes.groupBy("_label").agg(F.sum("_n").alias("_n")).collect():  # a row per shard
        held[r["_label"]] = r["_n"]
    target = [total // shards + (s < total % shards) for s in range(shards)]
    shard, slot = F.col("_label"), F.col("_slot")
    spare, over = [], 0  # where each shard's rows over its target begin among all such rows
    for s in range(shards):
        spare.append(over - target[s])
        over += max(0, held[s] - target[s])
    surplus = F.element_at(F.array(*[F.lit(x).cast("long") for x in spare]), F.col("_label") + 1) + F.col("_slot")
    moved = F.col("_slot") >= F.element_at(F.array(*[F.lit(x).cast("long") for x in target]), F.col("_label") + 1)
    filled = 0
    for s in range(shards):
        need = max(0, target[s] - held[s])
        here = moved & (surplus >= filled) & (surplus < filled + need)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, surplus - filled + held[s]).otherwise(slot)
        filled += need
    return slotted.select("_row", F.col("_id").alias("doc_id"), F.col("_bytes").alias("size"), F.col("_crc").alias("text_crc32"), (F.col("_single") == 0).alias("linked"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
