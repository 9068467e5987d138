"""Sharding by balanced label propagation.

Documents with equal texts are linked. Groups that are large against a shard are placed first, the
largest before the others: whole where a shard has the room, else over as few shards as it takes.
The other linked documents start in a shard that a hash picks; then rounds of Spark joins move
them to the shard where most of their group is, as far as the quota that is left there allows, and
unlinked documents fill the shards up. At the end counts differ by one at most: the surplus of
fuller shards, unlinked documents first, goes to the others.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from gridloom.llm._shared import discard, rank_in_group, stage

SHARDS = 8
ROUNDS = 4
#: Groups of more than this share of a shard are placed one by one: fewer than SHARDS / LARGE of them.
LARGE = 1 / 64


def place_large(groups: list[tuple[bytes, int]], quota: int, shards: int) -> tuple[list[tuple[bytes, list[float], list[int]]], dict[int, int]]:
    """(group, upper ends of shares, shards of these) of large groups, and the rows each shard then has.

    The largest comes first, to the shard where it fits with least room to spare; one that fits nowhere is
    dealt to the fewest shards that can hold it.
    """
    room, out = dict.fromkeys(range(shards), quota), []
    for g, size in sorted(groups, key=lambda x: (-x[1], x[0])):
        fits = [s for s in range(shards) if room[s] >= size]
        if fits:
            parts = [(min(fits, key=lambda s: (room[s], s)), size)]
        else:
            few, held = [], 0
            for s in sorted(range(shards), key=lambda s: (-room[s], s)):
                if held < size and room[s] > 0:
                    few.append(s)
                    held += room[s]
            # In proportion to their room, so each keeps some for what a hash deals it too much.
            ends = [size * sum(room[s] for s in few[: i + 1]) // held for i in range(len(few))]
            parts = [(s, end - before) for s, before, end in zip(few, [0, *ends], ends, strict=False)]
        upto = 0
        ends = []
        for s, took in parts:
            room[s] -= took
            upto += took
            ends.append(upto / size)
        out.append((g, [*ends[:-1], 1.0], [s for s, _ in parts]))
    return out, {s: quota - room[s] for s in range(shards)}


def balance(spark, counts: dict[int, int], shards: int) -> tuple[DataFrame, dict[int, int]]:
    """Intervals (of surplus numbers) -> receiving shard, and each shard's surplus, for counts at most one apart.

    Larger targets go to the fuller shards. Both tables have a row for each shard.
    """
    total = sum(counts.values())
    order = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))
    target = {s: total // shards + (i < total % shards) for i, s in enumerate(order)}
    surplus = {s: max(0, counts.get(s, 0) - target[s]) for s in range(shards)}
    rows, at = [], 0
    for s in range(shards):
        lack = max(0, target[s] - counts.get(s, 0))
        if lack:
            rows.append((at, at + lack, s))
            at += lack
    return rows, surplus


def propagate(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Add `shard` to rows (g, key, ...): g is the group, or null for unlinked rows. docs is a staged table."""
    n = docs.count()
    quota = -(-n // shards)
    start = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(shards)).cast("int")
    sizes = stage(docs.where("g is not null").groupBy("g").count().where("count > 1"), "shard-groups")
    # Fewer than shards / LARGE groups can be as large as that.
    plan, large = place_large([(bytes(r.g), r["count"]) for r in sizes.where(F.col("count") > quota * LARGE).collect()], quota, shards)
    linked = docs.join(sizes, "g", "left").withColumn("node", F.when(F.col("count").isNotNull(), F.col("g")))
    if plan:
        placed = docs.sparkSession.createDataFrame(plan, "large binary, ends array<double>, places array<int>")
        u = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
        linked = linked.join(F.broadcast(placed), linked["g"] == placed["large"], "left")
        at = F.size(F.filter("ends", lambda e: e <= u)) + 1
        linked = linked.withColumn("fixed", F.col("large").isNotNull()).withColumn("shard", F.when(F.col("fixed"), F.element_at("places", at)).otherwise(start))
    else:
        linked = linked.withColumn("fixed", F.lit(False)).withColumn("shard", start)
    state = stage(linked.select(*docs.columns, "node", "fixed", "shard"), "shard-state")
    for _ in range(rounds):
        # Votes: a row for each group part and shard at most, by partial aggregation.
        votes = state.where("node is not null and not fixed").groupBy("node", "shard").count()
        wish = votes.groupBy("node").agg(F.max(F.struct("count", F.xxhash64("node", "shard").alias("tie"), "shard")).alias("top"), F.sum("count").alias("size"), F.count("*").alias("spread"))
        wish = stage(wish.select("node", F.col("top.shard").alias("to"), "size", F.col("top.count").alias("there"), "spread"), "shard-wishes")
        if not wish.where("spread > 1").limit(1).count():
            discard(wish)
            break
        # Quotas: what a shard would hold of linked rows against its capacity. Where too many wish to come, a part of
        # the groups, picked by hash, is sent to the shard with most room instead.
        load = {r.to: r.size for r in wish.groupBy("to").agg(F.sum("size").alias("size")).collect()}  # a row for each shard
        room = {s: quota - large[s] - load.get(s, 0) for s in range(shards)}
        to = F.col("to")
        chance = F.pmod(F.xxhash64("node", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
        free = sum(max(0, r) for r in room.values())
        if any(r < 0 for r in room.values()):
            edge, pick = 0.0, F.lit(None).cast("int")
            again = F.pmod(F.xxhash64("node", F.lit(19)), F.lit(1 << 20)) / float(1 << 20)
            for s in range(shards):
                if room[s] > 0:
                    low, edge = edge, edge + room[s] / free
                    pick = F.when((again >= low) & (again < edge), F.lit(s)).otherwise(pick)
            over = F.lit(0.0)
            for s in range(shards):
                if room[s] < 0:
                    over = F.when(F.col("to") == s, F.lit(-room[s] / max(1, load.get(s, 0)))).otherwise(over)
            to = F.when(chance < over, F.coalesce(pick, F.col("to"))).otherwise(F.col("to"))
        moves = stage(wish.select(F.col("node").alias("at"), to.cast("int").alias("to")), "shard-moves")
        joined = state.join(moves, state["node"] == moves["at"], "left")
        new = stage(joined.select(*docs.columns, "node", "fixed", F.when(F.col("fixed"), F.col("shard")).otherwise(F.coalesce("to", "shard")).alias("shard")), "shard-state")
        discard(state, wish, moves)
        state = new
    # Unlinked rows are dealt to the shards' remaining room, by hash and in proportion.
    held = {r.shard: r["count"] for r in state.where("node is not null").groupBy("shard").count().collect()}
    room = {s: max(0, quota - held.get(s, 0)) for s in range(shards)}
    free, edge, pick = sum(room.values()) or 1, 0.0, F.lit(shards - 1)
    u = F.pmod(F.xxhash64("key", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    for s in range(shards):
        low, edge = edge, edge + room[s] / free
        pick = F.when((u >= low) & (u < edge), F.lit(s)).otherwise(pick)
    dealt = stage(state.withColumn("shard", F.when(F.col("node").isNull(), pick).otherwise(F.col("shard")).cast("int")), "shard-dealt")
    discard(state, sizes)
    return even_out(dealt, shards).select(*docs.columns, "shard")


def even_out(dealt: DataFrame, shards: int) -> DataFrame:
    """Move the surplus of fuller shards, unlinked rows first, so that counts are at most one apart."""
    spark = dealt.sparkSession
    tallies = {(r.shard, r.linked): r["count"] for r in dealt.groupBy("shard", F.col("node").isNotNull().alias("linked")).count().collect()}
    counts = {s: tallies.get((s, False), 0) + tallies.get((s, True), 0) for s in range(shards)}
    intervals, surplus = balance(spark, counts, shards)
    if not intervals:
        return dealt
    ranked = rank_in_group(dealt.withColumn("linked", F.col("node").isNotNull()), ["shard", "linked"], ["key", "size", "crc"], "r")
    # Unlinked rows have the numbers below their count, linked ones follow.
    singles = F.lit(0).cast("long")
    base, leaves, at = F.lit(0).cast("long"), F.lit(0).cast("long"), 0
    for s in range(shards):
        singles = F.when(F.col("shard") == s, F.lit(tallies.get((s, False), 0))).otherwise(singles)
        base = F.when(F.col("shard") == s, F.lit(at)).otherwise(base)
        leaves = F.when(F.col("shard") == s, F.lit(surplus[s])).otherwise(leaves)
        at += surplus[s]
    number = F.col("r") + F.when(F.col("linked"), singles).otherwise(0)
    to = F.col("shard")
    for low, high, s in intervals:
        to = F.when((base + number >= low) & (base + number < high), F.lit(s)).otherwise(to)
    return ranked.select(*[c for c in dealt.columns if c != "shard"], F.when(number < leaves, to).otherwise(F.col("shard")).cast("int").alias("shard"))


def key_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, crc, g, key of every row; staged."""
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("crc"), F.when(F.col(text_col).isNotNull(), F.unhex(F.md5(text))).alias("g"))
    # The key tells rows apart that share an id but not a text.
    return stage(rows.withColumn("key", F.xxhash64("id", "g")), "shard-rows")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row; counts at most one apart.

    Size is the UTF-8 bytes of the text plus 1; null texts have size 1, the checksum of an empty text, and
    no links; null ids are dealt like others; repeated rows are linked by their text; other
    columns are not read; an empty table gives no rows. grown_shard is null: adding a shard moves rows.
    """
    rows = key_rows(docs, id_col, text_col)
    placed = stage(propagate(rows, shards), "shard-placed")
    slots = rank_in_group(placed, ["shard"], ["key", "id", "size", "crc"], "slot")
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """docs with shard and slot, to be written with partitionBy('shard'); columns of these names are replaced.

    Rows that agree in id and text are dealt as assign() deals them, in any order among themselves.
    """
    rows = key_rows(docs, id_col, text_col)
    placed = stage(propagate(rows, shards), "shard-placed")
    slots = stage(rank_in_group(placed, ["shard"], ["key", "id", "size", "crc"], "slot"), "shard-slots")
    again = W.partitionBy("key").orderBy("shard", "slot")
    numbered = slots.select("key", "shard", "slot", F.row_number().over(again).alias("copy"))
    text = F.col(text_col)
    keyed = docs.withColumn("__key", F.xxhash64(F.col(id_col), F.when(text.isNotNull(), F.unhex(F.md5(text)))))
    # Rows of one key differ at most in their other columns; those order them, so that a rerun deals them alike.
    others = [f.name for f in docs.schema.fields if f.name != text_col and not isinstance(f.dataType, (MapType, VariantType))]
    keyed = keyed.withColumn("__copy", F.row_number().over(W.partitionBy("__key").orderBy(F.xxhash64(*others))))
    own = numbered.select(F.col("key").alias("__k"), F.col("copy").alias("__c"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    joined = keyed.join(own, (F.col("__key") == F.col("__k")) & (F.col("__copy") == F.col("__c")))
    return joined.select(*[keyed[c] for c in docs.columns if c not in ("shard", "slot")], F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))
