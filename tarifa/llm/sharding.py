"""Sharding by balanced label propagation over groups of linked documents."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_place, checkpoint, prefix_sum


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index + 1)


def _quotas(asked: dict, room: list[int]) -> dict:
    """Documents that may move per (from, to): as many as ask to go the other way, and what room there is."""
    quota = {k: min(n, asked.get((k[1], k[0]), 0)) for k, n in asked.items()}
    left = list(room)
    for (a, b), n in sorted(asked.items()):
        more = min(n - quota[a, b], max(0, left[b]))
        quota[a, b] += more
        left[b] -= more
    return quota


def _gather(cells: DataFrame, room: list[int]) -> DataFrame:
    """Moves (grp, shard, to, m) that bring a cut group together in one shard with room for all that it lacks there: of these
    the one where it lacks least. Groups are admitted whole, those that lack least first, by a running sum a shard."""
    size = cells.groupBy("grp").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.map_from_entries(
        F.collect_list(F.struct("shard", "c"))).alias("at")).where("k > 1")                  # at most one entry a shard
    lack = F.col("n") - F.coalesce(F.element_at("at", F.col("to")), F.lit(0))
    asks = (size.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(len(room) - 1)))).withColumn("lack", lack)
            .where(F.col("lack") <= _pick(room, F.col("to")))
            .groupBy("grp").agg(F.min(F.struct("lack", F.xxhash64("grp", "to").alias("tie"), "to")).alias("x")).select("grp", "x.lack", "x.to"))
    asks = prefix_sum(checkpoint(asks), ["to"], "lack", ["grp"], "ahead", 256, F.least(F.lit(63), F.floor(F.log2("lack"))))
    won = asks.where(F.col("ahead") + F.col("lack") <= _pick(room, F.col("to"))).select(F.col("grp").alias("g"), "to")
    return (cells.join(won, F.col("grp").eqNullSafe(F.col("g"))).where("shard != to")
            .select("grp", "shard", F.col("to").cast("int").alias("to"), F.col("c").alias("m")))


def propagate(cells: DataFrame, targets: list[int], rounds: int | None = None) -> DataFrame:
    """``cells`` (grp, shard, c): how many documents of a group a shard holds. Documents of one cell are
    alike, so a hot group is at most one row per shard.

    In each round every group looks at the shards of its members and asks to move its smaller cells to the
    fullest; every other round only shards with room count, else swaps with documents that want to go the
    other way are possible too. Quotas per pair of shards keep each shard within its target (documents that may lie
    anywhere make way). Requests of a pair are admitted, larger gains first, by a distributed running sum; the
    last may be admitted in part. When two rounds in a row move nothing, groups that fit the room of a shard are gathered there
    (``_gather``). A move goes to a cell no smaller or brings a whole group together, so the sum of the squared cells grows with each and
    the loop comes to an end: when no group can be gathered either (or after ``rounds``, if given)."""
    shards, idle = len(targets), 0
    group = Window.partitionBy("grp")
    for turn in itertools.count() if rounds is None else range(rounds):
        held = {r["shard"]: r["c"] for r in cells.groupBy("shard").agg(F.sum("c").alias("c")).collect()}  # one row a shard
        room = [targets[s] - held.get(s, 0) for s in range(shards)]
        rank = F.struct(F.col("c"), F.xxhash64("grp", "shard").alias("tie"), F.col("shard").alias("to"))
        may = _pick(room, F.col("shard")) > 0 if turn % 2 == 0 else F.lit(True)
        asks = checkpoint(cells.withColumn("rank", rank).withColumn("best", F.max(F.when(may, F.col("rank"))).over(group))
                          .where(F.col("best").isNotNull() & (F.col("rank") < F.col("best")))
                          .select("grp", "shard", "c", F.col("best.to").alias("to"), F.col("best.c").alias("gain")))
        asked = {(r["shard"], r["to"]): r["n"] for r in asks.groupBy("shard", "to").agg(F.sum("c").alias("n")).collect()}  # shards^2
        quota = _quotas(asked, room)
        if any(quota.values()):
            idle = 0
            limit = F.element_at(F.create_map(*[x for (a, b), q in quota.items() for x in (F.lit(a * shards + b), F.lit(q).cast("long"))]),
                                 F.col("shard") * shards + F.col("to"))
            asks = prefix_sum(asks, ["shard", "to"], "c", ["grp"], "ahead", 256, 63 - F.least(F.lit(63), F.floor(F.log2("gain"))))
            moves = checkpoint(asks.withColumn("m", F.least(F.col("c"), limit - F.col("ahead"))).where("m > 0").select("grp", "shard", "to", "m"))
        else:
            idle += 1
            if idle < 2:
                continue
            moves = checkpoint(_gather(cells, room))
            if moves.isEmpty():
                break
            idle = 0
        cells = checkpoint(cells.select("grp", "shard", "c")
                           .unionByName(moves.select("grp", "shard", (-F.col("m")).alias("c")))
                           .unionByName(moves.select("grp", F.col("to").alias("shard"), F.col("m").alias("c")))
                           .groupBy("grp", "shard").agg(F.sum("c").alias("c")).where("c > 0"))
    return cells


def shard_rows(df: DataFrame, group_col: str, order_cols: list[str], shards: int = 24, rounds: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes in rows differ by at most one. Rows with the same ``group_col`` are linked. A group larger than a
    shard has to be cut: it gets whole shards, but for as many of its rows as it takes for a quarter of the other places to go to rows
    that may lie anywhere (unlinked ones are such too); these make way while the groups that fit one shard are drawn together, until
    no move brings more of a group together. How many stay cut is not bounded. Null is a group value like any other.
    Rows equal in ``order_cols`` are interchangeable. An empty table gives no rows. Columns may have any names; where one is called ``shard`` or ``slot``, the new one gets an underscore."""
    return by_place(df, [group_col, *order_cols], lambda d, g, *o: _shard_rows(d, g, list(o), shards, rounds), ("shard", "slot"))


def _shard_rows(df: DataFrame, group_col: str, order_cols: list[str], shards: int, rounds: int | None) -> DataFrame:
    df = checkpoint(df)
    n = df.count()
    targets = [n // shards + (s < n % shards) for s in range(shards)]
    groups = df.groupBy(F.col(group_col).alias("grp")).agg(F.count("*").alias("n"))
    linked = checkpoint(groups.where("n > 1"))
    large = linked.where(F.col("n") > n // shards).withColumn("cls", F.row_number().over(Window.orderBy(F.desc("n"), "grp")) - 1)
    big = [r["n"] for r in large.orderBy("cls").collect()]                                    # fewer than ``shards``
    small = linked.where(F.col("n") <= n // shards)
    n_small = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Whole shards of the large groups, the last ones; a large group's other rows lie before it.
    free, spare, whole = shards, n - n_small, []
    for size in big:
        end = free
        while (free > 1 and size >= sum(targets[free - 1:end])
               and 4 * (spare - targets[free - 1]) >= sum(targets[:free - 1])):
            free -= 1
            spare -= targets[free]
        whole.append((free, sum(targets[free:end])))
    # Start: linked documents are dealt round robin, group after group, so every shard begins within its target.
    start = prefix_sum(small, [], "n", ["grp"], "at")
    first = F.pmod(F.col("s") - F.col("at"), F.lit(free))
    cells = checkpoint(start.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(free - 1))))
                       .select("grp", F.col("s").alias("shard"),
                               (F.floor(F.col("n") / free) + (first < F.col("n") % free).cast("long")).alias("c"))
                       .where("c > 0"))
    cells = propagate(cells, targets[:free], rounds)
    held = {r["shard"]: r["c"] for r in cells.groupBy("shard").agg(F.sum("c").alias("c")).collect()}
    room = [targets[s] - held.get(s, 0) for s in range(shards)]
    ends = [sum(room[:s + 1]) for s in range(shards)]
    plan = cells.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("shard", "c"))).alias("cells"))  # <= shards entries
    kinds = linked.join(large.select(F.col("grp").alias("g"), "cls"), F.col("grp").eqNullSafe(F.col("g")), "left")
    marked = (df.join(kinds.select("grp", F.coalesce("cls", F.lit(-1)).alias("__cls")), F.col(group_col).eqNullSafe(F.col("grp")), "left")
              .drop("grp"))
    # Linked rows: rank within the group, then the cell that the rank falls in.
    own = prefix_sum(marked.where("__cls = -1"), [group_col], None, order_cols, "__r")
    own = own.join(plan, F.col(group_col).eqNullSafe(F.col("grp")))
    place = F.aggregate("cells", F.struct(F.lit(-1).alias("s"), F.col("__r").alias("left")),
                        lambda a, x: F.when((a["s"] < 0) & (a["left"] < x["c"]), F.struct(x["shard"].alias("s"), a["left"].alias("left")))
                        .otherwise(F.struct(a["s"].alias("s"), F.when(a["s"] < 0, a["left"] - x["c"]).otherwise(a["left"]).alias("left"))))
    own = own.withColumn("shard", place["s"].cast("int")).select(*df.columns, "shard")
    # The rest fill what room is left: large groups (but for those of their rows that get whole shards) one by one, then unlinked rows.
    left, at = [size - w for size, (_, w) in zip(big, whole, strict=True)], sum(room[:free])
    rank = prefix_sum(marked.where("__cls >= 0"), ["__cls"], None, order_cols, "__r")
    if big:
        in_whole = _pick([w for _, w in whole], F.col("__cls"))
        rank = rank.withColumn("__r", F.when(F.col("__r") < in_whole, F.col("__r") + _pick([at + sum(targets[free:s]) for s, _ in whole], F.col("__cls")))
                               .otherwise(F.col("__r") - in_whole + _pick([sum(left[:i]) for i in range(len(left))], F.col("__cls"))))
    alone = prefix_sum(marked.where("__cls is null"), [], None, order_cols, "__r").withColumn("__r", F.col("__r") + sum(left))
    rest = rank.unionByName(alone)
    rest = rest.withColumn("shard", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]),
                                                    lambda e: e <= F.col("__r"))).cast("int")).select(*df.columns, "shard")
    return prefix_sum(checkpoint(own.unionByName(rest)), ["shard"], None, order_cols, "slot")


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int | None = None) -> DataFrame:
    """Documents in ``shards`` shards under the law ``rows``; equal texts (null: empty) are linked.
    Returns doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard, slot, grown_shard (null)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("grp_key"))
    out = _shard_rows(rows, "grp_key", ["doc_id", "grp_key"], shards, rounds)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
