"""Sharding (operator 8): from the bytes that each old shard holds and the capacities of the new ones, a minimum-cost flow
says how many bytes go from which old shard to which new one so that the fewest move; the documents then follow its pieces.

Law `bytes`: the new shards' bytes are near equal. A document's size is its text's UTF-8 bytes plus one. Documents of equal
texts form a unit, which goes to one shard and counts where its least doc_id was, as long as it isn't more than a shard holds;
of a larger group each document is a unit. Units of at least 1 / (200 * shards) of all bytes, at most 200 * shards of them,
take pieces of the flow first, each the one with most room left; the others, in the order of their hashes within an old
shard, are cut into what a flow over the rest assigns. A null text counts as empty; rows equal in id and text may be taken for
one another; an empty table gives an empty result. Extra columns of the input are not looked at."""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oscine.llm import common as C

OLD_SHARDS, NEW_SHARDS = 12, 16
ROWS_PER_BLOCK, MOST_BLOCKS = 4096, 1 << 16
LARGE_PARTS = 200


def least_moves(sizes: list[int], capacities: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j at the least cost, where a byte that leaves its shard costs one. Sum of sizes and
    of capacities must be equal. Successive shortest paths over a graph of the shards alone."""
    n, m = len(sizes), len(capacities)
    source, sink = n + m, n + m + 1
    room: dict[tuple[int, int], int] = defaultdict(int)
    cost: dict[tuple[int, int], int] = defaultdict(int)
    near: dict[int, list[int]] = defaultdict(list)

    def arc(a: int, b: int, most: int, price: int) -> None:
        room[a, b], cost[a, b], cost[b, a] = most, price, -price
        near[a].append(b)
        near[b].append(a)

    total = sum(sizes)
    for i, x in enumerate(sizes):
        arc(source, i, x, 0)
        for j in range(m):
            arc(i, n + j, total, int(i != j))
    for j, x in enumerate(capacities):
        arc(n + j, sink, x, 0)
    left = total
    while left:
        far, came, queue = {source: 0}, {}, deque([source])
        while queue:
            a = queue.popleft()
            for b in near[a]:
                if room[a, b] > 0 and far[a] + cost[a, b] < far.get(b, 1 << 60):
                    far[b], came[b] = far[a] + cost[a, b], a
                    queue.append(b)
        path, at = [], sink
        while at != source:
            path.append((came[at], at))
            at = came[at]
        push = min(left, *(room[x] for x in path))
        for a, b in path:
            room[a, b] -= push
            room[b, a] += push
        left -= push
    return {(i, j): room[n + j, i] for i in range(n) for j in range(m) if room[n + j, i] > 0}


def place_large(large: list[tuple[int, int, int]], flow: dict[tuple[int, int], int], n_new: int, target: float) -> dict[int, int]:
    """The new shard of each large unit (key, old shard, bytes). Largest first, they take the piece of their old shard's flow that
    stays, as long as it has room, then those that leave; one that no piece's shard can take goes to the emptiest shard."""
    room, loads, out = dict(flow), [0] * n_new, {}

    def put(key: int, old: int, size: int, j: int) -> None:
        out[key] = j
        loads[j] += size
        room[old, j] = room.get((old, j), 0) - size

    ordered = sorted(large, key=lambda x: (-x[2], x[0]))
    for key, old, size in ordered:  # the pieces that stay where they are cost nothing
        if room.get((old, old), 0) > 0 and loads[old] + size <= target:
            put(key, old, size, old)
    for key, old, size in ordered:
        if key not in out:
            fits = [j for j in range(n_new) if room.get((old, j), 0) > 0 and loads[j] + size <= target]
            j = max(fits, key=lambda j: (min(room[old, j], size), -loads[j], -j)) if fits else min(range(n_new), key=lambda j: (loads[j], j))
            put(key, old, size, j)
    return out


def plan_transfers(blocks: list[tuple[int, int, int]], loads: list[int], n_new: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """From (old shard, block, bytes) and what the new shards hold already: the byte at which each block begins in its old
    shard, and the pieces (old shard, from byte, to byte, new shard)."""
    sizes: dict[int, int] = defaultdict(int)
    begins = []
    for old, block, size in sorted(blocks):
        begins.append((old, block, sizes[old]))
        sizes[old] += size
    rest = sum(sizes.values())
    level = (rest + sum(loads)) / n_new
    room = [max(0.0, level - x) for x in loads]
    scale = rest / sum(room) if sum(room) else 0
    capacities = [int(x * scale) for x in room]
    for k in range(rest - sum(capacities)):
        capacities[k % n_new] += 1
    n_old = max(sizes, default=-1) + 1
    flows = least_moves([sizes[i] for i in range(n_old)], capacities)
    cuts, done = [], defaultdict(int)
    for (i, j), amount in sorted(flows.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        cuts.append((i, done[i], done[i] + amount, j))
        done[i] += amount
    return begins, cuts


def measured(docs: DataFrame, n_old: int, doc_id: str = "doc_id", text: str = "text", old: F.Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, crc, text's hash and old shard of each row; the old shard is the id's hash unless a column gives it."""
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("own"),
        (F.pmod(F.xxhash64(doc_id), F.lit(n_old)).cast("int") if old is None else old.cast("int")).alias("old_shard"), *also,
    )


def _units(rows: DataFrame, most: float) -> DataFrame:
    """Adds unit, home (the shard where the unit counts as being) and unit_bytes."""
    same = ["own", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "old_shard")).alias("first"))
    groups = groups.where((F.col("copies") > 1) & (F.col("copies") * F.col("size") <= most))
    grouped = F.col("copies").isNotNull()
    return rows.join(groups, same, "left").select(
        *rows.columns, F.when(grouped, F.xxhash64(F.lit("group"), *same)).otherwise(F.xxhash64(F.lit("row"), "doc_id", "own")).alias("unit"),
        F.coalesce("first.old_shard", "old_shard").alias("home"), F.coalesce(F.col("copies") * F.col("size"), "size").alias("unit_bytes"),
    )


def reshard(docs: DataFrame, n_new: int = NEW_SHARDS, n_old: int = OLD_SHARDS, doc_id: str = "doc_id", text: str = "text", old: F.Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot, and also columns of the input if named, of each row. The driver holds
    the sizes of at most MOST_BLOCKS blocks and of at most LARGE_PARTS * n_new large units, whatever the input's size."""
    spark = docs.sparkSession
    rows = C.materialize(measured(docs, n_old, doc_id, text, old, also), "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    per_shard = int(min(max(1, n / ROWS_PER_BLOCK / n_old), MOST_BLOCKS // n_old))
    least = max(2, -(-total // (LARGE_PARTS * n_new)))
    is_large = F.col("unit_bytes") >= least
    block = F.when(is_large, -1 - F.pmod(F.xxhash64("doc_id"), F.lit(per_shard))).otherwise(F.pmod("unit", F.lit(per_shard))).cast("int")
    rows = C.materialize(_units(rows, total / n_new).withColumn("block", block).drop("own"), "units")
    blocks = [(r["home"], r["block"], int(r["n"])) for r in rows.groupBy("home", "block").agg(F.sum("size").alias("n")).collect()]
    large = [tuple(r) for r in rows.where(is_large).groupBy("unit", "home").agg(F.sum("size")).collect()]
    flow = {(old_shard, j): hi - lo for old_shard, lo, hi, j in plan_transfers(blocks, [0] * n_new, n_new)[1]}
    placed = place_large(large, flow, n_new, total / n_new)
    loads = [0] * n_new
    for unit, _, size in large:
        loads[placed[unit]] += size
    begins, cuts = plan_transfers([x for x in blocks if x[1] >= 0], loads, n_new)

    begin = F.broadcast(spark.createDataFrame(begins or [(-1, -1, 0)], "home int, block int, begin long"))
    cut = F.broadcast(spark.createDataFrame(cuts or [(-1, 0, 0, 0)], "cut_old int, lo long, hi long, shard int"))
    upto = F.sum("size").over(Window.partitionBy("home", "block").orderBy("unit"))  # to the end of the row's unit
    middle = F.col("begin") + upto - F.expr("(unit_bytes + 1) div 2")
    spread = rows.where("block >= 0").join(begin, ["home", "block"]).withColumn("middle", middle)
    spread = spread.join(cut, (F.col("home") == F.col("cut_old")) & (F.col("middle") >= F.col("lo")) & (F.col("middle") < F.col("hi")))
    fixed = F.broadcast(spark.createDataFrame(list(placed.items()) or [(0, 0)], "unit long, shard int"))
    alone = rows.where("block < 0").join(fixed, "unit")
    columns = ["doc_id", "size", "text_crc32", "old_shard", "home", "block", "unit", "shard", *also]
    dealt = C.materialize(spread.select(columns).unionByName(alone.select(columns)), "dealt")

    pieces = dealt.groupBy("shard", "home", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("home", "block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("shard", "home", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = Window.partitionBy("shard", "home", "block").orderBy("unit", "doc_id", "size")
    return dealt.join(F.broadcast(pieces), ["shard", "home", "block"]).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", *also, (F.col("base") + F.row_number().over(rank) - 1).alias("slot")
    )


def rewrite(docs: DataFrame, placed: DataFrame, folder: str, doc_id: str = "doc_id") -> list[int]:
    """Writes the new shards that gained or lost documents, and gives their numbers; a shard that keeps just what its old
    namesake held needs no new file. Files of these shards that are there already are replaced, so that it may be run again.
    docs must have one row for each doc_id here."""
    moved = placed.where("shard <> old_shard")
    touched = [r[0] for r in moved.select("shard").union(moved.select("old_shard")).distinct().collect()]
    new = placed.where(F.col("shard").isin(touched)).select(F.col(doc_id), "shard", "slot")
    docs.join(new, doc_id).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
    return sorted(touched)
