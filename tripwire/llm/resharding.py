"""Minimum-cost-flow resharding of a table's files.

The files of a table are its old shards.  Given the capacities of the new
shards, a minimum-cost flow finds how many bytes go from each old shard to each
new one so that the fewest bytes move: staying costs nothing, moving costs one
a byte.  A transfer is a block: a run of rows in the old shard's order (largest
first, so what stays is large and what moves is small).  Files that no row
leaves or enters stay as they are; all others are rewritten.

Rows are whole, so blocks meet at rows that cross a border.  Three sets, each
with a bound that doesn't grow with the table, are placed one by one on the
driver so that shards still become nearly equal: rows above a small part of a
shard (there can't be more than shards times that part), rows that cross a
border (one a border), and the few smallest rows of each old shard.

A row's new shard follows from its old shard and its size by cuts that are
broadcast, so texts are shuffled once, to be written.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripwire.llm.common import fresh_path, written

SHARDS = 40
ROW_BYTES = 16          # of a row besides its text
LARGE = 64              # a row of more than this part of a shard is placed by itself
FINE = 64               # smallest rows of an old shard that are placed last
MAX_OLD = 512           # old shards; more files share numbers
PIECE_BYTES = 16 << 20  # bytes of a written file, about
BUCKET_ROWS = 100_000   # rows of a bucket of prefix sums, about


# ------------------------------------------------------------------ the flow
def min_cost_flow(supply: dict[int, int], room: dict[int, int], cost) -> dict[tuple[int, int], int]:
    """Units from each supply to each room at the least total cost; all supply goes if the room is enough.

    Successive shortest paths; ``cost(i, j)`` is of one unit.  A network has an
    arc for each supply and room at its own cost, and one hub for all pairs of
    cost 1, so it has as many arcs as nodes, about.
    """
    graph: dict[object, list[list]] = defaultdict(list)

    def arc(a, b, most: int, price: int) -> None:
        graph[a].append([b, most, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, units in supply.items():
        arc("source", ("from", i), units, 0)
        arc(("from", i), "hub", units, 1)
        for j in room:
            if cost(i, j) == 0:
                arc(("from", i), ("to", j), units, 0)
    for j, units in room.items():
        arc("hub", ("to", j), units, 0)
        arc(("to", j), "sink", units, 0)
    while True:
        far, back, queue, queued = {"source": 0}, {}, deque(["source"]), {"source"}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for k, (b, most, price, _) in enumerate(graph[a]):
                if most > 0 and far[a] + price < far.get(b, math.inf):
                    far[b], back[b] = far[a] + price, (a, k)
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if "sink" not in far:
            break
        path, node = [], "sink"
        while node != "source":
            a, k = back[node]
            path.append(graph[a][k])
            node = a
        units = min(e[1] for e in path)
        for e in path:
            e[1] -= units
            graph[e[0]][e[3]][1] += units
    flows: dict[tuple[int, int], int] = {}
    out, into = [], []
    for i, units in supply.items():
        for b, _, _, back_at in graph[("from", i)]:
            sent = graph[b][back_at][1] if b != "source" else 0     # what could flow back
            if sent and b == "hub":
                out.append([i, sent])
            elif sent:
                flows[i, b[1]] = sent
    for j in room:
        sent = sum(e[1] for e in graph[("to", j)] if e[0] == "hub")
        if sent:
            into.append([j, sent])
    while out and into:         # every pair through the hub costs the same
        units = min(out[0][1], into[0][1])
        key = out[0][0], into[0][0]
        flows[key] = flows.get(key, 0) + units
        for side in (out, into):
            side[0][1] -= units
            if not side[0][1]:
                side.pop(0)
    return flows


def levelled(load: list[int], capacities: list[float], more: int) -> list[int]:
    """How much of ``more`` each shard takes so that all come as near to the same share of their capacity as their ``load`` allows."""
    order = sorted(range(len(load)), key=lambda j: load[j] / capacities[j])
    poured, width = 0, 0.0
    level = 0.0
    for k, j in enumerate(order):
        width += capacities[j]
        poured += load[j]
        level = (more + poured) / width
        if k + 1 == len(order) or level <= load[order[k + 1]] / capacities[order[k + 1]]:
            break
    room = [max(0, math.floor(level * c) - x) for c, x in zip(capacities, load)]
    for j in itertools.cycle(order):        # what rounding left, a unit a shard
        if sum(room) >= more:
            break
        room[j] += min(1 + (more - sum(room)) // len(room), more - sum(room))
    return room


# ------------------------------------------------------------------ rows
def numbered(rows: DataFrame) -> DataFrame:
    """Each row of files as a struct ``row``, with its ``file``, ``_old``, the number of the file, and ``_tie``, a hash of its place in the file."""
    names = rows.select(F.col("_metadata.file_path").alias("file")).distinct().orderBy("file").limit(MAX_OLD + 1).collect()
    file = F.col("_metadata.file_path")
    if len(names) > MAX_OLD:
        old = F.pmod(F.xxhash64(file), F.lit(MAX_OLD)).cast("int")
    else:
        old = (F.array_position(F.array(*[F.lit(r.file) for r in names]), file) - 1).cast("int") if names else F.lit(0)
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.select(whole.alias("row"), file.alias("file"), old.alias("_old"), F.xxhash64(file, F.col("_metadata.row_index")).alias("_tie"))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def placed_before(slim: DataFrame, rows: int) -> DataFrame:
    """``slim`` (``_old``, ``_size``, ``_tie``) with ``before``: the bytes ahead of a row in its old shard's order.

    Prefix sums in two levels: sizes that share their leading bits, and a hash
    prefix of rows of such sizes; only sums of these buckets are in one window.
    """
    digits = max(0, math.ceil(math.log(max(1, rows / BUCKET_ROWS), 16)))
    leading = F.floor(F.log2("_size") * 8).cast("int")
    cut = slim.withColumn("_class", -leading).withColumn("_bucket", F.shiftright("_tie", 64 - 4 * digits) if digits else F.lit(0).cast("long"))     # keeps the order
    sums = cut.groupBy("_old", "_class", "_size", "_bucket").agg(F.sum("_size").alias("bytes"))
    classes = sums.groupBy("_old", "_class").agg(F.sum("bytes").alias("bytes"))
    over = Window.partitionBy("_old").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    class_base = classes.select("_old", "_class", F.coalesce(F.sum("bytes").over(over), F.lit(0)).alias("_class_base"))
    inside = Window.partitionBy("_old", "_class").orderBy(F.col("_size").desc(), "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_old", "_class", "_size", "_bucket", F.coalesce(F.sum("bytes").over(inside), F.lit(0)).alias("_base")).join(class_base, ["_old", "_class"])
    row = F.row_number().over(Window.partitionBy("_old", "_class", "_size", "_bucket").orderBy("_tie")) - 1
    return (cut.join(base, ["_old", "_class", "_size", "_bucket"])
            .withColumn("before", F.col("_class_base") + F.col("_base") + row * F.col("_size")).select("_old", "_size", "_tie", "before"))


class Plan:
    """Where each row goes: for each old shard the cuts of its order with the shard that begins there, and the rows placed one by one."""

    def __init__(self, capacities: list[float]):
        self.capacities, self.load = capacities, [0] * len(capacities)
        self.cuts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)    # old shard: (rank, tie, shard)
        self.alone: list[tuple[int, int, int, int]] = []                        # old shard, size, tie, shard
        self.transfers: dict[tuple[int, int], int] = {}                         # bytes from an old shard to a new one, as the flow has them

    def place(self, row, shard: int) -> None:
        self.alone.append((row[0], row[1], row[2], shard))
        self.load[shard] += row[1]

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` (``_old``, ``_size``, ``_tie``, others) with their new ``shard``."""
        spark = rows.sparkSession
        cuts = spark.createDataFrame([(old, sorted(c)) for old, c in self.cuts.items()], "_old int, _cuts array<struct<rank: long, tie: long, shard: int>>")
        alone = spark.createDataFrame(self.alone, "_old int, _size long, _tie long, _alone int")
        d = rows.join(F.broadcast(cuts), "_old", "left").join(F.broadcast(alone), ["_old", "_size", "_tie"], "left")     # both of bounded size
        own = F.struct((-F.col("_size")).alias("rank"), F.col("_tie").alias("tie"))
        passed = F.filter("_cuts", lambda c: F.struct(c["rank"].alias("rank"), c["tie"].alias("tie")) <= own)
        return d.withColumn("shard", F.coalesce("_alone", F.get(passed, F.size(passed) - 1)["shard"])).drop("_cuts", "_alone")


def planned(slim: DataFrame, capacities: list[float]) -> Plan:
    """The plan for the rows ``slim`` (``_old``, ``_size``, ``_tie``) and shards of these (relative) capacities."""
    spark, shards, plan = slim.sparkSession, len(capacities), Plan(capacities)
    total, rows = (x or 0 for x in slim.agg(F.sum("_size"), F.count(F.lit(1))).first())
    if not rows:
        return plan
    fair = [total * c / sum(capacities) for c in capacities]
    # 1. rows above a small part of the least shard: there is room for few of them only
    part = min(fair) / LARGE
    for r in sorted(slim.filter(F.col("_size") > part).select("_old", "_size", "_tie").collect(), key=lambda r: (-r[1], r[0], r[2])):
        home = r[0] < shards and plan.load[r[0]] + r[1] <= fair[r[0]]
        plan.place(r, r[0] if home else min(range(shards), key=lambda j: ((plan.load[j] + r[1]) / capacities[j], j)))
    small = slim.filter(F.col("_size") <= part)
    # 2. the few smallest rows of each old shard, the end of its order, are placed last
    last = F.row_number().over(Window.partitionBy("_old").orderBy("_size", F.col("_tie").desc()))
    loose = [tuple(r)[:3] for r in small.withColumn("_last", last).filter(F.col("_last") <= FINE).select("_old", "_size", "_tie").collect()]
    # 3. the flow of all others
    supply = {r[0]: r[1] for r in small.groupBy("_old").agg(F.sum("_size")).collect()}
    for old, size, _ in loose:
        supply[old] -= size
    room = levelled(plan.load, capacities, sum(supply.values()))
    full = [x + y for x, y in zip(plan.load, levelled(plan.load, capacities, sum(supply.values()) + sum(r[1] for r in loose)))]
    flows = min_cost_flow(supply, dict(enumerate(room)), lambda i, j: int(i != j))
    plan.transfers = {k: v for k, v in flows.items() if k[0] != k[1]}
    borders = []        # in bytes of an old shard's order: what stays, then the blocks that move
    for i in supply:
        at = 0
        for j in sorted((j for old, j in flows if old == i), key=lambda j: (j != i, j)):
            borders.append((i, j, at, at + flows[i, j]))
            at += flows[i, j]
    edges = spark.createDataFrame(borders, "_old int, shard int, begins long, ends long")
    inside = placed_before(small, rows).join(F.broadcast(edges), "_old").filter((F.col("before") >= F.col("begins")) & (F.col("before") < F.col("ends")))
    crossing = F.col("before") + F.col("_size") > F.col("ends")
    blocks = inside.groupBy("_old", "shard").agg(F.min(F.struct((-F.col("_size")).alias("rank"), "_tie")).alias("first"), F.max(F.when(crossing, F.struct("_size", "_tie"))).alias("over"),
                                                 F.coalesce(F.sum(F.when(~crossing, F.col("_size"))), F.lit(0)).alias("bytes"))
    for r in blocks.collect():      # a row a transfer
        plan.cuts[r["_old"]].append((*r["first"], r["shard"]))
        plan.load[r["shard"]] += r["bytes"]
        if r["over"] is not None:
            loose.append((r["_old"], *r["over"]))
    heap = [(plan.load[j] / capacities[j], j) for j in range(shards)]
    heapq.heapify(heap)
    for r in sorted(loose, key=lambda r: (-r[1], r[0], r[2])):
        j = r[0]
        if j >= shards or plan.load[j] + r[1] > full[j]:        # no room at home: the emptiest
            while heap[0][0] != plan.load[heap[0][1]] / capacities[heap[0][1]]:
                _, k = heapq.heappop(heap)      # it has grown since
                heapq.heappush(heap, (plan.load[k] / capacities[k], k))
            j = heap[0][1]
        plan.place(r, j)
    return plan


# ------------------------------------------------------------------ files
def reshard(spark: SparkSession, path: str, shards: int | list[float] = SHARDS, text_col: str = "text", out: str | None = None) -> DataFrame:
    """Put the rows of the Parquet files under ``path`` into new shards; ``shard``, ``slot`` and ``row`` of every row, read from the new shards' files.

    ``shards`` is a number of equal shards, or a list of relative capacities.
    Old shard ``k`` is the ``k``-th file by name; its rows stay in shard ``k``
    as far as there is room.  ``out`` gets ``manifest`` (a row a shard: its
    files' path, and whether they were rewritten) and the files of the
    rewritten shards.  A shard that keeps exactly the rows of its file keeps
    the file.  ``slot`` numbers a shard's rows from 0 without gaps.

    ``row`` is a struct of all columns, so none can clash.  Null and empty
    texts count ``ROW_BYTES``; a text longer than a shard has a shard that is
    larger than the others.  Repeated rows and texts are rows of their own.  An
    empty table gives no rows and empty shards.
    """
    capacities = [1.0] * shards if isinstance(shards, int) else list(shards)
    out = out or fresh_path(spark, "shards")
    docs = spark.read.parquet(path)
    named = numbered(docs)
    size = size_of(F.col("row").getField(text_col)).alias("_size")
    slim = written(named.select("_old", size, "_tie"), "reshard-sizes")
    plan = planned(slim, capacities)
    pieces = max(1, math.ceil(max(plan.load) / PIECE_BYTES))
    piece = F.pmod(F.xxhash64("_tie"), F.lit(pieces)).cast("int").alias("piece")
    moves = plan.apply(slim).groupBy("_old", "shard").agg(F.count(F.lit(1)).alias("rows"))
    files = named.groupBy("_old").agg(F.min("file").alias("file"), F.max("file").alias("other")).collect()
    pairs = [(r["_old"], r["shard"]) for r in moves.select("_old", "shard").collect()]      # old shards x shards at most
    stays = {i for i, j in pairs if i == j and sum(i == a for a, _ in pairs) == 1 and sum(j == b for _, b in pairs) == 1}
    kept = {r["_old"]: r["file"] for r in files if r["_old"] in stays and r["file"] == r["other"]}
    manifest = [(j, kept.get(j, f"{out}/rows/shard={j}"), j not in kept, int(plan.load[j])) for j in range(len(capacities))]
    spark.createDataFrame(manifest, "shard int, path string, rewritten boolean, bytes long").coalesce(1).write.json(f"{out}/manifest")

    affected = ~F.col("shard").isin(list(kept)) if kept else F.lit(True)
    sums = plan.apply(slim).filter(affected).select("shard", piece).groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)      # a row a piece
    bases = sums.select("shard", "piece", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("base"))
    rows = plan.apply(named.select("row", "_old", size, "_tie")).filter(affected).select("shard", piece, "_tie", "row")
    place = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("_tie")) - 1
    rows.join(bases, ["shard", "piece"]).select("shard", (F.col("base") + place).cast("long").alias("slot"), "row").write.partitionBy("shard").parquet(f"{out}/rows")
    return read_shards(spark, out, docs)


def read_shards(spark: SparkSession, out: str, like: DataFrame) -> DataFrame:
    """``shard``, ``slot``, ``row`` of what ``reshard`` has left under ``out``, by its manifest; ``like`` has the columns of a row."""
    whole = F.struct(*[F.col(c) for c in like.columns])
    schema = like.select(F.lit(0).cast("long").alias("slot"), whole.alias("row"), F.lit(0).alias("shard")).schema
    rows = spark.read.schema(schema).parquet(f"{out}/rows").select("shard", "slot", "row")
    for r in spark.read.schema("shard int, path string, rewritten boolean").json(f"{out}/manifest").filter("NOT rewritten").collect():     # a row a shard
        own = spark.read.schema(like.schema).parquet(r.path)
        rows = rows.unionByName(own.select(F.lit(r.shard).alias("shard"), F.col("_metadata.row_index").cast("long").alias("slot"), whole.alias("row")))
    return rows


def op11_resharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return reshard(spark, f"{sf_dir}/documents.parquet").select(
        F.col("row.doc_id").alias("doc_id"), size_of(F.col("row.text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
