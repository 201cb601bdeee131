"""Balanced shards of linked documents by label propagation.

Rows start dealt out evenly. In every round a linked row asks for the shard that most of
its neighbours are in; the moves between each two shards are counted, and granted as far as
rows without links can make room by moving the other way, so the shards' counts never
change. Rounds end when no row asks, when neither of two rounds in a row, an even and an
odd one, left fewer rows asking, or after ``rounds``. In even rounds the rows that all
their neighbours look up to stay, in odd rounds half of the rows do, so that two neighbours
don't swap places for ever.

Rows of a text that no shard can hold fill whole shards first, as many as they can; these
shards take no further part, so such a text lies over no more shards than it needs, or one
more. Links of equal texts among the rest are stars, not pairs: each row is linked to the
first of its text. Exact ranks within a shard or a flow are those within a hashed bucket plus
the counts of the buckets before it, so no task orders a whole shard. The driver sees counts
by pairs of shards only.

Everything is DataFrame expressions. Rows get a number when they are written first; what
follows reads the written table.

Defined cases: a null text has no bytes and equals an empty one; null ids pass through;
repeated rows are rows of their own, linked as equal texts; with fewer rows than shards
some stay empty; a very long text is one row like any other; of equally wanted shards the own one wins, then the lowest; an empty
table gives an empty table. Results have the columns named here only, so extra columns
can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolens.llm.tables import written

SHARDS = 40
ROUNDS = 8
OVERHEAD = 16  # bytes of a row beside its text
BUCKET_ROWS = 20_000  # about so many rows are ordered together
TEXT = ["text_hash", "text_crc32", "size"]  # what tells texts apart


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (a number of its own), ``doc_id``, and size and hashes of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    return written(rows, "shard-rows")


def ranked(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Adds each row's exact rank, from 0, among those with equal ``keys``. ``n`` is
    the number of rows in all."""
    buckets = max(1, n // BUCKET_ROWS)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = dealt.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("row"))
    joined = dealt.withColumn("within", within).join(offsets, [*keys, "bucket"])
    return joined.withColumn(name, (F.col("offset") + F.col("within") - 1).cast("long")).drop("bucket", "within", "offset")


def even_start(rows: DataFrame, shards: int, first: int = 0) -> DataFrame:
    """``row`` and ``shard`` (from ``first`` on), counts at most one apart: rows in turn. A
    row's number is its partition's and its place there, so its position follows from the
    partitions' counts; where rows are missing, from ranks in the partitions."""
    part = F.shiftright("row", 33).alias("part")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))  # a row for each partition
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("offset"))
    own = rows.select("row", part)
    if first:
        own = ranked(own, ["part"], rows.count(), "place")
    else:
        own = own.withColumn("place", F.col("row").bitwiseAND(F.lit((1 << 33) - 1)))
    place = F.col("place") + F.col("offset")
    turn = (place % max(1, shards - first) + first).cast("int").alias("shard")
    return own.join(offsets, "part").select("row", turn)


def filled(counts: list[tuple[tuple, int]], n: int, shards: int) -> list[tuple]:
    """Of texts and their counts, those that no shard can hold: which of a text's rows, from
    ``low`` to below ``high``, fill which shard. The first ``n % shards`` shards hold one more."""
    sizes = [n // shards + (k < n % shards) for k in range(shards)]
    out: list[tuple] = []
    for text, count in sorted(counts, key=lambda c: (-c[1], c[0])):
        low = 0
        while count > sizes[0] and len(out) < shards and count - low >= sizes[len(out)] > 1:
            size = sizes[len(out)]
            out.append((*text, low, low + size, len(out)))
            low += size
    return out


def full_shards(rows: DataFrame, n: int, shards: int) -> tuple[DataFrame, int]:
    """``row`` and ``shard`` of the rows that fill whole shards with one text, and how many
    these shards are. Fewer texts than shards have so many rows."""
    counts = rows.groupBy(*TEXT).agg(F.count("*").alias("n")).filter(F.col("n") > max(1, n // shards)).collect()
    ranges = filled([(tuple(r[name] for name in TEXT), r["n"]) for r in counts], n, shards)
    schema = "text_hash long, text_crc32 long, size long, low long, high long, shard int"
    places = rows.sparkSession.createDataFrame(ranges, schema)  # as many rows as shards at most
    if not ranges:
        return places.selectExpr("low AS row", "shard"), 0
    large = rows.select("row", *TEXT).join(F.broadcast(places.select(*TEXT).distinct()), TEXT)
    placed = ranked(large, TEXT, n, "rank").join(F.broadcast(places), TEXT).filter("rank >= low and rank < high")
    return written(placed.select("row", "shard"), "shard-full"), len(ranges)


def equal_text_links(rows: DataFrame) -> DataFrame:
    """``a`` and ``b``: a star for each text."""
    groups = rows.groupBy(*TEXT).agg(F.count("*").alias("n"), F.min("row").alias("hub")).filter("n > 1")
    groups = written(groups.drop("n"), "equal-texts")
    spokes = rows.select("row", *TEXT).join(groups, TEXT).select(F.col("row").alias("a"), F.col("hub").alias("b"))
    return written(spokes.filter("a <> b"), "equal-text-rows")


def granted(wants: dict[tuple[int, int], int], free: dict[int, int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """How many moves of each flow to grant, and how many free rows move back, so that
    every shard takes in as many rows as it gives away. Swaps between two shards need no
    room and are always granted; of the rest what finds no room is not."""
    swaps = {flow: min(n, wants.get(flow[::-1], 0)) for flow, n in wants.items()}
    flows = {flow: n - swaps[flow] for flow, n in wants.items()}
    net = {shard: 0 for flow in flows for shard in flow}
    for (source, target), n in flows.items():
        net[source] -= n
        net[target] += n
    while over := [shard for shard in sorted(net) if net[shard] > free.get(shard, 0)]:
        for shard in over:
            for flow in sorted(flow for flow in flows if flow[1] == shard):
                less = min(flows[flow], net[shard] - free.get(shard, 0))
                if less > 0:
                    flows[flow] -= less
                    net[shard] -= less
                    net[flow[0]] += less
    back: dict[tuple[int, int], int] = {}
    takers = [[shard, -n] for shard, n in sorted(net.items()) if n < 0]
    for shard, n in sorted(net.items()):
        while n > 0:
            moved = min(n, takers[0][1])
            back[shard, takers[0][0]] = moved
            n -= moved
            takers[0][1] -= moved
            if not takers[0][1]:
                takers.pop(0)
    return {flow: n + swaps[flow] for flow, n in flows.items()}, back


def propagate(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, first: int = 0) -> DataFrame:
    """``row`` and ``shard`` (from ``first`` on); counts at most one apart, linked rows
    together as far as they fit. ``links`` has ``a`` and ``b``, each link once."""
    n = rows.count()
    labels = written(even_start(rows, shards, first), "shard-start")
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "shard-links")
    degrees = both.groupBy("a").agg(F.count("*").alias("degree"))
    degrees = written(degrees, "shard-degrees")
    rank = F.struct("degree", (-F.col("row")).alias("row"))
    seen = both.join(degrees.select(F.col("a").alias("b"), "degree"), "b")
    above = seen.groupBy("a").agg(F.max(F.struct("degree", (-F.col("b")).alias("row"))).alias("above"))
    linked = degrees.withColumnRenamed("a", "row").join(above.withColumnRenamed("a", "row"), "row")
    linked = written(linked.select("row", (rank > F.col("above")).alias("anchor")), "shard-linked")
    least, idle = n + 1, 0
    for turn in range(rounds):
        near = both.join(labels.withColumnRenamed("row", "b"), "b").groupBy(F.col("a").alias("row"), "shard")
        near = near.agg(F.count("*").alias("votes")).withColumnRenamed("shard", "near")
        stays = F.col("anchor") if turn % 2 == 0 else F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(2)) == 0
        own = linked.join(labels, "row").select("row", "shard", stays.alias("stays"))
        choice = F.max(F.struct("votes", (F.col("near") == F.col("shard")).alias("own"), (-F.col("near")).alias("minus")))
        asked = own.join(near, "row").groupBy("row", "shard", "stays").agg(choice.alias("best"))
        asked = asked.select("row", "shard", "stays", (-F.col("best.minus")).alias("target")).filter("target <> shard")
        asked = written(asked, "shard-asked")
        asking = asked.count()
        idle = 0 if asking < least else idle + 1
        if asking == 0 or idle == 2:
            break
        least = min(least, asking)
        moves = asked.filter(~F.col("stays")).select("row", "shard", "target")
        wants = {(r["shard"], r["target"]): r["n"] for r in moves.groupBy("shard", "target").agg(F.count("*").alias("n")).collect()}
        if not wants:
            continue
        loose = labels.join(linked, "row", "left_anti")
        free = {r["shard"]: r["n"] for r in loose.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        flows, back = granted(wants, free)
        spark = rows.sparkSession
        schema = "shard int, target int, low long, high long"
        quota = F.broadcast(spark.createDataFrame([(*flow, 0, k) for flow, k in flows.items() if k], schema))  # shards squared at most
        ranges, given = [], {}
        for (source, target), k in back.items():
            low = given.get(source, 0)
            ranges.append((source, target, low, low + k))
            given[source] = low + k
        moved = ranked(moves, ["shard", "target"], n, "rank").join(quota, ["shard", "target"]).filter("rank < high")
        room = ranked(loose, ["shard"], n, "rank").join(F.broadcast(spark.createDataFrame(ranges, schema)), "shard")
        room = room.filter("rank >= low and rank < high")
        changed = moved.select("row", "target").unionByName(room.select("row", "target"))
        labels = written(
            labels.join(changed, "row", "left").select("row", F.coalesce("target", "shard").alias("shard")), "shard-labels"
        )
    return labels


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law`` (``rows``), ``shard``, ``slot`` within it
    and ``grown_shard`` (null) of every document, equal texts together."""
    rows = numbered(docs, id_col, text_col)
    n = rows.count()
    full, first = full_shards(rows, n, shards)
    rest = written(rows.join(full, "row", "left_anti"), "shard-rest") if first else rows
    labels = propagate(rest, equal_text_links(rest), shards, rounds, first)
    labels = labels.unionByName(full) if first else labels
    placed = ranked(rows.join(labels, "row"), ["shard"], n, "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
