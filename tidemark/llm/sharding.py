"""Shards of even row counts by balanced label propagation, in DataFrame operations only.

Nodes are groups of equal texts; two nodes are linked by every line (of LINE_CHARS code points or
more) that both hold. In each round a line speaks for the label that most of its nodes have, a node
wishes to move to the label that its lines speak for most, and only as many wishes are granted as
quotas allow. This is done twice. First every node has a label of its own and labels grow to
clusters, up to a share of a shard. Then clusters are dealt over the shards and a label is a shard:
of the wishes from one shard to another as many are granted as there are wishes back (plus
what room there is), so shards stay even. Documents are then laid out shard by shard, clusters and
groups together, and cut into shards whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table, text_or_empty
from tidemark.llm.line_dedup import line_key

N_SHARDS = 16
#: Rounds in which clusters grow, and in which nodes move between shards.
GROWING, ROUNDS = 4, 3
#: A cluster has this share of a shard at most.
CLUSTER_SHARE = 0.5
LINE_CHARS = 20
#: Buckets of hash prefixes within a label, and what share of all rows makes a group a hot one.
PREFIXES = 512
HOT_SHARE = 2048
_SCALE = 1 << 30
#: Rows of a written file, and edges of a line that one task joins. A line's pieces are 8192 times their share of all lines at most.
FILE_ROWS, PIECE_ROWS, PIECES = 1 << 16, 128, 8192


def _hash01(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(_SCALE)) / F.lit(float(_SCALE))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """In tasks that write a file of about FILE_ROWS each, one a core at least, whatever the number of shuffle partitions.

    An executor starts processes for each file that it makes (the local file system sets modes by chmod),
    and steps that write few rows would write them as hundreds of files.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def _wishes(edges: DataFrame, labelled: DataFrame, turn: int) -> DataFrame:
    """``g, to``: the label that the lines of each node speak for most. Ties go by hash, the same way everywhere."""
    tie = lambda c: F.xxhash64(F.lit(turn), c).alias("tie")
    tied = edges.join(labelled.select("g", "label"), "g")
    per_label = tied.groupBy("l", "label").agg(F.count("*").alias("k"), F.max("pieces").alias("pieces"))
    spoken = (
        per_label.groupBy("l")
        .agg(F.max(F.struct("k", tie("label"), "label")).alias("top"), F.sum("k").alias("all"), F.max("pieces").alias("pieces"))
        .select("l", _each_piece(), F.col("top.label").alias("to"), F.floor(1000 * F.col("top.k") / F.col("all")).alias("voice"))
    )
    # A very common line is dealt to many tasks by its pieces.
    return (
        edges.select("g", "l", _piece("pieces")).join(spoken, ["l", "piece"])
        .groupBy("g", "to").agg(F.sum("voice").alias("voice"))
        .groupBy("g").agg(F.max(F.struct("voice", tie("to"), "to")).alias("best"))
        .select("g", F.col("best.to").alias("to"))
    )


def _piece(pieces: str | Column) -> Column:
    """Which piece of its line's edges the edge of a node is in."""
    return F.pmod(F.xxhash64(F.lit(7), "g"), pieces).alias("piece")


def _each_piece() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece")


def _half(turn: int) -> Column:
    """Half of the nodes stay where they are in a round, so that linked nodes do not swap places."""
    return _hash01(F.lit(turn), F.col("g")) < 0.5


def clusters(nodes: DataFrame, edges: DataFrame, most: float, rows: int, rounds: int = GROWING) -> DataFrame:
    """``g, w, label`` for ``nodes`` (g, w; ``rows`` or fewer): clusters of weight ``most`` or less, named by one of their nodes.

    Every node starts as a cluster. Where more weight wishes to join a cluster than there is room, a
    share of the wishes is granted, chosen by hash. Those are few clusters, as what is held and what
    is asked weigh more than ``most`` there, and both weigh as much as all nodes in all.
    """
    labelled = nodes.withColumn("label", F.col("g"))
    for turn in range(rounds):
        wished = labelled.join(_wishes(edges, labelled, -1 - turn), "g", "left").withColumn("to", F.when(_half(-1 - turn), F.col("to")))
        wished = materialize(_few(wished, rows), f"joins{turn}")
        held = wished.select("label", F.col("w").alias("held"), F.lit(0).cast("long").alias("asked"))
        asked = wished.where("to != label").select(F.col("to").alias("label"), F.lit(0).cast("long").alias("held"), F.col("w").alias("asked"))
        weights = held.union(asked).groupBy("label").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked")).where("asked > 0")
        full = weights.select("label", ((F.lit(float(most)) - F.col("held")) / F.col("asked")).alias("share")).where("share < 1").collect()
        share = F.try_element_at(F.create_map(*(F.lit(x) for r in full for x in r)), F.col("to")) if full else F.lit(1.0)
        granted = _hash01(F.lit(500 + turn), F.col("g")) < F.coalesce(share, F.lit(1.0))
        labelled = wished.select("g", "w", F.when(F.col("to").isNotNull() & granted, F.col("to")).otherwise(F.col("label")).alias("label"))
    return labelled


def propagate(nodes: DataFrame, edges: DataFrame, n_labels: float, rows: int, rounds: int = ROUNDS) -> DataFrame:
    """``g, label, cluster`` for ``nodes`` (g, w; ``rows`` or fewer) under ``edges`` (g, l, pieces: see ``_links``).

    n_labels may have a fraction: the last label is then smaller by it.
    """
    capacity = nodes.agg(F.sum("w").alias("w")).first()["w"] / n_labels
    grown = clusters(nodes, edges, max(1.0, CLUSTER_SHARE * capacity), rows)
    start = F.floor(_hash01(F.lit(-1), F.col("label")) * n_labels).cast("int")
    labelled = grown.select("g", "w", start.alias("label"), F.col("label").alias("cluster"))
    count = int(-(-n_labels // 1))
    for turn in range(rounds):
        wished = labelled.join(_wishes(edges, labelled, turn), "g", "left").withColumn("to", F.when(_half(turn) & (F.col("w") <= capacity / 2), F.col("to")))
        wished = materialize(_few(wished, rows), f"wishes{turn}")
        flows = wished.where("to != label").groupBy("label", "to").agg(F.sum("w").alias("w")).collect()
        held = {r["label"]: r["w"] for r in wished.groupBy("label").agg(F.sum("w").alias("w")).collect()}
        want = {(r["label"], r["to"]): r["w"] for r in flows}  # at most one row per pair of labels
        room = {t: max(0.0, min(capacity, capacity * (n_labels - t)) - held.get(t, 0)) / count for t in range(count)}
        share = [
            min(1.0, (want.get((t, f), 0) + room[t]) / want[f, t]) if (f, t) in want else 0.0
            for f in range(count)
            for t in range(count)
        ]
        granted = F.get(F.array(*map(F.lit, share)), F.col("label") * count + F.col("to"))
        moves = F.col("to").isNotNull() & (_hash01(F.lit(1000 + turn), F.col("g")) < granted)
        labelled = wished.select("g", "w", F.when(moves, F.col("to")).otherwise(F.col("label")).alias("label"), "cluster")
    return labelled.select("g", "label", "cluster")


def _links(base: DataFrame, n_lines: int) -> DataFrame:
    """``g, l, pieces``: nodes and the lines that at least two of them hold, and in how many pieces such a line's edges are dealt.

    No more than PIECES lines have several.
    """
    held = base.select("g", F.explode("lines").alias("l")).distinct()
    shared = held.groupBy("l").agg(F.count("*").alias("k")).where("k > 1")
    shared = shared.select("l", F.ceil(F.col("k") / max(PIECE_ROWS, -(-n_lines // PIECES))).alias("pieces"))
    common = shared.where("pieces > 1").withColumnRenamed("pieces", "many")
    dealt = held.join(F.broadcast(common), "l", "left").select("g", "l", _piece(F.coalesce("many", F.lit(1))))
    return dealt.join(shared.select("l", "pieces", _each_piece()), ["l", "piece"]).select("g", "l", "pieces")


def shard(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; law ``rows``.

    Row counts of shards differ by one at most; the first ones take what is over. slot counts
    from 0 in each shard without gaps. Equal texts lie together: a group is cut only where it
    meets a shard's end, so one larger than a shard spans as few as it can.

    * A text of any length is one row; its lines are compared by hashes.
    * A null text is as an empty one: size 1, checksum 0. A null doc_id is placed and stays null.
    * Rows that share a doc_id are placed one by one. Fewer rows than shards: some shards are empty.
    * An empty table gives an empty result. Only doc_id and text are read.
    """
    lines = F.filter(F.transform(F.split(text_or_empty(), "\n"), line_key), lambda k: F.char_length(k) >= LINE_CHARS)
    base = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
            F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit(3), text_or_empty()).alias("g"),
            F.array_distinct(F.transform(lines, lambda k: F.xxhash64(k))).alias("lines"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "base",
    )
    found = base.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("lines")).first()
    total = found["rows"]
    nodes = materialize(_few(base.groupBy("g").agg(F.count("*").alias("w")), total), "nodes")
    # Groups of half a shard or more, 2 * n_shards at most, have a place of their own at the end.
    large = nodes.where(F.col("w") * 2 * n_shards >= total)
    giants = large.agg(F.sum("w").alias("w")).first()["w"] or 0
    n_labels = (total - giants) * n_shards / max(1, total)
    rest = nodes.where(F.col("w") * 2 * n_shards < total)
    if n_labels > 1:
        links = _links(base, found["lines"]).join(F.broadcast(large.select("g")), "g", "left_anti")
        labels = propagate(rest, materialize(_few(links, found["lines"]), "links"), n_labels, total, rounds)
    else:
        labels = rest.select("g", F.lit(0).alias("label"), F.col("g").alias("cluster"))
    return _laid_out(base.drop("lines"), nodes, labels, total, n_shards)


def _laid_out(base: DataFrame, nodes: DataFrame, labels: DataFrame, total: int, n_shards: int) -> DataFrame:
    """Positions 0 to total - 1 by label, cluster and group, from counts of small buckets; shards cut them."""
    marked = nodes.join(labels, "g", "left").select("g", "w", F.coalesce("label", F.lit(n_shards)).alias("label"), F.coalesce("cluster", "g").alias("cluster"))
    # Hot groups and clusters, HOT_SHARE of each at most, are buckets of their own, and several if need be.
    heavy = marked.groupBy("cluster").agg(F.sum("w").alias("weight")).where(F.col("weight") * HOT_SHARE > total)
    salts = lambda w: F.greatest(F.lit(1), F.ceil(F.col(w) * (4 * HOT_SHARE) / max(1, total)))
    hot = F.col("w") * HOT_SHARE > total
    marked = marked.join(F.broadcast(heavy), "cluster", "left").select(
        "g", "label", "cluster",
        F.when(hot, F.col("g")).when(F.col("weight").isNotNull(), F.col("cluster")).otherwise(0).alias("hot"),
        F.when(hot, salts("w")).alias("by_doc"), F.when(~hot, salts("weight")).alias("by_group"),
    )
    # Very many equal rows are told apart by their numbers; which of them lies where makes no difference. 4 * HOT_SHARE at most.
    equal = base.groupBy("g", F.coalesce("doc_id", F.lit(0)).alias("_doc"), F.col("doc_id").isNull().alias("_none")).agg(F.count("*").alias("k"))
    equal = equal.where(F.col("k") * (4 * HOT_SHARE) > total).drop("k").withColumn("many", F.lit(True))
    base = base.withColumns({"_doc": F.coalesce("doc_id", F.lit(0)), "_none": F.col("doc_id").isNull()}).join(F.broadcast(equal), ["g", "_doc", "_none"], "left")
    apart = F.when(F.col("many"), F.col("row")).otherwise(0)
    by_doc, by_group = F.pmod(F.xxhash64("doc_id", "size", apart), F.col("by_doc")), F.pmod(F.xxhash64(F.lit(6), "g"), F.col("by_group"))
    placed = base.join(marked, "g").select(
        "doc_id", "size", "text_crc32", "g", "label", "cluster", "hot",
        F.pmod(F.xxhash64(F.lit(5), "cluster"), F.lit(PREFIXES)).alias("region"), F.coalesce(by_doc, by_group, F.lit(0)).alias("part"),
    )
    placed = materialize(_few(placed, total), "placed")
    key = ["label", "region", "hot", "part"]
    counts = placed.groupBy(*key).agg(F.count("*").alias("n"))
    # At most n_shards * PREFIXES + 10 * HOT_SHARE buckets and some of their labels, however many rows: one task may sum them up.
    before = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy(*key).orderBy("cluster", "g", F.xxhash64("doc_id"), "doc_id", "text_crc32")
    position = F.col("before") + F.row_number().over(within) - 1
    each, over = divmod(total, n_shards)
    cut = over * (each + 1)
    at = placed.join(F.broadcast(offsets), key).withColumn("position", position)
    in_long = F.col("position") < cut
    number = F.when(in_long, F.floor(F.col("position") / (each + 1))).otherwise(
        over + F.floor((F.col("position") - cut) / max(1, each))
    )
    start = F.when(in_long, F.col("shard") * (each + 1)).otherwise(cut + (F.col("shard") - over) * each)
    out = at.withColumn("shard", number.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("position") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
    return _few(out, total)


def op10_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
