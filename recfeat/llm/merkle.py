"""A Merkle manifest of a dataset by a butterfly exchange.

Rows are leaves. The leaves of a group (a language) stand in the order of a column; each run of ``FANOUT`` nodes has a
parent, up to the group's root, and the groups' roots are the leaves of a last tree. Leaves are dealt to blocks
of ``FANOUT ** DEPTH`` neighbours, each of which hashes its own subtree. Then blocks swap roots round by round: in round
r the blocks that differ in digit r of their number alone (to the base of the fanout) meet, and each of them hashes the common
parent for itself, with the others' roots as its proof. So each block has all upper proofs after the last round, without a way
down again. Where the last subtree of a group is not full, its blocks stand in for the missing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_table

FANOUT, DEPTH = 8, 3
PATH = "array<struct<place:int,others:array<string>>>"
"""From the leaf up: the node's place in its run, and the digests of the run's other nodes from left to right."""


def digest(parts: Column) -> Column:
    """Lowercase hex SHA-256 of an array of texts, one after the other."""
    return F.sha2(F.array_join(parts, ""), 256)


def leaf(*columns: str | Column) -> Column:
    """The digest of a row's values in turn: ``-`` if null, else byte count, colon and value (numbers in decimals)."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return digest(F.array(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    whole = lambda node, step: F.concat(F.slice(step["others"], F.lit(1), step["place"]), F.array(node), F.slice(step["others"], step["place"] + 1, F.lit(FANOUT)))
    return F.aggregate(path, start, lambda node, step: digest(whole(node, step)))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, each from left to right."""
    return digest(F.flatten(F.transform(path, lambda step: step["others"])))


def _up(nodes: Column, more: Column) -> Column:
    """The next level of a block; ``more``: whether the group's level has several nodes."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(FANOUT))
    return F.when(more, F.transform(starts, lambda at: digest(F.slice(nodes, at, F.lit(FANOUT))))).otherwise(nodes)


def _step(nodes: Column, at: Column) -> Column:
    """The step of node ``at`` (from 0) of a block's level."""
    place = (at % FANOUT).cast("int")
    run = F.slice(nodes, (at - place + 1).cast("int"), F.lit(FANOUT))
    return F.struct(place.alias("place"), F.filter(run, lambda x, j: j != place).alias("others"))


def _width(n: Column, level: int) -> Column:
    """How many nodes ``n`` leaves have at a level."""
    return F.ceil(n / F.lit(FANOUT**level)).cast("long")


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (g, o, d, keep) with ``i``, the place in the group from 0, and ``n``, the group's size.

    Rows are range-partitioned by group and order, so neither a large group nor one repeated row meets in one task; rows
    of equal group and order stand by digest. Places are counted within partitions, plus what earlier ones hold.
    """
    order = ["g", "o", "d", "read"]
    slim = as_table(rows, "leaves").withColumn("read", F.monotonically_increasing_id())
    placed = as_table(slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("read").withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright(F.col("at"), 33)
    counts = placed.groupBy("g", part.alias("part")).agg(F.count("*").alias("c"), F.min("at").alias("first"))
    group = Window.partitionBy("g")
    before = F.sum("c").over(group.orderBy("part")) - F.col("c")
    starts = as_table(counts.select(F.col("g").alias("of"), "part", "first", before.alias("before"), F.sum("c").over(group).alias("n")), "starts")
    joined = placed.withColumn("part", part).join(starts, ["part"]).where(F.col("g").eqNullSafe(F.col("of")))
    return joined.select("g", "o", "d", "keep", (F.col("at") - F.col("first") + F.col("before")).alias("i"), "n")


def _blocks(ranked: DataFrame) -> DataFrame:
    """One row for each block: its leaves in order, its inner levels and its root."""
    size = FANOUT**DEPTH
    cell = F.struct("i", "d", "o", "keep")
    made = ranked.withColumn("block", F.floor(F.col("i") / size)).groupBy("g", "block").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(cell)).alias("leaves"))
    made = made.withColumn("level0", F.transform("leaves", lambda x: x["d"]))
    for level in range(DEPTH):
        made = made.withColumn(f"level{level + 1}", _up(F.col(f"level{level}"), _width(F.col("n"), level) > 1))
    return made.withColumn("node", F.col(f"level{DEPTH}")[0]).drop("level0", f"level{DEPTH}")


def _round(blocks: DataFrame, r: int) -> DataFrame:
    """One exchange: blocks meet those that differ in digit ``r`` alone, and each gets the parent and its siblings."""
    part = FANOUT**r
    width = _width(F.col("n_blocks"), r)
    now = blocks.withColumn("s", F.floor(F.col("block") / part)).withColumn("low", F.col("block") % part).withColumn("w", width)
    members = F.least(F.lit(part), F.col("n_blocks") - F.col("s") * part)
    beside = F.floor(F.col("s") / FANOUT) * FANOUT < F.col("s")  # an earlier, full subtree is in the run
    seats = F.when((members < part) & beside, F.sequence(F.col("low"), F.lit(part - 1).cast("long"), members)).otherwise(F.array("low"))
    sent = now.withColumn("seat", F.explode(seats)).withColumn("run", F.floor(F.col("s") / FANOUT))
    own = F.when(F.col("seat") == F.col("low"), F.struct("block", "upper"))
    cell = F.struct((F.col("s") % FANOUT).cast("int").alias("place"), "node", own.alias("own"))
    met = sent.groupBy("g", "run", "seat").agg(F.max("n_blocks").alias("n_blocks"), F.max("w").alias("w"), F.sort_array(F.collect_list(cell)).alias("cells"))
    met = met.withColumn("nodes", F.transform("cells", lambda c: c["node"]))
    met = met.withColumn("node", F.when(F.col("w") > 1, digest(F.col("nodes"))).otherwise(F.col("nodes")[0]))
    mine = met.select("g", "n_blocks", "w", "node", "nodes", F.explode(F.filter("cells", lambda c: c["own"].isNotNull())).alias("c"))
    step = F.array(F.struct(F.col("c.place").alias("place"), F.filter("nodes", lambda x, j: j != F.col("c.place")).alias("others")))
    upper = F.when(F.col("w") > 1, F.concat("c.own.upper", step)).otherwise(F.col("c.own.upper"))
    return mine.select("g", F.col("c.own.block").alias("block"), "n_blocks", "node", upper.alias("upper"))


def _uppers(blocks: DataFrame) -> DataFrame:
    """``(g, block, top, upper)``: the group's root and the steps above each block."""
    now = blocks.select("g", "block", _width(F.col("n"), DEPTH).alias("n_blocks"), "node", F.array().cast(PATH).alias("upper"))
    most, r = blocks.agg(F.max("n")).first()[0] or 0, 0
    while FANOUT ** (DEPTH + r) < most:
        now, r = _round(now, r), r + 1
    return now.select(F.col("g").alias("of"), F.col("block").alias("number"), F.col("node").alias("top"), "upper")


def _paths(blocks: DataFrame, above: Column) -> DataFrame:
    """One row for each leaf of ``blocks``: its path, with the steps ``above`` its block."""

    def path(x: Column, j: Column) -> Column:
        steps = []
        for level in range(DEPTH):
            nodes = F.transform("leaves", lambda y: y["d"]) if level == 0 else F.col(f"level{level}")
            steps.append(F.when(_width(F.col("n"), level) > 1, F.array(_step(nodes, F.floor(j / FANOUT**level)))).otherwise(F.array().cast(PATH)))
        return F.struct(x["o"].alias("o"), x["keep"].alias("keep"), x["d"].alias("d"), F.concat(*steps, above).cast(PATH).alias("path"))

    return blocks.withColumn("leaf", F.explode(F.transform("leaves", path)))


def manifest(rows: DataFrame, group_col: str = "lang", order_col: str = "doc_id", leaf_col: str = "leaf", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(group_col, order_col, *keep, leaf_col, subroot, root, path)``, one row for each row of ``rows``.

    ``leaf_col`` is a hex digest; only the named columns are read. Null is a group like others and comes first, as do null
    order values; rows of equal group and order stand by digest, and equal ones are leaves each. A lone leaf is its group's
    root, and a lone group's root the dataset's. No row: no row. Texts are hashed before anything is shuffled, so their
    length does not matter.
    """
    kept = F.struct(*keep) if keep else F.lit(None).cast("struct<none:int>")
    slim = rows.select(F.col(group_col).alias("g"), F.col(order_col).alias("o"), F.col(leaf_col).alias("d"), kept.alias("keep"))
    blocks = as_table(_blocks(_ranked(slim)), "blocks")
    uppers = as_table(_uppers(blocks), "uppers")
    roots = uppers.where("number = 0").select(F.lit(0).alias("g"), F.col("of").alias("o"), F.col("top").alias("d"), F.lit(None).cast("struct<none:int>").alias("keep"))
    top_blocks = as_table(_blocks(_ranked(roots)), "top_blocks")
    tops = _paths(top_blocks.join(_uppers(top_blocks), (F.col("g") == F.col("of")) & (F.col("block") == F.col("number"))), F.col("upper"))
    tops = as_table(tops.select(F.col("leaf.o").alias("group"), F.col("leaf.path").alias("last"), F.col("top").alias("root")), "tops")
    same = F.col("g").eqNullSafe(F.col("of")) & (F.col("block") == F.col("number"))
    whole = blocks.join(uppers, same).join(tops, F.col("g").eqNullSafe(F.col("group")))
    made = _paths(whole, F.concat("upper", "last"))
    return made.select(
        F.col("g").alias(group_col), F.col("leaf.o").alias(order_col), *[F.col("leaf.keep")[c].alias(c) for c in keep], F.col("leaf.d").alias(leaf_col),
        F.col("top").alias("subroot"), "root", F.col("leaf.path").alias("path"),
    )
