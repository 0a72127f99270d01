"""Merkle manifest of a dataset: one tree of leaf hashes per group of rows, and one tree over the groups' roots.

Each level is a window over runs of eight neighbours. Lag and lead columns of fixed offsets, masked by the slot of a node
and the length of its run, give its siblings, and the row of the first child hashes the parent. No group is gathered:
positions come from range partitions and their counts, and a window holds eight rows, whatever the size of a group. On
the way down every node joins the path of its parent on (tree, run), the keys its window is already dealt by.

Cases: a null field is `-`, an empty one `0:`. Groups ascend by their UTF-8 bytes, the null group first. In a group leaves
ascend by id, null ids first; leaves with one id by their hash, so repeated rows take places that cannot be told apart.
A group of one row has its leaf as root. An empty table gives an empty result. Other columns travel only inside `carried`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.topn import number_rows
from parley.session import stage, stage_counted

FAN = 8
STEP = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(*fields: Column) -> Column:
    """Hash of the fields, each as byte count, colon and value, or `-` where null."""

    def item(field: Column) -> Column:
        value = field.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(F.concat(*[item(f) for f in fields]))


def proof(path: Column) -> Column:
    """Hash of all siblings of a path, level by level and left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def _positions(rows: DataFrame) -> DataFrame:
    """Place of every leaf in its tree (from 0) and the size n of the tree."""
    order = ["doc_id", "h", "tag"]
    parts = stage(
        rows.withColumn("tag", F.monotonically_increasing_id())
        .repartitionByRange("tree", *order)
        .withColumn("part", F.spark_partition_id()),
        "merkle-leaves",
    )
    # One row per range partition and tree: at most the sum of both.
    by_part = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("part", "tree").agg(F.count("*").alias("c")).select(
        "part",
        "tree",
        F.coalesce(F.sum("c").over(by_part), F.lit(0)).alias("before"),
        F.sum("c").over(Window.partitionBy("tree")).alias("n"),
    )
    inside = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order))
    return parts.withColumn("inside", inside).join(counts, ["part", "tree"]).select(
        "tree", (F.col("before") + F.col("inside") - 1).alias("pos"), "n", "h", "doc_id", "carried"
    )


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """Add the run of a node, its slot there, and the hashes left and right of it."""
    runs = nodes.withColumns(
        {"run": F.floor(F.col("pos") / FAN).cast("long"), "slot": (F.col("pos") % FAN).cast("int")}
    ).withColumn("length", F.least(F.lit(FAN).cast("long"), F.col("n") - F.col("run") * FAN))
    window = Window.partitionBy("tree", "run").orderBy("pos")
    none = F.lit("")
    left = [F.when(F.col("slot") >= k, F.lag("h", k).over(window)).otherwise(none) for k in range(FAN - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < F.col("length"), F.lead("h", k).over(window)).otherwise(none) for k in range(1, FAN)]
    return runs.withColumns({"left": F.concat(*left), "right": F.concat(*right)}).drop("length")


def _climb(nodes: DataFrame, n_open: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of nodes in trees with more than one, and the top (tree, h, height) of every tree."""
    levels, tops = [], nodes.where("n = 1").select("tree", "h", F.lit(0).alias("height"))
    while n_open:
        levels.append(nodes.where("n > 1"))
        parents = _with_siblings(levels[-1]).where("slot = 0").select(
            "tree",
            F.col("run").alias("pos"),
            F.ceil(F.col("n") / FAN).cast("long").alias("n"),
            digest(F.concat("h", "right")).alias("h"),
        )
        nodes, n_open = stage_counted(parents, "merkle-level", F.count_if(F.col("n") > 1))
        tops = tops.unionByName(nodes.where("n = 1").select("tree", "h", F.lit(len(levels)).alias("height")))
    return levels, tops


def _descend(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` of the nodes of the lowest level with `path` and `top`; tops hold tree, height, path, top."""
    above = None
    for height in range(len(levels), 0, -1):
        ends = tops.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("run"), "path", "top")
        parents = ends if above is None else above.select("tree", F.col("pos").alias("run"), "path", "top").unionByName(ends)
        step = F.array(F.struct("left", "right"))
        above = (
            _with_siblings(levels[height - 1])
            .withColumnRenamed("h", "own")
            .join(parents.withColumnRenamed("path", "rest"), ["tree", "run"])
            .withColumnRenamed("own", "h")
            .withColumn("path", F.concat(step, F.col("rest")))
        )
    alone = nodes.where("n = 1").join(tops.where("height = 0").select("tree", "path", "top"), "tree")
    columns = [*keep, "path", "top"]
    return alone.select(*columns) if above is None else above.select(*columns).unionByName(alone.select(*columns))


def manifest(rows: DataFrame) -> DataFrame:
    """rows: doc_id, tree (string), leaf, carried. Returns doc_id, leaf, carried, subroot, root, path.

    `path` has one step of left and right siblings per level, first to the root of the row's tree, then over the trees.
    """
    # Prefixed, so that no tree has a null key and the null tree sorts first.
    key = F.coalesce(F.concat(F.lit("+"), F.col("tree")), F.lit(""))
    leaves, n_open = stage_counted(
        _positions(rows.select(key.alias("tree"), F.col("leaf").alias("h"), "doc_id", "carried")),
        "merkle-placed",
        F.count_if(F.col("n") > 1),
    )
    levels, tops = _climb(leaves, n_open)
    tops = stage(tops, "merkle-roots")
    n_trees = tops.count()
    # The trees' roots are the leaves of one more tree.
    roots = stage(
        number_rows(tops, ["tree"]).select(
            F.lit("").alias("tree"),
            (F.col("position") - 1).alias("pos"),
            F.lit(n_trees).cast("long").alias("n"),
            "h",
            F.col("tree").alias("of"),
            F.col("height").alias("below"),
        ),
        "merkle-top",
    )
    upper, summit = _climb(roots, n_trees if n_trees > 1 else 0)
    end = summit.select("tree", "height", F.array().cast(STEP).alias("path"), F.struct(F.col("h").alias("root")).alias("top"))
    placed = _descend(roots, upper, end, ["of", "below", "h"])
    ends = stage(
        placed.select(
            F.col("of").alias("tree"),
            F.col("below").alias("height"),
            "path",
            F.struct(F.col("h").alias("subroot"), F.col("top.root").alias("root")).alias("top"),
        ),
        "merkle-ends",
    )
    found = _descend(leaves, levels, ends, ["doc_id", "h", "carried"])
    return found.select("doc_id", F.col("h").alias("leaf"), "carried", "top.subroot", "top.root", "path")
