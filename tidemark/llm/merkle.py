"""Merkle manifest of a table: levels built bottom-up, proofs pushed top-down, both by joins of persisted levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stage

FANOUT = 8
#: One step of a proof: digests of the run's nodes before and after the own one, end to end.
STEP = "struct<before:binary,after:binary>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text, 256)


def hexed(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value: no two rows have the same concatenation."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


@dataclass(frozen=True)
class Tree:
    """``leaves`` with their group ``g``, place ``pos`` and the group's size ``n``; ``levels[k]`` are the nodes k + 1 steps above.

    A level's row has g, pos, n (nodes of the group on this level), digest and kids (the digests of its run, end to end).
    A group whose ``n`` is 1 ends on that level.
    """

    leaves: DataFrame
    levels: list[DataFrame]

    def tops(self) -> DataFrame:
        """(g, digest) of each group's last node."""
        out = self.leaves.where("n = 1").select("g", "digest")
        for level in self.levels:
            out = out.unionByName(level.where("n = 1").select("g", "digest"))
        return out


def grow(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> Tree:
    """The tree over ``leaves`` (columns g, digest, those of ``order`` and more): each group's leaves ascend by ``order``.

    Places are found without sorting a group in one task: rows are range-partitioned and sorted, counted per partition
    and group, and numbered from the sum of the counts before. ``order`` must tell all rows apart, so that equal keys
    can't fill one range.
    """
    key = ["g", *order]
    ranged = leaves.repartitionByRange(*key).sortWithinPartitions(*key)
    ranged = stage(ranged.select("*", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)))
    counts = stage(ranged.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first")))
    # a row per range partition and group that lies in it: few rows, even of a group that spans all partitions
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("g", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy("g")).alias("n"))
    numbered = ranged.join(sums, ["g", "part"]).withColumn("pos", F.col("offset") + F.col("at") - F.col("first")).drop("at", "part", "first", "offset")
    left = counts.groupBy("g").agg(F.sum("rows").alias("n")).agg(F.max("n")).first()[0] or 0
    levels, below = [], numbered
    while left > 1:
        run = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        up = below.where("n > 1").groupBy("g", "n", F.floor(F.col("pos") / fanout).alias("up")).agg(run.alias("run"))
        kids = F.array_join(F.transform("run", lambda x: hexed(x["digest"])), "")
        up = up.select("g", F.col("up").alias("pos"), F.ceil(F.col("n") / fanout).alias("n"), F.unhex(digest(kids)).alias("digest"), F.unhex(kids).alias("kids"))
        below = stage(up)
        levels.append(below)
        left = -(-left // fanout)
    return Tree(numbered, levels)


def prove(tree: Tree, seeds: DataFrame, carried: list[str], fanout: int = FANOUT) -> DataFrame:
    """``tree.leaves`` with ``proof`` (array of steps, bottom up) and ``carried`` columns.

    ``seeds`` has one row per group: g, proof (the suffix above the group's top) and the ``carried`` columns. From the
    top level down each node joins its parent (at most ``fanout`` rows a key) and prepends its own step to what the
    parent inherited; a level's suffixes are written before the next is joined.
    """
    above = None  # the level above with its suffixes
    out = None
    for k in range(len(tree.levels), -1, -1):
        nodes = tree.levels[k - 1] if k else tree.leaves
        done = nodes.where("n = 1").join(seeds, "g")
        if above is not None:
            parents = above.select("g", F.col("pos").alias("up"), F.col("kids").alias("run"), F.col("proof").alias("suffix"), *carried)
            own = nodes.where("n > 1").withColumn("up", F.floor(F.col("pos") / fanout)).join(parents, ["g", "up"])
            at = (F.pmod("pos", F.lit(fanout)) * 32).cast("int")
            step = F.struct(F.substring("run", F.lit(1), at).alias("before"), F.substring("run", at + 33, F.lit(32 * fanout)).alias("after"))
            own = own.withColumn("proof", F.concat(F.array(step), "suffix")).drop("up", "run", "suffix")
            done = done.unionByName(own)
        out = done
        if k:
            above = stage(out)
    return out


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` (hex) and the steps of ``proof`` lead to."""
    return F.aggregate(proof, leaf, lambda h, x: digest(F.concat(hexed(x["before"]), h, hexed(x["after"]))))


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    claimed: dict[str, Column] | None = None,
    fanout: int = FANOUT,
) -> tuple[DataFrame, DataFrame]:
    """(proofs, nodes) of a manifest with one subtree per ``group_col`` and a tree over the subtrees.

    ``proofs`` has per row: the id, leaf, subroot, root, proof (steps from the leaf to the root), proof_sha256,
    folded_root (from the row as ``claimed``, a map of fields to the values to be checked, and the proof), verified.
    ``nodes`` holds every inner node (tree, level, group, pos, digest, kids), to be kept as the manifest.

    Nulls in any field have their own encoding; a null id comes before all others and a null group before all others;
    rows with equal ids ascend by leaf, equal rows each have a place of their own. Very long texts are digested where
    they are read, only digests are shuffled. An empty table gives no rows. Columns that aren't fields aren't read.
    """
    claimed = claimed or {}
    leaf = F.unhex(digest(F.concat(*[encoded(F.col(c)) for c in fields])))
    claim = F.unhex(digest(F.concat(*[encoded(claimed.get(c, F.col(c))) for c in fields])))
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = stage(docs.select(group.alias("g"), F.col(id_col).alias("id"), leaf.alias("digest"), claim.alias("claim"), F.monotonically_increasing_id().alias("row")))
    tree = grow(leaves, ["id", "digest", "row"], fanout)
    tops = stage(tree.tops())
    crown = grow(tops.select(F.lit("").alias("g"), F.col("g").alias("group"), "digest"), ["group"], fanout)
    root = crown.tops().select("g", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("proof"))
    seeds = stage(prove(crown, root, ["root"], fanout).select(F.col("group").alias("g"), F.col("digest").alias("subroot"), "root", "proof"))
    rows = prove(tree, seeds, ["root", "subroot"], fanout)
    kept = F.aggregate("proof", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["before"], x["after"]))
    rows = rows.select(
        F.col("id").alias(id_col),
        hexed(F.col("digest")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        "proof",
        digest(hexed(kept)).alias("proof_sha256"),
        folded(hexed(F.col("claim")), F.col("proof")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root")), _nodes(tree, crown)


def _nodes(tree: Tree, crown: Tree) -> DataFrame:
    """Inner nodes of both trees in one table; a group's name is null for the null group and for the tree over groups."""
    out = None
    for name, levels in (("group", tree.levels), ("root", crown.levels)):
        for k, level in enumerate(levels):
            named = F.when(F.col("g").startswith("="), F.substring("g", 2, 1 << 30))
            rows = level.select(F.lit(name).alias("tree"), F.lit(k + 1).alias("level"), named.alias("group"), "pos", hexed(F.col("digest")).alias("digest"), hexed(F.col("kids")).alias("kids"))
            out = rows if out is None else out.unionByName(rows)
    if out is None:  # no rows, or one
        return tree.leaves.sparkSession.createDataFrame([], "tree string, level int, group string, pos long, digest string, kids string")
    return out


def lowered_where(id_col: str = "doc_id", text_col: str = "text", every: int = 3) -> Column:
    """The text with A-Z lower-cased where ``every`` divides the CRC-32 of the decimal id, else as it is."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return F.when(hit, F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col(text_col).cast("string"))


def manifest_check(docs: DataFrame) -> DataFrame:
    """The digest columns of ``manifest`` with every third row's text tampered with (:func:`lowered_where`)."""
    rows, _ = manifest(docs, claimed={"text": lowered_where()})
    return rows.drop("proof")
