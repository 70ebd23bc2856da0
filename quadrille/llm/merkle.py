"""A Merkle manifest of a dataset: leaves, a tree for each language, one root over their roots, and proofs.

The trees are built bottom-up in bands of ten levels. A band's chunk holds up to 1024 consecutive nodes of one tree and
all levels above them within the band; chunks are written to the shared folder, and their tops are the nodes of the
next band. Proofs are pushed top-down through the persisted bands: a chunk joins its parent's proof, and each of its
nodes puts its own siblings before that suffix. A step of either kind moves digests, no texts.

A proof is an array from the leaf up: 'L' or 'R' and the digest of the sibling on that side, or 'S' for a node alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import shared_dir, staged

LEVELS = 10  # of a band
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(**values: Column) -> Column:
    """The digest of a row: of each field '-' if null, else its UTF-8 bytes' count, ':' and the value. values stand for
    columns of their name."""
    parts = []
    for name in FIELDS:
        text = values.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (staged; tree first among its order) with pos, the place in the order of the tree, and size, how many the
    tree has. Rows are sorted over range partitions; what lies before a partition is a sum of counts."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the last key parts rows that are equal otherwise
    ranged = rows.withColumn("last", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "last").sortWithinPartitions(*order, "last")
    ranged = staged(ranged.drop("last").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "merkle-order")
    counts = ranged.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))  # a row for each partition, and for each tree
    tree = Window.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("part").alias("_part"), F.col("tree").alias("_tree"), "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(tree).alias("size"))
    return ranged.join(starts, (F.col("part") == F.col("_part")) & (F.col("tree") == F.col("_tree"))).select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "size")


def build(nodes: DataFrame) -> list[DataFrame]:
    """Bands of the trees over nodes (tree, pos, size, digest, own), lowest first: tree, chunk, size, levels (arrays of
    digests) and own (what the lowest nodes carry)."""
    bands, depth = [], None
    while depth is None or len(bands) * LEVELS < depth:
        base = len(bands) * LEVELS
        listed = nodes.groupBy("tree", F.shiftright("pos", LEVELS).alias("chunk")).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "digest", "own"))).alias("nodes"))
        # levels that the tree still has: the bits of its last place
        left = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0) - base))
        levelled = listed.withColumn("left", left).selectExpr(
            "tree", "chunk", "size", "transform(nodes, x -> x.own) AS own",
            f"""aggregate(slice(sequence(1, {LEVELS}), 1, left), array(transform(nodes, x -> x.digest)), (done, k) -> concat(done, array(
                transform(sequence(0, (size(element_at(done, -1)) - 1) div 2), i -> sha2(concat(element_at(done, -1)[2 * i], coalesce(get(element_at(done, -1), cast(2 * i + 1 as int)), '')), 256))))) AS levels""",
        )
        bands.append(staged(levelled, "merkle-band"))
        if depth is None:
            largest = bands[0].agg(F.max("size")).first()[0] or 0
            depth = max(0, largest - 1).bit_length()
        nodes = bands[-1].select("tree", F.col("chunk").alias("pos"), "size", F.expr("element_at(levels, -1)[0]").alias("digest"), F.lit(None).cast("string").alias("own"))
    return bands


def tops(bands: list[DataFrame]) -> DataFrame:
    """tree, digest: the root of each tree."""
    return bands[-1].select("tree", F.expr("element_at(levels, -1)[0]").alias("digest"))


def push(bands: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, own, digest, proof and told of each lowest node. above: tree, proof (what follows the tree's own siblings) and told."""
    parents = above.select(F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_chunk"), F.col("proof").alias("suffix"), "told")
    for band in reversed(bands):
        below = band.join(parents, (F.col("tree") == F.col("_tree")) & (F.col("chunk") == F.col("_chunk"))).selectExpr(
            "tree", "chunk", "suffix", "told",
            """explode(transform(levels[0], (d, i) -> struct(i, own[i] AS own, d AS digest, transform(slice(levels, 1, size(levels) - 1), (level, k) ->
                CASE WHEN get(level, cast(shiftright(i, k) ^ 1 as int)) IS NULL THEN 'S' ELSE concat(if(shiftright(i, k) % 2 = 1, 'L', 'R'), level[shiftright(i, k) ^ 1]) END) AS siblings))) AS node""",
        ).select("tree", (F.shiftleft("chunk", LEVELS) + F.col("node.i")).alias("pos"), "node.own", "node.digest", F.concat("node.siblings", "suffix").alias("proof"), "told")
        parents = below.select(F.col("tree").alias("_tree"), F.col("pos").alias("_chunk"), F.col("proof").alias("suffix"), "told")
    return below.drop("pos")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    side, other = (lambda s: F.substring(s, 1, 1)), (lambda s: F.substring(s, 2, 64))
    return F.aggregate(proof, start, lambda acc, s: F.sha2(F.when(side(s) == "L", F.concat(other(s), acc)).when(side(s) == "R", F.concat(acc, other(s))).otherwise(acc), 256))


def siblings_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)


@dataclass
class Manifest:
    """Persisted levels: of the trees of languages, and of the tree over their roots."""

    bands: list[DataFrame]
    over: list[DataFrame]

    def root(self) -> str | None:
        """The digest that stands for the dataset; of an empty one None."""
        found = tops(self.over).first()
        return found["digest"] if found else None

    def proofs(self) -> DataFrame:
        """A row for each document: its doc_id, what it carries, leaf, subroot (of its language), root and proof."""
        roots = tops(self.over).select("tree", F.array().cast("array<string>").alias("proof"), F.col("digest").alias("told"))
        langs = push(self.over, roots).select(F.col("own").alias("tree"), "proof", F.struct(F.col("digest").alias("subroot"), F.col("told").alias("root")).alias("told"))
        return push(self.bands, langs).select("own.*", F.col("digest").alias("leaf"), "told.*", "proof")


def manifest(docs: DataFrame, **carried: Column) -> Manifest:
    """The manifest of whole documents (doc_id, source, lang, n_chars, text). carried: further columns that proofs have.

    Leaves of a language ascend by doc_id, a null doc_id first, equal ids by leaf; repeated rows are leaves each. Two
    consecutive nodes become one, a node left over becomes one by itself; a lone leaf is its language's root. Roots of
    languages are ordered alike, that of null first, then by their UTF-8 bytes. A null field has its own mark in the
    leaf, so null and empty texts differ. Other columns are left out. An empty table has no root and no proofs.
    """
    shared_dir(docs.sparkSession)
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(name) for name, c in carried.items()))
    leaves = staged(docs.select(F.coalesce(F.concat(F.lit("v"), F.col("lang").cast("string")), F.lit("n")).alias("tree"), leaf_of().alias("digest"), own.alias("own")).withColumn("doc_id", F.col("own.doc_id")), "merkle-leaves")
    bands = build(_placed(leaves, ["tree", "doc_id", "digest"]).drop("doc_id"))
    roots = staged(tops(bands).select(F.lit("").alias("tree"), "digest", F.col("tree").alias("own")), "merkle-roots")
    return Manifest(bands, build(_placed(roots, ["tree", "own"])))
