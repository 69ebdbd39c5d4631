"""Merkle manifest of a dataset: a tree of hashes for each group of rows, one above them, and proofs by coordinates.

H of several inputs is the lowercase hex SHA-256 of them one after the other; digests are inputs as hex text. Leaves of a
group stand in the order of an id; every `fan` consecutive nodes become their H, the last run with what is left, until
one node remains. These subroots, in the order of the groups, become the root in the same way.

Nodes are rows (tree, level, place, n, digest), n being the nodes of that level, so that a node's coordinates give those
of its siblings: the other places of its run, and of the runs above. A proof explodes them, joins the table of nodes,
orders and concatenates; folding puts a leaf's digest between the siblings to the left and right, level by level. Leaves
of one run share all of their proof but the run itself, so coordinates above it are looked up once for each run.

A group with a third of all rows is dealt over many tasks; no task gathers more than `fan` digests of a level at once,
or one proof. Only built-in functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .ordered import ranked

FAN = 16
SALT = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as an input of H: '-' if null, else its UTF-8 byte count, ':' and the value."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def levels(n: int, fan: int = FAN) -> int:
    """How often n nodes are folded until one remains."""
    out = 0
    while n > 1:
        n, out = -(-n // fan), out + 1
    return out


def nodes(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The levels of all trees from leaves (tree, place, n, digest): the same columns, level 0 first, to the last node of the greatest tree.

    Places of a tree are 0, 1, 2 ... without gaps, n is how many nodes the tree has there, tree isn't null. A tree ends at
    the level where n is 1. Each level above the leaves is a written table; give written leaves. No leaves give one empty level.
    """
    out = [leaves.select("tree", F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"), "digest")]
    most = out[0].agg(F.max("n")).first()[0] or 0
    for _ in range(levels(most, fan)):
        runs = out[-1].where("n > 1").groupBy("tree", F.floor(F.col("place") / fan).alias("place"), F.ceil(F.col("n") / fan).alias("n"))
        out.append(written(runs.agg(F.sha2(joined(in_order(F.col("place"), F.col("digest"))).cast("binary"), 256).alias("digest")), "nodes"))
    return out


def in_order(place: Column, digest: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), digest.alias("d")))), lambda x: x["d"])


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def run_of(place: Column, fan: int) -> Column:
    return F.floor(place / fan).cast("long")


def split(run: Column, place: Column, fan: int) -> Column:
    """The siblings of a place in its run: those to the left, one after the other, and those to the right."""
    at = F.pmod(place, F.lit(fan)).cast("int")
    return F.struct(joined(F.slice(run, F.lit(1), at)).alias("left"), joined(F.slice(run, at + 2, F.lit(fan))).alias("right"))


def proofs(levels_of: list[DataFrame], asked: DataFrame, above: DataFrame, fan: int = FAN) -> DataFrame:
    """Adds path, an array of (left, right) from the leaf's run to the root, to asked, whose rows have the coordinates (tree, place, n) of leaves.

    above has (tree, path, ...) for each tree: how it goes on from the last node of the tree. Its other columns are added.
    The runs wanted are exploded to the coordinates of their nodes and joined with these; what leads on from a run is
    looked up once for the run, and never more than fan rows have the same key.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    above = above.select("tree", F.struct(F.col("path").alias("path"), *more).alias("_x_top"))
    wanted = [written(asked.where("n > 1").select("tree", run_of(F.col("place"), fan).alias("run"), "n").distinct(), "wanted")]
    while len(wanted) < len(levels_of) - 1:
        last = wanted[-1].where(F.col("n") > fan)
        wanted.append(last.select("tree", run_of(F.col("run"), fan).alias("run"), F.ceil(F.col("n") / fan).alias("n")).distinct())
    up = None
    for level in reversed(range(len(levels_of) - 1)):
        first = F.col("run") * fan
        coordinates = wanted[level].select("tree", "run", "n", F.explode(F.sequence(first, F.least(first + fan - 1, F.col("n") - 1))).alias("place"))
        found = coordinates.join(levels_of[level].select("tree", "place", "digest"), ["tree", "place"])
        runs = found.groupBy("tree", "run", "n").agg(in_order(F.col("place"), F.col("digest")).alias("_x_run"))
        # One run of a tree has all its nodes at the last level: there the tree's own way up begins.
        last = runs.where(F.col("n") <= fan).join(above, "tree")
        if up is not None:
            between = runs.where(F.col("n") > fan).withColumn("_x_next", run_of(F.col("run"), fan)).join(up.select("tree", F.col("run").alias("_x_next"), F.col("_x_run").alias("_x_over"), F.col("_x_top").alias("_x_before")), ["tree", "_x_next"])
            led = F.struct(F.concat(F.array(split(F.col("_x_over"), F.col("run"), fan)), F.col("_x_before.path")).alias("path"), *[F.col(f"_x_before.{c}").alias(c) for c in more])
            last = last.unionByName(between.withColumn("_x_top", led).select(last.columns))
        up = last
    alone = asked.where("n = 1").join(above, "tree").select(*[F.col(f"`{c}`") for c in asked.columns], F.col("_x_top.path").alias("path"), *[F.col(f"_x_top.{c}").alias(c) for c in more])
    if up is None:
        return alone
    many = asked.where("n > 1").withColumn("run", run_of(F.col("place"), fan)).join(up.drop("n"), ["tree", "run"])
    path = F.concat(F.array(split(F.col("_x_run"), F.col("place"), fan)), F.col("_x_top.path"))
    return alone.unionByName(many.select(*[F.col(f"`{c}`") for c in asked.columns], path.alias("path"), *[F.col(f"_x_top.{c}").alias(c) for c in more]))


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to by a path."""
    return F.aggregate(path, leaf_digest, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]).cast("binary"), 256))


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds place and n to leaves (tree, ...): the place in the tree in this order, and how many leaves it has."""
    leaves = ranked(written(leaves.withColumn("_x_row", F.monotonically_increasing_id()), "leaves"), ["tree", *order, "_x_row"], ["tree"], "place").drop("_x_row")
    # The sizes go to the rows of a tree by SALT keys, so that a tree with a third of all rows isn't one task's.
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n")).withColumn("_x_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return leaves.withColumn("_x_salt", F.pmod("place", F.lit(SALT)).cast("int")).join(sizes, ["tree", "_x_salt"]).drop("_x_salt")


def manifest(leaves: DataFrame, order: list[str], fan: int = FAN) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(levels, placed leaves, trees) of leaves (tree, digest, ...).

    trees has (tree, subroot, root, path): the last node of each tree, and its way to the root above all trees, which
    stand in the order of their names.
    """
    at = written(placed(leaves, order), "leaves")
    levels_of = nodes(at, fan)
    ends = reduce(DataFrame.unionByName, [x.where("n = 1") for x in levels_of])
    tops = placed(ends.select(F.lit("").alias("tree"), F.col("tree").alias("_x_name"), "digest"), ["_x_name"])
    tops = written(tops, "subroots")
    over = nodes(tops, fan)
    root = reduce(DataFrame.unionByName, [x.where("n = 1") for x in over]).select("tree", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    trees = proofs(over, tops, root, fan).select(F.col("_x_name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return levels_of, at, written(trees, "trees")


def op13_merkle(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of the contract, with source, place and n.

    A null source is a tree of its own before all others, '' another. Rows of one doc_id stand by their leaves; equal rows
    are leaves of their own, next to each other. A null doc_id stands first and isn't tampered with. A tampered text
    without letters A-Z keeps its leaf and is verified. No rows give no rows. Other columns are left out.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    values = lambda text: [text if c == "text" else F.col(c) for c in FIELDS]
    changed = F.when(hit & (lowered(F.col("text")) != F.col("text")), leaf(*values(lowered(F.col("text")))))
    # '=' before the name leaves the order of names by bytes as it is and puts null before all.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    leaves = docs.select("doc_id", "source", tree.alias("tree"), leaf(*values(F.col("text"))).alias("digest"), changed.alias("changed"))
    levels_of, at, trees = manifest(leaves, ["doc_id", "digest"], fan)
    found = proofs(levels_of, at, trees, fan)
    again = folded(F.coalesce("changed", "digest"), F.col("path"))
    proof = F.sha2(joined(F.transform("path", lambda x: F.concat(x["left"], x["right"]))).cast("binary"), 256)
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), again.alias("folded_root"), "source", F.col("place"), "n")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "source", "place", "n")
