"""Trie of the prefixes of conversations, merged family first.

Conversations whose ids have the same base are a family and share openings. The turns of a family meet once, in a cogroup
of the opening turns of its base with the turns of its own; there each conversation is rebuilt and the family's small
trie is made, in which each of its nodes stands once with its members. Only these combined nodes are shuffled on and
merged by their keys.

Turns are digests of 16 bytes, made by built-in functions before the cogroup, and the key of a node is a digest of its
parent's key and its turn. A family emits one row for each of its distinct rebuilt conversations: the keys from the
root on, by which all such rows are sorted, and the nodes that no earlier row of the family has. In that order the rows
of any subtree stand together, so that a sum over a subtree is a difference of two running sums, however deep the trie
is and however many rows a node has. Nothing goes level by level.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .ordered import ranked
from .sharding import before

BASE, SHARED = 20, 4
KEY = 16
SALT = 64
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of family paths in a bucket of the running sums, and ids in a piece of the digest of ends.
ROWS, IDS = 1000, 1 << 14

NODE = "struct<key:binary,parent:binary,depth:int,conv_id:bigint,n:bigint,rows:bigint,words:bigint>"
PATHS = f"base bigint, path binary, ends array<bigint>, nodes array<{NODE}>"
ARROW_NODE = pa.struct([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), *[(c, pa.int64()) for c in ("conv_id", "n", "rows", "words")]])
ARROW_PATHS = pa.schema([("base", pa.int64()), ("path", pa.binary()), ("ends", pa.list_(pa.int64())), ("nodes", pa.list_(ARROW_NODE))])


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, digest, words): the digest of a role and a text stands for both; null ones are empty."""
    role, said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    # The length of the role keeps ('a', 'bc') and ('ab', 'c') apart.
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, said)
    digest = F.unhex(F.substring(F.sha2(both.cast("binary"), 256), 1, 2 * KEY))
    rows = conversations.where(F.col(f"`{conv}`").isNotNull())
    return rows.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"))


def shared_turns(conv: Column) -> Column:
    """How many opening turns a conversation takes from its base."""
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("int")


def family_trie(heads: list[tuple[bytes, int]], own: dict[int, list[tuple[bytes, int]]], shared: dict[int, int]) -> list[tuple[bytes, list[int], list[dict]]]:
    """(path, ends, nodes) of each distinct rebuilt conversation of a family, in the order of the paths.

    heads: opening turns (digest, words) of the base conversation; own: those of each conversation. nodes are those
    that no earlier path has, from the upper ones on, with the least member, the members and the paths below each.
    """
    rebuilt: dict[bytes, list[int]] = {}
    words: dict[bytes, int] = {b"": 0}
    trie: dict[tuple[bytes, bytes], bytes] = {}
    for conv in sorted(own):
        h = shared[conv]
        path, key = [], b""
        for digest, n in [*heads[:h], *own[conv][h:]]:
            if (key, digest) not in trie:
                trie[key, digest] = hashlib.sha256(key + digest).digest()[:KEY]
            key = trie[key, digest]
            words[key] = n
            path.append(key)
        rebuilt.setdefault(b"".join(path), []).append(conv)
    members: dict[bytes, list[int]] = {}
    for path, ends in rebuilt.items():
        for at in range(0, len(path) + 1, KEY):
            node = members.setdefault(path[at - KEY : at] if at else b"", [ends[0], 0, 0])
            node[0], node[1], node[2] = min(node[0], ends[0]), node[1] + len(ends), node[2] + 1
    out, done = [], set()
    for path in sorted(rebuilt):
        nodes = []
        for at in range(0, len(path) + 1, KEY):
            key = path[at - KEY : at] if at else b""
            if key not in done:
                done.add(key)
                parent = None if not at else path[at - 2 * KEY : at - KEY] if at > KEY else b""
                least, n, rows = members[key]
                nodes.append({"key": key, "parent": parent, "depth": at // KEY, "conv_id": least, "n": n, "rows": rows, "words": words[key]})
        out.append((path, rebuilt[path], nodes))
    return out


def families(rows: DataFrame) -> DataFrame:
    """The combined nodes of all families (PATHS) from turns()."""
    own = rows.withColumns({"base": F.col("conv_id") - F.col("conv_id") % BASE, "shared": shared_turns(F.col("conv_id"))})
    # Of a base only the turns that others can share are wanted, the first of them in order.
    line = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    heads = rows.where(F.col("conv_id") % BASE == 0).withColumn("place", F.row_number().over(line)).where(F.col("place") < SHARED)
    heads = heads.select(F.col("conv_id").alias("base"), "place", "digest", "words")

    def joined(head: pa.Table, of: pa.Table) -> pa.Table:
        head = head.sort_by("place")
        opening = list(zip(head.column("digest").to_pylist(), head.column("words").to_pylist()))
        turns_of: dict[int, list] = {}
        shared = {}
        for conv, turn, digest, n, h in zip(*[of.column(c).to_pylist() for c in ("conv_id", "turn", "digest", "words", "shared")]):
            turns_of.setdefault(conv, []).append(((turn is not None, turn), digest, n))
            shared[conv] = h
        ordered = {c: [(d, n) for _, d, n in sorted(t, key=lambda x: (x[0][0], x[0][1] if x[0][0] else 0, x[1]))] for c, t in turns_of.items()}
        found = family_trie(opening, ordered, shared)
        base = of.column("base")[0].as_py() if len(of) else None
        return pa.Table.from_pylist([{"base": base, "path": path, "ends": ends, "nodes": nodes} for path, ends, nodes in found], ARROW_PATHS)

    return heads.groupBy("base").cogroup(own.groupBy("base")).applyInArrow(joined, PATHS)


def ends_of(paths: DataFrame) -> DataFrame:
    """(key, ends_sha256): the SHA-256 of the ascending ids, comma-joined, of the conversations that end at a node.

    Ids are joined to pieces by ranges of ids, in many tasks; the digest then runs over the pieces of a node in order,
    one in memory at a time: for a node with a third of all conversations one row for some thousands of them.
    """
    rows = paths.select("key", "base", "ends").withColumn("piece", F.expr(f"base div {IDS}"))
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("base", "ends"))), lambda x: F.array_sort(x["ends"])))
    pieces = rows.groupBy("key", "piece").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("said"))

    def digests(batches):
        at, sha = None, None
        for batch in batches:
            keys, said, found = batch.column("key").to_pylist(), batch.column("said").to_pylist(), []
            for key, text in zip(keys, said):
                if key != at:
                    if at is not None:
                        found.append((at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256(text.encode())
                else:
                    sha.update(b",")
                    sha.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([d for _, d in found], pa.string())], names=["key", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "said").mapInArrow(digests, "key binary, ends_sha256 string")


def merged(paths: DataFrame) -> DataFrame:
    """The nodes of the whole trie, once each, from ranked family paths: (key, parent, depth, conv_id, n_convs, rows, words, first).

    The rows of a subtree are those from `first` on, `rows` many.
    """
    nodes = paths.select(F.explode("nodes").alias("x"), "rank").select("x.*", "rank")
    return nodes.groupBy("key").agg(
        F.min("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
        F.sum("rows").alias("rows"), F.max("words").alias("words"), F.min("rank").alias("first"),
    )


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds n_children and parent_conv_id to written nodes. A node with most others as children has these dealt by SALT keys."""
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int"))
    asked = nodes.where("parent IS NOT NULL").groupBy("parent", "salt").agg(F.count("*").alias("n"))
    children = asked.groupBy(F.col("parent").alias("key")).agg(F.sum("n").alias("n_children"))
    found = asked.join(nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent").drop("n")
    return nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).join(found, ["parent", "salt"], "left").drop("salt")


def subtree_sums(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds the sum of each value over the subtree of a node, for nodes with first, rows and depth.

    Nodes in the order of (first, depth) are the trie from top to bottom, left to right: a sum is the running sum where
    the rows of the subtree end, less that before the node. Another node begins wherever one ends, but at the very end.
    """
    at = nodes.withColumns({f"_x_{k}": v for k, v in values.items()}).withColumn("_x_bucket", F.expr(f"first div {ROWS}"))
    line = Window.partitionBy("_x_bucket").orderBy("first", "depth").rowsBetween(Window.unboundedPreceding, -1)
    upto = at.withColumns({f"_x_to_{k}": F.coalesce(F.sum(f"_x_{k}").over(line), F.lit(0)) for k in values})
    for k in values:
        upto = upto.join(before(at, [], "_x_bucket", f"_x_{k}"), "_x_bucket").withColumn(f"_x_to_{k}", F.col(f"_x_to_{k}") + F.col("_x_before")).drop("_x_before")
    upto = written(upto.drop("_x_bucket"), "running")
    begin = upto.groupBy(F.col("first").alias("_x_end")).agg(*[F.min(f"_x_to_{k}").alias(f"_x_at_{k}") for k in values])
    end = upto.agg(F.max(F.col("first") + F.col("rows")).alias("_x_end"), *[F.sum(f"_x_{k}").alias(f"_x_at_{k}") for k in values])
    sums = {k: (F.col(f"_x_at_{k}") - F.col(f"_x_to_{k}")).cast("long") for k in values}
    return upto.withColumn("_x_end", F.col("first") + F.col("rows")).join(begin.unionByName(end), "_x_end").select(*nodes.columns, *[v.alias(k) for k, v in sums.items()])


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_words, ends_sha256) of each node.

    Rows without a conv_id are left out; null roles and texts are empty. Turns of one number stand by their digests,
    equal rows are turns of their own, a null turn comes first. A conversation is rebuilt from its base, whose turns may
    be none. No rows give no nodes, not even a root. Other columns are left out.
    """
    found = written(families(turns(conversations, conv, turn, role, text)), "families")
    paths = written(ranked(found, ["path", "base"]).select("base", "rank", F.substring("path", -KEY, KEY).alias("key"), "ends", "nodes"), "paths")
    nodes = with_parents(written(merged(paths), "nodes"))
    sums = subtree_sums(nodes, {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_words": (F.col("n_convs") - 1) * F.col("words")})
    return sums.join(ends_of(paths), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))).drop("first", "rows", "words")


def op11_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of the contract for each node of trie()."""
    long = lambda c: F.col(c).cast("long").alias(c)
    return trie(conversations).select("conv_id", long("depth"), "parent_conv_id", long("n_convs"), long("n_children"), "n_leaves", F.col("saved_words").alias("saved_tokens"), "ends_sha256")
