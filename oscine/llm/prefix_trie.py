"""Conversation prefix trie (operator 11): family first. The turns of a family, which are the conversations that share a base, come
together in order; each family's conversations are rebuilt and its small trie is made; the families' nodes alone are merged into
the trie of all conversations.

A turn travels as the hash of its role and text, with its number of words, so that texts aren't shuffled. A node is known by the hash of the turns
that lead to it (128 bits of BLAKE2 over 128 bits of SHA-256 each). The turns of a family are read one by one, and a trie of more
than FAMILY_NODES nodes is given out in pieces, which merge like those of different families, so that memory is bounded for a
conversation of any length; what a task must read is a family's turns in their order.

What is summed over subtrees is summed by members instead, without walking the trie: a node's tokens times its members, over a
subtree, are the members' tokens from there on, and each node is counted once with its least member, which owns a node and
with it all that is below on its own path. So a member adds, to each node that it is in, its tokens from there to its end less those that it owns,
but not less than 0. The leaves of a subtree are the members in it that own the childless node at which they end.

Rule: turns are in order of turn, null first; turns of equal number by their hash. Null role or text is empty. A conversation c is rebuilt
from the first h original turns of conversation c - c % 20 (all if fewer, none if absent; % has the sign of c) and its own turns after its
first h; h is crc32 of c in decimal, modulo 4. Rows without conv_id are in no conversation and are left out. Repeated rows are repeated turns.
An empty table has no conversation and gives no node, not even a root. Extra columns are not looked at."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.llm import common as C

FAMILY, BORROWED = 20, 4
#: Nodes of a family's trie that a task holds before it gives them out.
FAMILY_NODES = 100_000
#: Bytes of joined ids that a task holds before it gives them out.
PIECE_BYTES = 1 << 20
ROOT = bytes(16)
_NODES = "node binary, depth long, parent binary, tokens long, members array<long>, before array<long>, ends array<long>, totals array<long>"


class _Trie:
    """The nodes of one family."""

    def __init__(self) -> None:
        self.nodes: dict[bytes, tuple] = {}

    def add(self, node: bytes, depth: int, parent: bytes | None, tokens: int, member: int, before: int) -> None:
        found = self.nodes.get(node)
        if found is None:
            found = self.nodes[node] = (depth, parent, tokens, [], [], [], [])
        found[3].append(member)
        found[4].append(before)

    def end(self, node: bytes, depth: int, parent: bytes | None, tokens: int, member: int, total: int) -> None:
        found = self.nodes.get(node)
        if found is None:  # it was given out before
            found = self.nodes[node] = (depth, parent, tokens, [], [], [], [])
        found[5].append(member)
        found[6].append(total)

    def rows(self) -> list[tuple]:
        out = [(node, *values) for node, values in self.nodes.items()]
        self.nodes = {}
        return out


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tries of the families whose turns come one after the other, the base's first."""
    names = ["node", "depth", "parent", "tokens", "members", "before", "ends", "totals"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), *[pa.list_(pa.int64())] * 4]
    trie, out = _Trie(), []
    base = conv = None
    head: list[tuple[bytes, int]] = []  # the first turns of the base
    node, depth, parent, last, total, skip = ROOT, 0, None, 0, 0, 0

    def step(digest: bytes, tokens: int) -> None:
        nonlocal node, depth, parent, last, total
        parent, depth, last = node, depth + 1, tokens
        node = hashlib.blake2b(node + digest, digest_size=16).digest()
        trie.add(node, depth, parent, tokens, conv, total)
        total += tokens

    for batch in batches:
        for of, c, h, digest, tokens in zip(*(batch.column(k).to_pylist() for k in ("base", "conv_id", "h", "digest", "tokens")), strict=True):
            if c != conv or of != base:
                if conv is not None:
                    trie.end(node, depth, parent, last, conv, total)
                if of != base:
                    out += trie.rows()
                    base, head = of, []
                conv, node, depth, parent, last, total = c, ROOT, 0, None, 0, 0
                trie.add(ROOT, 0, None, 0, conv, 0)
                skip = 0 if c == of else h
                for turn in head[:skip]:
                    step(*turn)
            if c == of and len(head) < BORROWED - 1:
                head.append((digest, tokens))
            if skip:
                skip -= 1
            else:
                step(digest, tokens)
            if len(trie.nodes) >= FAMILY_NODES:
                out += trie.rows()
            if len(out) >= 8192:
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
    if conv is not None:
        trie.end(node, depth, parent, last, conv, total)
    out += trie.rows()
    if out:
        yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the same node that come one after the other as pieces of text: node, first, ids."""
    node, first, ids, size = None, 0, [], 0
    out: list[tuple] = []
    for batch in batches:
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if n != node or size >= PIECE_BYTES:
                if ids:
                    out.append((node, first, ",".join(ids)))
                node, first, ids, size = n, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if len(out) >= 1024:
            yield _pieces(out)
            out = []
    if ids:
        out.append((node, first, ",".join(ids)))
    if out:
        yield _pieces(out)


def _pieces(out: list[tuple]) -> pa.RecordBatch:
    node, first, ids = zip(*out, strict=True)
    return pa.record_batch({"node": pa.array(node, pa.binary()), "first": pa.array(first, pa.int64()), "ids": pa.array(ids, pa.string())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, which come in order."""
    node, state = None, None
    out: list[tuple] = []
    for batch in batches:
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if n == node:
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                out.append((node, state.hexdigest()))
            node, state = n, hashlib.sha256(ids.encode())
        if len(out) >= 8192:
            yield pa.record_batch({"node": pa.array([x for x, _ in out], pa.binary()), "ends_sha256": pa.array([x for _, x in out])})
            out = []
    if node is not None:
        out.append((node, state.hexdigest()))
    yield pa.record_batch({"node": pa.array([x for x, _ in out], pa.binary()), "ends_sha256": pa.array([x for _, x in out], pa.string())})


def turns(docs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every turn with its family, its hash and its words."""
    c = F.col(conv_id).cast("long")
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    known = docs.where(c.isNotNull()).select(c.alias("conv_id"), (c - c % FAMILY).alias("base"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text"))
    both = F.concat(F.length("role").cast("string"), F.lit(" "), "role", "text")
    return known.select(
        "base", "conv_id", (F.crc32(F.col("conv_id").cast("string")) % BORROWED).alias("h"), "turn",
        F.unhex(F.substring(F.sha2(both, 256), 1, 32)).alias("digest"), F.regexp_count("text", F.lit(C.WORD_PATTERN)).cast("long").alias("tokens"),
    )


def prefix_trie(docs: DataFrame, **columns: str) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    of_base = turns(docs, **columns).repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "digest")
    families = C.materialize(of_base.mapInArrow(_families, _NODES), "family-nodes")

    merged = families.where(F.size("members") > 0).groupBy("node").agg(
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("tokens").alias("tokens"),
        F.min(F.array_min("members")).alias("conv_id"), F.sum(F.size("members")).cast("long").alias("n_convs"),
    )
    merged = C.materialize(merged, "nodes")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = C.materialize(merged.join(children, "node", "left").fillna(0, ["n_children"]), "nodes")

    # what each conversation owns and where it ends
    owned = nodes.groupBy("conv_id").agg(F.sum("tokens").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    ended = families.where(F.size("ends") > 0).select("node", F.explode(F.arrays_zip("ends", "totals")).alias("e")).select("node", F.col("e.ends").alias("conv_id"), F.col("e.totals").alias("total"))
    of_conv = ended.select("conv_id", "total").join(owned, "conv_id", "left").select("conv_id", "total", F.coalesce("owned", F.lit(0)).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    members = families.select("node", F.explode(F.arrays_zip("members", "before")).alias("m")).select("node", F.col("m.members").alias("conv_id"), F.col("m.before").alias("before"))
    saved = F.greatest(F.lit(0), F.col("total") - F.col("before") - F.col("owned"))
    below = members.join(of_conv, "conv_id").groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))

    pieces = ended.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined, "node binary, first long, ids string")
    ends = pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")

    # parents with very many children are few, and the others' joins are even
    many = max(4096, nodes.count() // 16384)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    crowded = F.broadcast(parents.where(F.col("siblings") > many).drop("siblings"))  # at most 16384 rows
    near = nodes.join(crowded, "parent", "left")
    rest = near.where("parent_conv_id is null").drop("parent_conv_id").join(parents.where(F.col("siblings") <= many).drop("siblings"), "parent", "left")
    every = near.where("parent_conv_id is not null").unionByName(rest)
    every = every.join(below, "node").join(ends, "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


#: Conversations are rebuilt turn by turn, nodes are lists of turns, and subtrees are walked node by node.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))) AS crc FROM t),
k AS (SELECT conv_id, base, xor(crc, 4294967295::BIGINT) % 4 AS h FROM c),
seq AS (SELECT k.conv_id, 0 AS part, t.i, t.role, t.text FROM k JOIN t ON t.conv_id = k.base AND t.i <= k.h UNION ALL SELECT k.conv_id, 1, t.i, t.role, t.text FROM k JOIN t ON t.conv_id = k.conv_id AND t.i > k.h),
r AS (SELECT conv_id, row_number() OVER w AS depth, list(md5(role || chr(1) || text)) OVER (w ROWS UNBOUNDED PRECEDING) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens FROM seq WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
p AS (SELECT conv_id, depth, sha256(array_to_string(path, ',')) AS node, CASE WHEN depth = 1 THEN 'root' ELSE sha256(array_to_string(path[:-2], ',')) END AS parent, tokens FROM r
  UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM k),
n AS MATERIALIZED (SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, any_value(tokens) AS tokens, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM n WHERE parent IS NOT NULL GROUP BY 1),
walk(top, node) AS (SELECT node, node FROM n UNION ALL SELECT w.top, n.node FROM walk w JOIN n ON n.parent = w.node),
sub AS (SELECT w.top, sum((n.n_convs - 1) * n.tokens) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM walk w JOIN n USING (node) LEFT JOIN kids USING (node) GROUP BY 1),
lasts AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY 1),
ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS h FROM p JOIN lasts USING (conv_id, depth) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, sub.leaves AS n_leaves, sub.saved::BIGINT AS saved_tokens,
  coalesce(ends.h, sha256('')) AS ends_sha256
FROM n LEFT JOIN n up ON up.node = n.parent LEFT JOIN kids ON kids.node = n.node JOIN sub ON sub.top = n.node LEFT JOIN ends ON ends.node = n.node
"""
