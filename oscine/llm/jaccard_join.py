"""N-gram Jaccard join (operator 6): chosen paths. Sets of five-word shingles are split recursively: at each node of a tree a
few coordinates of the sets' MinHash sketches are chosen at random, and the sets that agree on one go down together. Small
nodes are compared by brute force, in large ones pivots absorb their like, and the rest is split until it is small. Trees are
built until the target recall at the depth that the sets have reached.

What the nodes find are candidates; each connected group of candidates is then verified exactly, set against set. Only
verified links count.

Shingles are windows of five words [^\\x20\\x09-\\x0D]+, unchanged; a text of one to four words has one shingle of all of them.
Null and empty texts have none and count as copies of each other. Copies, which are texts with equal sets, form one
representative, so that no pairs of copies are made; a row's links are the other rows at similarity 0.8 or more, copies
included. A class is what links connect, and its id is the least doc_id in it. Each row of the input gives one row; an empty
table gives none; extra columns are not looked at."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.llm import common as C
from oscine.llm.components import components

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
SKETCH = 64
SMALL_NODE, PLANNED = 512, 2
GROUP_SETS, GROUP_SHINGLES = 2048, 400_000
NODE_PAIRS, VAIN_PIVOTS = 1 << 24, 4
PARTITION_BYTES, PARTITION_ROWS = 16 << 20, 50_000
#: Sets, the first by a hash, among which pivots of very large groups are looked for; how many of them such a group has at least.
SAMPLE, SAMPLE_LIKE = 4096, 16
_MASK48 = C.U64((1 << 48) - 1)
#: What a row is that a node gives: a candidate edge, a set that goes down, a set of a node at a task's border.
_EDGE, _DOWN, _BORDER = 0, 1, 2
_FOUND = "kind byte, node long, key long, other long, short binary"


def _apart(levels: int, similarity: float = SIMILARITY) -> float:
    """The probability that a pair at the threshold parts within the levels of a tree: at each node the number of chosen
    coordinates on which such a pair agrees is about Poisson with mean 1; a root that chooses none is drawn again."""
    meet = 1.0
    for _ in range(levels):
        meet = 1 - math.exp(-meet)
    return 1 - min(1.0, meet / (1 - math.exp(-1 / similarity)))


def runs_for(recall: float, depth: int) -> int:
    """Trees after which a pair at the threshold has met in one at least with the given probability, if its nodes are small
    after depth levels."""
    return math.ceil(math.log(1 - recall) / math.log(_apart(depth))) + 1


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 48 bits for the distinct shingles of each text, in order, and where each text's begin."""
    starts, ends, first = C.words(buffer, offsets)
    owner_all, hashes = C.owners(first), C.word_hashes(buffer, starts, ends)
    owner = owner_all
    grams = C.gram_hashes(hashes, size)
    at = np.flatnonzero(owner[: len(grams)] == owner[size - 1 :]) if len(grams) else np.zeros(0, np.int64)
    grams, owner = grams[at], owner[at]
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    place = (np.arange(len(hashes)) - first[owner_all]).astype(C.U64)
    mixed = np.append(C.mix(hashes + place), C.U64(0))
    whole = np.bitwise_xor.reduceat(mixed, np.stack([first[short], first[short + 1]], 1).ravel())[::2] if len(short) else np.zeros(0, C.U64)
    whole = C.mix(counts[short].astype(C.U64) + C.U64(977) + whole)
    grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    out, begins = [], [0]
    for lo in range(0, len(offsets) - 1, 1 << 15):  # the text's number takes the upper 16 bits of a key
        part = (owner >= lo) & (owner < lo + (1 << 15))
        keys = np.unique((owner[part] - lo).astype(C.U64) << C.U64(48) | grams[part] >> C.U64(16))
        out.append(keys & _MASK48)
        count = np.bincount((keys >> C.U64(48)).astype(np.int64), minlength=min(1 << 15, len(offsets) - 1 - lo))
        begins += (begins[-1] + np.cumsum(count)).tolist()
    return np.concatenate(out) if out else np.zeros(0, C.U64), np.array(begins)


_FACTORS = C.mix(np.arange(1, SKETCH + 1, dtype=C.U64) * C.U64(0x9E3779B97F4A7C15)) | C.U64(1)


def sketches(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """MinHash sketches of the sets that aren't empty, as rows of 32-bit numbers; those of empty sets stay 0."""
    out = np.zeros((len(begins) - 1, SKETCH), np.uint32)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        spread = C.mix(ids + C.U64(1))
        for k in range(SKETCH):
            out[full, k] = np.minimum.reduceat(((spread * _FACTORS[k]) >> C.U64(32)).astype(np.uint32), begins[full])
    return out


def shortened(sketch: np.ndarray) -> np.ndarray:
    """The lowest four bits of each number of the sketches, 16 in a word."""
    low = (sketch & 15).astype(np.uint8)
    return np.ascontiguousarray(low[:, ::2] << 4 | low[:, 1::2]).view(C.U64)


_LOW_BITS = C.U64(0x1111111111111111)


def equal_numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """On how many of the SKETCH numbers short sketches, given as words of 64 bits, agree."""
    differ = a ^ b
    differ |= differ >> C.U64(1)
    differ |= differ >> C.U64(2)
    differ &= _LOW_BITS
    return SKETCH - np.bitwise_count(differ).sum(-1, dtype=np.int16)


def limits(similarity: float) -> tuple[int, int, int]:
    """Numbers on which short sketches must agree: to be candidates, to be absorbed by a pivot, to be in a pivot's ring. A pair
    at the threshold is a candidate but for chance beyond four deviations. What agrees with an absorbed set as candidates do is
    in the ring, without exception, as the numbers that differ obey the triangle inequality."""
    agree = similarity + (1 - similarity) / 16
    least = math.ceil(SKETCH * agree - 4 * math.sqrt(SKETCH * agree * (1 - agree)))
    absorbed = math.floor(SKETCH * agree)
    return least, absorbed, absorbed + least - SKETCH


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional array as binary values."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(len(column), width)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buffer, offsets in C.text_slices(batch.column("text")):
            ids, begins = shingle_sets(buffer, offsets)
            sums = np.concatenate([np.zeros(1, C.U64), np.cumsum(C.mix(ids * C.U64(3) + C.U64(7)), dtype=C.U64)])
            size = np.diff(begins)
            key = C.mix((sums[begins[1:]] - sums[begins[:-1]]) + size.astype(C.U64)).view(np.int64)
            sketch = sketches(ids, begins)
            own = {k: batch.column(k).slice(lo, hi - lo) for k in ("doc_id", "row", "own")}
            yield pa.RecordBatch.from_pydict(own | {"key": pa.array(key), "size": pa.array(size), "sketch": _binary(sketch), "short": _binary(shortened(sketch))})


def _chosen(nodes: np.ndarray, values: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and nodes of the next level: each coordinate is chosen at a node with probability 1 / (similarity * SKETCH)."""
    limit = C.U64(int((1 << 64) / (similarity * SKETCH)))
    row, child = [], []
    for k in range(SKETCH):
        at = np.flatnonzero(C.mix(nodes + C.U64(k * 2654435761 + 1)) < limit)
        row.append(at)
        child.append(C.mix(C.mix(nodes[at] ^ C.U64(0x5851F42D4C957F2D)) + (C.U64(k << 40) | values[at, k].astype(C.U64))))
    return np.concatenate(row), np.concatenate(child)


def _short_of(column: pa.Array) -> np.ndarray:
    return _rows(column, C.U64, SKETCH // 16)


def _first_level(runs: range, similarity: float):
    """Nodes of the second level of each tree, of key, sketch, short."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values, short = batch.column(0).to_numpy(), _rows(batch.column(1), np.uint32, SKETCH), _short_of(batch.column(2))
            for run in runs:
                root, n = C.mix(np.array([run + 1], C.U64)), 0
                while not n:  # a tree whose root chose nothing would find nothing
                    row, child = _chosen(np.repeat(root, len(keys)), values, similarity)
                    n, root = len(row) or not len(keys), C.mix(root)
                # two levels at once: sets that share a common passage, and little else, mostly part at the second
                again, child = _chosen(child, values[row], similarity)
                row = row[again]
                yield pa.RecordBatch.from_pydict({"node": pa.array(child.view(np.int64)), "key": pa.array(keys[row]), "short": _binary(short[row])})

    return split


def _next_level(similarity: float):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = batch.column(0).to_numpy().view(C.U64), batch.column(1).to_numpy()
            row, child = _chosen(nodes, _rows(batch.column(2), np.uint32, SKETCH), similarity)
            yield pa.RecordBatch.from_pydict({"node": pa.array(child.view(np.int64)), "key": pa.array(keys[row]), "short": _binary(_short_of(batch.column(3))[row])})

    return split


def _whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by their first columns, and where the groups begin and end."""
    rest: pa.Table | None = None

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in range(n_keys):
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.concatenate([np.flatnonzero(new), [table.num_rows]])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        if not table.num_rows:
            continue
        edges = bounds(table)
        if len(edges) > 2:
            yield table.slice(0, edges[-2]), edges[:-1]
        rest = table.slice(edges[-2])
    if rest is not None and rest.num_rows:
        yield rest, bounds(rest)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that each of n members is connected to by the pairs a, b."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def _found(kind: int, node: np.ndarray, key: np.ndarray, other: np.ndarray | None = None, short: pa.Array | None = None) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_pydict({
        "kind": pa.array(np.full(n, kind, np.int8)), "node": pa.array(node), "key": pa.array(key),
        "other": pa.nulls(n, pa.int64()) if other is None else pa.array(other), "short": pa.nulls(n, pa.binary()) if short is None else short,
    })


def _small_nodes(keys: np.ndarray, short: np.ndarray, lo: np.ndarray, size: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect the sets that are candidates within each of some small nodes, given by first row and size."""
    done, work = 0, np.cumsum(size * (size - 1) // 2)
    while done < len(lo):
        until = max(done + 1, int(np.searchsorted(work, (work[done - 1] if done else 0) + (1 << 17), "right")))
        rows = np.repeat(lo[done:until], size[done:until]) + _inner(size[done:until])
        later = np.repeat(size[done:until], size[done:until]) - _inner(size[done:until]) - 1  # rows after each in its node
        a = np.repeat(np.arange(len(rows)), later)
        b = a + 1 + _inner(later)
        alike = equal_numbers(short[rows[a]], short[rows[b]]) >= least
        root = _roots(len(rows), a[alike], b[alike])
        far = np.flatnonzero(root != np.arange(len(rows)))
        yield keys[rows[far]], keys[rows[root[far]]]
        done = until


def _inner(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _large_node(keys: np.ndarray, short: np.ndarray, small: int, similarity: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Edges within a large node, and the rows of the sets that go down. Pivots absorb what is like them; what may be like an
    absorbed set is compared with all that the pivot absorbed, or joined to the pivot if that absorbed most of the node."""
    least, absorb, ring = limits(similarity)
    rest, edges, vain = np.arange(len(keys)), [], 0
    while len(rest) > small and vain < VAIN_PIVOTS:
        agree = equal_numbers(short[rest[vain]], short[rest])
        own, around = rest[agree >= absorb], rest[(agree >= ring) & (agree < absorb)]
        if 2 * len(own) >= len(rest):
            edges.append((np.append(keys[own[1:]], keys[around]), np.repeat(keys[own[0]], len(own) - 1 + len(around))))
        elif 32 * len(own) >= len(rest) and len(own) * len(around) <= NODE_PAIRS:
            edges.append((keys[own[1:]], np.repeat(keys[own[0]], len(own) - 1)))
            step = max(1, (1 << 17) // len(own))
            for lo in range(0, len(around), step):
                part = around[lo : lo + step]
                alike = equal_numbers(short[part][:, None], short[own][None]) >= least
                some = np.flatnonzero(alike.any(1))
                edges.append((keys[part[some]], np.repeat(keys[own[0]], len(some))))
        else:  # what isn't absorbed goes down in the end, so that nothing is missed
            vain += 1
            continue
        rest, vain = rest[agree < absorb], 0
    if len(rest) <= small:
        edges += _small_nodes(keys[rest], short[rest], np.array([0]), np.array([len(rest)]), least)
        rest = rest[:0]
    return edges, rest


def _at_nodes(similarity: float, small: int, whole: bool):
    """Rows node, key, short in order of node to candidate edges and sets that go down. whole: no node is in two tasks; else a
    task's first and last node are given back."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = limits(similarity)[0]
        ahead: tuple[pa.Table, np.ndarray] | None = None
        begun = whole
        for table, edges in chain(_whole_groups(batches, 1), [(None, None)]):
            if ahead is not None:
                own, bounds = ahead
                nodes, keys, short = own.column(0).to_numpy(), own.column(1).to_numpy(), _short_of(own.column(2))
                lo, size = bounds[:-1], np.diff(bounds)
                border = np.zeros(len(lo), bool)
                border[0], border[-1] = not begun, table is None and not whole or border[-1]
                begun = True
                for k in np.flatnonzero(border):
                    yield _found(_BORDER, nodes[lo[k] : bounds[k + 1]], keys[lo[k] : bounds[k + 1]], None, _binary(short[lo[k] : bounds[k + 1]]))
                met = (size > 1) & (size <= small) & ~border
                for a, b in _small_nodes(keys, short, lo[met], size[met], least):
                    yield _found(_EDGE, np.zeros(len(a), np.int64), a, b)
                for k in np.flatnonzero((size > small) & ~border):
                    rows = slice(lo[k], bounds[k + 1])
                    found, down = _large_node(keys[rows], short[rows], small, similarity)
                    for a, b in found:
                        yield _found(_EDGE, np.zeros(len(a), np.int64), a, b)
                    yield _found(_DOWN, nodes[rows][down], keys[rows][down])
            ahead = (table, edges) if table is not None else None

    return meet


def _against_pivots(shared, similarity: float):
    """Rows of border nodes: those of small nodes are given back, the others meet their node's pivot."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        _, absorb, ring = limits(similarity)
        for batch in batches:
            nodes, keys, short = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _short_of(batch.column(2))
            at = np.searchsorted(pivots["node"], nodes)
            large, absorbing = pivots["large"][at], pivots["absorbing"][at]
            yield _found(_BORDER, nodes[~large], keys[~large], None, _binary(short[~large]))
            agree = equal_numbers(short, pivots["short"][at])
            near = absorbing & (agree >= ring) & (keys != pivots["key"][at])
            yield _found(_EDGE, np.zeros(near.sum(), np.int64), keys[near], pivots["key"][at][near])
            down = large & ~(absorbing & (agree >= absorb))
            yield _found(_DOWN, nodes[down], keys[down])

    return meet


def _absorbed(shared, similarity: float):
    """How many rows of each border node its pivot would absorb, summed up by batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            at = np.searchsorted(pivots["node"], batch.column(0).to_numpy())
            agree = equal_numbers(_short_of(batch.column(2)), pivots["short"][at])
            seen, which = np.unique(at, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"node": pa.array(pivots["node"][seen]), "n": pa.array(np.bincount(which, agree >= limits(similarity)[1], len(seen)).astype(np.int64))})

    return count


def _border_nodes(border: DataFrame, similarity: float, small: int) -> list[DataFrame]:
    """Rows of the nodes that stood first or last in a task. At most two such nodes a task exist, so that the driver holds two
    short records for each task, whatever the rows."""
    spark = border.sparkSession
    rows = border.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("key", "short")).alias("pivot")).orderBy("node").collect()
    if not rows:
        return []
    pivots = {
        "node": np.array([r["node"] for r in rows], np.int64), "key": np.array([r["pivot"]["key"] for r in rows], np.int64),
        "short": np.frombuffer(b"".join(bytes(r["pivot"]["short"]) for r in rows), C.U64).reshape(len(rows), SKETCH // 16),
        "large": np.array([r["n"] > small for r in rows]), "absorbing": np.zeros(len(rows), bool),
    }
    if pivots["large"].any():
        counts = border.select("node", "key", "short").mapInArrow(_absorbed(spark.sparkContext.broadcast(pivots), similarity), "node long, n long")
        absorbed = dict(counts.groupBy("node").agg(F.sum("n")).collect())
        pivots["absorbing"] = pivots["large"] & np.array([2 * absorbed.get(r["node"], 0) >= r["n"] for r in rows])
    shared = spark.sparkContext.broadcast(pivots)
    met = C.materialize(border.select("node", "key", "short").mapInArrow(_against_pivots(shared, similarity), _FOUND), "border-nodes")
    rest = met.where(F.col("kind") == _BORDER).select("node", "key", "short")
    rest = rest.repartition("node").sortWithinPartitions("node").mapInArrow(_at_nodes(similarity, small, True), _FOUND)
    return [met, C.materialize(rest, "border-rest")]


def _met(sets: DataFrame, runs: range, similarity: float, small: int, planned: int, partitions: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Edges that connect the sets which the trees of the given numbers bring together, and the keys of the sets in nodes that
    were split more often than planned, if any were.

    The members of a level's nodes are sorted by node over all tasks, so that a node of any size is spread evenly and most are
    whole in one task, where they are met in one pass; a level of at most PARTITION_ROWS members is one task. Nodes are split
    until they are small."""
    nodes = sets.select("key", "sketch", "short").mapInArrow(_first_level(runs, similarity), "node long, key long, short binary")
    edges, deeper, level = [], None, 2
    while True:
        whole = partitions == 1
        ordered = nodes.repartition(1).sortWithinPartitions("node", "key") if whole else nodes.repartitionByRange(partitions, "node", "key").sortWithinPartitions("node", "key")
        found = [C.materialize(ordered.mapInArrow(_at_nodes(similarity, small, whole), _FOUND), "met")]
        if not whole:
            found += _border_nodes(found[0].where(F.col("kind") == _BORDER), similarity, small)
        edges += [x.where(F.col("kind") == _EDGE).select(F.col("key").alias("a"), F.col("other").alias("b")) for x in found]
        down = _union([x.where(F.col("kind") == _DOWN).select("node", "key") for x in found])
        rows = down.count()
        if not rows:
            return edges, deeper
        if level == planned:  # the nodes below hold no others
            deeper = C.materialize(down.select("key").distinct(), "deeper")
        nodes = down.join(sets, "key").select("node", "key", "sketch", "short").mapInArrow(_next_level(similarity), "node long, key long, short binary")
        level, partitions = level + 1, 1 if rows <= PARTITION_ROWS else max(12, min(partitions, rows // PARTITION_ROWS))


def _pivots(sets: DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys and short sketches of sets that stand for very large groups of near copies, found in a sample of bounded size. They
    only save work: what they absorb is no part of the trees, and what may be like it is joined to them."""
    rows = sets.select("key", "short").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
    keys = np.array([r["key"] for r in rows], np.int64)
    short = np.frombuffer(b"".join(bytes(r["short"]) for r in rows), C.U64).reshape(len(rows), SKETCH // 16)
    absorb = limits(similarity)[1]
    left, chosen = np.ones(len(rows), bool), []
    like = [equal_numbers(x, short) >= absorb for x in short]
    for k in sorted(range(len(rows)), key=lambda k: (-like[k].sum(), keys[k])):
        if left[k] and (like[k] & left).sum() >= SAMPLE_LIKE:
            chosen.append(k)
            left &= ~like[k]
    return keys[chosen], short[chosen]


def _near_pivots(shared, similarity: float):
    """Edges from sets to the pivots in whose ring they are."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, short = shared.value
        for batch in batches:
            keys, own = batch.column(0).to_numpy(), _short_of(batch.column(1))
            for pivot, x in zip(pivots, short, strict=True):
                some = (equal_numbers(own, x) >= limits(similarity)[2]) & (keys != pivot)
                yield pa.RecordBatch.from_pydict({"a": pa.array(keys[some]), "b": pa.array(np.full(some.sum(), pivot))})

    return near


def _not_absorbed(shared, similarity: float):
    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, stays = _short_of(batch.column(2)), np.ones(batch.num_rows, bool)
            for x in shared.value[1]:
                stays &= equal_numbers(own, x) < limits(similarity)[1]
            yield batch.filter(pa.array(stays))

    return rest


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out


def candidates(sets: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, small: int = SMALL_NODE, partitions: int = 12) -> DataFrame:
    """sets: key, sketch, short. Edges a, b that connect all sets which the trees bring together. A pair whose nodes are split
    on may part below; both its sets are then in further trees, as many as the depth calls for, until no set goes deeper than
    was planned. The misses of all rounds together stay within the recall. Very large groups are absorbed before, each by a
    pivot."""
    edges, done, depth, missed = [], 0, PLANNED, 1 - recall
    pivots = _pivots(sets, similarity)
    if len(pivots[0]):
        shared = sets.sparkSession.sparkContext.broadcast(pivots)
        edges.append(C.materialize(sets.select("key", "short").mapInArrow(_near_pivots(shared, similarity), "a long, b long"), "near-pivots"))
        sets = C.materialize(sets.select("key", "sketch", "short").mapInArrow(_not_absorbed(shared, similarity), "key long, sketch binary, short binary"), "not-absorbed")
    while sets is not None:
        missed /= 2
        runs = runs_for(1 - missed, depth)
        met, deeper = _met(sets, range(done, runs), similarity, small, depth, partitions)
        edges += met
        if deeper is not None:
            deeper = C.materialize(sets.join(deeper, "key", "left_semi"), "sets-again")
        sets, done, depth = deeper, runs, 2 * depth + 2
    return _union(edges).distinct()


def _linked(ids: np.ndarray, begins: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the sets left have similarity enough to which of the sets right."""
    sizes = np.diff(begins)
    owner = C.owners(begins)
    _, which, times = np.unique(ids, return_inverse=True, return_counts=True)
    in_many = times[which] > 1
    owner, which = owner[in_many], which[in_many]
    _, which = np.unique(which, return_inverse=True)
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    n = int(which[-1]) + 1 if len(which) else 0
    common = np.zeros((len(left), len(right)), np.float32)
    width = max(1, (1 << 23) // max(1, len(sizes)))
    for lo in range(0, n, width):
        a, b = np.searchsorted(which, [lo, lo + width])
        block = np.zeros((len(sizes), min(width, n - lo)), np.float32)
        block[owner[a:b], which[a:b] - lo] = 1
        common += block[left] @ block[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    return (common >= similarity * union - 1e-6) & (union > 0)


def _verified(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole_groups(batches, 3):
            part_i, part_j, part = (table.column(k).to_numpy() for k in (1, 2, 3))
            keys, copies = table.column(4).to_numpy(), table.column(5).to_numpy()
            out: list[tuple] = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                ids, begins = [], [0]
                for _, _, buffer, offsets in C.text_slices(table.column(6).slice(lo, hi - lo)):
                    more, at = shingle_sets(buffer, offsets)
                    ids.append(more)
                    begins += (begins[-1] + at[1:]).tolist()
                same = part_i[lo] == part_j[lo]
                left = np.flatnonzero(part[lo:hi] == part_i[lo])
                right = left if same else np.flatnonzero(part[lo:hi] == part_j[lo])
                if not len(left) or not len(right):
                    continue
                linked = _linked(np.concatenate(ids), np.array(begins), left, right, similarity)
                own, weight = keys[lo:hi], copies[lo:hi].astype(float)
                if same:
                    np.fill_diagonal(linked, False)
                count = np.zeros(hi - lo)
                count[left] += linked @ weight[right]
                if not same:
                    count[right] += linked.T @ weight[left]
                a, b = np.nonzero(linked)
                root = _roots(hi - lo, left[a], right[b])
                out.append((own, count.astype(np.int64), own[root]))
            if out:
                yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v)) for k, v in zip(("key", "links", "root"), zip(*out, strict=True), strict=True)})

    return verify


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text", with_rows: bool = False) -> DataFrame:
    """doc_id, class_id, n_links, copy_of (the least doc_id of the row's copies) of each row; with_rows: also row and own,
    the hashes of id and text and of the text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # a row's own numbers, as an id may be null or stand in several rows
    rows = rows.withColumns({"row": F.xxhash64("doc_id", "text"), "own": F.xxhash64("text")})
    total = C.text_bytes(rows)
    shards = C.parts(total, 8 << 20)
    described = rows.mapInArrow(_described, "doc_id long, row long, own long, key long, size long, sketch binary, short binary")
    described = C.materialize(described, "sketches")
    first = F.min(F.struct("doc_id", "row", "own")).alias("first")
    classes = described.groupBy("key").agg(first, F.count("*").alias("copies"), F.max("size").alias("size"))
    classes = C.materialize(classes.select("key", F.col("first.doc_id").alias("rep"), "first.row", "first.own", "copies", "size"), "copies")
    one = described.join(classes.select("key", "row", "own"), ["key", "row", "own"], "left_semi").where("size > 0").dropDuplicates(["key"])
    sets = C.materialize(one.select("key", "sketch", "short"), "sets")

    grouped = components(candidates(sets, similarity, recall, partitions=C.parts(total, PARTITION_BYTES)))
    members = grouped.join(classes, grouped["node"] == F.col("key")).select("label", "key", "row", "own", "copies", "size")
    members = C.materialize(members, "members")
    weights = members.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / GROUP_SETS), F.ceil(F.sum("size") / GROUP_SHINGLES)).cast("int").alias("parts"))
    # groups that are too large for a task are cut into parts, and each pair of parts meets in a task
    parted = members.join(weights, "label").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    # both sides grow with the input; a plan that changed with the size would surprise on the day of the large run
    texts = rows.drop("doc_id").hint("shuffle_merge").join(parted, ["row", "own"]).dropDuplicates(["key"])
    met = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("label", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "key", "copies", "text")
    met = met.repartition(shards, "label", "i", "j").sortWithinPartitions("label", "i", "j")
    checked = C.materialize(met.mapInArrow(_verified(similarity), "key long, links long, root long"), "links")

    classed = components(checked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.join(classed.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", "copies", F.coalesce("label", "key").alias("label"))
    named = named.join(named.groupBy("label").agg(F.min("rep").alias("class_id")), "label").join(links, "key", "left")
    named = C.materialize(named.select("key", "class_id", F.col("rep").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    return described.select("doc_id", "key", "row", "own").join(named, "key").select("doc_id", "class_id", "n_links", "copy_of", *(["row", "own"] if with_rows else []))
