"""Embedding near-dedup (operator 13): a join by the pigeonhole principle over blocks of rotated vectors.

Two unit vectors with cosine s are sqrt(2 - 2 s) apart. A rotation keeps distances and spreads them evenly over components;
split into BLOCKS blocks, some block of a pair within that radius holds at most the block's share of the squared distance. So
a range join of each block under its share finds every such pair. What the joins find are candidates, settled in each cell by
distances of vectors rounded to bytes, with what rounding may add; each connected set of candidates is then compared pair by
pair in double precision, and only cosines of at least the threshold count.

Range join: vectors meet by label, length, block and cell. Labels of more than CELL vectors are cut at the label's mean, in as
many components of a block as brings its cells to about CELL vectors (MOST_CUTS at most); a vector goes to its own cell and to
those of higher number that its radius touches. A cell of still more vectors is met in pairs of parts.

Hot groups: SAMPLE vectors, the first by a hash, show groups that hold a good part of all rows. Vectors within half the radius
of such a group's mean link with each other by the triangle inequality; they are counted and not compared, and the mean takes
their place in the range join with a radius that much larger, so that nothing that links with one of them is lost. The others
of a group of M are compared with all of it in pairs of parts, each in its own task.

Vectors link if their labels are equal and not null, and their cosine reaches the threshold. Vectors that are null, empty, zero
or hold null, NaN or infinite components link with nothing, and vectors of different lengths don't link. Each row is a vector of its
own, repeated rows too. component_id is the least vec_id of those connected by links; a null id is never the least unless all are null, and
kept compares null as a value. An empty table gives no rows. Extra columns are not looked at."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscine.llm import common as C
from oscine.llm import vectors
from oscine.llm.components import components

SIMILARITY, BLOCKS = 0.98, 4
#: Vectors of a cell that are compared by one task; cuts of a label's cells at most.
CELL, MOST_CUTS = 8192, 6
#: Vectors that are looked at for hot groups; how many of them such a group has at least, the first included.
SAMPLE, SAMPLE_LIKE = 1024, 9
#: Members of a group of candidates that one task compares as a whole.
GROUP = 2048
#: Added to radii, beyond what rounding in double precision may do to them.
_SLACK = 1e-6
_MESSAGE = "label long, place long, pair long, block int, row long, first boolean, wide double, bytes binary"


@cache
def _rotation(length: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(length).standard_normal((length, length)))[0]


def _scale(length: int) -> float:
    """What a component is multiplied by before it is rounded to a byte: six times the usual size of one is the largest."""
    return 127 * math.sqrt(length) / 6


def _borders(length: int) -> np.ndarray:
    """Where the blocks of a vector begin and end."""
    return np.unique(np.linspace(0, length, BLOCKS + 1).round().astype(int))


def _scaled(x: np.ndarray) -> np.ndarray:
    """The vectors without extreme sizes: multiplied by powers of two, so that no cosine changes."""
    most = np.abs(x).max(1, initial=0)
    return np.ldexp(x, -np.frexp(most)[1][:, None])


def _units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: rows that may link, their labels, their vectors at length 1."""
    labels = batch.column("label")
    known = np.asarray(labels.is_valid())
    number = np.asarray(labels.fill_null(0), np.int64)
    for rows, x in vectors.matrices(batch.column("vector")):
        use = known[rows] & (x != 0).any(1)
        x = _scaled(x[use])
        yield rows[use], number[rows[use]], x / np.sqrt((x * x).sum(1))[:, None]


class _Plan:
    """What all tasks know: centres of hot groups, means and cuts of large labels, parts of large cells. All of it is bounded."""

    def __init__(self, radius: float):
        self.radius = radius
        self.centres: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        self.cuts: dict[int, int] = {}
        self.means: dict[tuple[int, int], np.ndarray] = {}
        self.parts: dict[tuple[int, int], int] = {}

    def absorbed(self, labels: np.ndarray, x: np.ndarray, within: float) -> np.ndarray:
        """For each vector the nearest centre of its label within the distance, as its number, or 0 for none."""
        out = np.zeros(len(x), np.int64)
        for (label, length), found in self.centres.items():
            if length == x.shape[1]:
                rows = np.flatnonzero(labels == label)
                apart = np.stack([((x[rows] - c) ** 2).sum(1) for _, c in found])
                least = apart.argmin(0)
                out[rows] = np.where(apart.min(0) <= within * within, np.array([n for n, _ in found])[least], 0)
        return out

    def messages(self, row: np.ndarray, labels: np.ndarray, x: np.ndarray, extra: float = 0.0) -> pa.RecordBatch:
        """The vectors as they are sent to their cells. extra is the radius of what stands at a place of its own, as a centre does;
        it goes to every cell that it touches."""
        length = x.shape[1]
        turned = x @ _rotation(length)
        scale = _scale(length)
        rounded = np.clip(np.rint(turned * scale), -127, 127)
        wide = np.sqrt(((turned - rounded / scale) ** 2).sum(1)) + _SLACK + extra
        low = rounded.astype(np.int8)
        edges, sent = _borders(length), []
        for label in np.unique(labels):
            mine = np.flatnonzero(labels == label)
            means = self.means.get((int(label), length))
            for block, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                cuts = min(self.cuts[int(label)], b - a) if means is not None else 0
                off = turned[mine, a : a + cuts] - means[a : a + cuts] if cuts else np.zeros((len(mine), 0))
                home = (off > 0) @ (1 << np.arange(cuts))
                reach = (self.radius + 2 * extra) * math.sqrt((b - a) / length) + _SLACK
                for flip in range(1 << cuts):
                    bits = np.array([flip >> i & 1 for i in range(cuts)], bool)
                    cell = home.astype(np.int64) ^ flip
                    at = np.flatnonzero(((off[:, bits] ** 2).sum(1) <= reach * reach) & ((cell >= home) | (extra > 0)))
                    sent.append((mine[at], np.full(len(at), label, np.int64), np.full(len(at), block, np.int32), cell[at]))
        at, label, block, cell = (np.concatenate(c) for c in zip(*sent, strict=True))
        place = (length << 4 | block.astype(np.int64)) << MOST_CUTS | cell
        pair, first, again = self._parts(label, place, row[at])
        at, label, block, place = at[again], label[again], block[again], place[again]
        values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(at), [None, pa.py_buffer(np.ascontiguousarray(low[at]))])
        return pa.record_batch(
            {"label": label, "place": place, "pair": pair, "block": block, "row": row[at], "first": pa.array(first), "wide": wide[at], "bytes": values.cast(pa.binary())}
        )

    def _parts(self, label: np.ndarray, place: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In a cell of many parts a vector meets its own part and each other, pair by pair: the pair, whether the vector's is the
        first part of it, and which of the given vectors it is."""
        pair, first, again = np.zeros(len(row), np.int64), np.ones(len(row), bool), np.arange(len(row))
        if not self.parts:
            return pair, first, again
        out = []
        whole = np.ones(len(row), bool)
        for of_label, p in set(zip(label.tolist(), place.tolist(), strict=True)) & self.parts.keys():
            parts = self.parts[of_label, p]
            at = np.flatnonzero((label == of_label) & (place == p))
            whole[at] = False
            own = (C.mix(row[at].astype(np.int64).view(C.U64)) % C.U64(parts)).astype(np.int64)
            for other in range(parts):
                lo, hi = np.minimum(own, other), np.maximum(own, other)
                out.append((lo << 32 | hi, own == lo, at))
        out.append((pair[whole], first[whole], again[whole]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _near(low: np.ndarray, wide: np.ndarray, first: np.ndarray, block: tuple[int, int], radius: float) -> np.ndarray:
    """For the vectors of a cell the least of those that candidates connect with each: by the block, then by all of it."""
    n, length = low.shape
    scale = _scale(length)
    kind = np.float32 if length < 1000 else np.float64  # whole numbers are exact in both
    x = low.astype(kind)
    part = np.ascontiguousarray(x[:, block[0] : block[1]])
    squares, whole = (part * part).sum(1), (x * x).sum(1)
    share = math.sqrt((block[1] - block[0]) / length)
    root = np.arange(n)
    apart = not first.all()
    left = np.flatnonzero(first)
    right = np.flatnonzero(~first) if apart else left
    for lo in range(0, len(left), 1024):
        rows = left[lo : lo + 1024]
        others = right if apart else right[lo:]
        for at in range(0, len(others), 4096):
            cols = others[at : at + 4096]
            reach = wide[rows][:, None] + wide[cols]
            within = squares[rows][:, None] + squares[cols] - 2 * (part[rows] @ part[cols].T) <= ((radius * share + reach) * scale) ** 2
            i, j = np.nonzero(within)
            if len(i) * 4 > within.size:
                near = (whole[rows][:, None] + whole[cols] - 2 * (x[rows] @ x[cols].T))[i, j]
            else:
                near = ((x[rows[i]] - x[cols[j]]) ** 2).sum(1)
            ok = near <= ((radius + reach[i, j]) * scale) ** 2
            _hook(root, rows[i[ok]], cols[j[ok]])
    return root


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Connects a with b, pair by pair; root keeps the least of each connected set."""
    while len(a):
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _cells(radius: float):
    def found(table: pa.Table) -> pa.Table:
        rows = np.asarray(table.column("row"))
        low = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.int8).reshape(len(rows), -1)
        block = int(table.column("block")[0].as_py())
        edges = _borders(low.shape[1])
        root = _near(low, np.asarray(table.column("wide")), np.asarray(table.column("first")), (edges[block], edges[block + 1]), radius)
        other = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": rows[other], "b": rows[root[other]]})

    return found


def _hot_groups(base: DataFrame, plan: _Plan) -> None:
    """Finds hot groups in the sample, and their means over all rows."""
    sample = base.where("label is not null and vector is not null").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("label", "vector").toArrow()
    seeds: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    number = 0
    for batch in sample.combine_chunks().to_batches():
        for _, labels, x in _units(batch):
            for label in np.unique(labels):
                own = x[labels == label]
                like = ((own[:, None] - own) ** 2).sum(2) <= plan.radius**2 if len(own) * x.shape[1] <= 1 << 14 else 2 - 2 * own @ own.T <= plan.radius**2
                left = np.ones(len(own), bool)
                while (counts := (like & left).sum(1) * left).max(initial=0) >= SAMPLE_LIKE:
                    number -= 1
                    seeds.setdefault((int(label), x.shape[1]), []).append((number, own[like[counts.argmax()] & left].mean(0)))
                    left &= ~like[counts.argmax()]
    if not seeds:
        return
    plan.centres = seeds  # as they are in the sample

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, labels, x in _units(batch):
                near = plan.absorbed(labels, x, plan.radius)
                for n in np.unique(near[near < 0]):
                    sums[int(n)] = sums.get(int(n), 0) + x[near == n].sum(0)
        yield pa.record_batch({"n": pa.array(list(sums), pa.int64()), "sums": pa.array(list(sums.values()), pa.list_(pa.float64()))})

    means = base.mapInArrow(summed, "n long, sums array<double>").select("n", F.posexplode("sums")).groupBy("n", "pos").agg(F.sum("col").alias("x")).collect()  # SAMPLE / SAMPLE_LIKE groups at most
    of_group: dict[int, dict[int, float]] = {}
    for r in means:
        of_group.setdefault(r["n"], {})[r["pos"]] = r["x"]
    mean = {n: np.array([v[i] for i in range(len(v))]) for n, v in of_group.items()}
    plan.centres = {key: [(n, mean[n] / np.sqrt((mean[n] ** 2).sum())) for n, _ in found if n in mean and (mean[n] != 0).any()] for key, found in seeds.items()}
    plan.centres = {key: found for key, found in plan.centres.items() if found}


def _large_labels(base: DataFrame, plan: _Plan, total: int) -> int:
    """How often the cells of labels with very many vectors are cut, and where. Gives the vectors of the largest label."""
    least = max(CELL, total // 16384)  # so many labels at most
    sizes = base.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    large = {r["label"]: r["n"] for r in sizes.where(F.col("n") > least).collect()}
    plan.cuts = {label: min(MOST_CUTS, math.ceil(math.log2(n / CELL))) for label, n in large.items()}
    if not large:
        return least

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, labels, x in _units(batch):
                for label in np.unique(labels):
                    if int(label) in large:
                        key = int(label), x.shape[1]
                        sums[key] = sums.get(key, 0) + np.append((x[labels == label] @ _rotation(key[1])).sum(0), (labels == label).sum())
        yield pa.record_batch({"label": pa.array([k[0] for k in sums], pa.int64()), "length": pa.array([k[1] for k in sums], pa.int64()), "sums": pa.array(list(sums.values()), pa.list_(pa.float64()))})

    each = base.mapInArrow(summed, "label long, length long, sums array<double>").select("label", "length", F.posexplode("sums"))
    means: dict[tuple[int, int], dict[int, float]] = {}
    for r in each.groupBy("label", "length", "pos").agg(F.sum("col").alias("x")).collect():
        means.setdefault((r["label"], r["length"]), {})[r["pos"]] = r["x"]
    plan.means = {key: np.array([v[i] for i in range(key[1])]) / v[key[1]] for key, v in means.items()}
    return max(large.values())


def _large_cells(base: DataFrame, plan: _Plan, most: int) -> None:
    """Cells of more than a task's vectors, and into how many parts they go."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            row = np.asarray(batch.column("row"))
            for rows, labels, x in _units(batch):
                stay = plan.absorbed(labels, x, plan.radius / 2 - _SLACK) == 0
                message = plan.messages(row[rows[stay]], labels[stay], x[stay])
                keys, counts = np.unique(np.stack([message["label"], message["place"]]), axis=1, return_counts=True)
                for label, place, n in zip(*keys.tolist(), counts.tolist(), strict=True):
                    sums[label, place] = sums.get((label, place), 0) + n
        yield pa.record_batch({"label": pa.array([k[0] for k in sums], pa.int64()), "place": pa.array([k[1] for k in sums], pa.int64()), "n": pa.array(list(sums.values()), pa.int64())})

    cells = base.mapInArrow(counted, "label long, place long, n long").groupBy("label", "place").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    plan.parts = {(r["label"], r["place"]): math.ceil(r["n"] / most) for r in cells.collect()}


def _absorbed(base: DataFrame, plan: _Plan) -> DataFrame:
    """row, centre: the vectors within half the radius of a centre, which all link with each other."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = np.asarray(batch.column("row"))
            for rows, labels, x in _units(batch):
                near = plan.absorbed(labels, x, plan.radius / 2 - _SLACK)
                yield pa.record_batch({"row": row[rows[near < 0]], "centre": near[near < 0]})

    if not plan.centres:
        return base.sparkSession.createDataFrame([], "row long, centre long")
    return C.materialize(base.mapInArrow(found, "row long, centre long"), "absorbed")


def _candidates(base: DataFrame, plan: _Plan) -> DataFrame:
    """Edges a, b that connect what candidates connect. Centres stand in for the vectors that they absorb."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = np.asarray(batch.column("row"))
            for rows, labels, x in _units(batch):
                stay = plan.absorbed(labels, x, plan.radius / 2 - _SLACK) == 0
                if stay.any():
                    yield plan.messages(row[rows[stay]], labels[stay], x[stay])

    messages = base.mapInArrow(sent, _MESSAGE)
    for (label, _), found in plan.centres.items():
        own = plan.messages(np.array([n for n, _ in found]), np.full(len(found), label), np.stack([c for _, c in found]), plan.radius / 2)
        messages = messages.union(base.sparkSession.createDataFrame([tuple(r.values()) for r in own.to_pylist()], _MESSAGE))
    return messages.groupBy("label", "place", "pair").applyInArrow(_cells(plan.radius), "a long, b long")


def _verified(similarity: float):
    """Compares the vectors of a group: all with all, or those of its first part with the others."""

    def found(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first, n = np.asarray(table.column("first")), len(table)
        (_, x), *_ = vectors.matrices(table.column("vector").chunk(0))
        x = _scaled(x)
        size = np.sqrt((x * x).sum(1))
        root, links = np.arange(n), np.zeros(n, np.int64)
        one = table.column("lo")[0] == table.column("hi")[0]  # one part; of two, either may be without vectors
        left = np.flatnonzero(first)
        right = left if one else np.flatnonzero(~first)
        for lo in range(0, len(left), 1024):
            rows = left[lo : lo + 1024]
            linked = (x[rows] @ x[right].T) / (size[rows][:, None] * size[right]) >= similarity
            i, j = np.nonzero(linked)
            i, j = rows[i], right[j]
            i, j = i[i != j], j[i != j]
            np.add.at(links, i, 1)
            if not one:
                np.add.at(links, j, 1)
            _hook(root, i, j)
        ids = table.column("vec_id").to_pylist()
        least: dict[int, int] = {}
        for r, v in zip(root.tolist(), ids, strict=True):
            if v is not None:
                least[r] = min(v, least.get(r, v))
        rows = np.asarray(table.column("row"))
        return pa.table(
            {"apart": table.column("lo"), "row": rows, "vec_id": table.column("vec_id"), "links": links, "root": rows[root], "least": pa.array([least.get(r) for r in root.tolist()], pa.int64())}
        )

    return found


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of large groups for each pair of parts that they are compared in. Parts are of one centre's vectors or of none's;
    a centre's parts don't meet each other."""
    for batch in batches:
        comps, centres = np.asarray(batch.column("comp")), np.asarray(batch.column("centre").fill_null(0), np.int64)
        spread = C.mix(np.asarray(batch.column("row")).view(C.U64))
        at, lo, hi, first = [], [], [], []
        for comp in np.unique(comps):
            mine = np.flatnonzero(comps == comp)
            parts = {p["centre"] or 0: p["parts"] for p in batch.column("plan")[int(mine[0])].as_py()}
            begin = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
            total = sum(parts.values())
            for centre, count in parts.items():
                rows = mine[centres[mine] == centre]
                own = begin[centre] + (spread[rows] % C.U64(count)).astype(np.int64)
                for other in range(total):
                    if centre < 0 and begin[centre] <= other < begin[centre] + count:
                        continue
                    at.append(rows), lo.append(np.minimum(own, other)), hi.append(np.maximum(own, other)), first.append(own <= other)
        if at:
            index = np.concatenate(at)
            same = batch.select(["comp", "row", "vec_id", "vector"]).take(pa.array(index))
            yield pa.record_batch({**{k: same.column(k) for k in same.schema.names}, "lo": np.concatenate(lo), "hi": np.concatenate(hi), "first": pa.array(np.concatenate(first))})


def embedding_dedup(docs: DataFrame, similarity: float = SIMILARITY, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each row of the input: vec_id, n_links, component_id, kept."""
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    base = C.materialize(named, "vectors")
    total = base.count()
    plan = _Plan(math.sqrt(2 - 2 * similarity))
    _hot_groups(base, plan)
    largest, most = _large_labels(base, plan, total), max(CELL, total // 4096)
    if largest > most:
        _large_cells(base, plan, most)
    absorbed = _absorbed(base, plan)
    edges = C.materialize(_candidates(base, plan), "candidates")
    comps = components(edges.union(absorbed.select("row", "centre"))).where("node >= 0").select(F.col("node").alias("row"), F.col("label").alias("comp"))
    members = comps.join(absorbed, "row", "left").join(base.select("row", "vec_id", "vector"), "row")

    # groups that one task compares, and the others in pairs of parts
    group = max(GROUP, total // 16384)
    sizes = C.materialize(comps.join(absorbed, "row", "left").groupBy("comp", "centre").agg(F.count("*").alias("n")), "group-sizes")
    large = sizes.groupBy("comp").agg(F.sum("n").alias("n"), F.collect_list(F.struct("centre", F.ceil(F.col("n") / group).alias("parts"))).alias("plan")).where(F.col("n") > group).drop("n")
    large = C.materialize(large, "large-groups")
    kinds = f"comp long, row long, vec_id long, vector {base.schema['vector'].dataType.simpleString()}, lo long, hi long, first boolean"
    small = members.join(large, "comp", "left_anti").select("comp", "row", "vec_id", "vector", F.lit(-1).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"), F.lit(True).alias("first"))
    parted = members.join(large, "comp").mapInArrow(_in_parts, kinds)
    schema = "apart long, row long, vec_id long, links long, root long, least long"
    verified = C.materialize(small.union(parted).groupBy("comp", "lo", "hi").applyInArrow(_verified(similarity), schema), "verified")

    done = verified.where("apart < 0").select("row", "links", "least")
    if not large.isEmpty():
        apart = verified.where("apart >= 0")
        of_large = absorbed.join(comps, "row").join(large.select("comp"), "comp", "left_semi")
        true_edges = apart.where("row <> root").select(F.col("row").alias("a"), F.col("root").alias("b")).union(of_large.select("row", "centre"))
        least = components(true_edges).where("node >= 0").withColumnsRenamed({"node": "row", "label": "of"}).join(base.select("row", "vec_id"), "row")
        named = least.join(least.groupBy("of").agg(F.min("vec_id").alias("least")), "of").select("row", "least")
        cliques = F.broadcast(sizes.where("centre is not null").select("comp", "centre", (F.col("n") - 1).alias("links")))  # as many as centres
        links = apart.select("row", "links").union(of_large.join(cliques, ["comp", "centre"]).select("row", "links")).groupBy("row").agg(F.sum("links").alias("links"))
        done = done.union(links.join(named, "row").select("row", "links", "least"))
    found = base.select("row", "vec_id").join(done, "row", "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return found.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: All pairs of a label are compared.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.a AS vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM reach r LEFT JOIN n ON n.a = r.a GROUP BY r.a
"""
