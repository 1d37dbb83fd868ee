"""The operators on conversations and embeddings against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("oscine.llm")
from oscine.llm import centroids, embedding_dedup, prefix_trie  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- conversations -------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, node string, base long, h int, parent string, tokens int"


def _trie_plain(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(int(c - math.fmod(c, 20)), [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
        ends[tuple(path)].append(c)
    kids = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * len(WORD.findall(n[-1][1])) if n else 0
    return Counter(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], _sha(",".join(map(str, sorted(ends[n])))))
        for n, m in members.items()
    )


def _trie(spark, rows):
    df = spark.createDataFrame([(*r, "n", 1, 2, "p", 3) for r in rows], TURNS)
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return Counter(tuple(r[n] for n in names) for r in prefix_trie.prefix_trie(df).collect())


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(3)
    lines = [f"a{i} b" + " c" * (i % 4) for i in range(6)] + ["", " \n", None, "é x"]
    rows = []
    for c in [*range(0, 65), *range(103, 118), 210, 211, 1000000007]:
        if c == 20:
            continue  # a family without its base
        for t in range(rng.choice([1, 2, 3, 4, 6])):
            role = rng.choice(["user", "assistant", None])
            rows.append((c, t, role if t else "user", lines[0] if t == 0 and rng.random() < 0.6 else rng.choice(lines)))
    rows += [(c, t, "user", f"same {t}") for c in (120, 121, 122, 340, 341) for t in range(150)]  # long ones, alike
    rows += [(61, None, "user", "before all"), (62, 0, "user", "tie"), (62, 0, "user", "tie"), (None, 0, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def _without_ties(rows):
    """Turns of equal number in one conversation are repeated rows or dropped, as their order is the operator's own."""
    seen, out = {}, []
    for r in rows:
        if seen.setdefault(r[:2], r) == r or r[0] is None:
            out.append(r)
    return out


def test_prefix_trie(spark, conversations):
    rows = _without_ties(conversations)
    assert _trie(spark, rows) == _trie_plain(rows)


def test_prefix_trie_in_pieces(spark, conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAMILY_NODES", 7)
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 5)
    rows = _without_ties(conversations)
    assert _trie(spark, rows) == _trie_plain(rows)


def test_prefix_trie_copies_and_edges(spark):
    copies = [(c, t, "user", f"t{t}") for c in range(400) for t in range(3)]
    assert _trie(spark, copies) == _trie_plain(copies)
    assert _trie(spark, []) == Counter()
    assert _trie(spark, [(None, 1, "user", "x")]) == Counter()
    one = [(5, None, None, None)]
    assert _trie(spark, one) == _trie_plain(one)
    negative = [(c, t, "user", f"{c % 3} {t}") for c in range(-45, 3) for t in range(4)]
    assert _trie(spark, negative) == _trie_plain(negative)


def test_prefix_trie_tied_turns_are_told_by_hash(spark):
    rows = [(0, 1, "user", "x"), (0, 1, "user", "y")]
    assert _trie(spark, rows) == _trie(spark, rows[::-1])


# ---- vectors -------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row long, vector string, cluster int, comp long, centre long, links long"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, 3, 4, 5) for r in rows], VECTORS)


def _odd(rng, length):
    full = [0.5] * length
    return [
        (900, None, 1), (901, [], 1), (902, [float("nan"), *full[1:]], 1), (903, [float("inf"), *full[1:]], 1), (904, [None, *full[1:]], 1),
        (905, [0.0] * length, 1), (906, full[:-1], 1), (907, full, None), (None, full, 1), (908, full, 1), (908, full, 1), (None, [x * 3 for x in full], 1), (909, [*full, 0.5], 1),
        (910, [1e-30] * length, 1), (911, [1e30] * length, 1),
    ]


def _cluster_plain(rows, k, rounds, components, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v) and all(abs(x) <= 2**21 for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, _sha(f"{seed}:{r[0]}"), r[1]))
    centres = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        to = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, to) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    to = assign()
    each = Counter()
    for d, c in to:
        each[c] += d
    return Counter((i, c, d, each[c], sum(each.values()), _sha(",".join(map(str, centres[c])))) for (i, _), (d, c) in zip(kept, to))


@pytest.mark.parametrize("parts", [1, 5])
def test_cluster(spark, parts):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.choice([-1, 0, 0.5, 1]) * rng.random())) for _ in range(6)], i % 3) for i in range(300)]
    rows += [(i + 1000, [0.25] * 6, 0) for i in range(90)] + [(i + 2000, [float(i % 2)] * 6, 0) for i in range(40)]  # copies, ties
    rows += _odd(rng, 6)
    df = _frame(spark, rows).repartition(parts)
    for k, rounds in ((7, 3), (1, 1), (500, 2)):
        found = centroids.with_inertia(*centroids.cluster(df, k=k, rounds=rounds, components=6, scale=16, seed=3))
        got = Counter(tuple(r) for r in found.collect())
        assert got == _cluster_plain(rows, k, rounds, 6, 16, 3)


def test_cluster_of_nothing(spark):
    for rows in ([], [(1, None, 1), (2, [1.0], 1)]):
        found = centroids.with_inertia(*centroids.cluster(_frame(spark, rows)))
        assert found.count() == 0 and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), min_size=3, max_size=3), min_size=1, max_size=30), st.lists(st.lists(st.integers(-5, 5), min_size=3, max_size=3), min_size=1, max_size=9))
def test_annulus_is_exact_with_ties(x, centres):
    best, distance = centroids.nearest(np.array(x), np.array(centres))
    for v, b, d in zip(x, best, distance, strict=True):
        assert (d, b) == min((sum((p - q) ** 2 for p, q in zip(v, c)), j) for j, c in enumerate(centres))


def _dedup_plain(rows, similarity):
    n = len(rows)
    x = [None if v is None or not v or any(a is None or not math.isfinite(a) for a in v) or not any(v) or l is None else np.array(v, float) for _, v, l in rows]
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]):
                a, b = x[i] / np.abs(x[i]).max(), x[j] / np.abs(x[j]).max()
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= similarity:
                    links[i].append(j), links[j].append(i)
    out, seen = Counter(), {}
    for i in range(n):
        if i not in seen:
            stack, comp = [i], {i}
            while stack:
                for j in links[stack.pop()]:
                    if j not in comp:
                        comp.add(j), stack.append(j)
            ids = [rows[j][0] for j in comp if rows[j][0] is not None]
            seen |= dict.fromkeys(comp, min(ids, default=None))
        out[rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]] += 1
    return out


@pytest.fixture(scope="module")
def near_rows():
    rng = np.random.default_rng(8)
    rows = []

    def add(v, label):
        rows.append((len(rows), [float(a) for a in np.asarray(v, np.float32)], label))

    for label in range(3):
        for v in rng.standard_normal((150, 16)):
            add(v, label)
    for v in rng.standard_normal((40, 16)) + 2.5:  # a label whose mean is far from zero, and chains that drift apart
        for step in range(rng.integers(1, 6)):
            add(v, 3)
            v = v + rng.standard_normal(16) * np.linalg.norm(v) * 0.04
    hot = rng.standard_normal(16)
    for _ in range(220):  # a third of all rows, some beyond half the radius
        add((hot + rng.standard_normal(16) * np.linalg.norm(hot) * rng.choice([0.0, 0.02, 0.03, 0.045]) ) * rng.choice([1, 7]), 1)
    return rows + _odd(random.Random(1), 16)


def _dedup(df):
    return Counter(tuple(r) for r in embedding_dedup.embedding_dedup(df).select("vec_id", "n_links", "component_id", "kept").collect())


def test_embedding_dedup(spark, near_rows):
    expected = _dedup_plain(near_rows, 0.98)
    assert sum(1 for k in expected if k[1] > 100) > 50
    assert _dedup(_frame(spark, near_rows).repartition(5)) == expected


@pytest.mark.parametrize("cell,group,like", [(16, 40, 9), (16, 40, 10**6), (64, 3, 5), (10**6, 10, 3)])
def test_embedding_dedup_in_cells_and_parts(spark, near_rows, monkeypatch, cell, group, like):
    """Cut cells, cells and groups in parts, with and without groups that a centre stands for."""
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "GROUP", group)
    monkeypatch.setattr(embedding_dedup, "SAMPLE_LIKE", like)
    assert _dedup(_frame(spark, near_rows)) == _dedup_plain(near_rows, 0.98)


def test_embedding_dedup_of_nothing(spark):
    assert _dedup(_frame(spark, [])) == Counter()
    assert _dedup(_frame(spark, [(1, None, 1), (None, [1.0], None)])) == Counter({(1, 0, 1, True): 1, (None, 0, None, True): 1})


def test_blocks_find_every_pair_within_the_radius():
    """Pairs at the radius, whatever their direction, lie within a block's share in some block of the rotated vectors."""
    rng = np.random.default_rng(2)
    for length in (1, 2, 3, 5, 64, 130):
        x = rng.standard_normal((200, length))
        off = rng.standard_normal((200, length))
        off *= 0.2 / np.linalg.norm(off, axis=1)[:, None]
        turned = off @ embedding_dedup._rotation(length)
        edges = embedding_dedup._borders(length)
        within = [(turned[:, a:b] ** 2).sum(1) <= 0.04 * (b - a) / length + 1e-9 for a, b in zip(edges[:-1], edges[1:])]
        assert edges[0] == 0 and edges[-1] == length and np.any(within, axis=0).all() and len(x)
