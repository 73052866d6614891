"""The k most similar vectors of every vector, by cross-polytope hashing.

Vectors are scaled to unit length and kept as 16-bit integers (an error of under 2e-5 in the cosine). In each table three
rounds of random signs and fast Hadamard transforms rotate a vector; its cell is the signed axis that is nearest, over as
many axes as give enough cells, with a second and a third hash appended where one does not. A vector is stored in its
nearest cell and also asks the next nearest ones (multiprobe), in the order of how much farther they are.

There are about sqrt(n) / 4 cells a table, so a cell grows as slowly as the number of cells, and coarse cells keep recall
high where fine ones would lose it. Within a cell of more than ``BRUTE`` vectors the same hashing with finer cells picks
the candidates, without another shuffle; smaller ones are compared in full. Similarities are computed in matrix blocks.

How many tables there are and how far a vector asks follows from a recall target: ``SAMPLE`` vectors, chosen by hash, are
compared with all, and of the settings that would find ``RECALL`` of their true neighbours the one with the fewest copies
is taken. Where no setting of up to ``MOST_COPIES`` copies does, cells are made coarser until one does. The sample only
chooses the setting; every vector is stored and asks. Whoever has found fewer than k is then compared with all vectors, which lie
in parts of bounded size.

Equal vectors form one class of which one member is searched with, so a vector that a third of all rows share costs as
much as any other; a cell of far more vectors than its share is cut into salted parts that each query visits in turn.

Defined results: null, empty, zero and non-finite vectors and null ids are left out; vectors of different lengths are
not compared, each length has its own cells; of several vectors of one id the least (in bytes) counts. Ties go to the
smaller id within what was found, and of more than k equal vectors any k are right. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize

K = 5
RECALL = 0.99
SAMPLE = 256
MOST_TABLES, MOST_PROBES, MOST_COPIES = 6, 8, 12.0
TARGET = 1024
BRUTE = 4096
PART = 65_536
CELL_BYTES = 64 << 20
SEED = 20_250_101
INNER = 1000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the width is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.float32(math.sqrt(n))


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1]))) if width > x.shape[1] else x
    rng = np.random.default_rng((SEED, number, width))
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1.0, 1.0], dtype=np.float32), width))
    return x


def axes_for(cells: int, width: int) -> list[int]:
    """Axes of each hash, so that together they give about ``cells`` cells; none for a single cell."""
    out: list[int] = []
    left = float(cells)
    while left > 1.5:
        out.append(min(width, max(1, round(left / 2))))
        left /= 2 * out[-1]
    return out


def probes(x: np.ndarray, cells: int, table: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest cells of each vector in one table, nearest first, and how much farther than the first each is
    (0 for the first, infinite where there are fewer cells)."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    code, far = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1), dtype=np.float32)
    for number, axes in enumerate(axes_for(cells, width)):
        y = rotate(x, 16 * table + number)[:, :axes]
        both = np.concatenate((y, -y), axis=1)
        m = min(most, 2 * axes)
        at = np.argpartition(-both, m - 1, axis=1)[:, :m] if m < 2 * axes else np.broadcast_to(np.arange(m), (len(x), m))
        near = np.take_along_axis(both, at, axis=1)
        gap = (near.max(axis=1, keepdims=True) - near) ** 2
        code = (code[:, :, None] * (2 * axes) + at[:, None, :]).reshape(len(x), -1)
        far = (far[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
        order = np.argsort(far, axis=1, kind="stable")[:, :most]
        code, far = np.take_along_axis(code, order, axis=1), np.take_along_axis(far, order, axis=1)
    if code.shape[1] < most:
        more = most - code.shape[1]
        code, far = np.pad(code, ((0, 0), (0, more)), constant_values=-1), np.pad(far, ((0, 0), (0, more)), constant_values=np.inf)
    return code, far


class Plan(NamedTuple):
    """Cells a table, tables, and up to which distance a vector asks further cells; recall and copies on the sample."""

    cells: int
    tables: int
    reach: float
    recall: float
    copies: float


def choose_plan(x: np.ndarray, near: list[np.ndarray], cells: int, first_table: int, recall: float = RECALL) -> Plan:
    """The setting of fewest copies with which the sample's vectors find ``recall`` of their true neighbours' cells;
    fewer cells where none does. ``near``: for each sample vector its true neighbours."""
    flat = np.concatenate([v for v in near if len(v)]) if any(len(v) for v in near) else np.empty((0, x.shape[1]), np.float32)
    owner = np.repeat(np.arange(len(x)), [len(v) for v in near])
    while cells > 1 and len(flat):
        asked = np.full((MOST_TABLES, len(flat)), np.inf, dtype=np.float32)
        gaps = []
        for t in range(MOST_TABLES):
            code, far = probes(x, cells, first_table + t, MOST_PROBES)
            home = probes(flat, cells, first_table + t, 1)[0][:, 0]
            hit = code[owner] == home[:, None]
            asked[t] = np.where(hit, far[owner], np.inf).min(axis=1)
            gaps.append(far)
        best: Plan | None = None
        tried = np.unique(np.quantile(np.concatenate(gaps)[:, 1:][np.isfinite(np.concatenate(gaps)[:, 1:])], np.linspace(0, 1, 41))) if np.isfinite(gaps[0][:, 1:]).any() else np.zeros(1)
        for tables in range(1, MOST_TABLES + 1):
            least = asked[:tables].min(axis=0)
            for reach in np.concatenate(([0.0], tried)):
                found, copies = float((least <= reach).mean()), float(sum((g <= reach).sum() for g in gaps[:tables]) / len(x))
                if found >= recall and copies <= MOST_COPIES and (best is None or copies < best.copies):
                    best = Plan(cells, tables, float(reach), found, copies)
        if best is not None:
            return best
        cells //= 2
    return Plan(1, 1, 0.0, 1.0, 1.0)


def pack(x: np.ndarray) -> np.ndarray:
    """Unit vectors as one float32 scale and int16 values each (bytes)."""
    top = np.abs(x).max(axis=1)
    q = np.rint(x / top[:, None] * 32767).astype(np.int16)
    out = np.empty((len(x), 4 + 2 * x.shape[1]), dtype=np.uint8)
    out[:, :4] = (top / 32767).astype(np.float32)[:, None].view(np.uint8).reshape(len(x), 4)
    out[:, 4:] = q.view(np.uint8).reshape(len(x), -1)
    return out


def unpack(raw: list[bytes] | np.ndarray) -> np.ndarray:
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)
    scale = np.ascontiguousarray(data[:, :4]).view(np.float32)
    return np.ascontiguousarray(data[:, 4:]).view(np.int16).astype(np.float32) * scale


def _packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, vectors = b.column(0), b.column(1)
            by_size: dict[int, list[int]] = {}
            lists = vectors.to_numpy(zero_copy_only=False)
            for i, v in enumerate(lists):
                if v is not None and len(v):
                    by_size.setdefault(len(v), []).append(i)
            for places in by_size.values():
                x = np.stack([lists[i] for i in places]).astype(np.float64)
                big = np.abs(x).max(axis=1)
                ok = np.isfinite(big) & (big > 0)
                x = x[ok] / big[ok, None]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if len(x):
                    at = pa.array(np.array(places)[ok])
                    yield pa.RecordBatch.from_arrays([keys.take(at), pa.array([r.tobytes() for r in pack(x)], pa.binary())], names=["id", "vec"])

    rows = df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    return rows.mapInArrow(run, "id string, vec binary")


def _best(x: np.ndarray, index: np.ndarray, ids: np.ndarray, index_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of ``index`` for each row of ``x`` without itself: (ids, cosines); -2 where there are fewer."""
    m = len(index)
    out_i, out_s = np.zeros((len(x), k), dtype=np.int64), np.full((len(x), k), -2.0, dtype=np.float32)
    order = np.argsort(index_ids)
    sorted_ids = index_ids[order]
    step = max(16, min(1024, (1 << 22) // max(m, 1)))
    for lo in range(0, len(x), step):
        sims = x[lo : lo + step] @ index.T
        own = ids[lo : lo + step]
        p = np.searchsorted(sorted_ids, own)
        there = (p < m) & (sorted_ids[np.minimum(p, m - 1)] == own)
        sims[np.nonzero(there)[0], order[p[there]]] = -2.0
        take = min(k, m)
        part = np.argpartition(-sims, take - 1, axis=1)[:, :take] if m > take else np.tile(np.arange(m), (len(sims), 1))
        s = np.take_along_axis(sims, part, axis=1)
        o = np.argsort(-s, axis=1, kind="stable")
        out_i[lo : lo + step, :take] = index_ids[np.take_along_axis(part, o, axis=1)]
        out_s[lo : lo + step, :take] = np.take_along_axis(s, o, axis=1)
    return out_i, out_s


_FOUND = "h long, near array<struct<s:float,h:long>>"


def _as_lists(ids: np.ndarray, near: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    ok = sims > -1.5
    ends = np.concatenate(([0], np.cumsum(ok.sum(axis=1)))).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(sims[ok], pa.float32()), pa.array(near[ok], pa.int64())], names=["s", "h"])
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=["h", "near"])


def _merge(found: DataFrame, k: int) -> DataFrame:
    """Of the lists of each vector the k best; every list is short, and there are few of them."""
    best = F.array_distinct(F.transform(F.sort_array(F.flatten(F.collect_list("near")), asc=False), lambda x: x["h"]))
    return found.groupBy("h").agg(F.slice(best, 1, k).alias("near"))


def _inner(x: np.ndarray, index: np.ndarray, ids: np.ndarray, index_ids: np.ndarray, k: int, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_best`, but with candidates from the finer cells of ``plan`` only."""
    who, near, sims = [], [], []
    for t in range(plan.tables):
        home = np.concatenate([probes(index[i : i + PART], plan.cells, INNER + t, 1)[0][:, 0] for i in range(0, len(index), PART)])
        order = np.argsort(home, kind="stable")
        held = home[order]
        parts = [probes(x[i : i + PART], plan.cells, INNER + t, MOST_PROBES) for i in range(0, len(x), PART)]
        code, far = np.concatenate([c for c, _ in parts]), np.concatenate([f for _, f in parts])
        row, col = np.nonzero(far <= plan.reach)
        asked = code[row, col]
        by = np.argsort(asked, kind="stable")
        row, asked = row[by], asked[by]
        starts = np.nonzero(np.diff(asked, prepend=-2))[0]
        for a, b in zip(starts, np.append(starts[1:], len(asked))):
            lo, hi = np.searchsorted(held, asked[a], "left"), np.searchsorted(held, asked[a], "right")
            if lo < hi:
                at, rows = order[lo:hi], row[a:b]
                n, s = _best(x[rows], index[at], ids[rows], index_ids[at], k)
                ok = s > -1.5
                who.append(np.repeat(rows, ok.sum(axis=1)))
                near.append(n[ok])
                sims.append(s[ok])
    out_i, out_s = np.zeros((len(x), k), dtype=np.int64), np.full((len(x), k), -2.0, dtype=np.float32)
    if not who:
        return out_i, out_s
    w, n, s = np.concatenate(who), np.concatenate(near), np.concatenate(sims)
    order = np.lexsort((n, -s, w))
    w, n, s = w[order], n[order], s[order]
    fresh = np.ones(len(w), dtype=bool)
    fresh[1:] = (w[1:] != w[:-1]) | (n[1:] != n[:-1])
    w, n, s = w[fresh], n[fresh], s[fresh]
    place = np.arange(len(w)) - np.searchsorted(w, w, "left")
    keep = place < k
    out_i[w[keep], place[keep]], out_s[w[keep], place[keep]] = n[keep], s[keep]
    return out_i, out_s


def cells_for(n: int, row_bytes: int) -> int:
    return max(1, round(math.sqrt(n) / 4), math.ceil(n * row_bytes / CELL_BYTES)) if n > BRUTE else 1


def _plans(reps: DataFrame, k: int, cells: int | None, brute: int) -> dict[int, tuple[int, Plan, Plan]]:
    """For each vector length (in bytes): vectors, the plan over all of them and the one within a cell."""
    out = {}
    for size, n in reps.groupBy(F.length("vec").alias("size")).count().collect():
        wanted = cells or cells_for(n, size)
        one = Plan(1, 1, 0.0, 1.0, 1.0)
        if wanted == 1:
            out[size] = (n, one, one)
            continue
        mine = reps.where(F.length("vec") == size)
        block = [(r[0], bytes(r[1])) for r in mine.orderBy(F.xxhash64("h"), "h").limit(SAMPLE).collect()]
        lists = {r[0]: list(r[1]) for r in _against_all(mine, block, k).collect()}
        wanted_ids = sorted({i for v in lists.values() for i in v})
        vec = {r[0]: bytes(r[1]) for r in mine.where(F.col("h").isin(wanted_ids)).select("h", "vec").collect()}
        x = unpack([v for _, v in block])
        near = [unpack([vec[i] for i in lists.get(h, [])]) if lists.get(h) else np.empty((0, x.shape[1]), np.float32) for h, _ in block]
        outer = choose_plan(x, near, wanted, 0)
        inside = n / outer.cells
        out[size] = (n, outer, choose_plan(x, near, max(1, round(inside / TARGET)), INNER) if inside > brute / 4 else one)
    return out


def _search(k: int, plans: dict[int, tuple[int, Plan, Plan]], brute: int):
    """Of one cell, or one part of it: for every row its k nearest among the stored rows."""

    def run(group: pa.Table) -> pa.Table:
        ids, stored = group.column("h").to_numpy(), group.column("stored").to_numpy(zero_copy_only=False)
        if not stored.any():
            return pa.table({"h": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.struct([("s", pa.float32()), ("h", pa.int64())])))})
        x = unpack(group.column("vec").to_pylist())
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        plan = plans[4 + 2 * x.shape[1]][2]
        if stored.sum() > brute and plan.cells > 1:
            near, sims = _inner(x[asks], x[stored], ids[asks], ids[stored], k, plan)
        else:
            near, sims = _best(x[asks], x[stored], ids[asks], ids[stored], k)
        return pa.Table.from_batches([_as_lists(ids[asks], near, sims)])

    return run


def nearest_classes(reps: DataFrame, k: int = K, cells: int | None = None, brute: int = BRUTE) -> DataFrame:
    """From (h, vec) without repeats: h and near, the hashes of its k nearest in order. ``cells`` and ``brute`` force the
    number of cells and the size up to which a cell is compared in full."""
    plans = _plans(reps, k, cells, brute)
    if not plans:
        return reps.sparkSession.createDataFrame([], "h long, near array<long>")

    def hashed(own_only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
                sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
                for size in np.unique(sizes):
                    at = np.nonzero(sizes == size)[0]
                    plan, x = plans[int(size)][1], unpack([raw[i] for i in at])
                    for t in range(plan.tables):
                        code, far = probes(x, plan.cells, t, 1 if own_only else MOST_PROBES)
                        row, col = np.nonzero((far <= plan.reach) | (np.arange(code.shape[1]) == 0))
                        where = at[row]
                        n = len(where)
                        cell = [pa.array(np.full(n, size), pa.int32()), pa.array(np.full(n, t), pa.int32()), pa.array(code[row, col])]
                        if own_only:
                            yield pa.RecordBatch.from_arrays(cell, names=["size", "t", "cell"])
                        else:
                            yield pa.RecordBatch.from_arrays([*cell, pa.array(ids[where]), pa.array(col == 0), b.column(1).take(pa.array(where))], names=["size", "t", "cell", "h", "own", "vec"])

        return run

    rows = reps.select("h", "vec").mapInArrow(hashed(False), "size int, t int, cell long, h long, own boolean, vec binary")
    most = max([2 * brute, *(4 * n // p.cells for n, p, _ in plans.values())])
    parts = F.lit(1)
    if max(n for n, _, _ in plans.values()) > most:
        hot = reps.select("h", "vec").mapInArrow(hashed(True), "size int, t int, cell long").groupBy("size", "t", "cell").count()
        hot = materialize(hot.where(F.col("count") > most).select("size", "t", "cell", F.ceil(F.col("count") / most).cast("int").alias("parts")), "hot")
        if not hot.isEmpty():
            rows = rows.join(hot, ["size", "t", "cell"], "left")
            parts = F.coalesce(F.col("parts"), F.lit(1))
    home = F.pmod(F.xxhash64("h"), parts)
    rows = rows.select("size", "t", "cell", "h", "vec", "own", home.alias("home"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    rows = rows.select("size", "t", "cell", "salt", "h", (F.col("own") & (F.col("home") == F.col("salt"))).alias("stored"), F.lit(True).alias("asks"), "vec")
    run = _search(k, plans, brute)
    found = materialize(_merge(rows.groupBy("size", "t", "cell", "salt").applyInArrow(run, _FOUND), k), "near")

    # whoever has found too few asks all vectors of its length, which lie in parts of at most about PART
    sized = reps.select("h", "vec", F.length("vec").alias("size"))
    count = F.create_map(*[F.lit(x) for size, (n, _, _) in plans.items() for x in (size, n)])
    few = materialize(sized.join(found.select("h", F.size("near").alias("got")), "h").where(F.col("got") < F.least(F.lit(k), count[F.col("size")] - 1)).select("h", "vec", "size"), "few")
    if few.isEmpty():
        return found
    n_parts = F.ceil(count[F.col("size")] / PART).cast("int")
    stored = sized.join(few.select("size").distinct(), "size", "left_semi").select("size", F.pmod(F.xxhash64("h"), n_parts).cast("int").alias("salt"), "h", "vec", F.lit(True).alias("stored"), F.lit(False).alias("asks"))
    asking = few.select("size", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("salt"), "h", "vec", F.lit(False).alias("stored"), F.lit(True).alias("asks"))
    exact = materialize(_merge(stored.unionByName(asking).groupBy("size", "salt").applyInArrow(_search(k, plans, 1 << 40), _FOUND), k), "exact")
    return found.join(few.select("h"), "h", "left_anti").unionByName(exact)


def _against_all(reps: DataFrame, block: list[tuple[int, bytes]], k: int) -> DataFrame:
    """The exact k nearest of a bounded block of queries, all of one length."""
    shared = reps.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = np.array([h for h, _ in shared.value], dtype=np.int64), unpack([v for _, v in shared.value])
        for b in batches:
            if b.num_rows:
                near, sims = _best(asked, unpack(b.column(1).to_pylist()), ids, b.column(0).to_numpy(), k)
                yield _as_lists(ids, near, sims)

    return _merge(reps.select("h", "vec").mapInArrow(run, _FOUND), k)


def nearest(df: DataFrame, key: str = "chunk_id", vector: str = "embedding", k: int = K, cells: int | None = None, brute: int = BRUTE) -> DataFrame:
    """id, near_id, place (from 1): the k nearest other ids of every id."""
    vectors = materialize(_packed(df, key, vector).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("h", F.xxhash64("vec")), "vectors")
    shared = materialize(vectors.groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("first")).where("c > 1"), "shared")
    reps = vectors.join(shared.select("h", "first"), "h", "left").where("first is null or first = id").select("h", "vec")
    near = nearest_classes(reps, k, cells, brute).select("h", F.posexplode("near").alias("place", "nh"))
    near = near.unionByName(shared.select("h", F.lit(-1).alias("place"), F.col("h").alias("nh")))
    # of each class the first k + 1 members can be named as neighbours
    members = vectors.select("h", "id")
    named = members.join(shared.select("h"), "h", "left_anti").unionByName(
        members.join(shared.select("h"), "h", "left_semi").withColumn("_r", F.row_number().over(W.partitionBy("h").orderBy("id"))).where(F.col("_r") <= k + 1).select("h", "id")
    )
    lists = near.join(named.select(F.col("h").alias("nh"), F.col("id").alias("near_id")), "nh").groupBy("h").agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "near_id"))), 1, k + 1).alias("near"))
    mine = F.slice(F.filter(F.transform("near", lambda x: x["near_id"]), lambda x: x != F.col("id")), 1, k)
    return members.join(lists, "h").select("id", F.posexplode(mine).alias("place", "near_id")).select("id", "near_id", (F.col("place") + 1).alias("place"))


def nearest_pairs(df: DataFrame, key: str = "chunk_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(a, b), the smaller id first, where one is among the k nearest of the other."""
    return nearest(df, key, vector, k).select(F.least("id", "near_id").alias("a"), F.greatest("id", "near_id").alias("b")).distinct()
