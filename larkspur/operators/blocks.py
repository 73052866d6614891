"""Postings in blocks of documents, and the best documents of every query by passes over the blocks.

A block is one row, so that all of a document lies in one task. A task scores its blocks for a pack of queries and keeps
the best of each, so that pairs of query and document are neither shuffled nor stored; every such pair is still scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from .expansion import union_all

BLOCK = 2048  # documents of a stored block, fewer than 65536
WIDTH = 8192  # documents scored at once, in whole blocks
PACK = 8192  # queries of a task
ROWS = 256  # queries scored at once
DENSE = 16  # a term of at least one in so many documents is added as a whole row

#: Row groups stay small, as a reader unpacks a whole one.
STORED = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4"}


# storing -------------------------------------------------------------------------------------------------------------


def _kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def postings(docs: DataFrame, key: str, fields: list[str], tags: str | None = None) -> DataFrame:
    """Rows of up to ``BLOCK`` documents: their keys (unique in docs) and of each field ``i`` the sizes, the terms, of each
    term the number of documents, then the documents and counts of all terms. ``tags``: an array of words that is stored
    as one field more."""
    lists = [tokens(f) for f in fields] + ([F.array_distinct(tags)] if tags else [])
    none = F.array().cast("array<string>")
    base = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), *[F.coalesce(x, none).alias(f"t{i}") for i, x in enumerate(lists)])
    n = len(lists)
    schema = f"doc array<{_kind(docs, key)}>" + "".join(f", n{i} long, sum{i} long, lens{i} binary, terms{i} array<string>, dfs{i} array<int>, docs{i} binary, tfs{i} binary" for i in range(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                rows, out = b.num_rows, {"doc": pa.array([b.column(0).to_pylist()], pa.list_(b.column(0).type))}
                for i in range(n):
                    lens = pc.list_value_length(b.column(1 + i)).to_numpy(zero_copy_only=False).astype(np.int32)
                    words = b.column(1 + i).flatten().dictionary_encode()
                    each = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * rows + np.repeat(np.arange(rows), lens)
                    each, tf = np.unique(each, return_counts=True)
                    dfs = np.bincount(each // rows, minlength=len(words.dictionary)).astype(np.int32)
                    out |= {
                        f"n{i}": pa.array([int((lens > 0).sum())], pa.int64()), f"sum{i}": pa.array([int(lens.sum())], pa.int64()), f"lens{i}": pa.array([lens.tobytes()], pa.binary()),
                        f"terms{i}": pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary), f"dfs{i}": pa.ListArray.from_arrays(pa.array([0, len(dfs)], pa.int32()), pa.array(dfs)),
                        f"docs{i}": pa.array([(each % rows).astype(np.uint16).tobytes()], pa.binary()), f"tfs{i}": pa.array([tf.astype(np.int32).tobytes()], pa.binary()),
                    }
                yield pa.RecordBatch.from_pydict(out)

    return base.mapInArrow(run, schema)


def sizes(blocks: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n, avg_len): documents that have a token in the field and their average size."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n{i}").alias("n"), F.col(f"sum{i}").alias("s")) for i, f in enumerate(fields)]))
    return blocks.select(each.alias("x")).groupBy("x.field").agg(F.sum("x.n").alias("n"), F.sum("x.s").alias("s")).where("n > 0").select("field", "n", (F.col("s") / F.col("n")).alias("avg_len"))


def frequencies(blocks: DataFrame, n: int) -> DataFrame:
    """(at, term, df): documents that hold a term in the field of this number."""
    out = None
    for i in range(n):
        part = blocks.select(F.lit(i).alias("at"), F.explode(F.arrays_zip(f"terms{i}", f"dfs{i}")).alias("x")).select("at", F.col(f"x.terms{i}").alias("term"), F.col(f"x.dfs{i}").alias("df"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("at", "term").agg(F.sum("df").alias("df"))


def weighed(blocks: DataFrame, asked: list[dict[str, float] | None], avg_len: list[float], k1: float, b: float) -> DataFrame:
    """The blocks with asked terms only and, of each field, what a posting adds to its score. asked: of each field the
    terms with their weight, or None where the field has no scores; a term's code is its place there."""
    spark, kind = blocks.sparkSession, blocks.schema["doc"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(asked)
    schema = f"doc {kind}" + "".join(f", codes{i} binary, dfs{i} binary, docs{i} binary, gains{i} binary" for i in range(len(asked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [pa.array(list(a or {}), pa.string()) for a in shared.value]
        weight = [np.array(list((a or {}).values()), dtype=float) for a in shared.value]
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                out, some = {"doc": one.column("doc")}, False
                for i, words in enumerate(known):
                    code = pc.index_in(one.column(f"terms{i}").flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
                    dfs = one.column(f"dfs{i}").flatten().to_numpy(zero_copy_only=False)
                    kept = np.flatnonzero(code >= 0)
                    every = np.repeat(code >= 0, dfs)
                    docs = np.frombuffer(one.column(f"docs{i}")[0].as_buffer(), np.uint16)[every]
                    gains = np.zeros(0)
                    if len(kept) and shared.value[i] is not None and avg_len[i]:
                        tf = np.frombuffer(one.column(f"tfs{i}")[0].as_buffer(), np.int32)[every].astype(float)
                        size = np.frombuffer(one.column(f"lens{i}")[0].as_buffer(), np.int32)[docs]
                        gains = np.repeat(weight[i][code[kept]], dfs[kept]) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / avg_len[i]))
                    some = some or len(kept) > 0
                    for name, x in (("codes", code[kept].astype(np.int32)), ("dfs", dfs[kept].astype(np.int32)), ("docs", docs), ("gains", gains)):
                        out[f"{name}{i}"] = pa.array([x.tobytes()], pa.binary())
                if some:
                    yield pa.RecordBatch.from_pydict(out)

    return blocks.mapInArrow(run, schema)


# scoring -------------------------------------------------------------------------------------------------------------


def keys(ids: pa.Array, as_text: bool = False) -> np.ndarray:
    """Ids in an order of their own: numbers, or UTF-8 text by its bytes."""
    if pa.types.is_integer(ids.type) and not as_text:
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.array([str(x).encode() for x in ids.to_pylist()], dtype="S")


class Best:
    """The k best of each of n queries over scores offered in parts; scores are compared at six decimals, ties go to the
    smaller key. Only scores from ``least`` on count, without it those above 0."""

    def __init__(self, n: int, k: int, least: float | None = None) -> None:
        self.k, self.floor = k, least
        self.score, self.key, self.count = np.full((n, k), -np.inf), None, np.zeros(n, dtype=np.int64)
        self.enough = np.full(n, 5e-324 if least is None else least - 6e-7)

    def offer(self, first: int, scores: np.ndarray, key: np.ndarray) -> None:
        """scores: (queries from ``first`` on, documents of ``key``)."""
        k, (n, width) = self.k, scores.shape
        enough = self.enough[first : first + n]
        mask = scores >= enough[:, None]
        many = np.flatnonzero(np.count_nonzero(mask, axis=1) > 2 * k)
        if len(many):  # what is under the k-th by more than the rounding can't come in
            some = scores[many]
            kth = np.partition(some, width - k, axis=1)[:, width - k]
            mask[many] = some >= np.maximum(enough[many], kth - 1.1e-6)[:, None]
        r, c = np.nonzero(mask)
        if not len(r):
            return
        s, key, r = np.floor(scores[r, c] * 1000000 + 0.5) / 1000000.0, key[c], r + first
        if self.key is None:
            self.key = np.zeros(self.score.shape, dtype=key.dtype)
        if self.key.dtype.itemsize < key.dtype.itemsize:
            self.key = self.key.astype(key.dtype)
        last = self.score[r, k - 1]
        keep = (s > last) | ((s == last) & (key < self.key[r, k - 1]))
        if self.floor is not None:
            keep &= s >= self.floor
        r, s, key = r[keep], s[keep], key[keep]
        rows = np.unique(r)
        held = np.repeat(rows, self.count[rows])
        place = np.arange(len(held)) - np.repeat(np.cumsum(self.count[rows]) - self.count[rows], self.count[rows])
        r, s, key = np.concatenate([held, r]), np.concatenate([self.score[held, place], s]), np.concatenate([self.key[held, place], key])
        order = np.lexsort((key, -s, r))
        r, s, key = r[order], s[order], key[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        r, s, key, place = (x[place < k] for x in (r, s, key, place))
        self.score[r, place], self.key[r, place] = s, key
        self.count[rows] = np.bincount(r, minlength=len(self.count))[rows]
        full = rows[self.count[rows] == k]
        self.enough[full] = np.maximum(self.enough[full], self.score[full, k - 1] - 6e-7)

    def rows(self, ids: list[int], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(set, doc, score, rank)"""
        for at in range(0, len(ids), 1024):
            n = self.count[at : at + 1024]
            r = np.repeat(np.arange(at, at + len(n)), n)
            if not len(r):
                continue
            p = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            doc = self.key[r, p]
            doc = pa.array([x.decode() for x in doc.tolist()] if doc.dtype.kind == "S" else doc).cast(kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, dtype=np.int64)[r]), doc, pa.array(self.score[r, p]), pa.array((p + 1).astype(np.int32))], names=["set", "doc", "score", "rank"])


class _Field:
    """The postings of a field in several blocks, by the code of the term."""

    def __init__(self, parts: list[tuple[int, pa.RecordBatch, int]], i: int, width: int, used: np.ndarray, gains: bool) -> None:
        codes, docs, values = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for start, b, at in parts:
            read = lambda name, kind: np.frombuffer(b.column(f"{name}{i}")[at].as_buffer(), kind)  # noqa: B023, E731
            codes.append(np.repeat(read("codes", np.int32), read("dfs", np.int32)))
            docs.append(read("docs", np.uint16).astype(np.int64) + start)
            values.append(read("gains", np.float64) if gains else np.ones(len(docs[-1])))
        code, doc, value = np.concatenate(codes), np.concatenate(docs), np.concatenate(values)
        order = np.argsort(np.where(used[code], code, len(used)), kind="stable") if len(code) else np.zeros(0, np.int64)
        order = order[: int(used[code].sum())] if len(code) else order
        code, doc, value = code[order], doc[order], value[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        self.of: dict[int, tuple[np.ndarray | None, np.ndarray]] = {}
        for a, z in zip(first, np.r_[first[1:], len(code)]):
            if (z - a) * DENSE >= width:
                row = np.zeros(width)
                row[doc[a:z]] = value[a:z]
                self.of[int(code[a])] = (None, row)
            else:
                self.of[int(code[a])] = (doc[a:z], value[a:z])

    def add(self, codes: list[int], out: np.ndarray) -> bool:
        """Add what the terms give to ``out``, which is zero; whether there is any."""
        some = False
        for c in codes:
            if (x := self.of.get(c)) is not None:
                some = True
                if x[0] is None:
                    out += x[1]
                else:
                    out[x[0]] += x[1]
        return some

    def count(self, codes: list[int], width: int) -> np.ndarray:
        out = np.zeros(width, dtype=np.int32)
        for c in codes:
            if (x := self.of.get(c)) is not None:
                if x[0] is None:
                    out += x[1] > 0
                else:
                    out[x[0]] += 1
        return out

    def bits(self, code: int, width: int) -> np.ndarray | None:
        if (x := self.of.get(code)) is None:
            return None
        row = np.zeros(width, dtype=bool)
        row[slice(None) if x[0] is None else x[0]] = x[1] > 0
        return np.packbits(row)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, pa.RecordBatch, int]], int]]:
    """Blocks together, up to about ``WIDTH`` documents; each with where its documents begin."""
    parts, width = [], 0
    for b in batches:
        sizes_ = pc.list_value_length(b.column("doc")).to_pylist()
        for at, n in enumerate(sizes_):
            if parts and width + n > WIDTH:
                yield parts, width
                parts, width = [], 0
            parts.append((width, b, at))
            width += n
    if parts:
        yield parts, width


def _codes(lists: list[list[str]], asked: dict[str, float] | None) -> tuple[list[list[int]], np.ndarray]:
    """The codes of each list's known terms, and which codes are used at all."""
    place = {t: i for i, t in enumerate(asked or {})}
    out = [[place[t] for t in terms if t in place] for terms in lists]
    used = np.zeros(len(place), dtype=bool)
    used[[c for codes in out for c in codes]] = True
    return out, used


def packs(sets: list, cores: int, size: int = PACK) -> tuple[list[list], int]:
    """The queries in packs, as many for each core, and into how many parts blocks must go to keep all cores busy."""
    n = -(-len(sets) // (size * cores)) * cores if len(sets) >= 64 * cores else max(1, len(sets) // 64)
    return [sets[i::n] for i in range(n)], max(1, -(-cores // n))


def best(blocks: DataFrame, sets: list[tuple], asked: list[dict[str, float]], boosts: list[float], k: int, every_term: bool = False, tag_boost: float | None = None) -> DataFrame:
    """(set, doc, score, rank): the k best documents of each set; blocks as :func:`weighed` gives them. sets: (set, terms,
    number of terms that must be found, tags). Boosts are positive. With ``tag_boost`` the last field of the blocks holds
    tags, and a document that shares one has so much more."""
    kind = blocks.schema["doc"].dataType.elementType
    schema = f"set long, doc {kind.simpleString()}, score double, rank int"
    n_fields = len(boosts)

    def search(pack: list[tuple], parts: int) -> DataFrame:
        shared = blocks.sparkSession.sparkContext.broadcast((pack, asked))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack, asked = shared.value
            of = [_codes([x[1] for x in pack], a) for a in asked[:n_fields]]
            tags = _codes([x[3] for x in pack], asked[n_fields]) if tag_boost is not None else None
            found, type_ = Best(len(pack), k), None
            spare = np.zeros(0)
            for parts, width in _wide(batches):
                ids = pa.concat_arrays([b.column("doc").slice(at, 1).flatten() for _, b, at in parts])
                key, type_ = keys(ids), ids.type
                fields = [_Field(parts, i, width, of[i][1], True) for i in range(n_fields)]
                tagged = _Field(parts, n_fields, width, tags[1], False) if tags else None
                if len(spare) != width:
                    spare = np.zeros(width)
                for first in range(0, len(pack), ROWS):
                    scores = np.zeros((min(ROWS, len(pack) - first), width))
                    for j, out in enumerate(scores):
                        begun = False
                        for i, boost in enumerate(boosts):
                            codes = of[i][0][first + j]
                            at = spare if begun else out
                            if begun:
                                at.fill(0)
                            if not fields[i].add(codes, at):
                                continue
                            if every_term:
                                at *= fields[i].count(codes, width) == pack[first + j][2]
                            if boost != 1:
                                at *= boost
                            if begun:
                                np.maximum(out, at, out=out)
                            begun = True
                        if tagged:
                            spare.fill(0)
                            if tagged.add(tags[0][first + j], spare):
                                out += (spare > 0) * tag_boost
                    found.offer(first, scores, key)
            if type_ is not None:
                yield from found.rows([x[0] for x in pack], type_)

        return blocks.coalesce(parts).mapInArrow(run, schema)

    return _over_packs(blocks, sets, search, schema, lambda df: ranked(df, k))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each set from those of several parts."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy("set").orderBy(F.col("score").desc(), "doc"))).where(F.col("rank") <= k)


def _over_packs(blocks: DataFrame, sets: list, search, schema: str, merge, size: int = PACK) -> DataFrame:
    if not sets:
        return blocks.sparkSession.createDataFrame([], schema)
    several, parts = packs(sets, blocks.sparkSession.sparkContext.defaultParallelism, size)
    if len(several) == 1:
        return merge(search(several[0], parts)) if parts > 1 else search(several[0], 1)
    if parts > 1:
        return merge(union_all([search(pack, parts) for pack in several]))
    # the first goes over two parts, as Spark makes one task of a union whose members all have one partition
    return union_all([merge(search(several[0], 2)), *[search(pack, 1) for pack in several[1:]]])


def hits(blocks: DataFrame, sets: list[tuple], asked: list[dict[str, float]]) -> DataFrame:
    """(set, hits): how many documents hold a term of the set in any field."""

    def search(pack: list[tuple], parts: int) -> DataFrame:
        shared = blocks.sparkSession.sparkContext.broadcast((pack, asked))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack, asked = shared.value
            terms = {t: i for i, t in enumerate(sorted({t for x in pack for t in x[1]}))}
            lists = [np.array([terms[t] for t in x[1]]) for x in pack]
            of = [_codes([[t] for t in terms], a) for a in asked]
            total = np.zeros(len(pack), dtype=np.int64)
            for parts, width in _wide(batches):
                padded = -(-width // 64) * 64
                fields = [_Field(parts, i, padded, of[i][1], False) for i in range(len(asked))]
                held = np.zeros((len(terms), padded // 8), dtype=np.uint8)
                for f, (codes, _) in zip(fields, of):
                    for t, code in enumerate(codes):
                        if code and (x := f.bits(code[0], padded)) is not None:
                            held[t] |= x
                words = held.view(np.uint64)
                for s, own in enumerate(lists):
                    total[s] += int(np.bitwise_count(np.bitwise_or.reduce(words[own], axis=0)).sum())
            if len(pack):
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pack], pa.int64()), pa.array(total)], names=["set", "hits"])

        return blocks.select("doc", *[f"{c}{i}" for i in range(len(asked)) for c in ("codes", "dfs", "docs")]).coalesce(parts).mapInArrow(run, "set long, hits long")

    return _over_packs(blocks, sets, search, "set long, hits long", lambda df: df.groupBy("set").agg(F.sum("hits").alias("hits"))).where("hits > 0")


def similar(vectors: DataFrame, sets: list[tuple[int, np.ndarray]], k: int, least: float) -> DataFrame:
    """(set, doc, score, rank): the k documents of greatest cosine for each set, from ``least`` on; ties go to the first by
    the text of the key. vectors: blocks (doc, values), the values whole numbers; sets: (set, vector), none of them zero."""
    kind = vectors.schema["doc"].dataType.elementType
    schema = f"set long, doc {kind.simpleString()}, score double, rank int"

    def search(pack: list[tuple], parts: int) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(([x[0] for x in pack], np.array([x[1] for x in pack], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            length, found, type_ = np.sqrt((q * q).sum(axis=1)), Best(len(ids), k, least), None
            for parts, _ in _wide(batches):
                docs = pa.concat_arrays([b.column("doc").slice(at, 1).flatten() for _, b, at in parts])
                v = np.concatenate([np.frombuffer(b.column("values")[at].as_buffer(), np.int32) for _, b, at in parts]).reshape(len(docs), -1).astype(np.float64)
                size = np.sqrt((v * v).sum(axis=1))
                some = np.flatnonzero(size > 0)
                if not len(some):
                    continue
                v, size, key, type_ = v[some], size[some], keys(docs, as_text=True)[some], docs.type
                exact = np.float32 if length.max() * size.max() < 2**24 else np.float64  # sums of whole numbers stay whole
                v, own = v.astype(exact).T, q.astype(exact)
                for first in range(0, len(ids), ROWS):
                    found.offer(first, (own[first : first + ROWS] @ v) / (length[first : first + ROWS, None] * size), key)
            if type_ is not None:
                yield from found.rows(ids, type_)

        return vectors.coalesce(parts).mapInArrow(run, schema)

    def merge(df: DataFrame) -> DataFrame:
        order = W.partitionBy("set").orderBy(F.col("score").desc(), F.col("doc").cast("string"))
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    return _over_packs(vectors, sets, search, schema, merge)


def exploded(blocks: DataFrame, fields: list[str], asked: list[dict[str, float]]) -> DataFrame:
    """(term, field, doc, gain): the postings of the blocks that :func:`weighed` gives, one by one."""
    kind = blocks.schema["doc"].dataType.elementType.simpleString()
    shared = blocks.sparkSession.sparkContext.broadcast([list(a) for a in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                ids = b.column("doc").slice(at, 1).flatten()
                for i, f in enumerate(fields):
                    read = lambda name, kind: np.frombuffer(b.column(f"{name}{i}")[at].as_buffer(), kind)  # noqa: B023, E731
                    docs = read("docs", np.uint16)
                    term = pa.array(shared.value[i], pa.string()).take(pa.array(np.repeat(read("codes", np.int32), read("dfs", np.int32))))
                    yield pa.RecordBatch.from_arrays([term, pa.array([f] * len(docs), pa.string()), ids.take(pa.array(docs)), pa.array(read("gains", np.float64))], names=["term", "field", "doc", "gain"])

    return blocks.mapInArrow(run, f"term string, field string, doc {kind}, gain double")
