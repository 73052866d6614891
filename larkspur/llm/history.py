"""Checking each new batch against everything accepted so far, without going through the history again.

Equal bodies form one class; only one body of a class is fingerprinted. A fingerprint has 128 bits, each the lowest bit
of a min-hash over the runs of three words, so two bodies of likeness J differ in about 128 (1 - J) / 2 bits. Its block
tables hold, for each of ``BLOCKS`` rotations, a key over ``PER_BLOCK`` of the min-hashes whose bits the rotation puts
in front. A batch looks up exact block matches, keeps pairs within ``MOST_DIFFERENT`` bits, and verifies the likeness on
the texts. Keys over whole min-hashes and not over bare bits are needed here: at a likeness of 0.7 a SimHash of 64 bits
differs in about 12, which leaves no block that is both equal and rare. Of pairs at exactly 0.7 a share of
(1 - 0.7^5)^36 = 0.13 % is missed, of pairs at 0.8 less than one in a million.

Which rows are accepted depends on earlier rows, so the links of a batch are settled in rounds: a row is a repeat once a
linked earlier row is accepted, and accepted once all of them are repeats. Rows of one class under one document id act
as one; within a class only the first two documents, and documents that also occur in another class, can decide
anything, so no class is ever joined with itself row by row.

The index lies in three tables (documents, bodies, blocks). Each append adds a segment to each, parted into shards of
about ``SHARD_ROWS`` rows by a hash of the key that the table is asked for. A batch reads the shards in which its keys
fall and no others, so that what a batch of a given size reads does not grow with the history once that has more shards
than the batch has keys; a batch with more keys than that reads the keys through, 36 a body, but texts only of candidates.
A class stands for its body by the first 128 bits of its SHA-256.

Defined results: rows with a null body, document id, batch or sequence number are no cases and are not accepted. Bodies of
fewer than three words only match equal ones. Repeated rows act as one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize, scratch_path
from .text import WordHasher, mix, shingles, words

LEAST_LIKENESS = 0.7
RUN = 3
BLOCKS, PER_BLOCK, BITS = 36, 5, 128
MOST_DIFFERENT = 38
#: Rows of a shard: a few MB of keys, some ten MB of texts.
SHARD_ROWS = {"nodes": 1 << 17, "bodies": 1 << 12, "blocks": 1 << 17}
_BODY = "cls binary, body string, bits binary, keys array<long>"
_TABLES = {"nodes": ("cls", "cls binary, doc string, first struct<b:long,s:long>"), "bodies": ("cls", "cls binary, body string, bits binary"), "blocks": ("key", "key long, cls binary")}


def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    n = BLOCKS * PER_BLOCK
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def min_hashes(runs: np.ndarray) -> np.ndarray:
    a, c = _hash_family()
    with np.errstate(over="ignore"):
        return ((runs[:, None] * a[None, :] + c[None, :]) >> np.uint64(32)).min(axis=0)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared runs over all runs of two sorted arrays without repeats; 0 when either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sketch(bodies: DataFrame) -> DataFrame:
    """(cls, body) with the fingerprint bits and the block keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        salt = mix(np.arange(1, BLOCKS + 1, dtype=np.uint64))
        for b in batches:
            bits, keys = [], []
            for t in b.column(1).to_pylist():
                runs = shingles(hasher(words(t)), RUN)
                if not len(runs):
                    bits.append(None)
                    keys.append([])
                    continue
                low = min_hashes(runs)
                bits.append(np.packbits((low[:BITS] & np.uint64(1)).astype(np.uint8)).tobytes())
                with np.errstate(over="ignore"):
                    key = salt.copy()
                    for column in low.reshape(BLOCKS, PER_BLOCK).T:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["cls", "body", "bits", "keys"])

    return bodies.mapInArrow(run, _BODY)


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """The (a, b) of (a, b, body_a, body_b) whose likeness reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        known: dict[bytes, np.ndarray] = {}

        def runs(cls: bytes, body: str) -> np.ndarray:
            got = known.get(cls)
            if got is None:
                if len(known) > 2000:
                    known.clear()
                got = known[cls] = shingles(hasher(words(body)), RUN)
            return got

        for b in batches:
            a_, b_, ta, tb = (c.to_pylist() for c in b.columns)
            keep = [likeness(runs(i, x), runs(j, y)) >= least for i, j, x, y in zip(a_, b_, ta, tb)]
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(m), b.column(1).filter(m)], names=["a", "b"])

    return pairs.select("a", "b", "body_a", "body_b").mapInArrow(run, "a binary, b binary")


def rows_of(df: DataFrame, batch: str | Column = "batch_id", seq: str | Column = "arrival_seq", doc: str | Column = "doc_id", body: str | Column = "content.body") -> DataFrame:
    """Rows in the operator's form: cls, doc, at (batch, sequence), body."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = df.select(F.substring(F.unhex(F.sha2(col(body), 256)), 1, 16).alias("cls"), col(doc).alias("doc"), F.struct(col(batch).cast("long").alias("b"), col(seq).cast("long").alias("s")).alias("at"), col(body).alias("body"))
    return out.where("body is not null and doc is not null and at.b is not null and at.s is not null")


def _nodes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cls", "doc").agg(F.min("at").alias("first"), F.max("at").alias("last"))


@dataclass
class History:
    """The accepted documents: tables below ``root``."""

    spark: SparkSession
    root: str
    shard_rows: int | None = None

    @classmethod
    def create(cls, spark: SparkSession, root: str | None = None, shard_rows: int | None = None) -> History:
        """A history below ``root``, which lasts; without one it lies in the scratch space and goes with the session."""
        return cls(spark, root or scratch_path(spark, "history"), shard_rows)

    def _segments(self, name: str) -> list[tuple[str, int, set[int]]]:
        """(path, shards, those that hold anything) of each segment."""
        conf, path = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        top = path(f"{self.root}/{name}")
        fs = top.getFileSystem(conf)
        out = []
        for seg in fs.listStatus(top) if fs.exists(top) else []:
            seg = seg.getPath()
            held = {int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(seg) if x.getPath().getName().startswith("shard=")}
            out.append((seg.toString(), int(seg.getName().split("-")[1]), held))
        return sorted(out)

    def lookup(self, name: str, asked: DataFrame) -> DataFrame:
        """Rows of a table from the shards that the keys of ``asked`` (one column) fall into; a superset of those asked for."""
        key, schema = _TABLES[name]
        segments = self._segments(name)
        if not segments:
            return self.spark.createDataFrame([], schema)
        h = F.xxhash64(asked.columns[0])
        sizes = sorted({n for _, n, _ in segments})
        # as many numbers as there are shards, at most
        want = asked.agg(*[F.collect_set(F.pmod(h, F.lit(n))).alias(f"s{n}") for n in sizes]).first()
        paths = []
        for path, n, held in segments:
            hit = held & set(want[f"s{n}"])
            paths += [path] if hit == held else [f"{path}/shard={i}" for i in sorted(hit)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def _append(self, df: DataFrame, name: str) -> None:
        df = materialize(df, name)
        n = max(1, -(-df.count() // (self.shard_rows or SHARD_ROWS[name])))
        number = len(self._segments(name))
        rows = df.withColumn("shard", F.pmod(F.xxhash64(_TABLES[name][0]), F.lit(n)))
        rows.repartition(min(n, 10_000), "shard").write.partitionBy("shard").option("compression", "zstd").parquet(f"{self.root}/{name}/{number:06}-{n}")

    def start(self, rows: DataFrame) -> None:
        """Take rows into an empty history, all as accepted."""
        bodies = materialize(_sketch(rows.groupBy("cls").agg(F.min("body").alias("body"))), "bodies")
        self.append(_nodes(rows), bodies)

    def append(self, nodes: DataFrame, bodies: DataFrame) -> None:
        """Add accepted documents; ``bodies`` (cls, body, bits, keys) may hold classes that are known or not accepted."""
        mine = nodes.select("cls").distinct()
        fresh = bodies.join(mine, "cls", "left_semi").join(self.lookup("nodes", mine).select("cls"), "cls", "left_anti")
        fresh = materialize(fresh, "fresh")
        self._append(fresh.select(F.explode("keys").alias("key"), "cls"), "blocks")
        self._append(fresh.select("cls", "body", "bits"), "bodies")
        self._append(nodes.select("cls", "doc", "first"), "nodes")


@dataclass
class Checked:
    pairs: DataFrame  # doc (the repeat), accepted (the document that it repeats)
    accepted: DataFrame  # cls, doc, first
    bodies: DataFrame  # cls, body, bits, keys of the batch


def near_classes(bodies: DataFrame, history: History, least: float = LEAST_LIKENESS) -> DataFrame:
    """(a, b): a is a class of the batch, b another class of the batch or of the history, both ways within the batch."""
    mine = bodies.select(F.explode("keys").alias("key"), "cls")
    left, right = mine.withColumnRenamed("cls", "a"), mine.withColumnRenamed("cls", "b")
    old = history.lookup("blocks", mine.select("key")).select("key", F.col("cls").alias("b"))
    inside = left.join(right, "key").where("a < b").select("a", "b", F.lit(True).alias("own"))
    across = left.join(old, "key").where("a <> b").select("a", "b", F.lit(False).alias("own"))
    pairs = materialize(inside.unionByName(across).groupBy("a", "b").agg(F.max("own").alias("own")), "pairs")
    others = pairs.where("not own").select(F.col("b").alias("cls")).distinct()
    known = bodies.select("cls", "body", "bits").unionByName(history.lookup("bodies", others).join(bodies.select("cls"), "cls", "left_anti"))
    bits = known.select("cls", "bits")
    different = F.lit(0)
    for i in (1, 9):
        word = lambda c, i=i: F.conv(F.hex(F.substring(c, i, 8)), 16, -10).cast("long")
        different = different + F.bit_count(word(F.col("bits_a")).bitwiseXOR(word(F.col("bits_b"))))
    close = (
        pairs.join(bits.select(F.col("cls").alias("a"), F.col("bits").alias("bits_a")), "a")
        .join(bits.select(F.col("cls").alias("b"), F.col("bits").alias("bits_b")), "b")
        .where(different <= MOST_DIFFERENT)
        .select("a", "b", "own")
    )
    close = materialize(close, "close")
    wanted = close.select(F.col("a").alias("cls")).unionByName(close.select(F.col("b").alias("cls"))).distinct()
    texts = known.select("cls", "body").join(wanted, "cls", "left_semi")
    with_text = close.join(texts.select(F.col("cls").alias("a"), F.col("body").alias("body_a")), "a").join(texts.select(F.col("cls").alias("b"), F.col("body").alias("body_b")), "b")
    near = materialize(_verified(with_text, least), "near").join(close, ["a", "b"]).select("a", "b", "own")
    return near.select("a", "b").unionByName(near.where("own").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def check(history: History, rows: DataFrame, least: float = LEAST_LIKENESS) -> Checked:
    """Find what each row repeats among the history and the accepted rows before it."""
    nodes = materialize(_nodes(rows), "nodes")
    bodies = materialize(_sketch(rows.groupBy("cls").agg(F.min("body").alias("body"))), "bodies")
    near = near_classes(bodies, history, least)
    links = materialize(near.unionByName(bodies.select(F.col("cls").alias("a"), F.col("cls").alias("b"))), "links")

    # what can decide about a row: the first two documents of a class, and documents found in several classes
    order = W.partitionBy("cls").orderBy("first", "doc")
    linked = links.select(F.col("b").alias("cls")).distinct()
    old = history.lookup("nodes", linked).join(linked, "cls", "left_semi").select("cls", "doc", "first")
    old_anchor = old.withColumn("_r", F.row_number().over(order)).where("_r <= 2").drop("_r")
    first_two = nodes.select("cls", "doc", "first").withColumn("_r", F.row_number().over(order)).where("_r <= 2").drop("_r")
    several = nodes.join(nodes.groupBy("doc").agg(F.count("*").alias("_c")).where("_c > 1").select("doc"), "doc", "left_semi").select("cls", "doc", "first")
    anchor = first_two.unionByName(several).distinct()

    def edges(to: DataFrame) -> DataFrame:
        to = to.select(F.col("cls").alias("b"), F.col("doc").alias("doc_s"), F.col("first").alias("first_s"))
        return nodes.select(F.col("cls").alias("a"), "doc", "first").join(links, "a").join(to, "b").where("doc <> doc_s and first_s < first")

    repeats = edges(old_anchor).select(F.col("a").alias("cls"), "doc").distinct()
    repeats = materialize(repeats, "repeats")
    waits = edges(anchor).select(F.col("a").alias("cls"), "doc", F.col("b").alias("cls_s"), "doc_s")
    waits = waits.join(repeats, ["cls", "doc"], "left_anti").join(repeats.select(F.col("cls").alias("cls_s"), F.col("doc").alias("doc_s")), ["cls_s", "doc_s"], "left_anti")
    waits = materialize(waits.select("cls", "doc", "cls_s", "doc_s"), "waits")
    gone = repeats
    while not waits.isEmpty():
        waiting = waits.select("cls", "doc").distinct()
        ready = waits.select(F.col("cls_s").alias("cls"), F.col("doc_s").alias("doc")).distinct().join(waiting, ["cls", "doc"], "left_anti")
        ready_s = ready.select(F.col("cls").alias("cls_s"), F.col("doc").alias("doc_s"))
        # linked to an accepted row: a repeat; what waited for it alone is accepted in the next round
        new = materialize(waits.join(ready_s, ["cls_s", "doc_s"], "left_semi").select("cls", "doc").distinct(), "repeats")
        gone = gone.unionByName(new)
        left = waits.join(new, ["cls", "doc"], "left_anti").join(new.select(F.col("cls").alias("cls_s"), F.col("doc").alias("doc_s")), ["cls_s", "doc_s"], "left_anti")
        waits = materialize(left.select("cls", "doc", "cls_s", "doc_s"), "waits")
    accepted = materialize(nodes.join(gone, ["cls", "doc"], "left_anti").select("cls", "doc", "first"), "accepted")

    known = old.unionByName(accepted).select(F.col("cls").alias("b"), F.col("doc").alias("accepted"), F.col("first").alias("first_s"))
    pairs = nodes.select(F.col("cls").alias("a"), "doc", "last").join(links, "a").join(known, "b").where("doc <> accepted and first_s < last").select("doc", "accepted").distinct()
    return Checked(pairs, accepted, bodies)


def check_and_append(history: History, rows: DataFrame, least: float = LEAST_LIKENESS) -> Checked:
    """One batch: find its repeats, then take what is accepted into the history."""
    found = check(history, rows, least)
    found = Checked(materialize(found.pairs, "pairs"), found.accepted, found.bodies)
    history.append(found.accepted, found.bodies)
    return found


def with_manifest(pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    """The pairs with the accepted document's hash: of several entries the latest counts, in lower case; null without one."""
    latest = manifest.where("doc_id is not null").groupBy(F.col("doc_id").alias("accepted")).agg(F.max(F.struct("indexed_at", F.lower("content_hash").alias("h"))).alias("_e"))
    return pairs.join(latest, "accepted", "left").select("doc", "accepted", F.col("_e.h").alias("content_hash"))
