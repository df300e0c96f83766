"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Distinct fingerprints are dealt into tiles of neighbours by the bit counts of their four 16-bit parts. The bit
counts of two fingerprints within the radius differ, summed over the parts, by no more than the radius, so
pairs of tiles further apart are skipped; all other pairs are compared in full with numpy exclusive-or and bit counts.
A task returns a spanning forest of the links it found, which has no more edges than the two tiles have members.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, written
from .components import components
from .tokens import LOWER_BYTES, SPACE, chunks, normalised, words, xxh64

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a tile: about a TILES-th of all, within these bounds.
TILE_LEAST, TILE_MOST, TILES = 4096, 65536, 24
#: Comparisons made at a time, in buffers that stay in a core's cache.
BLOCK = 1 << 17
PARTS = 4


def bit_majorities(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """For the hashes from per[i] to per[i + 1]: the number whose bits are set in over half of them; 0 if there are none.

    Bits are summed in byte lanes, at most 255 hashes at a time.
    """
    n = np.diff(per)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    parts = (n[some] + 254) // 255
    text = np.repeat(np.arange(len(some)), parts)
    step = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    begins = per[some][text] + 255 * step
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    hashes = hashes[: per[-1]]
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101), begins)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * counts > n[some][:, None]).astype(np.uint8)
        out[some] |= over.reshape(-1).view("<u8").astype(np.uint64) << np.uint64(bit)
    return out


def fingerprint_batch(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text: bits set in over half of the hashes of its 4-word shingles, repeats included."""
    out = [np.zeros(0, np.uint64)]
    for _, _, data, offsets in chunks(column):
        data = LOWER_BYTES[data]
        starts, ends, per = words(data, offsets, SPACE)
        joined, at = normalised(data, starts, ends)
        n = np.diff(per)
        shingles = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        base = np.concatenate(([0], np.cumsum(shingles)))
        first = np.repeat(per[:-1] - base[:-1], shingles) + np.arange(int(base[-1]))
        last = first + np.repeat(np.minimum(n, SHINGLE), shingles)
        out.append(bit_majorities(xxh64(joined, at[first], at[last] - 1, SEED), base))
    return np.concatenate(out)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, fp), fp the fingerprint as a signed long; null and wordless texts have 0."""

    def run(batches):
        for batch in batches:
            fp = fingerprint_batch(batch.column(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _part_counts(fp: str) -> list:
    return [F.bit_count(F.col(fp).bitwiseAND(F.lit(((1 << 16) - 1) << (16 * i) if i < 3 else -(1 << 48)))).alias(f"c{i}") for i in range(PARTS)]


def _tiles(cells: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tile of each cell, sub-tiles of each tile, lowest counts, highest counts): cells split at medians until a tile is small enough.

    A single cell larger than `size` is dealt by hash into so many sub-tiles.
    """
    tile, low, high, subs = np.zeros(len(cells), np.int64), [], [], []
    todo = [np.arange(len(cells))]
    while todo:
        rows = todo.pop()
        spread = cells[rows].max(0) - cells[rows].min(0)
        if n[rows].sum() <= size or not spread.any():
            tile[rows] = len(low)
            low.append(cells[rows].min(0))
            high.append(cells[rows].max(0))
            subs.append(max(1, -(-int(n[rows].sum()) // size)))
            continue
        axis = int(spread.argmax())
        values = cells[rows, axis]
        order = np.argsort(values, kind="stable")
        weight = np.cumsum(n[rows][order])
        cut = values[order[np.searchsorted(weight, weight[-1] / 2)]]
        cut = cut if (values < cut).any() else cut + 1
        todo += [rows[values < cut], rows[values >= cut]]
    return tile, np.array(subs), np.array(low), np.array(high)


def tile_size(n: int) -> int:
    return max(TILE_LEAST, min(TILE_MOST, -(-n // TILES)))


def tile_pairs(members: DataFrame, low: np.ndarray, high: np.ndarray, reach: float, columns: Sequence[str]) -> DataFrame:
    """Pairs of tiles of members(tile, *columns), each with itself too, whose bounds low and high (a row per tile) can lie within reach.

    Columns: ta, tb and every one of `columns` as a_ and b_. A task finds the partners of its tiles from the bounds, which are all
    that is broadcast; 16 bytes a tile of a corpus of 10 billion fingerprints are 3 MB.
    """
    spark = members.sparkSession
    bounds = spark.sparkContext.broadcast((low, high))

    def partners(batches):
        low, high = bounds.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                gap = np.maximum(np.maximum(low[i:] - high[i], low[i] - high[i:]), 0).sum(1)
                j = i + np.flatnonzero(gap <= reach)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i)), pa.array(j)], ["ta", "tb"])

    pairs = written(spark.range(len(low)).mapInArrow(partners, "ta long, tb long"), "tile-pairs")
    sides = [members.select(F.col("tile").alias(f"t{k}"), *[F.col(c).alias(f"{k}_{c}") for c in columns]) for k in "ab"]
    return sides[0].join(pairs, "ta").join(sides[1], "tb")


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """For tiles a and b (unsigned, laid end to end) the root of each member in a spanning forest of the links between them (and within, if same)."""
    parent = np.arange(len(a) + (0 if same else len(b)))
    shift = 0 if same else len(a)
    step = max(1, BLOCK // max(1, len(b)))
    differing, bits = np.empty((step, len(b)), np.uint64), np.empty((step, len(b)), np.uint8)
    for lo in range(0, len(a), step):
        block = a[lo : lo + step, None]
        differ, count = differing[: len(block)], bits[: len(block)]
        np.bitwise_xor(block, b, out=differ)
        np.bitwise_count(differ, out=count)
        if same:
            count[np.arange(len(block)), np.arange(lo, lo + len(block))] = 255
        if count.min(initial=255) > radius:
            continue
        i, j = np.nonzero(count <= radius)
        i, j = i + lo, j + shift
        while True:
            x, y = parent[i], parent[j]
            differ = x != y
            if not differ.any():
                break
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return parent


def links(classes: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """(a, b) edges between ids of classes(fp, id): a spanning forest, per pair of tiles, of all pairs of fingerprints within the radius.

    The driver sees the number of fingerprints per vector of part counts, of which there are at most 17**4, and the
    tiles' bounds; the fingerprints themselves stay on the executors, a tile of about `tile` of them in a row. No classes: no links.
    """
    spark = classes.sparkSession
    counted = classes.select("fp", "id", *_part_counts("fp"))
    cells = counted.groupBy("c0", "c1", "c2", "c3").count().toPandas()
    if not len(cells):
        return spark.createDataFrame([], "a long, b long")
    n = cells["count"].to_numpy(np.int64)
    of_cell, subs, low, high = _tiles(cells[["c0", "c1", "c2", "c3"]].to_numpy(np.int64), n, tile or tile_size(int(n.sum())))
    base = np.concatenate(([0], np.cumsum(subs)))[:-1]
    cells["first"], cells["subs"] = base[of_cell], subs[of_cell]
    placed = counted.join(F.broadcast(spark.createDataFrame(cells[["c0", "c1", "c2", "c3", "first", "subs"]])), ["c0", "c1", "c2", "c3"])
    placed = placed.select("fp", "id", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("subs"))).alias("tile"))
    members = placed.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("id", "fp"))).alias("m"))
    members = written(members.selectExpr("tile", "transform(m, x -> x.id) AS ids", "transform(m, x -> x.fp) AS fps"), "tiles")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ia, fa, ib, fb = (np.asarray(batch.column(name)[k].values) for name in ("a_ids", "a_fps", "b_ids", "b_fps"))
                same = batch.column("ta")[k].as_py() == batch.column("tb")[k].as_py()
                ids = ia if same else np.concatenate((ia, ib))
                root = forest(fa.view(np.uint64), fb.view(np.uint64), radius, same)
                child = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root[child]])], ["a", "b"])

    pairs = tile_pairs(members, np.repeat(low, subs, 0).astype(np.int8), np.repeat(high, subs, 0).astype(np.int8), radius, ("ids", "fps"))
    return pairs.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id reachable over links.

    Words are split at white space, A-Z lower-cased; a text of fewer than four words is one shingle; null, empty and
    wordless texts have fingerprint zero and link like any other. Equal fingerprints are compared once, for their
    smallest doc_id. Null doc_id: the row shares its fingerprint's component; a fingerprint that only null ids hold
    has no name, links nothing and has component_id null. Repeated rows: each reported. Empty input: no rows. Other
    columns of docs are ignored.
    """
    marked = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    reached = components(links(classes.where("id IS NOT NULL").select("fp", "id"), radius, tile))
    named = classes.join(reached, classes.id == reached.node, "left").select(F.col("fp").cast("string").alias("fp_key"), "n", F.coalesce("component", "id").alias("component_id"))
    out = keyed_join(marked.withColumn("fp_key", F.col("fp").cast("string")), named, "fp_key", "n", marked.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
