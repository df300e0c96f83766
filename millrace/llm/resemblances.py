"""Near-duplicates at a similarity of 0.8: wide SimHash fingerprints compared in tiles, whole sets of five-word shingles decide.

A fingerprint of 64 bits within 4 is too narrow for this similarity, at which a bit differs with a chance of 0.15. So a
document's set of five-word shingles gets four such fingerprints, compared like the single one: in tiles of documents of
similar size, every pair of tiles whose sizes allow the similarity in full, by exclusive-or and bit counts, first over one fingerprint
within NARROW and then over all four within WIDE. A pair that differs in so many bits is at 0.8 or more with a
chance below one in 5,000 (one in 150 for sets of four or five shingles). Odd sketches (bitmaps that bound the sets' difference from below) rule more pairs out;
the others are links only where the Jaccard similarity of the whole sets reaches the threshold, so none that is found is wrong.

Equal sets are compared once. Of the others each document is first compared in full with the nearest fingerprint only, which joins most
families at a cost in proportion to their size; at last all near pairs that are still in different components are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, keyed_join, written
from .components import components
from .simhash import BLOCK, bit_majorities, tile_pairs, tile_size
from .sketches import sketch_chunk
from .tokens import Hasher, chunks, mixed

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of 64 bits a document, and the most bits in which the first, and all, of two near ones differ.
PRINTS, NARROW, WIDE = 4, 20, 64
#: Rounds of nearest pairs, at most, and the near pairs a node, on average, from which on all are compared.
TURNS, NEAR_PAIRS = 8, 16
#: Bits of an odd sketch.
ODD = 1024
#: Numbers of 64 bits in the bitmap that says which texts may be needed: a row each, broadcast.
BITMAP_WORDS = 1 << 18
#: Classes of set sizes differ by this factor.
SIZE_STEP = 1.02
_SECOND = np.uint64(0x9E3779B97F4A7C15)
_SALTS = mixed(np.arange(1, PRINTS + 1, dtype=np.uint64))


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, hashes, second hashes, fingerprints, PRINTS to a row) of sets of shingle hashes; an empty set's are zero."""
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    one, two = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    prints = np.zeros((len(sets), PRINTS), np.uint64)
    if len(some):
        grams = np.concatenate([sets[i] for i in some])
        per = np.concatenate(([0], np.cumsum(sizes[some])))
        one[some] = np.add.reduceat(mixed(grams), per[:-1])
        two[some] = np.add.reduceat(mixed(grams ^ _SECOND), per[:-1])
        for k in range(PRINTS):
            prints[some, k] = bit_majorities(mixed(grams ^ _SALTS[k]), per)
    return sizes, one, two, prints


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ODD / 64 numbers per set, with the bits set on which an odd number of its hashes fall."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (mixed(np.concatenate(sets) ^ _SECOND) % np.uint64(ODD)).astype(np.int64) if len(sets) else of
    odd = (np.bincount(of * ODD + at, minlength=len(sets) * ODD) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(len(sets), ODD // 64)


def _rows_of(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * width, width, dtype=np.int32), pa.array(values.reshape(-1).view(np.int64)))


def marked(docs: DataFrame) -> DataFrame:
    """docs(doc_id, th, text) to doc_id, th, h1, h2, n, odd, prints: the set's hashes, size, odd sketch and fingerprints."""

    def run(batches):
        hasher = Hasher(lower=True)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2)):
                sets = sketch_chunk(data, offsets, hasher, None, SHINGLE)
                n, one, two, prints = set_hashes(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n), _rows_of(odd_sketches(sets)), _rows_of(prints)],
                    ["doc_id", "th", "h1", "h2", "n", "odd", "prints"],
                )

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, h1 long, h2 long, n long, odd array<long>, prints array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """docs(node, text) to node, grams, the hashes of its distinct shingles."""

    def run(batches):
        hasher = Hasher(lower=True)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                sets = sketch_chunk(data, offsets, hasher, None, SHINGLE)
                cut = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(cut, pa.array(np.concatenate(sets).view(np.int64)))], ["node", "grams"])

    return docs.select("node", "text").mapInArrow(run, "node long, grams array<long>")


def texts_of(needed: DataFrame, ids: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, text), a row for each of needed(node), of classes(node, rep), whose text is that of a row of ids(doc_id, th, text) that rep names.

    Most texts are not needed, so a bitmap of the needed ones' hashes goes to the texts, which are shuffled only where it has their
    bit: all needed ones and, of the others, as many as the bitmap is full. Repeated rows are one before the shuffle.
    """
    wanted = written(classes.select("node", "rep.doc_id", "rep.th").join(needed, "node", "left_semi"), "wanted")
    word, bit = F.pmod(F.xxhash64("doc_id", "th"), F.lit(BITMAP_WORDS)), F.expr("shiftleft(1L, CAST(pmod(xxhash64(th, doc_id), 64) AS INT))")
    bitmap = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = ids.withColumn("word", word).join(F.broadcast(bitmap), "word").where(F.col("bits").bitwiseAND(bit) != 0).select("doc_id", "th", "text")
    return found.dropDuplicates(["doc_id", "th"]).join(wanted, ["doc_id", "th"]).select("node", "text")


def verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose shingle sets have this Jaccard similarity or more; texts gives (node, text), a row for each of a table's nodes."""
    needed = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    sets = written(shingle_sets(texts(needed)), "shingles")
    both = pairs.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.withColumn("common", common).where(F.col("common") >= similarity * (F.size("ga") + F.size("gb") - F.col("common")) - 1e-9).select("a", "b")


def near(a: dict[str, np.ndarray], b: dict[str, np.ndarray], same: bool, similarity: float = SIMILARITY):
    """(places in a, places in b, bits that differ) of near pairs of different components, some at a time.

    a and b hold, of two tiles, node, c (component), n (size), prints and, in rounds that have them, odd.
    """
    first = [np.ascontiguousarray(x["prints"][:, 0]) for x in (a, b)]
    step = max(1, BLOCK // max(1, len(first[1])))
    for lo in range(0, len(first[0]), step):
        differ = np.bitwise_count(first[0][lo : lo + step, None] ^ first[1])
        i, j = np.nonzero(differ <= NARROW)
        i = i + lo
        keep = a["c"][i] != b["c"][j]
        if same:
            keep &= i < j
        i, j = i[keep], j[keep]
        keep = np.minimum(a["n"][i], b["n"][j]) >= similarity * np.maximum(a["n"][i], b["n"][j]) - 1e-9
        i, j = i[keep], j[keep]
        bits = np.bitwise_count(a["prints"][i] ^ b["prints"][j]).sum(1, dtype=np.int64)
        keep = bits <= WIDE
        if "odd" in a:
            # sketches differ in no more bits than sets in hashes, of which sets at the similarity differ in at most (1 - s) / (1 + s) of both sizes together
            odd = np.bitwise_count(a["odd"][i[keep]] ^ b["odd"][j[keep]]).sum(1, dtype=np.int64)
            keep[keep] = odd <= (1 - similarity) / (1 + similarity) * (a["n"][i[keep]] + b["n"][j[keep]]) + 1e-9
        if keep.any():
            yield i[keep], j[keep], bits[keep]


def compared(live: DataFrame, every: bool, with_odd: bool, similarity: float = SIMILARITY, tile: int | None = None) -> DataFrame:
    """Near pairs of live(node, c, n, odd, prints) that are in different components c.

    every: (a, b), all of them. Else (x, near, bits, others) per pair of tiles and node x that has any: the nearest (of equally
    near ones the smallest node) and their number. Tiles hold nodes of similar size; sizes alone bound what a pair of tiles can hold.
    """
    step = math.log(SIZE_STEP)
    placed = live.withColumn("size", F.floor(F.log("n") / step).cast("int"))
    counts = sorted((r["size"], r["count"]) for r in placed.groupBy("size").count().collect())  # a row per factor of SIZE_STEP in length
    tile = tile or tile_size(sum(n for _, n in counts))
    of, firsts, subs, low, high, held = {}, [], [], [], [], 0
    for size, n in counts:
        if not low or held + n > tile:
            firsts.append(sum(subs))
            subs.append(0)
            low.append(size)
            high.append(size)
            held = 0
        held += n
        high[-1], of[size] = size, len(subs) - 1
        subs[-1] = -(-held // tile)
    rows = [(size, firsts[t], subs[t]) for size, t in of.items()]
    placed = placed.join(F.broadcast(live.sparkSession.createDataFrame(rows, "size int, first int, subs int")), "size")
    placed = placed.withColumn("tile", F.col("first") + F.pmod(F.xxhash64("node", F.lit(3)), F.col("subs")))
    columns = ["node", "c", "n", "prints"] + (["odd"] if with_odd else [])
    members = placed.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("m"))
    wide = {"prints", "odd"}
    members = written(members.selectExpr("tile", *[f"flatten(transform(m, x -> x.{c})) AS {c}" if c in wide else f"transform(m, x -> x.{c}) AS {c}" for c in columns]), "tiles")
    bounds = (np.repeat(np.array(x, np.float32), subs)[:, None] for x in (low, high))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for side in "ab":
                    value = {c: np.asarray(batch.column(f"{side}_{c}")[k].values) for c in columns}
                    sides.append({c: v.view(np.uint64).reshape(len(value["node"]), -1) if c in wide else v for c, v in value.items()})
                a, b = sides
                same = batch.column("ta")[k].as_py() == batch.column("tb")[k].as_py()
                if every:
                    for i, j, _ in near(a, b, same, similarity):
                        yield pa.RecordBatch.from_arrays([pa.array(a["node"][i]), pa.array(b["node"][j])], ["a", "b"])
                    continue
                best: dict[int, list[int]] = {}
                for i, j, bits in near(a, b, same, similarity):
                    for x, y in ((a["node"][i], b["node"][j]), (b["node"][j], a["node"][i])):
                        order = np.lexsort((y, bits, x))
                        x, y, d = x[order], y[order], bits[order]
                        cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
                        for node, other, dist, n in zip(x[cut].tolist(), y[cut].tolist(), d[cut].tolist(), np.diff(np.append(cut, len(x))).tolist()):
                            was = best.setdefault(node, [dist, other, 0])
                            was[2] += n
                            if (dist, other) < (was[0], was[1]):
                                was[0], was[1] = dist, other
                if best:
                    nodes = list(best)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), *[pa.array([best[x][c] for x in nodes]) for c in (1, 0, 2)]], ["x", "near", "bits", "others"])

    pairs = tile_pairs(members, *bounds, -math.log(similarity) / step + 1, columns)
    return pairs.mapInArrow(run, "a long, b long" if every else "x long, near long, bits long, others long")


def linked(classes: DataFrame, texts: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, tile: int | None = None) -> DataFrame | None:
    """(node, component) of the nodes of classes(node, n, odd, prints) that a link of the similarity or more joins to others; None if there is none.

    A set of n < s / (1 - s) shingles is as similar to no other, so it is left out. A round of nearest pairs comes first and shows which
    nodes have near ones at all; only these go on. Once a round has joined few, or near pairs are few, all of these are compared.
    """
    live = classes.where(F.col("n") >= similarity / (1 - similarity) - 1e-9).withColumn("c", F.col("node"))
    if not live.limit(1).count():
        return None
    links, reached, turn, few, across = None, None, 0, False, None
    while True:
        full = turn > 0 and (few or turn == TURNS or across <= NEAR_PAIRS * rows)
        if full:
            pairs = written(compared(live, True, True, similarity, tile), "pairs")
        else:
            stars = compared(live, False, turn > 0, similarity, tile).groupBy("x").agg(F.min(F.struct("bits", "near")).alias("m"), F.sum("others").alias("others"))
            stars = written(stars.select("x", "m.near", "others"), "nearest")
            rows, across = stars.agg(F.count(F.lit(1)), F.coalesce(F.sum("others") / 2, F.lit(0.0))).first()
            if not rows:
                break
            pairs = written(stars.select(F.least("x", "near").alias("a"), F.greatest("x", "near").alias("b")).distinct(), "pairs")
        found = written(verified(pairs, texts, similarity), "links")
        joined = found.count()
        links = found if links is None else links.unionAll(found)
        if joined:
            reached = components(links)
        if full:
            break
        few = 20 * joined <= rows
        live = live.drop("c").join(stars.select(F.col("x").alias("node")), "node", "left_semi")
        if reached is not None:
            live = live.join(reached, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        else:
            live = live.withColumn("c", F.col("node"))
        live = written(live, "live")
        turn += 1
    return reached


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY, tile: int | None = None) -> DataFrame:
    """docs with one document of each component kept, that of its smallest doc_id (of several texts with that id, of the smallest hash).

    Words are split at white space, A-Z lower-cased; a text of fewer than five words is one shingle; null, empty and
    wordless texts are equal. A row is known by doc_id and text: rows that share a doc_id but whose texts belong to different components
    are all kept, and rows equal in both are one document, of which one stays. Rows without a doc_id are kept and
    compared with none. Very long texts cost in proportion to their length. Empty input: no rows. All columns are kept, whatever their names.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.xxhash64(F.col("text").cast("string")).alias("row_th"))
    ids = packed.where("row_id IS NOT NULL").select(F.col("row_id").alias("doc_id"), F.col("row_th").alias("th"), F.col("row.text").alias("text"))
    units = marked(ids).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in ("h1", "h2", "n", "odd", "prints")])
    units = written(units.withColumn("key", F.concat_ws(",", "h1", "h2", "n")).drop("h1", "h2"), "units")
    classes = units.groupBy("key").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count(F.lit(1)).alias("units"), *[F.first(c).alias(c) for c in ("n", "odd", "prints")])
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reached = linked(classes.select("node", "n", "odd", "prints"), lambda needed: texts_of(needed, ids, classes), similarity, tile)
    named = classes.select("node", "key", "units", "rep")
    if reached is not None:
        stays = written(named.join(reached, "node").groupBy("component").agg(F.min("rep").alias("stays")).join(reached, "component").select("node", "stays"), "stays")
        named = named.join(stays, "node", "left").withColumn("rep", F.coalesce("stays", "rep"))
    found = keyed_join(units.select("doc_id", "th", "rows", "key"), named.select("key", "units", "rep"), "key", "units", units.count())
    same = (F.col("doc_id") == F.col("rep.doc_id")) & (F.col("th") == F.col("rep.th"))
    flags = found.where(~same | (F.col("rows") > 1)).select(F.concat_ws(",", "doc_id", "th").alias("unit"), "rows", same.alias("stays"))
    flags = written(flags, "flags")
    n_flags, n_rows = flags.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    packed = packed.withColumn("unit", F.when(F.col("row_id").isNotNull(), F.concat_ws(",", "row_id", "row_th")))
    flagged = keyed_join(packed.select("row", "unit"), flags, "unit", "rows", int(n_rows), int(n_flags))
    plain = [F.col(f"row.{c}") for c, kind in docs.dtypes if not kind.startswith(("struct", "map", "array", "variant"))]
    one = flagged.where("stays").groupBy("unit").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return flagged.where("stays IS NULL").select("row.*").unionByName(one.select("row.*"))
