"""Near-duplicate sites by MinHash bands with exact verification, and similar titles."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import _settled, connected

BANDS, ROWS = 16, 4
SHINGLE = 6


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once: the lambda's variable stands for it, where a plain column would be written out at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(words: Column, k: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of the runs of k words; none for fewer words."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return _bound(words, lambda w: F.when(F.size(w) >= k, F.array_distinct(runs(w))).otherwise(F.array().cast("array<bigint>")))


def band_keys(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """sets(rep, g) to a row per band: rep, n (grams), band, a key of the band and its minima.

    A MinHash signature has bands * rows minima, each over the grams hashed with a number of its own. The grams are
    laid out as rows and the minima taken by one generated aggregate, whose partial step leaves a row per set and task.
    """
    minima = [F.min(F.xxhash64("gram", F.lit(i))).alias(f"m{i}") for i in range(bands * rows)]
    signed = sets.select("rep", F.explode("g").alias("gram")).groupBy("rep").agg(F.count(F.lit(1)).cast("int").alias("n"), *minima)
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * rows + r}") for r in range(rows)]) for b in range(bands)])
    return signed.select("rep", "n", F.explode(F.array_distinct(keys)).alias("band"))


def near_duplicates(df: DataFrame, key: str, grams: str, threshold: float = 0.9, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b, similarity) of keys whose gram sets have a Jaccard similarity of threshold or more.

    Equal sets are first reduced to one representative each; a class of copies is linked to it, not in pairs. Candidates share a
    band; each is compared exactly, so none that is returned is wrong. In a band key of many members each is paired with
    those of the nearest sizes only as far as the size ratio can reach the threshold.
    """
    sets = df.select(F.col(key).alias("k"), F.array_sort(grams).alias("g")).where(F.size("g") > 0)
    sets = _settled(sets.withColumn("h", F.struct(F.xxhash64("g"), F.xxhash64(F.lit(1), "g"))))  # 128 bits name a set
    reps = _settled(sets.groupBy("h").agg(F.min("k").alias("rep")))
    classes = sets.join(reps, "h").where("k = rep").select("rep", "g").dropDuplicates(["rep"])
    copies = sets.select("h", "k").join(reps, "h").where("k <> rep").select(F.col("rep").alias("a"), F.col("k").alias("b"), F.lit(1.0).alias("similarity"))
    shared = band_keys(classes.select("rep", "g"), bands, rows)
    shared = shared.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("band"))).where("members > 1").drop("members")
    left, right = shared.select("band", F.col("rep").alias("a"), F.col("n").alias("na")), shared.select("band", F.col("rep").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, "band").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    ga, gb = classes.select(F.col("rep").alias("a"), F.col("g").alias("ga")), classes.select(F.col("rep").alias("b"), F.col("g").alias("gb"))
    both = pairs.join(ga, "a").join(gb, "b")
    common = F.size(F.array_intersect("ga", "gb"))
    exact = both.withColumn("similarity", common / (F.size("ga") + F.size("gb") - common)).where(F.col("similarity") >= threshold)
    return exact.select("a", "b", "similarity").unionByName(copies)


#: Priority marks before a title, fixed values.
TITLE_MARK = r"^\s*\[(P0|P1|P2\+|P2|P3|P4)\]"
#: Titles in a tile: about a TILES-th of all, within these bounds.
TILE_LEAST, TILE_MOST, TILES = 2048, 1 << 17, 8
#: Comparisons made at a time, in buffers that stay in a core's cache, and pairs whose common subsequences are.
BLOCK, CHUNK = 1 << 17, 2048
#: Bits of a sketch, twice the longest title's characters within these bounds; classes of characters; characters whose places fit in one number.
LEAST_BITS, MOST_BITS, LETTERS, PLACES = 128, 4096, 32, 64


def plain_title(title: Column) -> Column:
    """A title without its priority mark, in lower case, with single spaces for whatever is no letter, digit or underscore."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(title, TITLE_MARK, "")), r"(?U)\W+", " "))


class _Tile:
    """A tile's titles: ids, texts, their lengths and characters, laid end to end."""

    def __init__(self, ids: pa.Array, texts: list[str]) -> None:
        self.ids, self.texts = ids, texts
        self.n = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.n) - self.n
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)

    def _counts(self, values: np.ndarray, of: np.ndarray, width: int, pack) -> np.ndarray:
        """pack(how often each of `width` values is in each title), some titles at a time; of: the title of each value, ascending."""
        out, step = [], max(1, (1 << 21) // width)
        for lo in range(0, len(self.n), step):
            first, last = np.searchsorted(of, (lo, lo + step))
            rows = min(step, len(self.n) - lo)
            out.append(pack(np.bincount((of[first:last] - lo) * width + values[first:last], minlength=rows * width).reshape(rows, width)))
        return np.concatenate(out)

    @staticmethod
    def _odd(n: np.ndarray) -> np.ndarray:
        return np.packbits((n & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")

    def parities(self) -> np.ndarray:
        """Of each title a number, with the bits set on which an odd number of its characters fall."""
        at = (self.codes * np.uint32(0x9E3779B1) >> np.uint32(26)).astype(np.int64)
        return self._counts(at, np.repeat(np.arange(len(self.n)), self.n), 64, self._odd)[:, 0]

    def sketches(self, bits: int) -> np.ndarray:
        """Of each title bits / 64 numbers, with the bits set on which an odd number of its pairs of neighbouring characters fall."""
        of = np.repeat(np.arange(len(self.n)), self.n)
        inside = np.flatnonzero(of[1:] == of[:-1])
        pair = self.codes[inside].astype(np.uint64) << np.uint64(21) | self.codes[inside + 1]
        pair = (pair ^ pair >> np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15)
        at = (pair >> np.uint64(65 - bits.bit_length())).astype(np.int64)
        return self._counts(at, of[inside], bits, self._odd)

    def letters(self) -> np.ndarray:
        """How many characters of each class each title has."""
        at = (self.codes * np.uint32(0x9E3779B1) >> np.uint32(33 - LETTERS.bit_length())).astype(np.int64)
        return self._counts(at, np.repeat(np.arange(len(self.n)), self.n), LETTERS, lambda n: n.astype(np.int32))

    def padded(self, rows: np.ndarray, width: int, pad: int) -> np.ndarray:
        at = np.arange(width)
        there = at < self.n[rows, None]
        return np.where(there, self.codes[np.where(there, self.starts[rows, None] + at, 0)], np.uint32(pad))


def _subsequences(a: _Tile, i: np.ndarray, b: _Tile, j: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of each pair, a's of PLACES characters or fewer: a bit a character of a, a step a character of b."""
    x, y = a.padded(i, PLACES, 0xFFFFFFFF), b.padded(j, int(b.n[j].max()), 0xFFFFFFFE)
    left = np.full(len(i), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for c in y.T:
        met = left & np.packbits(x == c[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        left = left + met | left - met
    return np.bitwise_count(~left).astype(np.int64)


def _title_forest(a: _Tile, b: _Tile, ratio: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between the titles of a and b (within a, if it is b), as places in a and b.

    Titles of m and n characters of which M match, in order, leave e = m + n - 2M without a match. Their bags of characters
    differ in e at most, and their bags of neighbouring pairs in 3e, as the matches are e + 1 runs at most and each run has one pair less in common than
    characters; sketches differ in no more bits than bags in members. What passes and has a common subsequence of M characters is
    compared in full, unless links found so far join it.
    """
    same = a is b
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * max(a.n.max(), b.n.max()) - 1).bit_length()))
    of_a = a.parities(), a.sketches(bits), a.letters()
    (bits_a, sa, la), (bits_b, sb, lb) = of_a, of_a if same else (b.parities(), b.sketches(bits), b.letters())
    shift = 0 if same else len(a.n)
    parent = np.arange(len(a.n) + (0 if same else len(b.n)))
    spare = lambda total: total - 2 * np.ceil(ratio * total / 2 - 1e-9).astype(np.int64)
    most = spare(np.arange(a.n.min() + b.n.min(), a.n.max() + b.n.max() + 1)).max()
    step, links = max(1, BLOCK // len(b.n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return int(x)

    for lo in range(0, len(a.n), step):
        i, j = np.nonzero(np.bitwise_count(bits_a[lo : lo + step, None] ^ bits_b) <= most)
        i += lo
        keep = parent[i] != parent[j + shift]
        if same:
            keep &= i < j
        i, j = i[keep], j[keep]
        e = spare(a.n[i] + b.n[j])
        keep = np.bitwise_count(sa[i] ^ sb[j]).sum(1, dtype=np.int64) <= 3 * e
        i, j, e = i[keep], j[keep], e[keep]
        keep = np.abs(la[i] - lb[j]).sum(1) <= e
        i, j, e = i[keep], j[keep], e[keep]
        for at in range(0, len(i), CHUNK):
            p, q, d = i[at : at + CHUNK], j[at : at + CHUNK], e[at : at + CHUNK]
            while (parent != (up := parent[parent])).any():
                parent[:] = up
            keep = parent[p] != parent[q + shift]
            p, q, d = p[keep], q[keep], d[keep]
            short, turned = a.n[p] <= PLACES, (a.n[p] > PLACES) & (b.n[q] <= PLACES)
            keep = np.ones(len(p), bool)
            for some, (c, k), (f, l) in ((short, (a, p), (b, q)), (turned, (b, q), (a, p))):
                if some.any():
                    keep[some] = a.n[p[some]] + b.n[q[some]] - 2 * _subsequences(c, k[some], f, l[some]) <= d[some]
            for x, y in zip(p[keep].tolist(), q[keep].tolist()):
                r, o = root(x), root(y + shift)
                if r == o:
                    continue
                first, second = (a.texts[x], b.texts[y]) if same or a.ids[x].as_py() < b.ids[y].as_py() else (b.texts[y], a.texts[x])
                if difflib.SequenceMatcher(None, first, second).ratio() >= ratio:
                    parent[max(r, o)] = min(r, o)
                    links.append((x, y))
    return links


def alike_titles(reps: DataFrame, ratio: float, tile: int | None = None) -> DataFrame:
    """(src, dst) edges between reps(rep, t), distinct titles, that join those whose likeness, of that of the smaller rep to the other, is `ratio` or more.

    Titles are dealt by length into tiles. Pairs of tiles whose lengths allow the ratio are compared in full, by bounds that lose no link (_title_forest);
    each gives a spanning forest of its links, so neither candidates nor a family's pairs are ever rows. The driver sees the number
    of titles per length. A title travels once per tile that its own is compared with: some TILES times, until tiles are TILE_MOST titles.
    Comparisons grow with the square of the number of distinct titles of a length.
    """
    spark, kind = reps.sparkSession, dict(reps.dtypes)["rep"]
    sized = reps.where("rep IS NOT NULL").select("rep", "t", F.length("t").alias("n"))
    counts = sorted((r["n"], r["count"]) for r in sized.groupBy("n").count().collect())
    if not counts:
        return spark.createDataFrame([], f"src {kind}, dst {kind}")
    total = sum(k for _, k in counts)
    tile = tile or max(TILE_LEAST, min(TILE_MOST, -(-total // TILES)))
    groups: list[list] = []  # lowest length, highest, titles
    of = {}
    for n, k in counts:
        if not groups or groups[-1][2] + k > tile:
            groups.append([n, n, 0])
        groups[-1][1:] = [n, groups[-1][2] + k]
        of[n] = len(groups) - 1
    subs = [-(-k // tile) for _, _, k in groups]
    firsts = np.cumsum([0, *subs]).tolist()
    dealt = spark.createDataFrame([(n, firsts[g], subs[g]) for n, g in of.items()], "n int, first int, subs int")
    placed = sized.join(F.broadcast(dealt), "n").withColumn("tile", F.col("first") + F.pmod(F.xxhash64("t"), F.col("subs")))
    members = _settled(placed.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("rep", "t"))).alias("m")).selectExpr("tile", "m.rep AS ids", "m.t AS texts"))
    bounds = spark.createDataFrame([(firsts[g] + k, low, high) for g, (low, high, _) in enumerate(groups) for k in range(subs[g])], "tile long, low int, high int")
    a, b = bounds.toDF("ta", "la", "ha"), bounds.toDF("tb", "lb", "hb")
    gap = 2 * F.least("ha", "hb") >= ratio * (F.least("ha", "hb") + F.greatest("la", "lb")) - 1e-9
    pairs = _settled(a.crossJoin(F.broadcast(b)).where(F.col("ta") <= F.col("tb")).where(gap).select("ta", "tb"))
    sides = pairs.select("ta", "tb", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("tile"))
    met = members.join(F.broadcast(sides), "tile").repartition(min(10_000, pairs.count()), "ta", "tb").sortWithinPartitions("ta", "tb", "tile")

    def run(batches):
        a = None
        for batch in batches:
            for k in range(batch.num_rows):
                ta, tb, t = (batch.column(c)[k].as_py() for c in ("ta", "tb", "tile"))
                b = _Tile(batch.column("ids")[k].values, batch.column("texts")[k].as_py())
                if t == ta:
                    a = b
                if t == tb:
                    found = _title_forest(a, b, ratio)
                    x, y = (side.ids.take(pa.array([f[k] for f in found], pa.int64())) for k, side in enumerate((a, b)))
                    yield pa.RecordBatch.from_arrays([x, y], ["src", "dst"])

    return met.select("ta", "tb", "tile", "ids", "texts").mapInArrow(run, f"src {kind}, dst {kind}")


def title_clusters(df: DataFrame, key: str, title: str, ratio: float = 0.92, least: int = 30) -> DataFrame:
    """(node, component) of titles that are equal, or of `least` characters or more and alike by `ratio`, once in plain form; empty ones are alike to none.

    Equal titles meet by equality, and only distinct ones are compared.
    """
    rows = df.select(F.col(key).alias("node"), plain_title(F.col(title)).alias("t")).where("t <> ''")
    reps = _settled(rows.groupBy("t").agg(F.min("node").alias("rep")))
    same = rows.join(reps, "t").where("node <> rep").select(F.col("rep").alias("src"), F.col("node").alias("dst"))
    return connected(same.unionByName(alike_titles(reps.where(F.length("t") >= least), ratio)))


def sites(df: DataFrame, family: str, site: str) -> DataFrame:
    return df.select(family, site).distinct()


def unregistered(found: DataFrame, registered: DataFrame, on: Sequence[str]) -> DataFrame:
    """Findings without a registered exception."""
    return found.join(registered, list(on), "left_anti")
