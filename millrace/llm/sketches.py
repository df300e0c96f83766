"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct 64-bit hashes of a text's five-word shingles. Sketches of parts merge into
that of the whole, and two sketches estimate resemblance, containment and distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import SPACE, Hasher, chunks, strings, window_hashes, words

K = 128
SHINGLE = 5
#: Bytes of the input, as the optimizer estimates them, for a block of consecutive documents, and the most blocks.
BLOCK_BYTES, MAX_BLOCKS = 64 << 20, 100_000


def merged(*sketches: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the parts' union."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.zeros(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of shared over all distinct shingles; exact while neither sketch is full. Two empty sketches: 1."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    twice = both[1:] == both[:-1]
    first = np.concatenate(([True], ~twice))
    rank = np.cumsum(first)
    size = min(int(rank[-1]), k)
    return float(np.count_nonzero(twice & (rank[1:] <= size))) / size


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles; exact while the sketch is not full."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1.0) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j / (1.0 + j) * (distinct(a, k) + distinct(b, k)) / distinct(a, k))


def encoded(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(np.uint64)


def sketch_chunk(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text of a chunk; a text of fewer words than a shingle has one, of all its words; none: empty."""
    starts, ends, per = words(data, offsets, SPACE)
    h = hasher(data, starts, ends)
    full, _ = window_hashes(h, per, shingle)
    out = []
    for a, b in zip(per[:-1].tolist(), per[1:].tolist()):
        n = b - a
        if n >= shingle:
            out.append(np.unique(full[a : b - shingle + 1])[:k])
        elif n:
            out.append(window_hashes(h[a:b], np.array([0, n]), n)[0][:1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (the sketch in base64), n_distinct, the estimated distinct shingles. A null text is empty."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                found = sketch_chunk(data, offsets, hasher, k, shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([encoded(s) for s in found], pa.string()), pa.array([distinct(s, k) for s in found], pa.float64())],
                    ["doc_id", "fingerprint", "n_distinct"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string, n_distinct double")


def in_order(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) dealt into partitions of consecutive doc_ids, in order: block, doc_id, text, tail.

    Behind each partition's rows stands, with tail set, a copy of the first row of the next (behind the last, of the
    first), so every row can see its successor. Bounds are approximate quantiles of doc_id, as many as shuffle
    partitions, or more for BLOCK_BYTES of input each; a row finds its block by bisection. The texts are shuffled once.
    """
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = 0 if size >= 1 << 60 else size  # unknown
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_BLOCKS, size // BLOCK_BYTES))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0]
    bounds = sorted(set(bounds or [0]))
    halvings = len(bounds).bit_length()
    held = F.array(*[F.lit(b) for b in bounds]) if len(bounds) <= 1000 else F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    step = lambda s, _: F.when(  # noqa: E731  the number of bounds below doc_id
        s["lo"] < s["hi"],
        F.when(F.get(held, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) < F.col("doc_id"), F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))
        ),
    ).otherwise(s)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step, lambda s: s["lo"])
    block = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(found)
    rows = docs.withColumn("block", block)
    least = rows.groupBy("block").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("no_id")).collect()  # a row per block
    blocks = sorted(r["block"] for r in least)
    firsts = [(None if r["no_id"] else r["doc_id"], blocks[blocks.index(r["block"]) - 1]) for r in least]
    heads = spark.createDataFrame(firsts, "doc_id long, block int")
    tails = docs.join(F.broadcast(heads), docs.doc_id.eqNullSafe(heads.doc_id)).groupBy("block").agg(F.min(docs.text).alias("text"), F.min(docs.doc_id).alias("doc_id"))
    rows = rows.select("block", "doc_id", "text", F.lit(False).alias("tail")).unionByName(tails.select("block", "doc_id", "text", F.lit(True).alias("tail")))
    return rows.repartitionById(len(bounds) + 1, F.col("block")).sortWithinPartitions("block", "tail", F.col("doc_id").asc_nulls_first(), "text")


def _cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte place of every code point, index of each text's first among them, code points per text)."""
    places = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(places, offsets)
    return np.append(places, len(data)), first, np.diff(first)


def edited_fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, held_by_edited.

    near_* are resemblances, n_shingles is the number of distinct shingles and held_by_edited the share of them in the edited text, all by estimate from the sketches.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's, in order of doc_id; after the last comes the first, and a document alone is its own next. Null doc_ids come first,
    and rows with one doc_id follow in the order of their texts. Null text: empty. Repeated rows: each reported.
    Empty input: no rows. Other columns of docs are ignored.
    """

    def run(batches):
        hasher, held = Hasher(), None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            held = now.slice(now.num_rows - 1)
            ids, texts, tail = now.column("doc_id").combine_chunks(), strings(now.column("text")), now.column("tail").combine_chunks()
            if now.num_rows < 2:
                continue
            for lo, hi, data, offsets in chunks(texts.slice(0, now.num_rows - 1)):
                _, _, more, more_offsets = next(chunks(texts.slice(hi, 1), 0))
                data, offsets = np.concatenate((data, more)), np.append(offsets, offsets[-1] + len(more))
                places, first, n = _cuts(data, offsets)
                cut = n[:-1] // 4
                take = np.minimum(cut, n[1:])
                head_end, next_end = places[first[:-2] + n[:-1] - cut], places[first[1:-1] + take]
                head_end = np.where(cut > 0, head_end, offsets[1:-1])
                next_end = np.where(take > 0, next_end, offsets[1:-1])
                pieces = [p for i in range(hi - lo) for p in (data[offsets[i] : head_end[i]], data[offsets[i + 1] : next_end[i]])]
                edited = np.concatenate(pieces)
                edited_offsets = np.concatenate(([0], np.cumsum((head_end - offsets[:-2]) + (next_end - offsets[1:-1]))))
                own, changed = sketch_chunk(data, offsets, hasher, k, shingle), sketch_chunk(edited, edited_offsets, hasher, k, shingle)
                raw = edited.tobytes()
                keep = np.flatnonzero(~np.asarray(tail.slice(lo, hi - lo).to_pylist(), bool)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo).take(pa.array(keep, pa.int64())),
                        pa.array(n[:-1][keep], pa.int64()),
                        pa.array([hashlib.sha256(raw[edited_offsets[i] : edited_offsets[i + 1]]).hexdigest() for i in keep], pa.string()),
                        pa.array([encoded(own[i]) for i in keep], pa.string()),
                        pa.array([encoded(changed[i]) for i in keep], pa.string()),
                        pa.array([resemblance(own[i], changed[i], k) for i in keep], pa.float64()),
                        pa.array([resemblance(own[i], own[i + 1], k) for i in keep], pa.float64()),
                        pa.array([distinct(own[i], k) for i in keep], pa.float64()),
                        pa.array([containment(own[i], changed[i], k) for i in keep], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "held_by_edited"],
                )

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, held_by_edited double"
    return in_order(docs).select("doc_id", "text", "tail").mapInArrow(run, out)
