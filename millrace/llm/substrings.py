"""Substring dedup with a count-min prefilter.

A window is `window` consecutive words of one document; a word is removed when a window that covers it also starts
earlier in the corpus. Windows of one word sequence share their anchor, the shingle of smallest hash among
those inside, so the number of an anchor's places is never below the number of places of any window that it stands for.

First pass: partitions count anchors in sparse count-min sketches, which are merged by ranges of cells into bitmaps of
the cells counted twice or more. The merged sketch only overestimates. Second pass: windows
whose anchor is estimated repeated, and no others, are grouped exactly (by anchor and window hash, 128 bits),
after each task has kept only the first place of each window it saw. A window seen once is not sent unless its
anchor is repeated or the anchor's cells collide. Windows travel by anchor; those of an anchor estimated at HOT places
or more, such as a line that stands in a third of all documents among other words each time, travel by their own hash.

Where the anchors outgrow a sketch of MAX_CELLS a row, they are dealt by hash into passes, each with a sketch of its own:
the texts are counted once for all passes and searched once for each, so a sketch's load stays the same. All windows of
an anchor are in its pass. Beyond MAX_PASSES the load grows and more windows pass the filter.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import temporary_tables, written
from .tokens import SPACE, Hasher, chunks, mixed, normalised, window_hashes, words

WINDOW = 20
#: Words of an anchor; a window of 20 words holds 13 of them, and about one word in seven begins an anchor.
ANCHOR = 8
DEPTH = 2
#: Cells of a sketch row merged by one task, and the most cells of a row. A row has two to four cells per expected anchor of its pass.
RANGE_CELLS = 1 << 21
MAX_CELLS = 1 << 28
#: Passes at most, as each searches all texts anew.
MAX_PASSES = 16
SHARD_BYTES = 2 << 20
#: Places of an anchor from which its windows are spread.
HOT = 1_000
_STEP = 0x9E3779B97F4A7C15


def cells(anchor: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of each anchor hash in a row of the sketch; width is a power of two."""
    return ((anchor * np.uint64(_STEP * (2 * row + 1) % (1 << 64))) >> np.uint64(64 - (width.bit_length() - 1))).astype(np.int64)


def anchors(h: np.ndarray, per: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word places of windows, the anchor's word place of each, anchor hash by word place); ties go to the leftmost shingle."""
    size = min(ANCHOR, window)
    shingle, _ = window_hashes(h, per, size, 0xA0761D6478BD642F)
    room = np.repeat(per[1:], np.diff(per)) - np.arange(len(h))
    starts = np.flatnonzero(room >= window)
    span = window - size + 1
    # a sliding minimum by doubling; ties keep the left place
    best = np.arange(len(h))
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        other = best[np.minimum(np.arange(len(h)) + step, len(h) - 1)] if len(h) else best
        best = np.where(shingle[other] < shingle[best], other, best)
        reach += step
    return starts, best[starts], shingle


def sketch_size(n_windows: int, max_cells: int = MAX_CELLS, max_passes: int = MAX_PASSES) -> tuple[int, int]:
    """(passes, cells of a row of each pass's sketch) for so many windows, of which about one in seven has an anchor of its own."""
    wanted = max(1, n_windows) * 2 // 7
    passes = min(max_passes, max(1, -(-wanted // max_cells)))
    return passes, 1 << min(max_cells.bit_length() - 1, max(16, (wanted // passes).bit_length()))


def pass_of(anchor: np.ndarray, passes: int) -> np.ndarray:
    """The pass of each anchor hash, independent of its cells."""
    return (mixed(anchor) % np.uint64(passes)).astype(np.int64)


def _texts(batch: pa.RecordBatch, hasher: Hasher):
    for lo, hi, data, offsets in chunks(batch.column("text"), SHARD_BYTES):
        starts, ends, per = words(data, offsets, SPACE)
        yield lo, hi, data, starts, ends, per, hasher(data, starts, ends)


def repeated_cells(docs: DataFrame, width: int, window: int = WINDOW, passes: int = 1) -> DataFrame:
    """(pass, row, range, bits, hot): the merged sketches of all anchors of docs(text), bitmaps of the cells that hold two places or more, and of those with HOT or more.

    A partition sends, per pass and range of cells, those it counted once, and those it counted more with their numbers,
    packed; a task merges one range.
    """
    span = min(RANGE_CELLS, width)

    def count(batches):
        hasher, seen = Hasher(), []

        def flush():
            found = np.concatenate(seen)
            turn = pass_of(found, passes)
            for p, row in [(p, row) for p in range(passes) for row in range(DEPTH)]:
                cell, n = np.unique(cells(found[turn == p], row, width), return_counts=True)
                cut = np.searchsorted(cell, np.arange(0, width + span, span))
                for r in range(len(cut) - 1):
                    part, times = cell[cut[r] : cut[r + 1]] - r * span, n[cut[r] : cut[r + 1]]
                    if len(part):
                        packed = np.diff(part[times == 1], prepend=0), np.diff(part[times > 1], prepend=0), times[times > 1]
                        blobs = [pa.array([zlib.compress(x.astype(np.uint32).tobytes(), 1)], pa.binary()) for x in packed]
                        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int32()) for x in (p, row, r)), *blobs], ["pass", "row", "range", "once", "more", "times"])
            seen.clear()

        held = 0
        for batch in batches:
            for _, _, _, _, _, per, h in _texts(batch, hasher):
                _, at, shingle = anchors(h, per, window)
                at = np.unique(at)
                seen.append(shingle[at])
                held += len(at)
                if held >= 4_000_000:
                    yield from flush()
                    held = 0
        if seen:
            yield from flush()

    def merge(key, parts):
        unpacked = lambda x: np.frombuffer(zlib.decompress(x.as_py()), np.uint32).astype(np.int64)
        counts = np.zeros(span, np.int64)
        for once, more, times in zip(parts.column("once"), parts.column("more"), parts.column("times")):
            counts[np.cumsum(unpacked(once))] += 1
            counts[np.cumsum(unpacked(more))] += unpacked(times)
        bits = [pa.array([np.packbits(counts >= least).tobytes()], pa.binary()) for least in (2, HOT)]
        return pa.Table.from_arrays([*(pa.array([x.as_py()], pa.int32()) for x in key), *bits], ["pass", "row", "range", "bits", "hot"])

    parts = docs.select("text").mapInArrow(count, "pass int, row int, range int, once binary, more binary, times binary")
    return parts.groupBy("pass", "row", "range").applyInArrow(merge, "pass int, row int, range int, bits binary, hot binary")


def gathered(merged: DataFrame, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bitmaps of one pass's rows of repeated_cells, put together on the driver: width/4 bytes a row, which MAX_CELLS bounds."""
    span = min(RANGE_CELLS, width)
    out = [(np.zeros(width // 8, np.uint8), np.zeros(width // 8, np.uint8)) for _ in range(DEPTH)]
    for r in merged.toLocalIterator():
        for into, name in zip(out[r["row"]], ("bits", "hot")):
            into[r["range"] * span // 8 :][: span // 8] = np.frombuffer(r[name], np.uint8)
    return out


def _firsts(anchor: np.ndarray, value: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, later) for places in order of window, document and place: each window's first place, and the places after it."""
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (anchor[1:] != anchor[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))
    return first, (ids != ids[head]) | (place != place[head])


def _set(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0


def repeated_windows(docs: DataFrame, shared: Broadcast, width: int, window: int = WINDOW, turn: int = 0, passes: int = 1) -> DataFrame:
    """(doc_id, starts): words of docs(doc_id, text) at which a window of pass `turn` starts that also starts earlier; some rows per document. `shared` holds the pass's bitmaps.

    A task keeps, per shard of texts, the first place of each candidate window: any later one is repeated whatever
    other tasks hold, and is returned at once. First places are grouped over all tasks by anchor, a row holding
    the windows of one place of an anchor (of a hot anchor, one window); there all but the earliest are returned.
    """
    def candidates(batches):
        hasher, merged = Hasher(), [[np.frombuffer(b, np.uint8) for b in row] for row in shared.value]
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for lo, hi, _, _, _, per, h in _texts(batch, hasher):
                start, at, shingle = anchors(h, per, window)
                if passes > 1:
                    mine = pass_of(shingle[at], passes) == turn
                    start, at = start[mine], at[mine]
                ok, hot = np.ones(len(start), bool), np.ones(len(start), bool)
                for row, (twice, often) in enumerate(merged):
                    cell = cells(shingle[at], row, width)
                    ok &= _set(twice, cell)
                    hot &= _set(often, cell)
                start, at, hot = start[ok], at[ok], hot[ok]
                if not len(start):
                    continue
                value, _ = window_hashes(h, per, window)
                value = value[start]
                anchor = np.where(hot, mixed(shingle[at] + value), shingle[at])
                doc = np.searchsorted(per, start, "right") - 1
                order = np.lexsort((start - per[doc], ids[lo + doc], value, anchor))
                start, at, hot, anchor, value, doc = (x[order] for x in (start, at, hot, anchor, value, doc))
                first, later = _firsts(anchor, value, ids[lo + doc], start - per[doc])
                yield from _by_document(ids[lo + doc[later]], (start - per[doc])[later])
                start, at, hot, anchor, value, doc = (x[first] for x in (start, at, hot, anchor, value, doc))
                order = np.lexsort((start, at))  # one row per place of an anchor, or per window of a hot one
                start, at, hot, anchor, value, doc = (x[order] for x in (start, at, hot, anchor, value, doc))
                cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | hot[1:]))) if len(at) else np.zeros(0, np.int64)
                ends = np.append(cut, len(at)).astype(np.int32)
                places = (start - per[doc]).astype(np.int32)
                yield _batch(anchor[cut].view(np.int64), ids[lo + doc[cut]], pa.ListArray.from_arrays(ends, pa.array(places)), pa.ListArray.from_arrays(ends, pa.array(value.view(np.int64))))

    def _batch(anchor, ids, starts, values):
        return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(ids, pa.int64()), starts, values], ["anchor", "doc_id", "starts", "vals"])

    def _by_document(ids, starts):
        """Rows without values, which say that the starts are repeated."""
        if len(ids):
            order = np.lexsort((starts, ids))
            ids, starts = ids[order], starts[order].astype(np.int32)
            cut = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            ends = np.append(cut, len(ids)).astype(np.int32)
            none = pa.ListArray.from_arrays(np.zeros(len(cut) + 1, np.int32), pa.array([], pa.int64()))
            # any key: spread by document, a third of a corpus's windows may be here
            yield _batch(ids[cut] * np.int64(-7046029254386353131), ids[cut], pa.ListArray.from_arrays(ends, pa.array(starts)), none)

    def losers(batches):
        """All rows of an anchor lie in one partition, sorted by it; a run of whole anchors is judged at a time."""
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            key = now.column("anchor").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            held = now.slice(cut)
            if cut:
                yield from judged(now.slice(0, cut))
        if held is not None:
            yield from judged(held)

    def judged(rows):
        rows = rows.combine_chunks()
        ids, anchor = rows.column("doc_id").to_numpy(), rows.column("anchor").to_numpy()
        starts, values = rows.column("starts").combine_chunks(), rows.column("vals").combine_chunks()
        n_starts, n_values = (np.asarray(x.value_lengths()).astype(np.int64) for x in (starts, values))
        place, value = np.asarray(starts.flatten()), np.asarray(values.flatten())
        row = np.repeat(np.arange(len(ids)), n_starts)
        known = n_values[row] == 0
        out_ids, out_starts = [ids[row[known]]], [place[known]]
        row, place = row[~known], place[~known]
        order = np.lexsort((place, ids[row], value, anchor[row]))
        row, place, value = row[order], place[order], value[order]
        _, later = _firsts(anchor[row], value, ids[row], place)
        out_ids.append(ids[row[later]])
        out_starts.append(place[later])
        found, at = np.concatenate(out_ids), np.concatenate(out_starts)
        if len(found):
            order = np.lexsort((at, found))
            found, at = found[order], at[order]
            cut = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(found[cut]), pa.ListArray.from_arrays(np.append(cut, len(found)).astype(np.int32), pa.array(at.astype(np.int32)))], ["doc_id", "starts"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = docs.select("doc_id", "text").mapInArrow(candidates, "anchor long, doc_id long, starts array<int>, vals array<long>")
    return first.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(losers, "doc_id long, starts array<int>")


def _with_starts(docs: DataFrame, window: int, max_cells: int, max_passes: int) -> DataFrame:
    """docs(id, text, ...) with starts, the words of each document at which a repeated window starts; null where there is none."""
    n_chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes, width = sketch_size(int(n_chars) // 6, max_cells, max_passes)
    keyed = docs.select(F.col("id").alias("doc_id"), "text")
    found = _repeats(keyed, width, window, passes).groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return docs.join(found.withColumnRenamed("doc_id", "id"), "id", "left")


def _repeats(docs: DataFrame, width: int, window: int, passes: int) -> DataFrame:
    """repeated_windows over all passes. Of several, each is written before the next, so that executors hold one pass's bitmaps."""
    sc = docs.sparkSession.sparkContext
    merged = repeated_cells(docs, width, window, passes)

    def broadcast(sketches):
        return sc.broadcast([(b.tobytes(), hot.tobytes()) for b, hot in gathered(sketches, width)])

    if passes == 1:
        return repeated_windows(docs, broadcast(merged), width, window)
    parts = []
    with temporary_tables(docs.sparkSession):
        merged = written(merged, "sketches")
        for turn in range(passes):
            shared = broadcast(merged.where(F.col("pass") == turn))
            parts.append(written(repeated_windows(docs, shared, width, window, turn, passes), "repeats", keep=True))
            shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def _kept(text: pa.Array, starts: pa.Array, window: int):
    """For each text: number of words, number removed, the kept words joined by single spaces (bytes)."""
    n_starts = np.asarray(starts.value_lengths().fill_null(0)).astype(np.int64)
    flat, at = np.asarray(starts.flatten()), np.concatenate(([0], np.cumsum(n_starts)))
    for lo, hi, data, offsets in chunks(text):
        begin, end, per = words(data, offsets, SPACE)
        steps = np.zeros(len(begin) + 1, np.int64)
        first = flat[at[lo] : at[hi]] + np.repeat(per[:-1], n_starts[lo:hi])
        np.add.at(steps, first, 1)
        np.add.at(steps, np.minimum(first + window, len(begin)), -1)
        keep = np.cumsum(steps[:-1]) <= 0
        joined, place = normalised(data, begin, end, keep)
        gone = np.concatenate(([0], np.cumsum(~keep)))
        for i in range(hi - lo):
            a, b = per[i], per[i + 1]
            yield int(b - a), int(gone[b] - gone[a]), joined[place[a] : max(place[a], place[b] - 1)]


def _id_of(text: Column) -> Column:
    """The doc_id; a row without one is a document by its text, before all that have one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)) + F.pmod(F.xxhash64(text), F.lit(1 << 61)))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(_id_of(text).alias("id"), "doc_id", text.alias("text"))


def removal_report(docs: DataFrame, window: int = WINDOW, max_cells: int = MAX_CELLS, max_passes: int = MAX_PASSES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256.

    Words are split at white space and compared unchanged. Null text: no words. A text of fewer words than a window
    loses none. Rows without a doc_id are documents by their texts, before all others (doc_ids below -2**62 are not expected). Rows with one doc_id are one document in several
    copies: a window at one place of it is no repeat of itself, and all the rows lose the same places. Empty input:
    no rows. Other columns of docs are ignored.
    """

    def finish(batches):
        for batch in batches:
            rows = list(_kept(batch.column(1), batch.column(2), window))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    rows = _with_starts(_keyed(docs), window, max_cells, max_passes)
    return rows.select("doc_id", "text", "starts").mapInArrow(finish, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, window: int = WINDOW, max_cells: int = MAX_CELLS, max_passes: int = MAX_PASSES) -> DataFrame:
    """docs, all columns kept, with each text that loses words replaced by its kept words joined by single spaces.

    Texts that lose none stay as they are, null ones null. Other cases are as in removal_report.
    """

    def cut(batches):
        for batch in batches:
            rows = list(_kept(batch.column(0), batch.column(1), window))
            texts = [r[2].decode() if r[1] else None for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(texts, pa.string())], ["row", "kept"])

    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = packed.select("row", _id_of(text).alias("id"), text.alias("text"))
    rows = _with_starts(packed, window, max_cells, max_passes).select("text", "starts", "row")
    out = rows.mapInArrow(cut, f"row {rows.schema['row'].dataType.simpleString()}, kept string")
    return out.select(*[(F.coalesce("kept", F.col("row").getField(c)) if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


#: The same rows as op7_substrings', from every window of every text.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i+1:i+20], ' ') AS w FROM (SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS i FROM d WHERE len(words) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
p AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
k AS (SELECT doc_id, words, coalesce(len(gone), 0) AS n_removed, CASE WHEN gone IS NULL THEN words ELSE words[0:0] END AS whole FROM d LEFT JOIN p USING (doc_id)),
u AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept FROM (SELECT d.doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS q FROM d JOIN p USING (doc_id)) x ANTI JOIN g ON x.doc_id = g.doc_id AND x.q = g.p GROUP BY doc_id)
SELECT k.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(CASE WHEN n_removed = 0 THEN array_to_string(words, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM k LEFT JOIN u ON k.doc_id = u.doc_id
"""
