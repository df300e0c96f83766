"""Benchmark decontamination with training suffix arrays.

Training texts are taken in shards of whole texts. The words of a shard become numbers in the benchmark's
vocabulary, 0 for any other word; a run of known words too short for the shortest window can hold no match and is left
out. The rest is sorted into a suffix array, every test suffix is binary-searched in it, and
neighbouring window matches are joined into the longest verbatim matches with their locations.

Words are compared by 64-bit hash. A document is searched where it is read: nothing is shuffled, and
what a task holds is one shard and one block of the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import written
from .tokens import ALNUM, Hasher, chunks, words

WINDOW = 10
#: Characters of the benchmark that a task holds at a time; a larger benchmark is searched in blocks of items, one pass each.
BLOCK_CHARS = 32_000_000
SHARD_BYTES = 2 << 20


class TestItems:
    """A block of benchmark items: vocabulary, words as numbers, and the suffixes that begin a window."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        hasher, hashes, item = Hasher(lower=True), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, _, data, offsets in chunks(pa.array(texts, pa.string())):
            starts, ends, per = words(data, offsets, ALNUM)
            hashes.append(hasher(data, starts, ends))
            item.append(lo + np.repeat(np.arange(len(per) - 1), np.diff(per)))
        hashes, item = np.concatenate(hashes), np.concatenate(item)
        self.ids = np.array(ids, object)
        self.vocabulary, code = np.unique(hashes, return_inverse=True)
        self.codes = code.astype(np.int64) + 1
        n_words = np.bincount(item, minlength=len(ids))
        sizes, first = np.minimum(n_words, window), np.cumsum(n_words) - n_words
        at = np.arange(len(item)) - first[item]
        self.suffix = np.flatnonzero(at + sizes[item] <= n_words[item])
        self.item, self.at = item[self.suffix], at[self.suffix]
        self.size = sizes[self.item].astype(np.int64)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.per = max(1, 62 // self.bits)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 where the benchmark lacks it."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def suffix_array(codes: np.ndarray, bits: int, per: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the nonzero codes in the order of the next `depth` codes, `per` codes packed at each place).

    Ranks start from the packed codes and double until they cover `depth`. A zero ends what can match, so the order behind one is free.
    """
    n = len(codes)
    padded = np.concatenate((codes, np.zeros(per, np.int64)))
    packed, live = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(per):
        ahead = padded[k : k + n]
        live &= ahead > 0
        packed = (packed << bits) | np.where(live, ahead, 0)
    places = np.flatnonzero(codes)
    values, inverse = np.unique(packed[places], return_inverse=True)
    covered = per
    while covered < depth and len(values) < len(places):
        rank = np.zeros(n + covered, np.int64)
        rank[places] = inverse + 1
        values, inverse = np.unique(rank[places] * (len(values) + 1) + rank[places + covered], return_inverse=True)
        covered *= 2
    return places[np.argsort(inverse, kind="stable")], packed


def intervals(sa: np.ndarray, packed: np.ndarray, items: TestItems) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range [low, high) of the suffix array whose suffixes begin with its window."""
    patterns = []
    for block in range(0, int(items.size.max()), items.per):
        value, mask = np.zeros(len(items.suffix), np.int64), np.zeros(len(items.suffix), np.int64)
        for k in range(block, block + items.per):
            inside = k < items.size
            code = items.codes[np.minimum(items.suffix + k, len(items.codes) - 1)]
            value = (value << items.bits) | np.where(inside, code, 0)
            mask = (mask << items.bits) | np.where(inside, (1 << items.bits) - 1, 0)
        patterns.append((value, mask))

    def side(after: bool) -> np.ndarray:
        low, high = np.zeros(len(items.suffix), np.int64), np.full(len(items.suffix), len(sa), np.int64)
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo]) // 2
            place = sa[middle]
            below, equal = np.zeros(len(todo), bool), np.ones(len(todo), bool)
            for k, (value, mask) in enumerate(patterns):
                there = place + k * items.per
                text = np.where(there < len(packed), packed[np.minimum(there, len(packed) - 1)], 0) & mask[todo]
                want = value[todo]
                below |= equal & (text < want)
                equal &= text == want
            right = below | equal if after else below
            low[todo[right]] = middle[right] + 1
            high[todo[~right]] = middle[~right]
        return low

    return side(False), side(True)


def occurrences(numbers: np.ndarray, per: np.ndarray, items: TestItems) -> tuple[np.ndarray, np.ndarray]:
    """(test suffix, word place) of every occurrence of a window in a shard, whose texts' words begin at `per`."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = numbers > 0
    if not len(items.suffix) or not known.any():
        return nothing
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    edge = per[per < len(numbers)]
    begin[edge] = known[edge]
    run = np.cumsum(begin) - 1
    long_ = np.bincount(run[known]) >= int(items.size.min())
    places = np.flatnonzero(known & long_[np.maximum(run, 0)])
    if not len(places):
        return nothing
    slots = np.arange(len(places)) + np.cumsum(begin[places])
    short, origin = np.zeros(int(slots[-1]) + 2, np.int64), np.zeros(int(slots[-1]) + 2, np.int64)
    short[slots], origin[slots] = numbers[places], places
    sa, packed = suffix_array(short, items.bits, items.per, int(items.size.max()))
    low, high = intervals(sa, packed, items)
    count = high - low
    hit = np.flatnonzero(count)
    suffix, begins = np.repeat(hit, count[hit]), np.cumsum(count[hit]) - count[hit]
    return suffix, origin[sa[np.repeat(low[hit] - begins, count[hit]) + np.arange(len(suffix))]]


def shards(column: pa.Array, items: TestItems) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, where its texts' words begin, test suffix, word place) for each shard of a column of texts."""
    hasher = Hasher(lower=True)
    for lo, hi, data, offsets in chunks(column, SHARD_BYTES):
        starts, ends, per = words(data, offsets, ALNUM)
        numbers = items.numbers(hasher(data, starts, ends)) if len(items.vocabulary) else np.zeros(len(starts), np.int64)
        yield lo, hi, per, *occurrences(numbers, per, items)


def longest(suffix: np.ndarray, place: np.ndarray, items: TestItems) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, item word, text word, words) of the maximal matches that window occurrences make up."""
    item, at, size = items.item[suffix], items.at[suffix], items.size[suffix]
    order = np.lexsort((place, place - at, item))
    item, at, size, place = item[order], at[order], size[order], place[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | ((place - at)[1:] != (place - at)[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1 if len(item) else first
    return item[first], at[first], place[first], place[last] + size[last] - place[first]


def _blocks(benchmark: DataFrame, window: int) -> Iterator[TestItems]:
    """The benchmark's items in blocks of at most BLOCK_CHARS characters; at least one, maybe empty. A null item_id is the empty string."""
    ids, texts, held, any_ = [], [], 0, False
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ids.append("" if row[0] is None else str(row[0]))
        texts.append(row[1] or "")
        held += len(texts[-1])
        if held >= BLOCK_CHARS:
            yield TestItems(ids, texts, window)
            ids, texts, held, any_ = [], [], 0, True
    if ids or not any_:
        yield TestItems(ids, texts, window)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Longest verbatim matches of at least a window: doc_id, item_id, item_word, doc_word, n_words.

    Places are word numbers from 0. Null texts match nothing; repeated rows and items match each; a null item_id is the empty string.
    """
    out = None
    for items in _blocks(benchmark, window):

        def find(batches, items=items):
            for batch in batches:
                for lo, _, per, suffix, place in shards(batch.column(1), items):
                    item, at, start, size = longest(suffix, place, items)
                    # a match within one text only: windows never cross texts, runs of them on one diagonal don't either
                    doc = np.searchsorted(per, start, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(lo + doc)), pa.array(items.ids[item], pa.string()), pa.array(at), pa.array(start - per[doc]), pa.array(size)],
                        ["doc_id", "item_id", "item_word", "doc_word", "n_words"],
                    )

        kind = dict(docs.dtypes)["doc_id"]
        found = docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, item_id string, item_word long, doc_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def _runs(marks: np.ndarray) -> np.ndarray:
    """Flat [start, end) pairs of the true runs."""
    edges = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.column_stack((np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))).ravel()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, letters (A-Z as a-z) and characters beyond ASCII. A window is `window` consecutive words
    of an item, or the whole of a shorter one; a word inside any occurrence of a window is hit. Null or empty text:
    no words. Items without words never occur. Repeated rows: each reported; repeated items count by item_id. Empty
    docs: no rows; empty benchmark: no hits. Other columns of docs are ignored. A benchmark of several blocks takes
    one pass each, which leaves the hit words and items beside the text in a table, so the driver holds no more than two blocks.
    """
    kind, blocks = dict(docs.dtypes)["doc_id"], _blocks(benchmark, window)
    rows, n, after = docs.select("doc_id", "text"), 0, next(blocks)
    while after is not None:
        items, after = after, next(blocks, None)
        final = after is None

        def search(batches, items=items, first=n == 0, final=final):
            for batch in batches:
                text = batch.column(1)
                for lo, hi, per, suffix, place in shards(text, items):
                    item, _, start, size = longest(suffix, place, items)
                    steps = np.zeros(int(per[-1]) + 1, np.int64)
                    np.add.at(steps, start, 1)
                    np.add.at(steps, start + size, -1)
                    hit = np.cumsum(steps[:-1]) > 0
                    doc = np.searchsorted(per, start, "right") - 1
                    pairs = np.unique(doc * (len(items.ids) + 1) + item)
                    names: list[set] = [set() for _ in range(hi - lo)]
                    for pair in pairs.tolist():
                        names[pair // (len(items.ids) + 1)].add(items.ids[pair % (len(items.ids) + 1)])
                    if not first:
                        for i in range(hi - lo):
                            runs = batch.column(2)[lo + i].as_py()
                            for a, b in zip(runs[::2], runs[1::2]):
                                hit[per[i] + a : per[i] + b] = True
                            names[i].update(batch.column(3)[lo + i].as_py())
                    ids = batch.column(0).slice(lo, hi - lo)
                    if not final:
                        runs = [_runs(hit[per[i] : per[i + 1]]) for i in range(hi - lo)]
                        yield pa.RecordBatch.from_arrays(
                            [ids, text.slice(lo, hi - lo), pa.array(runs, pa.list_(pa.int64())), pa.array([sorted(s) for s in names], pa.list_(pa.string()))], ["doc_id", "text", "runs", "items"]
                        )
                        continue
                    total = np.concatenate(([0], np.cumsum(hit)))
                    n_hit = total[per[1:]] - total[per[:-1]]
                    digests = [hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in names]
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.diff(per)), pa.array(n_hit), pa.array([len(s) for s in names], pa.int64()), pa.array(digests, pa.string()), pa.array(n_hit > 0)],
                        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                    )

        carried = f"doc_id {kind}, text string, runs array<long>, items array<string>"
        rows = rows.mapInArrow(search, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if final else carried)
        if not final:
            rows = written(rows, "hits")
        n += 1
    return rows


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs; all columns are kept, whatever their names.

    Null and empty texts stay; repeated rows fall alike; nulls elsewhere do not matter. Empty docs: no rows; empty benchmark: all rows.
    """
    at = docs.columns.index("text")
    for items in _blocks(benchmark, window):

        def clean(batches, items=items):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, per, _, place in shards(batch.column(at), items):
                    keep[lo + np.searchsorted(per, place, "right") - 1] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


#: The same rows as op4_decontaminate's, from every window of every text.
ORACLE = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), bw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[i+1:i+least(10, len(words))], ' ') AS w
  FROM (SELECT item_id, words, unnest(range(0, len(words) - least(10, len(words)) + 1)) AS i FROM bw WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM windows), grams AS (
  SELECT rid, i, n, array_to_string(words[i+1:i+n], ' ') AS w FROM (SELECT rid, words, n, unnest(range(0, len(words) - n + 1)) AS i FROM dw, sizes WHERE len(words) >= n)
), hits AS (SELECT rid, i, g.n, item_id FROM grams g JOIN windows USING (n, w)
), marks AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), named AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN marks USING (rid) LEFT JOIN named USING (rid)
"""
