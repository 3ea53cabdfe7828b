"""Substring deduplication with prefix-partitioned suffix trees.

Words are maximal runs of bytes other than space and tab to carriage return, unchanged;
null has none. A window is ``width`` consecutive words of a text. Words covered by a
window whose words also begin anywhere else (in the same text too) are removed.

Suffixes. The trees are sparse: of the first ``REACH`` places of every window the one
with the least hash of its next ``GRAM`` words is the window's anchor (the leftmost, if
equal). Equal windows have the same anchor, at the same place, and share at least
``PREFIXES[-1]`` words from it. So only suffixes that begin at anchors are dealt, each
with the words before it that its windows reach back to.

Pruning. A suffix whose prefix of ``PREFIXES[-1]`` words begins no other suffix has no
repeated window; only the others are cut from the texts. Hashes choose anchors and leave
out single prefixes, and equal hashes of different words only cost work: what repeats is
decided by comparing words.

Groups. Suffixes go by a prefix of variable length: the shortest of ``PREFIXES`` that
begins at most ``GROUP_ROWS`` different suffixes. Groups are brought together to
memory-sized bins. Prefixes that are still too frequent at the greatest length are
lengthened to whole windows, whose tree nodes are deep by themselves and are counted.

Trees. In a bin the suffixes are sorted; neighbours' common words are the depths of the
internal nodes. A node of depth ``width - n`` whose suffixes also agree in the n words before
them is a repeat of ``width`` words; maximal repeats are covered by these windows.

Copies of a text, and suffixes that are equal with all their words, are counted in the
tasks first and compared once, so hot passages stay small. Texts are known by
their SHA-256, suffixes with their words by 128 bits of BLAKE2.

Null and empty texts and texts of fewer than ``width`` words keep all words. Repeated rows are
documents of their own: their windows repeat each other. Keys may be null or of any type; an empty
table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm.common import packed_strings, scratch, spread_ranges, stored, temp_name, text_bytes, text_slices, words_of

WIDTH, GRAM, REACH = 35, 8, 24
PREFIXES = (4, 8, 12)  # words; the last is at most WIDTH - REACH + 1
GROUP_ROWS = 20_000  # suffixes of one prefix
BIN_ROWS = 40_000  # suffixes of a bin of groups, about
BROADCAST_ROWS = 100_000  # frequent prefixes sent to all tasks, at most
SLICE = 2 << 20  # bytes of text hashed at once
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD, MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
POWERS = np.cumprod(np.full(256, 0x100000001B3, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * MORE
    x = (x ^ (x >> np.uint64(32))) * MORE
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    at = spread_ranges(starts, ends - starts)
    place = at - np.repeat(starts, ends - starts)
    total = np.concatenate(([np.uint64(0)], np.cumsum((raw[at].astype(np.uint64) + np.uint64(1)) * POWERS[place % len(POWERS)], dtype=np.uint64)))
    bounds = np.concatenate(([0], np.cumsum(ends - starts)))
    return mixed((total[bounds[1:]] - total[bounds[:-1]]) * ODD)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on (places near the end: of what is left)."""
    out = np.zeros(len(words), np.uint64)
    for n in range(min(size, len(words))):
        out[:len(words) - n] += words[n:] * POWERS[n]
    return mixed(out)


def least_places(values: np.ndarray, reach: int) -> np.ndarray:
    """For each place the leftmost place of the least value among the next ``reach``."""
    place, size = np.arange(len(values)), 1
    least = values
    while size < reach:
        step = min(size, reach - size)
        keep = least[:-step] <= least[step:]
        place = np.where(keep, place[:-step], place[step:])
        least = np.where(keep, least[:-step], least[step:])
        size += step
    return place


def anchors(hashes: np.ndarray, firsts: np.ndarray, counts: np.ndarray, width: int, reach: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first and last window start) of every run of windows with one anchor; places in the slice."""
    windows = np.maximum(counts - width + 1, 0)
    if not windows.sum():
        return (np.zeros(0, np.int64),) * 3
    begin = spread_ranges(firsts, windows)
    at = least_places(gram_hashes(hashes, gram), reach)[begin]
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[new], begin[new], begin[np.append(new[1:], len(at)) - 1]


def text_key(text: str) -> list[Column]:
    """128 bits of the text's SHA-256 as two columns t1, t2."""
    code = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return [F.conv(F.substring(code, 1 + 16 * n, 16), 16, -10).cast("long").alias(f"t{n + 1}") for n in range(2)]


def sweep(docs: DataFrame, path: str, key: str, text: str, width: int, reach: int) -> DataFrame:
    """One row per document: row, key, t1, t2, n_words, whole_sha256 (of all words) and its anchors:
    prefix hashes and places (anchor << 16 | windows back << 8 | windows ahead)."""
    rows = docs.select(F.col(key).alias("key"), *text_key(text), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                raw, offsets = text_bytes(part.column(3))
                starts, ends, owner = words_of(raw, offsets, NOT_SPACE)
                counts = np.bincount(owner, minlength=part.num_rows)
                firsts = np.cumsum(counts) - counts
                hashes = word_hashes(raw, starts, ends)
                at, low, high = anchors(hashes, firsts, counts, width, reach, GRAM)
                prefix = gram_hashes(hashes, PREFIXES[-1])[at].view(np.int64)
                row = owner[at] if len(at) else np.zeros(0, np.int64)
                place = (at - firsts[row]) << 16 | (at - low) << 8 | (high - low)
                bounds = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                digests = [hashlib.sha256(words).hexdigest() for words in joined_words(raw, starts, ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number + np.arange(part.num_rows)), *(part.column(n) for n in range(3)), pa.array(counts.astype(np.int64)), pa.array(digests, pa.string()),
                     pa.ListArray.from_arrays(bounds, pa.array(prefix)), pa.ListArray.from_arrays(bounds, pa.array(place))],
                    names=["row", "key", "t1", "t2", "n_words", "whole_sha256", "prefix", "place"])
                number += part.num_rows

    kind = docs.schema[key].dataType.simpleString()
    made = rows.mapInArrow(run, f"row long, key {kind}, t1 long, t2 long, n_words long, whole_sha256 string, prefix array<long>, place array<long>")
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def joined_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> Iterator[memoryview]:
    """The words of each row, joined by one space."""
    lengths = ends - starts
    places = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    out[spread_ranges(places, lengths)] = raw[spread_ranges(starts, lengths)]
    view, last = memoryview(out), np.cumsum(counts)
    stop = np.concatenate(([0], places + lengths + 1))
    for a, b in zip(stop[last - counts].tolist(), stop[last].tolist(), strict=True):
        yield view[a:max(b - 1, a)]


def repeated_anchors(rows: DataFrame, path: str) -> DataFrame:
    """(t1, t2, places) of one copy of each text: its anchors whose longest prefix begins several suffixes."""
    listed = rows.filter(F.size("prefix") > 0).select("row", F.explode(F.arrays_zip("prefix", "place")).alias("a")).select("row", "a.prefix", "a.place")
    often = stored(listed.groupBy("prefix").count().filter("count > 1").select("prefix"), f"{path}/often")
    found = listed.join(often, "prefix").groupBy("row").agg(F.collect_list("place").alias("places"))
    return found.join(rows.select("row", "t1", "t2"), "row").groupBy("t1", "t2").agg(F.first("places").alias("places"))


PARTS = ("digest binary, words string, back int, windows int, copies long, " + ", ".join(f"p{n} long" for n in PREFIXES)
         + ", t1 long, t2 long, text string, lows array<int>, digests array<binary>")


def cut_suffixes(docs: DataFrame, wanted: DataFrame, path: str, text: str, width: int) -> DataFrame:
    """Rows of two kinds: suffixes with the words of their windows, once per task; texts with the places of theirs."""
    texts = docs.select(*text_key(text), F.col(text).alias("text")).groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    both = texts.join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "copies", "places")
    kinds = [pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.int64()] * len(PREFIXES), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.binary())]
    names = [c.split(" ")[0] for c in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                raw, offsets = text_bytes(part.column(2))
                starts, ends, owner = words_of(raw, offsets, NOT_SPACE)
                counts = np.bincount(owner, minlength=part.num_rows)
                firsts = np.cumsum(counts) - counts
                hashes = word_hashes(raw, starts, ends)
                places = part.column(4)
                sizes = np.diff(places.offsets.to_numpy())
                place = places.flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), sizes)
                order = np.lexsort((place, row))
                place, row = place[order], row[order]
                at = (place >> 16) + firsts[row]
                back, ahead = (place >> 8) & 255, place & 255
                low = at - back
                lengths = ends - starts
                spots = np.cumsum(lengths + 1) - lengths - 1
                single = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
                single[spread_ranges(spots, lengths)] = raw[spread_ranges(starts, lengths)]
                last = low + ahead + width - 1
                cuts = zip(spots[low].tolist(), (spots[last] + lengths[last]).tolist(), back.tolist(), strict=True)
                view, copies = memoryview(single), part.column(3).to_numpy()[row]
                digests = [hashlib.blake2b(view[a:b], digest_size=16, salt=bytes([n])).digest() for a, b, n in cuts]
                # Suffixes that are equal in all their words, counted with the copies of their texts.
                name: dict[bytes, int] = {}
                number = np.array([name.setdefault(d, len(name)) for d in digests], np.int64)
                _, first = np.unique(number, return_index=True)
                total = np.bincount(number, copies, minlength=len(name)).astype(np.int64)
                a, b = spots[low[first]], spots[last[first]] + lengths[last[first]]
                prefix = [pa.array(gram_hashes(hashes, n)[at[first]].view(np.int64)) for n in PREFIXES]
                none = [pa.nulls(len(first), k) for k in kinds[-5:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[n] for n in first.tolist()], pa.binary()), packed_strings(single, a, b), pa.array(back[first].astype(np.int32)),
                     pa.array((ahead[first] + 1).astype(np.int32)), pa.array(total), *prefix, *none], names=names)
                bounds = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32))
                none = [pa.nulls(part.num_rows, k) for k in kinds[:-5]]
                yield pa.RecordBatch.from_arrays(
                    [*none, part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(bounds, pa.array((low - firsts[row]).astype(np.int32))),
                     pa.ListArray.from_arrays(bounds, pa.array(digests, pa.binary()))], names=names)

    made = both.mapInArrow(run, PARTS)
    made.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def frequent(suffixes: DataFrame, prefix: str, rows: int, path: str) -> tuple[DataFrame, int]:
    """(the prefixes that begin more than ``rows`` suffixes, how many these are)."""
    found = stored(suffixes.groupBy(prefix).count().filter(F.col("count") > rows).select(prefix, F.lit(True).alias(f"often_{prefix}")), path)
    return found, found.count()


def dealt(suffixes: DataFrame, path: str, group_rows: int, bin_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """(suffixes with the group of their shortest prefix that is not too frequent, those that have none, bins)."""
    open_ = suffixes
    for n in PREFIXES:
        often, size = frequent(suffixes, f"p{n}", group_rows, f"{path}/often{n}")
        open_ = open_.join(F.broadcast(often) if size <= BROADCAST_ROWS else often, f"p{n}", "left")
    group = F.coalesce(*[F.when(F.col(f"often_p{n}").isNull(), F.xxhash64(F.lit(n), f"p{n}")) for n in PREFIXES])
    bins = max(1, -(-suffixes.count() // bin_rows))
    named = open_.withColumn("group", group).select("digest", "words", "back", "windows", "copies", "group")
    return named.filter("group is not null").withColumn("bin", F.pmod("group", F.lit(bins))), named.filter("group is null"), bins


def sorted_tree(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, words that each shares with the one before it) of rows of word numbers."""
    if not table.shape[1]:
        return np.arange(len(table)), np.zeros(len(table), np.int64)
    order = np.lexsort(table.T[::-1])
    ranked = table[order]
    same = np.zeros(ranked.shape, dtype=bool)
    same[1:] = ranked[1:] == ranked[:-1]
    return order, np.where(same.all(axis=1), table.shape[1], (~same).argmax(axis=1))


def nodes_at(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """The tree node at a depth that each row lies below."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeats_in_bin(table: pa.Table, width: int, reach: int) -> pa.Table:
    """(digest, mask): the windows of every suffix that repeat, bit n for the one that begins n words after the first."""
    digest, first, number = np.unique(np.array(table["digest"].to_pylist(), dtype="S16"), return_index=True, return_inverse=True)
    copies = np.bincount(number, table["copies"].to_numpy()).astype(np.int64)
    own = table.take(pa.array(first))
    back, windows = own["back"].to_numpy().astype(np.int64), own["windows"].to_numpy().astype(np.int64)
    raw, offsets = text_bytes(own["words"])
    starts, ends, owner = words_of(raw, offsets, NOT_SPACE)
    coded = packed_strings(raw, starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(owner, minlength=len(first))
    anchor = np.cumsum(counts) - counts + back
    bounds = np.cumsum(counts)
    spot = anchor[:, None] + np.arange(width)
    after = np.where(spot < bounds[:, None], coded[np.minimum(spot, len(coded) - 1)], -1)
    spot = anchor[:, None] - 1 - np.arange(reach - 1)
    before = np.where(spot >= (bounds - counts)[:, None], coded[np.maximum(spot, 0)], -1)
    right, left = sorted_tree(after), sorted_tree(before)
    mask = np.zeros(len(first), np.int64)
    for n in range(reach):
        has = np.flatnonzero((n <= back) & (n > back - windows))
        if not len(has):
            continue
        node = nodes_at(*right, width - n)[has] * (len(first) + 1) + nodes_at(*left, n)[has]
        _, which = np.unique(node, return_inverse=True)
        hit = has[np.bincount(which, copies[has])[which] > 1]
        mask[hit] |= 1 << (back[hit] - n)
    some = np.flatnonzero(mask)
    return pa.table({"digest": own["digest"].take(pa.array(some)).combine_chunks(), "mask": pa.array(mask[some])})


def repeats_of_windows(suffixes: DataFrame, path: str, width: int) -> DataFrame:
    """(digest, mask) where prefixes are lengthened to whole windows: those that begin several times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, words, windows, copies in zip(*(batch.column(c).to_pylist() for c in ("digest", "words", "windows", "copies")), strict=True):
                cut = words.split(" ")
                for n in range(windows):
                    out.append((digest, hashlib.blake2b(" ".join(cut[n:n + width]).encode(), digest_size=16).digest(), n, copies))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.int32(), pa.int64()), strict=True)], names=["digest", "window", "n", "copies"])

    each = suffixes.groupBy("digest").agg(F.first("words").alias("words"), F.first("windows").alias("windows"), F.sum("copies").alias("copies"))
    each = stored(each.mapInArrow(run, "digest binary, window binary, n int, copies long"), f"{path}/windows")
    often = stored(each.groupBy("window").agg(F.sum("copies").alias("all")).filter("all > 1").select("window"), f"{path}/often_windows")
    return each.join(often, "window").groupBy("digest").agg(F.sum(F.expr("shiftleft(1L, n)")).alias("mask"))


def removed_words(spans: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(t1, t2, n_removed, kept_sha256, removed word ranges) of texts (t1, t2, text) with marked windows."""
    marked = spans.groupBy("t1", "t2").agg(F.collect_list("low").alias("lows"), F.collect_list("mask").alias("masks"))
    both = rows.join(marked, ["t1", "t2"]).select("t1", "t2", "text", "lows", "masks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                raw, offsets = text_bytes(part.column(2))
                starts, ends, owner = words_of(raw, offsets, NOT_SPACE)
                counts = np.bincount(owner, minlength=part.num_rows)
                firsts = np.cumsum(counts) - counts
                row = np.repeat(np.arange(part.num_rows), np.diff(part.column(3).offsets.to_numpy()))
                low, mask = (part.column(n).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for n in (3, 4))
                change = np.zeros(len(starts) + 1, np.int64)
                for n in range(int(mask.max()).bit_length()):
                    at = (low + firsts[row])[(mask >> n) & 1 > 0] + n
                    np.add.at(change, at, 1)
                    np.add.at(change, at + width, -1)
                gone = np.cumsum(change[:-1]) > 0
                left = np.bincount(owner[~gone], minlength=part.num_rows)
                digests = [hashlib.sha256(words).hexdigest() for words in joined_words(raw, starts[~gone], ends[~gone], left)]
                edge = np.ones(len(gone), dtype=bool)
                edge[1:] = (gone[1:] != gone[:-1]) | (owner[1:] != owner[:-1])
                begin = np.flatnonzero(edge)
                stop = np.append(begin[1:], len(gone))
                begin, stop = begin[gone[begin]], stop[gone[begin]]
                whose = owner[begin]
                ranges = pa.StructArray.from_arrays([pa.array(begin - firsts[whose]), pa.array(stop - firsts[whose])], names=["low", "high"])
                bounds = pa.array(np.searchsorted(whose, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array((counts - left).astype(np.int64)), pa.array(digests, pa.string()),
                                                  pa.ListArray.from_arrays(bounds, ranges)], names=["t1", "t2", "n_removed", "kept_sha256", "removed"])

    return both.mapInArrow(run, "t1 long, t2 long, n_removed long, kept_sha256 string, removed array<struct<low:long,high:long>>")


def find_repeats(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, path: str | None = None,
                 group_rows: int = GROUP_ROWS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """One row per document: key, t1, t2 (of its text), n_words, n_removed, kept_sha256 (of the kept words
    joined by one space) and ``removed``, the word ranges that go."""
    reach = min(REACH, width - PREFIXES[-1] + 1)
    if reach < 1:
        raise ValueError(f"a window has at least {PREFIXES[-1]} words")
    path = path or scratch(spark, "substrings")
    rows = sweep(docs, f"{path}/rows", key, text, width, reach)
    parts = cut_suffixes(docs, repeated_anchors(rows, path), f"{path}/parts", text, width)
    suffixes = parts.filter("digest is not null")
    grouped, hot, bins = dealt(suffixes, path, group_rows, bin_rows)
    trees = grouped.repartition(bins, "bin").groupBy("bin").applyInArrow(lambda t: repeats_in_bin(t, width, reach), "digest binary, mask long")
    masks = stored(trees.unionByName(repeats_of_windows(hot, path, width)), f"{path}/masks")
    texts = parts.filter("text is not null")
    placed = texts.select("t1", "t2", F.explode(F.arrays_zip("lows", "digests")).alias("s")).select("t1", "t2", F.col("s.lows").alias("low"), F.col("s.digests").alias("digest"))
    spans = placed.join(masks, "digest").select("t1", "t2", "low", "mask")
    found = stored(removed_words(spans, texts.select("t1", "t2", "text"), width), f"{path}/removed")
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    return (rows.select("key", "t1", "t2", "n_words", "whole_sha256").join(found, ["t1", "t2"], "left")
            .select(F.col("key").alias(key), "t1", "t2", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                    F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), F.coalesce("removed", none).alias("removed")))


def remove_repeats(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents with their repeated words gone (the others joined by one space) and all their columns.
    A text that loses nothing stays as it is."""
    found = find_repeats(spark, docs, key=key, text=text, width=width).filter("n_removed > 0").select("t1", "t2", "removed").dropDuplicates(["t1", "t2"])
    found = stored(found, f"{scratch(spark, 'removed')}/found")
    spots = [temp_name(docs, f"_{c}") for c in ("t1", "t2", "removed")]
    both = docs.withColumns(dict(zip(spots, text_key(text), strict=False))).join(found.toDF(*spots), spots[:2], "left").select(*docs.columns, spots[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text, SLICE):
                at = part.schema.get_field_index(text)
                kept = []
                for said, ranges in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    if ranges:
                        words, stay, last = WORD.findall(said), [], 0
                        for r in ranges:
                            stay += words[last:r["low"]]
                            last = r["high"]
                        said = " ".join(stay + words[last:])
                    kept.append(said)
                columns = part.columns[:-1]
                columns[at] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])

    return both.mapInArrow(run, docs.schema)
