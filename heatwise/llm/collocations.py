"""Phrase collocations: counts of all frequent word sequences from vertically partitioned suffixes.

A suffix is what follows a word inside its piece, cut after ``max_words`` words.  The forest
of all suffixes is partitioned by word prefixes so that every part fits a memory budget, and
each part's subtree is built in one task, independent of the others:

1. words are counted; a phrase is no more frequent than its words, so suffixes end before the
   first word under ``min_count``.  Tasks know the others by a bit table of fixed size;
2. a phrase is no more frequent than its word pairs either: pairs are counted by slots of their
   hash, which travel as sorted gap-coded runs, and suffixes also end before the first pair
   whose slot is under ``min_count``.  The bit table of slots grows with the words up to 32 MB.
   False hits in both tables only cost rows: their phrases fall below ``min_count`` in the end;
3. prefixes of one word lie in 4096 slices, which one scan counts; a slice over the budget is
   split by prefixes of two words, and so on up to the full depth (one scan for each depth that
   is still over).  Slices are gathered into groups up to the budget.  The driver holds one
   number for each slice: 4096, and 64 for each slice over budget, of which there are at most
   (words / budget) for each depth;
4. tasks sort the suffixes of a block, add up equal ones and send each group's part as one
   front-coded record: what is shared with the suffix before is left out;
5. a group's task merges its records, which makes the leaves of its subtree; a node's count is
   the sum of the leaves under it.  Nodes above a slice's own depth lie in several groups,
   their counts are added up afterwards.

Scores, cuts and the dropping of phrases inside longer ones are joins of the counted phrases.

Defined cases: null texts are empty, a null language counts as ``und``; every row counts, also
repeated ones and those without an id; other columns are ignored; texts are read whole; an
empty table gives no rows.  Words of one language are told apart by 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from heatwise.llm import textnum as tn
from heatwise.llm.scratch import Scratch

MIN_COUNT, TOP, MAX_WORDS, ABSORB_PERCENT = 100, 2000, 5, 100
GROUP_SUFFIXES = 1_000_000       # budget: suffixes whose subtree one task builds
BLOCK_SUFFIXES = 1_000_000       # suffixes that are sorted together before they are sent
SLICE_BYTES = 1 << 21
TABLE_BITS = 25                  # bit table of frequent words: 4 MB
PAIR_BITS = (16, 28)             # bit table of pairs: least and most (32 MB)
PAIR_RANGES = 64                 # ranges of slots that are added up in one task each
FIRST, FAN = 12, 6               # bits of a slice: of the first word, of each further one
_U = np.uint64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _STOP.copy()
_GAP[[0x20, 0x09]] = True


def _words(batches: Iterator[pa.RecordBatch]):
    """(language of each row, folded bytes, starts, ends, row, word ids, first of its piece)."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        salt = {lang: tn.mix(np.array([hash_text(lang)], dtype=_U))[0] for lang in set(langs)}
        for low, high, offsets, data in tn.slices(batch.column(1), SLICE_BYTES):
            if not len(data):
                continue
            data = _FOLD[data]
            starts, ends = tn.runs(~_GAP[data], offsets)
            if not len(starts):
                continue
            row = np.searchsorted(offsets, starts, side="right") - 1
            own = np.array([salt[lang] for lang in langs[low:high]], dtype=_U)
            ids = tn.mix(tn.run_hashes(data, starts, ends) ^ own[row]) | _U(1)     # 0 stands for no word
            stops = np.cumsum(_STOP[data], dtype=np.int64)[starts]
            fresh = np.ones(len(starts), dtype=bool)
            fresh[1:] = (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])
            yield langs[low:high], data, starts, ends, row, ids, fresh


def hash_text(text: str) -> int:
    """A 64-bit hash of a short text, the same in every process."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return 1
    return int(tn.run_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs of bytes as strings."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(flat)).cast(pa.string())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, id, n) of a slice; its total for each language with a null word."""
    for langs, data, starts, ends, row, ids, _ in _words(batches):
        keys, at, n = np.unique(ids, return_index=True, return_counts=True)
        of_row = np.bincount(row, minlength=len(langs))
        total: dict[str, int] = {}
        for lang, many in zip(langs, of_row.tolist()):
            total[lang] = total.get(lang, 0) + many
        rest = len(total)
        word = pa.concat_arrays([_gather(data, starts[at], ends[at]), pa.nulls(rest, pa.string())])
        lang = pa.concat_arrays([pa.array(langs, pa.string()).take(pa.array(row[at])), pa.array(list(total), pa.string())])
        ident = pa.concat_arrays([pa.array(keys.view(np.int64)), pa.nulls(rest, pa.int64())])
        many = np.concatenate([n, np.fromiter(total.values(), np.int64, rest)])
        yield pa.RecordBatch.from_arrays([lang, word, ident, pa.array(many)], ["lang", "word", "id", "n"])


def _marked(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & np.uint8(1) != 0


def _joined(ids: np.ndarray, fresh: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frequent words, whether a frequent word is followed by another one of its piece)."""
    frequent = _marked(table, ids >> _U(1) & _U((1 << TABLE_BITS) - 1))
    return frequent, frequent[:-1] & frequent[1:] & ~fresh[1:]


def _slots(ids: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    return tn.mix(ids[at] * _U(0x9E3779B97F4A7C15) + ids[at + 1]) >> _U(64 - bits)


def _packed(values: np.ndarray) -> bytes:
    """Small numbers as bytes; 255 stands for 255 and more to come."""
    more = values // 255
    ends = np.cumsum(more + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, dtype=np.uint8)
    out[ends - 1] = values % 255
    return out.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, dtype=np.uint8)
    return np.diff(np.cumsum(data, dtype=np.int64)[data < 255], prepend=0)


def _count_pairs(tables, bits: int):
    """(range, gaps, counts): the slots of a block's word pairs in each range of slots."""
    def runs(held):
        slots, n = np.unique(np.concatenate(held), return_counts=True)
        slots = slots.astype(np.int64)
        width = (1 << bits) // PAIR_RANGES
        cuts = np.searchsorted(slots, np.arange(PAIR_RANGES + 1) * width)
        some = [r for r in range(PAIR_RANGES) if cuts[r] < cuts[r + 1]]
        parts = [slice(cuts[r], cuts[r + 1]) for r in some]
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()),
             pa.array([_packed(np.diff(slots[p], prepend=r * width)) for r, p in zip(some, parts)], pa.binary()),
             pa.array([_packed(n[p] - 1) for p in parts], pa.binary())], ["range", "gaps", "counts"])

    def run(batches):
        held, n = [], 0
        for *_, ids, fresh in _words(batches):
            _, goes_on = _joined(ids, fresh, tables.value[0])
            held.append(_slots(ids, np.flatnonzero(goes_on), bits))
            n += len(held[-1])
            if n >= 2 * BLOCK_SUFFIXES:
                yield runs(held)
                held, n = [], 0
        if n:
            yield runs(held)
    return run


def _frequent_pairs(bits: int, min_count: int):
    """(range, bits) of the slots with at least min_count pairs, from the rows of _count_pairs."""
    def run(batches):
        at, total = None, None
        for batch in batches:
            for r, gaps, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if r != at:
                    if at is not None:
                        yield done(at, total)
                    at, total = r, np.zeros((1 << bits) // PAIR_RANGES, dtype=np.int64)
                total[np.cumsum(_unpacked(gaps))] += _unpacked(counts) + 1
        if at is not None:
            yield done(at, total)

    def done(at, total):
        raw = np.packbits(total >= min_count, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([raw], pa.binary())], ["range", "bits"])
    return run


def _suffixes(batches: Iterator[pa.RecordBatch], tables, bits: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word ids, numbers of a suffix's words in them, a row for each depth) of the suffixes that
    start with a frequent pair; word 0 stands behind the end."""
    for *_, ids, fresh in _words(batches):
        frequent, goes_on = _joined(ids, fresh, tables.value[0])
        at = np.flatnonzero(goes_on)
        goes_on[at] = _marked(tables.value[1], _slots(ids, at, bits))
        at = np.flatnonzero(goes_on)
        if not len(at):
            continue
        known, of_word = np.unique(ids[frequent], return_inverse=True)
        number = np.zeros(len(ids) + depth, dtype=np.int32)
        number[:len(ids)][frequent] = of_word + 1
        more = np.concatenate([goes_on, np.zeros(depth, bool)])
        out = np.zeros((depth, len(at)), dtype=np.int32)
        alive = np.ones(len(at), dtype=bool)
        out[0] = number[at]
        for k in range(1, depth):
            alive &= more[at + k - 1]
            out[k] = number[at + k] * alive
        yield np.concatenate([[_U(0)], known]), out


def _prefixes(words: np.ndarray, suffixes: np.ndarray) -> Iterator[np.ndarray]:
    """Hash of the first word, of the first two, and so on."""
    key = words[suffixes[0]]
    yield key
    for column in suffixes[1:]:
        key = tn.mix(key * _U(0x9E3779B97F4A7C15) + words[column])
        yield key


def _place(words: np.ndarray, suffixes: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(group of each suffix, or -1; its slice among those that are split further, or -1)."""
    n = suffixes.shape[1]
    group, split = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for d, key in enumerate(_prefixes(words, suffixes)):
        bits = FAN if d else FIRST
        cell = np.where(split < 0, -1, (split << FAN if d else 0) + (key >> _U(64 - bits)).astype(np.int64))
        if d == len(levels):
            return group, cell
        found = levels[d][np.maximum(cell, 0)]
        group = np.where((cell >= 0) & (found >= 0), found, group)
        split = np.where((cell >= 0) & (found < 0), -1 - found, -1)
        if (split < 0).all():
            break
    return group, np.full(n, -1, dtype=np.int64)


def _slice_sizes(tables, bits: int, levels: list[np.ndarray], depth: int):
    """(slice, suffixes) below the slices that are still split."""
    def run(batches):
        for words, part in _suffixes(batches, tables, bits, depth):
            _, cell = _place(words, part, levels)
            cells, n = np.unique(cell[cell >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], ["slice", "n"])
    return run


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """Sorting order by all columns of small non-negative numbers, the first one leading."""
    width = max(int(max((c.max(initial=0) for c in columns))).bit_length(), 1)
    each = max(63 // width, 1)
    keys = []
    for i in range(0, len(columns), each):
        key = np.zeros(len(columns[0]), dtype=np.int64)
        for c in columns[i:i + each]:
            key = (key << width) | c
        keys.append(key)
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def _merge(rows: np.ndarray, n: np.ndarray, lead: np.ndarray | None = None):
    """Sorted distinct suffixes (by ``lead`` first) with their summed n and the first depth that
    differs from the suffix before."""
    order = _order([*([lead] if lead is not None else []), *rows])
    rows, n = rows[:, order], n[order]
    lead = None if lead is None else lead[order]
    shared = np.zeros(rows.shape[1], dtype=np.int8)
    same = np.ones(max(rows.shape[1] - 1, 0), dtype=bool) if lead is None else lead[1:] == lead[:-1]
    for column in rows:
        same &= column[1:] == column[:-1]
        shared[1:] += same
    first = np.flatnonzero(shared < len(rows))
    total = np.add.reduceat(n, first) if len(n) else n
    return rows[:, first], total, shared[first], None if lead is None else lead[first]


def _narrow(values: np.ndarray) -> bytes:
    most = int(values.max(initial=0))
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


RECORD = "group int, words binary, shape binary, counts binary, tails binary"


def _send(tables, bits: int, levels: list[np.ndarray], depth: int):
    """One front-coded record for each group of a block of suffixes."""
    def records(parts):
        words, number = np.unique(np.concatenate([w for w, _, _ in parts]), return_inverse=True)
        rows, at = [], 0
        for own, part, _ in parts:
            rows.append(number[at:at + len(own)].astype(np.int32)[part])
            at += len(own)
        group = np.concatenate([g for _, _, g in parts])
        parts.clear()
        rows = np.concatenate(rows, axis=1)
        rows, n, shared, group = _merge(rows, np.ones(rows.shape[1], dtype=np.int64), group)
        cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
        places = np.arange(depth)[:, None]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = rows[:, a:b]
            if part.size < len(words):
                used, part = np.unique(np.append(part.reshape(-1), 0), return_inverse=True)
                part = part[:-1].reshape(depth, b - a)
            else:
                flag = np.zeros(len(words), dtype=bool)
                flag[part.reshape(-1)] = True
                flag[0] = True
                used, part = np.flatnonzero(flag), (np.cumsum(flag) - 1)[part]
            keep = shared[a:b].copy()
            keep[0] = 0
            size = (part > 0).sum(axis=0)
            tail = part.T[((places >= keep) & (places < size)).T]
            out.append((int(group[a]), words[used[1:]].tobytes(), (keep | size << 4).astype(np.uint8).tobytes(),
                        _narrow(n[a:b]), _narrow(tail)))
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
            ["group", "words", "shape", "counts", "tails"])

    def run(batches):
        held, n = [], 0
        for words, part in _suffixes(batches, tables, bits, depth):
            held.append((words, part, _place(words, part, levels)[0].astype(np.int32)))
            n += part.shape[1]
            if n >= BLOCK_SUFFIXES:
                yield records(held)
                held, n = [], 0
        if n:
            yield records(held)
    return run


def _decoded(shape: bytes, tails: bytes, depth: int) -> np.ndarray:
    """Word numbers of a front-coded record, a row for each depth."""
    packed = np.frombuffer(shape, dtype=np.uint8)
    keep, size = packed & np.uint8(15), packed >> np.uint8(4)
    places = np.arange(depth, dtype=np.uint8)
    own = places >= keep[:, None]
    out = np.zeros((len(packed), depth), dtype=np.int32)
    out[own & (places < size[:, None])] = _widened(tails)
    rows = np.arange(len(packed))
    return np.stack([out[np.maximum.accumulate(np.where(own[:, k], rows, 0)), k] for k in range(depth)])


def _subtrees(depth_of: np.ndarray, depth: int, min_count: int):
    """(words, f, part) of the nodes of two and more words; ``part`` if other groups add to f."""
    def tree(group, held):
        words = [np.frombuffer(r[0], dtype=_U) for r in held]
        known, number = np.unique(np.concatenate(words), return_inverse=True)
        rows, at = [], 0
        for own, (_, shape, _, tails) in zip(words, held):
            to = np.concatenate([[0], number[at:at + len(own)] + 1]).astype(np.int32)
            at += len(own)
            rows.append(to[_decoded(shape, tails, depth)])
        n = np.concatenate([_widened(r[2]) for r in held])
        held.clear()
        rows, n, shared, _ = _merge(np.concatenate(rows, axis=1), n)
        for d in range(2, depth + 1):
            start = np.flatnonzero(shared < d)
            f = np.add.reduceat(n, start)
            part = d < depth_of[group]
            good = (rows[d - 1, start] > 0) & ((f >= min_count) | part)
            start, f = start[good], f[good]
            ids = known[rows[:d, start].T - 1].view(np.int64)
            for low in range(0, len(f), 100_000):
                some = ids[low:low + 100_000]
                lists = pa.ListArray.from_arrays(np.arange(0, some.size + 1, d, dtype=np.int32), pa.array(some.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [lists, pa.array(f[low:low + 100_000]), pa.array(np.full(len(some), part))], ["words", "f", "part"])

    def run(batches):
        held, group = [], None
        for batch in batches:
            for g, *record in zip(*(c.to_pylist() for c in batch.columns)):
                if held and g != group:
                    yield from tree(group, held)
                    held = []
                group = g
                held.append(record)
        if held:
            yield from tree(group, held)
    return run


def _grouped(sizes: np.ndarray, over: np.ndarray, first_group: int) -> np.ndarray:
    """Group numbers of consecutive slices up to the budget; -1, -2, ... for slices to split."""
    out, group, held = np.empty(len(sizes), dtype=np.int64), first_group, 0
    for i, n in enumerate(sizes.tolist()):
        if over[i]:
            continue
        if held and held + n > GROUP_SUFFIXES:
            group, held = group + 1, 0
        out[i], held = group, held + n
    out[over] = -1 - np.arange(over.sum())
    return out


def _sizes(found: DataFrame, cells: int) -> np.ndarray:
    out = np.zeros(cells, dtype=np.int64)
    for r in found.groupBy("slice").agg(F.sum("n").alias("n")).collect():      # at most one row a slice
        out[r["slice"]] = r["n"]
    return out


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                  max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): phrases (words array<long>, f) of one to max_words word ids that
    occur at least min_count times, words (lang, word, id, f), totals (lang, n)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.col(text_col).cast("string").alias("text"))
    counted = (texts.mapInArrow(_count_words, "lang string, word string, id long, n long")
               .groupBy("lang", "word", "id").agg(F.sum("n").alias("f"))
               .where(F.col("word").isNull() | (F.col("f") >= min_count)))
    counted = scratch.keep(counted, "words", "snappy")
    words = counted.where("word is not null")
    totals = counted.where("word is null").select("lang", F.col("f").alias("n"))
    singles = words.select(F.array("id").alias("words"), "f")

    slot = F.shiftrightunsigned("id", 1).bitwiseAND((1 << TABLE_BITS) - 1) + 1
    table = np.zeros(1 << TABLE_BITS - 3, dtype=np.uint8)
    for r in (words.groupBy(F.bitmap_bucket_number(slot).alias("b"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()):   # 4 MB at most
        bits = np.frombuffer(r["bits"], dtype=np.uint8)
        table[(r["b"] - 1) * len(bits):][:len(bits)] = bits

    bits = min(max((totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 4).bit_length(), PAIR_BITS[0]), PAIR_BITS[1])
    pairs = np.zeros(1 << bits - 3, dtype=np.uint8)
    only_words = spark.sparkContext.broadcast((table,))
    counted = texts.mapInArrow(_count_pairs(only_words, bits), "range int, gaps binary, counts binary")
    for r in (counted.repartition(PAIR_RANGES, "range").sortWithinPartitions("range")
              .mapInArrow(_frequent_pairs(bits, min_count), "range int, bits binary").collect()):   # 32 MB at most
        raw = np.frombuffer(r["bits"], dtype=np.uint8)
        pairs[r["range"] * len(raw):][:len(raw)] = raw
    tables = spark.sparkContext.broadcast((table, pairs))

    levels, depth_of, cells = [], np.zeros(0, np.int64), 1 << FIRST
    while True:
        found = texts.mapInArrow(_slice_sizes(tables, bits, levels, max_words), "slice long, n long")
        sizes = _sizes(found, cells)
        over = (sizes > GROUP_SUFFIXES) & (len(levels) + 1 < max_words)
        level = _grouped(sizes, over, len(depth_of))
        groups = max(int(level.max(initial=-1)) + 1, len(depth_of))
        depth_of = np.concatenate([depth_of, np.full(groups - len(depth_of), len(levels) + 1)])
        levels.append(level)
        cells = int(over.sum()) << FAN
        if not cells:
            break

    sent = texts.mapInArrow(_send(tables, bits, levels, max_words), RECORD)
    dealt = sent.repartition(max(len(depth_of), 1), "group").sortWithinPartitions("group")
    nodes = scratch.keep(dealt.mapInArrow(_subtrees(depth_of, max_words, min_count),
                                          "words array<long>, f long, part boolean"), "nodes")
    phrases = nodes.where("not part").select("words", "f")
    if depth_of.max(initial=0) > 2:
        spread = nodes.where("part").groupBy("words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
        phrases = phrases.union(spread)
    return singles.union(phrases), words, totals


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP,
         max_words: int = MAX_WORDS, absorb_percent: int = ABSORB_PERCENT) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``score`` is floor(1000 * a * n / (l * r)) of the lowest-scoring cut (ties: the first).  A
    phrase inside a longer one with at least ``absorb_percent`` of its count is left out; as
    counts never grow with length, phrases longer by one word tell.
    """
    counts, words, totals = phrase_counts(docs, text_col, lang_col, min_count, max_words)
    scratch = Scratch(docs.sparkSession, "collocations")
    owner = words.select(F.col("id").alias("__first"), "lang").join(totals, "lang")
    phrases = (counts.where(F.size("words") > 1).withColumn("__first", F.col("words")[0])
               .join(owner, "__first").drop("__first").withColumnRenamed("f", "a"))
    size = F.size("words")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumns(
        {"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    cuts = (cuts.join(counts.select(F.col("words").alias("left"), F.col("f").alias("l")), "left")
            .join(counts.select(F.col("words").alias("right"), F.col("f").alias("r")), "right"))
    wide = {c: f"cast({c} as decimal(15,0))" for c in "alrn"}
    cuts = scratch.keep(cuts.withColumn("score", F.expr(
        f"(1000 * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})")), "cuts")
    held = 100 * F.col("a")
    inside = (cuts.where((F.col("k") == F.size("words") - 1) & (held >= absorb_percent * F.col("l")))
              .select(F.col("left").alias("words"))
              .union(cuts.where((F.col("k") == 1) & (held >= absorb_percent * F.col("r"))).select("right"))
              .where(F.size("words") > 1).distinct())
    scored = (cuts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .join(inside, "words", "left_anti")
              .select("lang", "words", "a", "cut.l", "cut.r", "n", "cut.score"))
    # ties at the last place stay until the phrase decides between them
    by_score = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    best = scored.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top).drop("place")
    spelt = (best.select("*", F.posexplode("words").alias("at", "id"))
             .join(words.select("id", "word"), "id")
             .groupBy("lang", "words", "a", "l", "r", "n", "score")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ")
                  .alias("phrase")))
    last = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return (spelt.withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
