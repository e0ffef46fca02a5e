"""Near-duplicate classes of texts: consistent weighted sampling over TF-IDF shingles.

The weight of a five-word shingle in a text is its count times ``1 + ln(D / df)`` with D
distinct texts and df the distinct texts that hold it.  Every shingle's df is counted: blocks
of texts, bucketed once, report their sorted shingles as gap-coded runs with local counts; the
counts are added up in ranges of hashes, and the places of those that other blocks hold too go
back to the blocks.  Each text then carries the df of its shingles, so no table of shingles
travels with the tasks.

Two texts link if their weighted Jaccard similarity is at least ``threshold``; classes are
the connected components.  Candidates come from 12 bands of 4 improved consistent weighted
samples (a pair at 0.8 is missed with probability 0.002, at 0.9 with 2e-6):

1. equal word sequences collapse to their smallest id;
2. in each band bucket every member is verified against one leader, the member that shares
   most buckets with others (pairs grow linearly with a bucket);
3. buckets whose members still lie in several components are compared blockwise inside
   tasks of bounded size.  Only links that join components leave a task, so a group never
   emits its pairs.  A candidate pair across components is verified exactly unless its
   samples agree in less than half of all places (``ESTIMATE``).

Defined cases: null or wordless texts link with nothing (class = own id); a text of fewer
than five words is one shingle; a row with a null id gets a null class and is kept; rows
that repeat an id are one document; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from heatwise.llm import textnum as tn
from heatwise.llm.graph import components
from heatwise.llm.scratch import Scratch

PHI = 0.0                 # document share below which all shingles weigh the same: none
BANDS, ROWS = 12, 4
BLOCK = 256               # members of a bucket that meet in one task at once
BLOCK_WORDS = 500_000     # words of the texts whose shingles are counted together
RANGE_WORDS = 500_000     # words of all blocks whose shingles are added up together
MOST_BUCKETS = 10_000     # files that blocks are dealt to; each holds whole blocks
#: An estimate from 48 samples lies below this with probability 8e-07 for a pair at 0.8 (less
#: for band mates, which already agree in four places); scaled with the threshold.
ESTIMATE = 0.5 / 0.8
_U = np.uint64


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 65536 equal steps, by bisection."""
    p = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros_like(p), np.full_like(p, 64.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low


_tables: list[np.ndarray] = []


def _gamma() -> list[np.ndarray]:
    if not _tables:
        g = _gamma_table()
        _tables.extend([g.astype(np.float32), np.log(g).astype(np.float32)])
    return _tables


def signatures(sh: np.ndarray, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """uint32 samples (row, BANDS * ROWS) of rows that each hold at least one shingle."""
    gamma, log_gamma = _gamma()
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(at) - 1, BANDS * ROWS), dtype=np.uint32)
    for k in range(BANDS * ROWS):
        x = tn.mix(sh + _U((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        r = gamma[x >> _U(48)]
        beta = (x & _U(0xFFFFFFFF)).astype(np.float32) * np.float32(2.0 ** -32)
        t = np.floor(log_w / r + beta)
        log_a = log_gamma[(x >> _U(32)) & _U(0xFFFF)] - r * (t - beta + np.float32(1))
        bits = log_a.view(np.uint32)
        rank = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
        name = (x + t.astype(np.int64).view(_U) * _U(0xD6E8FEB86659FD93)) * _U(0x9FB21C651E98DF25)
        key = (rank.astype(_U) << _U(32)) | (name >> _U(32))
        out[:, k] = (np.minimum.reduceat(key, at[:-1]) & _U(0xFFFFFFFF)).astype(np.uint32)
    return out


def idf(df: np.ndarray, texts: int) -> np.ndarray:
    return 1 + np.log(texts / df)


def jaccard(a: tuple, b: tuple) -> float:
    """a, b: (sorted shingles, weights, sum of weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    rest = a[2] + b[2] - both
    return float(both / rest) if rest > 0 else 0.0


def vectors(column: pa.Array, dfs: pa.Array, texts: int) -> list[tuple]:
    """(sorted shingles, weights, sum) of every text; dfs has the int32 df of its shingles."""
    out, dfs = [], dfs.to_pylist()
    for start, _, offsets, data in tn.slices(column):
        sh, counts, at = tn.distinct_shingles(*tn.shingles(*tn.words(offsets, data)))
        for i, j, df in zip(at[:-1], at[1:], dfs[start:]):
            w = counts[i:j] * idf(np.frombuffer(df, dtype=np.int32), texts)
            out.append((sh[i:j], w, float(w.sum())))
    return out


def _digests(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's word sequence."""
    place = np.arange(len(hashes), dtype=_U) - np.repeat(at[:-1], np.diff(at)).astype(_U)
    out = []
    for salt in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03):
        term = tn.mix((hashes ^ _U(salt)) + tn.mix(place + _U(salt)))
        total = np.concatenate([[_U(0)], np.cumsum(term, dtype=_U)])
        out.append(tn.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(_U)).view(np.int64))
    return out[0], out[1]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digests, word count) of every row."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for start, end, offsets, data in tn.slices(batch.column(1)):
            hashes, at = tn.words(offsets, data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a) for a in (ids[start:end].astype(np.int64), *_digests(hashes, at), np.diff(at))],
                ["id", "d1", "d2", "n"])
        tn.give_back()


def _with_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that hold words, with their digests."""
    for batch in batches:
        for start, end, offsets, data in tn.slices(batch.column(1)):
            hashes, at = tn.words(offsets, data)
            rows = batch.slice(start, end - start)
            d1, d2 = _digests(hashes, at)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(d1), pa.array(d2)], ["id", "text", "d1", "d2"]).filter(pa.array(np.diff(at) > 0))
        tn.give_back()


def _block_shingles(texts: pa.ChunkedArray) -> Iterator[tuple]:
    """(first row, end row, distinct shingles, counts, offsets) of slices of a block's texts."""
    done = 0
    for chunk in texts.chunks:
        for start, end, offsets, data in tn.slices(chunk):
            yield done + start, done + end, *tn.distinct_shingles(*tn.shingles(*tn.words(offsets, data)))
        done += len(chunk)


def _ranges(bits: int) -> np.ndarray:
    """First hash of each of the 2 ** bits equal ranges, and none behind the last."""
    return np.arange(1 << bits, dtype=_U) << _U(64 - bits) if bits else np.zeros(1, _U)


def _run(hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes as gaps: a byte of the gap's size, then so many bytes."""
    gaps = np.diff(hashes, prepend=_U(0)).astype("<u8")
    raw = gaps.view(np.uint8).reshape(-1, 8)
    size = 8 - (raw[:, ::-1] != 0).argmax(axis=1)            # a gap is never 0 but for hash 0
    size[gaps == 0] = 1
    return np.uint32(len(gaps)).tobytes() + size.astype(np.uint8).tobytes() + raw[np.arange(8) < size[:, None]].tobytes()


def _hashes(run: bytes) -> np.ndarray:
    n = int(np.frombuffer(run, np.uint32, 1)[0])
    size = np.frombuffer(run, np.uint8, n, 4)
    raw = np.zeros((n, 8), dtype=np.uint8)
    raw[np.arange(8) < size[:, None]] = np.frombuffer(run, np.uint8, -1, 4 + n)
    return np.cumsum(raw.reshape(-1).view("<u8"), dtype=_U)


def _report(bits: int):
    """Of a block's texts: (block, range, run of its distinct shingles, how many texts hold each)."""
    def run(table: pa.Table) -> pa.Table:
        found = [part[2] for part in _block_shingles(table["text"])]
        keys, n = np.unique(np.concatenate([np.zeros(0, _U), *found]), return_counts=True)
        del found
        cuts = np.append(np.searchsorted(keys, _ranges(bits)), len(keys))
        some = [r for r in range(1 << bits) if cuts[r] < cuts[r + 1]]
        block = table["block"][0].as_py()
        return pa.table([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()),
                         pa.array([_run(keys[cuts[r]:cuts[r + 1]]) for r in some], pa.binary()),
                         pa.array([_small(n[cuts[r]:cuts[r + 1]]) for r in some], pa.binary())],
                        ["block", "range", "run", "counts"])

    def lean(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            tn.give_back()
    return lean


def _small(values: np.ndarray) -> bytes:
    kind = np.uint8 if not len(values) or values.max() < 256 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up a range's reports and tells each block which of its shingles (places in its run)
    other blocks' texts hold too, and in how many texts each is."""
    held: list[tuple] = []

    def told():
        runs = [_hashes(r[2]) for r in held]
        keys, number = np.unique(np.concatenate(runs), return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        counts = [_wide(r[3]) for r in held]
        np.add.at(total, number, np.concatenate(counts))
        out, at = [], 0
        for (block, r, *_), own in zip(held, counts):
            df = total[number[at:at + len(own)]]
            at += len(own)
            more = np.flatnonzero(df > own)
            out.append((block, r, more.astype(np.uint32).tobytes(), _small(df[more])))
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()),
             pa.array(cols[3], pa.binary())], ["block", "range", "places", "dfs"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][1] != row[1]:
                yield told()
                held.clear()
                tn.give_back()
            held.append(row)
    if held:
        yield told()
    held.clear()
    tn.give_back()


def _sketch(texts: int, bits: int):
    """(id, dfs, sig, bands) of a block's texts; the answers tell the shingles of other blocks."""
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        parts = list(_block_shingles(table["text"]))
        keys, n = np.unique(np.concatenate([np.zeros(0, _U), *(p[2] for p in parts)]), return_counts=True)
        many = n.astype(np.int64)
        first = np.searchsorted(keys, _ranges(bits))
        for r, places, dfs in zip(told["range"].to_pylist(), told["places"].to_pylist(), told["dfs"].to_pylist()):
            many[first[r] + np.frombuffer(places, np.uint32).astype(np.int64)] = _wide(dfs)
        out = []
        for start, end, sh, counts, at in parts:
            df = many[np.searchsorted(keys, sh)].astype(np.int32)
            sig = signatures(sh, counts * idf(df, texts), at)
            bands = np.zeros((end - start, BANDS), dtype=_U)
            for i in range(ROWS):
                bands = tn.mix(bands + sig.reshape(-1, BANDS, ROWS)[:, :, i] + _U(i + 1))
            out.append(pa.table(
                [pa.array(ids[start:end]), pa.array([df[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()),
                 pa.array([row.tobytes() for row in sig], pa.binary()),
                 pa.ListArray.from_arrays(
                     pa.array(np.arange(0, (end - start) * BANDS + 1, BANDS, dtype=np.int32)),
                     pa.array(bands.reshape(-1).view(np.int64)))],
                ["id", "dfs", "sig", "bands"]))
        return pa.concat_tables(out) if out else _EMPTY_SKETCH

    def lean(table: pa.Table, told: pa.Table) -> pa.Table:
        try:
            return run(table, told)
        finally:
            tn.give_back()
    return lean


_SKETCH = "id long, dfs binary, sig binary, bands array<long>"
_EMPTY_SKETCH = pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))],
                         ["id", "dfs", "sig", "bands"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen row of each text: rows come sorted by (block, id, digests), a row without text
    marking the ones to keep before all that carry it; the first of equal rows stays."""
    last = None                                   # key of a mark whose text has not come yet
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))))
        has, keep = batch.column("has").to_pylist(), []
        for i, key in enumerate(keys):
            if not has[i]:
                last = key
            elif key == last:
                keep.append(i)
                last = None
        yield batch.take(pa.array(keep, pa.int64())).select(["block", "id", "text"])


MARK_BITS = 26                                    # bit table of ids: 8 MB


def _slot(id_col: str):
    return F.xxhash64(id_col).bitwiseAND((1 << MARK_BITS) - 1).cast("int")


def _mark_table(ids: DataFrame) -> np.ndarray:
    """Slots of all ids as a bit table of fixed size."""
    at = _slot("id") + 1
    table = np.zeros(1 << MARK_BITS - 3, dtype=np.uint8)
    for r in (ids.groupBy(F.bitmap_bucket_number(at).alias("b"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()):
        raw = np.frombuffer(r["bits"], dtype=np.uint8)
        table[(r["b"] - 1) * len(raw):][:len(raw)] = raw
    return table


def _wanted(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """The rows whose id is marked; false marks, which only cost rows, are rare up to millions
    of ids."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            slot = batch.column(batch.num_columns - 1).to_numpy()
            hit = table[slot >> 3] >> (slot & 7).astype(np.uint8) & np.uint8(1)
            yield batch.filter(pa.array(hit.astype(bool))).select(names)
    return rows.select("*", _slot("id").alias("__slot")).mapInArrow(run, rows.schema)


def _verify(texts: int, threshold: float):
    """(a, b) of pairs (a, b, text_a, text_b, dfs_a, dfs_b) at or over the threshold."""
    def run(batches):
        for batch in batches:
            a = vectors(batch.column(2), batch.column(4), texts)
            b = vectors(batch.column(3), batch.column(5), texts)
            ok = np.array([jaccard(x, y) >= threshold - 1e-12 for x, y in zip(a, b)], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])
            del a, b
            tn.give_back()
    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows of equal first column, over batch borders."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for cut in cuts.tolist():
            yield pa.Table.from_batches([*held, batch.slice(at, cut - at)])
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(table: pa.Table, estimate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row pairs i, j): pairs of the table's two blocks that lie in different
    components, meet first in this band, and whose samples agree often enough."""
    band, low = table["band"][0].as_py(), table["part"][0].as_py()
    ids, comp = table["id"].to_numpy(), table["comp"].to_numpy()
    own = table["own"].to_numpy()
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), dtype=np.uint32).reshape(len(ids), BANDS, ROWS)
    left = np.flatnonzero(own == low)
    pairs_i, pairs_j = [], []
    for i in left.tolist():
        other = np.flatnonzero((comp != comp[i]) & ((own != low) | (ids > ids[i])))
        if not len(other):
            continue
        same = sig[other] == sig[i]
        first = same.all(axis=2).argmax(axis=1) == band
        ok = first & same.all(axis=2).any(axis=1) & (same.sum(axis=(1, 2)) >= estimate * BANDS * ROWS)
        pairs_i.append(np.full(int(ok.sum()), i))
        pairs_j.append(other[ok])
    none = np.zeros(0, dtype=np.int64)
    return ids, np.concatenate([none, *pairs_i]), np.concatenate([none, *pairs_j])


def _in_question(estimate: float):
    """Members of a bucket that have a possible partner in another component."""
    def run(batches):
        for table in _groups(batches):
            ids, i, j = _candidates(table, estimate)
            hit = np.unique(ids[np.concatenate([i, j])])
            if len(hit):
                n = len(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, table["band"][0].as_py(), np.int32)),
                     pa.array(np.full(n, table["h"][0].as_py(), np.int64)), pa.array(hit)], ["band", "h", "id"])
    return run


def _joining(total: int, threshold: float, estimate: float):
    """(component, component) joined by a verified link of a block pair."""
    def run(batches):
        for table in _groups(batches):
            ids, pi, pj = _candidates(table, estimate)
            if not len(pi):
                continue
            comp = table["comp"].to_pylist()
            parent: dict[int, int] = {}

            def root(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            rows = np.unique(np.concatenate([pi, pj]))
            texts, dfs = (table[c].take(pa.array(rows)).combine_chunks() for c in ("text", "dfs"))
            vector = dict(zip(rows.tolist(), vectors(texts, dfs, total)))
            a, b = [], []
            for i, j in zip(pi.tolist(), pj.tolist()):
                x, y = root(comp[i]), root(comp[j])
                if x != y and jaccard(vector[i], vector[j]) >= threshold - 1e-12:
                    parent[max(x, y)] = min(x, y)
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _blocks(members: DataFrame) -> DataFrame:
    """Deal each bucket's members to pairs of blocks; one group key for each block pair.

    Members of the bucket's largest component need not meet each other: their blocks come
    first and meet only the others' blocks, so a bucket of many near copies and a few outsiders
    sends its copies about once.  A bucket of one component sends nothing."""
    sizes = members.groupBy("band", "h", "comp").agg(F.count("*").alias("n"))
    blocks = sizes.groupBy("band", "h").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n")).select(
        "band", "h", F.col("top.comp").alias("most"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("nb"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("nr"))
    most, last = F.col("comp") == F.col("most"), F.col("nb") + F.col("nr") - 1
    dealt = (members.join(blocks.where("nr > 0"), ["band", "h"])
             .withColumn("own", F.when(most, F.pmod(F.xxhash64("id"), F.col("nb")))
                         .otherwise(F.col("nb") + F.pmod(F.xxhash64("id"), F.col("nr"))).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.when(most, F.col("nb")).otherwise(0), last)))
             .withColumn("part", F.least("own", "other")))
    key = F.xxhash64("band", "h", "part", F.greatest("own", "other"))
    # one group: rows of both blocks, with the pair's lower block in `part`
    return dealt.withColumn("g", key).drop("nb", "nr", "most", "other").dropDuplicates(["g", "id"])


def block_of(id_col: str, blocks: int):
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("block")), F.lit(blocks)).alias("block")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.8) -> DataFrame:
    """One row per document: (id, class_id, copy_of, kept).

    ``class_id`` is the smallest id of the component, ``copy_of`` the smallest id with the
    same word sequence, ``kept`` is true for the one document that stands for its class.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    both = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = both.where("id is not null")
    docs_of = scratch.keep(texts.mapInArrow(_profile, "id long, d1 long, d2 long, n long"), "profile")
    reps = docs_of.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    distinct, total = reps.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # a rep's own text: an id may have rows with other texts.  Texts move once, to their block.
    blocks = max(total // BLOCK_WORDS, 1)
    digested = texts.mapInArrow(_with_digests, "id long, text string, d1 long, d2 long")
    marks = reps.select(block_of("rep", blocks), F.col("rep").alias("id"), "d1", "d2",
                        F.lit(None).cast("string").alias("text"), F.lit(False).alias("has"))
    dealt = (marks.union(digested.select(block_of("id", blocks), "id", "d1", "d2", "text", F.lit(True).alias("has")))
             .repartition(min(blocks, MOST_BUCKETS), "block").sortWithinPartitions("block", "id", "d1", "d2", "has"))
    # bucketed by block: both passes over the blocks read their texts where they lie
    unique = scratch.bucketed(dealt.mapInArrow(_marked, "block long, id long, text string"), "unique", "block", min(blocks, MOST_BUCKETS))
    bits = max(total // RANGE_WORDS, 1).bit_length() - 1
    reported = unique.groupBy("block").applyInArrow(_report(bits), "block long, range int, run binary, counts binary")
    answers = scratch.keep(reported.repartition("range").sortWithinPartitions("range")
                           .mapInArrow(_answers, "block long, range int, places binary, dfs binary"), "answers")
    vectored = scratch.keep(unique.groupBy("block").cogroup(answers.groupBy("block"))
                            .applyInArrow(_sketch(distinct, bits), _SKETCH), "vectored", "snappy")
    sketch = vectored.select("id", "sig", "bands")
    banded = sketch.select("id", F.posexplode("bands").alias("band", "h"))
    shared = banded.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1")
    mates = scratch.keep(banded.join(shared, ["band", "h"]), "mates")
    reach = mates.groupBy("id").agg(F.sum("n").alias("reach"))
    leaders = (mates.join(reach, "id").groupBy("band", "h")
               .agg(F.max(F.struct("reach", (-F.col("id")).alias("neg"))).alias("top"))
               .select("band", "h", (-F.col("top.neg")).alias("a")))
    pairs = (mates.join(leaders, ["band", "h"]).where("id != a")
             .select("a", F.col("id").alias("b")).distinct())
    # only the texts of bucket mates travel again
    marked = _mark_table(mates.select("id"))
    rep_texts = scratch.keep(_wanted(unique.select("id", "text"), marked).hint("merge")
                             .join(_wanted(vectored.select("id", "dfs"), marked), "id"), "texts", "snappy")
    scratch.drop(answers, unique)
    scratch.close()
    # Merge joins at every size: ids and pairs grow with the corpus, so no plan may count on
    # sending them to all tasks.
    posed = (pairs.hint("merge").join(rep_texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"),
                                                              F.col("dfs").alias("dfs_b")), "b")
             .join(rep_texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"),
                                    F.col("dfs").alias("dfs_a")).hint("merge"), "a")
             .select("a", "b", "text_a", "text_b", "dfs_a", "dfs_b"))
    links = scratch.keep(posed.mapInArrow(_verify(distinct, threshold), "a long, b long"), "links")
    comp = scratch.keep(components(scratch, links, "a", "b"), "components")
    scratch.drop(links)

    estimate = ESTIMATE * threshold
    named = (mates.select("band", "h", "id").join(comp.withColumnRenamed("node", "id"), "id", "left")
             .select("band", "h", "id", F.coalesce("component", "id").alias("comp")))
    split = (named.groupBy("band", "h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
             .where("c0 < c1").select("band", "h"))
    members = scratch.keep(named.join(split, ["band", "h"]).join(sketch.select("id", "sig"), "id"), "open")
    scratch.drop(mates, vectored)
    cols = ["g", "band", "h", "part", "own", "id", "comp", "sig"]

    def grouped(df, *more):
        return _blocks(df).select(*cols, *more).repartition("g").sortWithinPartitions("g", "id")

    doubt = scratch.keep(grouped(members).mapInArrow(_in_question(estimate), "band int, h long, id long")
                         .distinct(), "doubt")
    rest = grouped(members.join(doubt, ["band", "h", "id"], "left_semi").join(rep_texts, "id"), "text", "dfs")
    more = scratch.keep(rest.mapInArrow(_joining(distinct, threshold, estimate), "a long, b long"), "more")
    scratch.drop(members, doubt, rep_texts)
    merged = components(scratch, more, "a", "b").select(
        F.col("node").alias("component"), F.col("component").alias("merged"))
    final = comp.join(merged, "component", "left").select(
        F.col("node").alias("rep"), F.coalesce("merged", "component").alias("component"))
    # a text with no link of its own may still be the end of a link found blockwise
    alone = merged.withColumnRenamed("component", "rep")
    classed = (reps.join(final, "rep", "left").join(alone, "rep", "left")
               .select("d1", "d2", F.col("rep").alias("copy_of"),
                       F.coalesce("component", "merged", "rep").alias("class_id")))
    out = (docs_of.join(classed, ["d1", "d2"], "left")
           .select("id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
                   F.when(F.col("n") > 0, F.col("copy_of")).otherwise(F.col("id")).alias("copy_of")))
    nulls = both.where("id is null").select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_of"))
    return (out.union(nulls)
            .select(F.col("id").alias(id_col), "class_id", "copy_of",
                    (F.col("id").isNull() | (F.col("id") == F.col("class_id"))).alias("kept")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: float = 0.8) -> DataFrame:
    """The rows of the documents that stand for their class, with all their columns."""
    gone = (near_duplicates(docs, id_col, text_col, threshold).where("not kept")
            .select(F.col(id_col).alias("__gone")).distinct().hint("merge"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
