"""Pack token sequences for training: vector bins, dot-product heuristic, free cuts.

A sequence holds at most ``capacity`` tokens, ``segments`` pieces and ``loss`` loss-bearing
tokens (those behind a row's prompt).  A bin is filled one piece at a time: of the remains
that fit it takes the one whose vector (tokens, one segment, loss tokens; each as a share
of its limit) has the largest dot product with what is left of the bin, so a piece is large
where room is plenty.  If none fits, or at the last segment, the best remain is cut to fill
the bin.  What is left over at the end of a task goes into sequences whose lengths are
powers of two, which need no padding.

Rows are packed where they are read: no shuffle, no group, and a task holds a bounded pool
of tokens.  Sequence ids are the task's partition and a counter, so a repeated task gives
the same rows and ids.

Tokens are those of a public ``tokenizers`` file that drops white space: chunks between
blanks and line ends are encoded apart (its words never cross white space), and the ids of
recent chunks are kept in a bounded cache.  Texts are cut at the file's added tokens first,
which get their own ids, as the library does.

Defined cases: a null text counts as empty and has the end id only; a null or negative
prompt counts as 0; rows that repeat are packed each; an empty table gives no rows; other
columns are ignored.
"""
from __future__ import annotations

import gc
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from heatwise.llm import textnum

CAPACITY, SEGMENTS = 4096, 128
POOL_TOKENS = 1 << 21       # a task packs when its pool holds so many
ROWS_AT_ONCE = 1_000
CACHED_CHUNKS = 400_000
LONG = 64                   # longer chunks are not cached
_LATIN = "\u024f"


class Tokens:
    """Token ids of texts as uint32 bytes (little-endian, as all platforms Spark runs on here).

    A mark behind a letter is a word of its own to the tokenizer and letter case is dropped,
    so texts are cut there and plain ASCII is lowered before the lookup.  Letters whose
    normalised form ends in something else (a combining mark, which the tokenizer joins with
    the mark behind it) are found with the file's own normaliser and not cut behind.  For chunks of
    lower-case Latin letters the file's normaliser and splitter change nothing; they go to
    a copy of the tokenizer without them.  With ``added``, the file's added tokens in a text
    get their own ids (the library's default); else they are ordinary characters.
    """

    def __init__(self, path: str, added: bool = False):
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as source:
            rules = json.load(source)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        level = next(p for p in rules["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel")
        self.plain = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": level}))
        normal = self.whole.normalizer.normalize_str if self.whole.normalizer else str
        letter = (lambda c: c.isalnum() and not c.isdecimal())          # as [^\W\d_] in a pattern
        odd = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if letter(c) and not letter(normal(c)[-1:])]
        self.behind_letter = re.compile(r"[.,;:!?](?<=[^\W\d_" + "".join(map(re.escape, odd)) + "].)").sub
        self.ends_word = np.zeros(max(rules["model"]["vocab"].values()) + 1, dtype=bool)
        suffix = rules["model"]["end_of_word_suffix"]
        self.ends_word[[i for t, i in rules["model"]["vocab"].items() if t.endswith(suffix)]] = True
        # no chunk holds a line end, so these keys are only those of added tokens
        self.added = [t["content"] for t in rules["added_tokens"]] if added else []
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in rules["added_tokens"] if added):
            raise ValueError("added tokens must be found as they are")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.fixed = {"": b""} | {t["content"] + "\n": array("I", [t["id"]]).tobytes()
                                  for t in rules["added_tokens"] if added}
        self.known: dict[str, bytes] = dict(self.fixed)

    def _learn(self, chunks: list[str]) -> None:
        known = self.known
        if len(known) + len(chunks) > CACHED_CHUNKS:
            known.clear()
            known.update(self.fixed)
        easy, hard = [], []
        for c in chunks:
            (easy if c.isalpha() and c == c.lower() and (c.isascii() or max(c) <= _LATIN) else hard).append(c)
        if easy:
            # one sequence of words; each word's last token, and no other, has the word-end suffix
            got = self.plain.encode_batch_fast([easy], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.array(got.ids, dtype="<u4")
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            start = 0
            for chunk, end in zip(easy, ends, strict=True):
                known[chunk] = raw[start:end]
                start = end
        for chunk, got in zip(hard, self.whole.encode_batch_fast(hard, add_special_tokens=False)):
            known[chunk] = array("I", got.ids).tobytes()

    def _chunks(self, text: str) -> list[str]:
        text = self.behind_letter(r" \g<0>", text.lower() if text.isascii() else text)
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        rows = []
        for text in texts:
            if any(token in text for token in self.added):
                # every second part is an added token
                rows.append([c for i, part in enumerate(self.cut(text))
                             for c in ([part + "\n"] if i % 2 else self._chunks(part))])
            else:
                rows.append(self._chunks(text))
        stop = array("I", [end]).tobytes()
        found = [list(map(self.known.get, row)) for row in rows]
        new = {c for row, ids in zip(rows, found) if None in ids for c, i in zip(row, ids) if i is None}
        self._learn(list(new))
        out = []
        for row, ids in zip(rows, found):
            if None in ids:
                ids = [self.known[c] if i is None else i for c, i in zip(row, ids)]
            ids.append(stop)
            out.append(b"".join(ids))
        for chunk in new:
            if len(chunk) > LONG:
                del self.known[chunk]
        return out


@cache
def tokens(path: str, added: bool = False) -> Tokens:
    return Tokens(path, added)


class Packer:
    """Pieces (row, start, length, sequence, offset) of rows added one by one."""

    def __init__(self, capacity: int, segments: int, loss: int):
        self.limits = np.array([capacity, segments, loss], dtype=np.float64)
        self.capacity, self.segments, self.loss = capacity, segments, loss
        self.row: list[int] = []
        self.start: list[int] = []
        self.length: list[int] = []
        self.prompt: list[int] = []
        self.pool = 0
        self.sequence = 0

    def add(self, row: int, length: int, prompt: int) -> Iterator[tuple]:
        """Queue a row; whole sequences of one long row leave at once."""
        start = 0
        while length - start > self.capacity:
            take = self._most(start, prompt, length, self.capacity, self.loss)
            if take < self.capacity:
                break
            yield row, start, take, self.sequence, 0
            self.sequence += 1
            start += take
        if start < length:
            self.row.append(row)
            self.start.append(start)
            self.length.append(length)
            self.prompt.append(prompt)
            self.pool += length - start

    @staticmethod
    def _most(start: int, prompt: int, length: int, room: int, loss: int) -> int:
        """Most tokens from start under both limits."""
        return min(length - start, room, max(prompt - start, 0) + loss)

    def pack(self, last: bool) -> Iterator[tuple]:
        """Fill sequences; unless ``last``, keep the remains of a few for later."""
        row, start = np.array(self.row, np.int64), np.array(self.start, np.int64)
        end, prompt = np.array(self.length, np.int64), np.array(self.prompt, np.int64)
        left = end - start
        bear = np.maximum(end - np.maximum(start, prompt), 0)
        pool = int(left.sum())
        keep = 0 if last else 8 * self.capacity
        while pool >= max(keep, self.capacity) or (last and pool):
            room = self.capacity if pool >= self.capacity else 1 << (pool.bit_length() - 1)
            slots, loss, offset = self.segments, self.loss, 0
            while room and slots and loss and pool:
                share = np.array([room, slots, loss]) / self.limits
                score = left * (share[0] / self.limits[0]) + bear * (share[2] / self.limits[2]) \
                    + share[1] / self.limits[1]
                fits = (left > 0) & (left <= room) & (bear <= loss)
                if slots == 1:
                    fits &= left == room
                if fits.any():
                    at = int(np.where(fits, score, -1.0).argmax())
                else:
                    at = int(np.where(left > 0, score, -1.0).argmax())
                take = self._most(int(start[at]), int(prompt[at]), int(end[at]), room, loss)
                if not take:
                    break
                yield int(row[at]), int(start[at]), take, self.sequence, offset
                bearing = max(int(start[at]) + take - max(int(start[at]), int(prompt[at])), 0)
                start[at] += take
                left[at] -= take
                bear[at] -= bearing
                room, slots, loss, offset, pool = room - take, slots - 1, loss - bearing, offset + take, pool - take
            self.sequence += 1
        stay = np.flatnonzero(left)
        self.row, self.start = row[stay].tolist(), start[stay].tolist()
        self.length, self.prompt = end[stay].tolist(), prompt[stay].tolist()
        self.pool = pool


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = 2, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = CAPACITY,
         prompt_col: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    loss_tokens and, if asked for, the ids.  ``prompt_col`` counts a row's leading tokens
    that bear no loss."""
    if min(capacity, segments, loss) < 1 or capacity & (capacity - 1):
        raise ValueError("limits must be positive and the capacity a power of two")
    kind = docs.schema[id_col].dataType
    prompt = F.coalesce(F.col(prompt_col).cast("long"), F.lit(0)) if prompt_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.greatest(prompt, F.lit(0)).alias("prompt"))
    fields = [T.StructField(id_col, kind), *(T.StructField(n, T.LongType()) for n in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()        # millions of strings in lists, no cycles: collections only cost time
        try:
            yield from packed(batches)
        finally:
            gc.enable()
            textnum.give_back()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = tokens(tokenizer_path, added=True), Packer(capacity, segments, loss)
        first = TaskContext.get().partitionId() << 40
        held: dict[int, tuple] = {}
        count = 0

        def out(pieces: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in names]
            for row, start, length, sequence, offset in pieces:
                key, raw, mute = held[row]
                part = raw[4 * start:4 * (start + length)]
                values = [key, start, length, zlib.crc32(part), len(raw) // 4, first + sequence, offset,
                          max(start + length - max(start, mute), 0)]
                if with_ids:
                    values.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                for column, value in zip(columns, values):
                    column.append(value)
            kinds = [id_type, *[pa.int64()] * 7, pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        id_type = pa.int64()
        for whole in batches:
            id_type = whole.schema.field("id").type
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ready: list[tuple] = []
                raw = own.encode(batch.column("text").to_pylist(), end_id)
                for key, ids, mute in zip(batch.column("id").to_pylist(), raw, batch.column("prompt").to_pylist()):
                    held[count] = (key, ids, mute)
                    ready += packer.add(count, len(ids) // 4, mute)
                    count += 1
                if packer.pool >= POOL_TOKENS:
                    ready += packer.pack(last=False)
                if ready:
                    yield out(ready, id_type)
                held = {r: held[r] for r in packer.row}
        ready = list(packer.pack(last=True))
        if ready:
            yield out(ready, id_type)
    return rows.mapInArrow(run, T.StructType(fields))
