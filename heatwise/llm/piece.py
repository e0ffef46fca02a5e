"""SentencePiece BPE encoding by a prefix table, and decoding.

The BPE encoding of every prefix of a text ends in exactly one token.  For each end
position an automaton over the vocabulary lists the tokens that end there; the one that
belongs is the one compatible with the (already known) last token of the prefix before it,
where two tokens are compatible if merging their joined characters gives just these two.
A table of one token for each prefix therefore suffices, and the ids are read backwards
from its end.  The table grows linearly with the text, also without any blank.

No piece holds a blank mark after another character or a character outside the vocabulary,
so texts are cut there (checked against the vocabulary when it is loaded) and the ids of
recent chunks are kept in a bounded cache.  Characters outside the vocabulary become byte
pieces.  Vocabulary, scores and piece kinds come from the public model file whose path is
given; it must do no normalisation besides the blank marks and one blank in front.

Defined cases: a null text counts as empty and has the end id only; other columns pass
through, a column of a name that is added here is replaced; rows are independent.
"""
from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

MARK = "▁"
CACHED_CHUNKS = 300_000
SHORT = 48                # longer chunks are not cached
ROWS_AT_ONCE = 1_000
_UNKNOWN = -1


class Vocabulary:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.end = model.eos_id()
        self.piece = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.bytes = {int(self.piece[i][3:5], 16): i for i in special if model.is_byte(i)}
        self.id = {p: i for i, p in enumerate(self.piece) if i not in special}
        self.score = {p: model.get_score(i) for p, i in self.id.items()}
        if any(MARK in p.lstrip(MARK) or "\n" in p or " " in p for p in self.id):
            raise ValueError("pieces may hold blank marks in front only")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        #: a mark that no piece holds behind a letter is a chunk of its own
        inner = {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}
        self.apart = frozenset(m for m in ".,;:!?" if not any(b[1] == m and b[0].isalpha() for b in inner))
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        # decoding
        of_byte = {i: b for b, i in self.bytes.items()}
        self.byte_of = np.full(size, -1, dtype=np.int64)
        for i, b in of_byte.items():
            self.byte_of[i] = b
        self.text = [chr(of_byte[i]) if of_byte.get(i, 128) < 128
                     else "" if model.is_control(i) else " ⁇ " if model.is_unknown(i)
                     else self.piece[i].replace(MARK, " ") for i in range(size)]

    def merged(self, chars: str) -> list[str]:
        """Merge the best-scored adjacent pair, leftmost first, until none is a piece."""
        parts = list(chars)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, token: int) -> bool:
        """The token's own characters merge to the token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = len(self.merged(self.piece[token])) == 1
        return known

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= 2_000_000:
                self.fits.clear()
            x, y = self.piece[a], self.piece[b]
            known = self.fits[key] = self.merged(x + y) == [x, y]
        return known

    def encode_chunk(self, chunk: str) -> list[int]:
        n = len(chunk)
        tokens = [_UNKNOWN] * (n + 1)       # last token of each prefix, and its length
        lengths = [1] * (n + 1)
        fits, whole = self.fits, self.whole
        for last, (token, length) in self.automaton.iter(chunk):
            end = last + 1
            if tokens[end] >= 0:
                continue
            before = tokens[end - length]
            if before < 0:
                ok = whole.get(token)
                if ok is None:
                    ok = self.stands(token)
            else:
                ok = fits.get(before << 32 | token)
                if ok is None:
                    ok = self.compatible(before, token)
            if ok:
                tokens[end], lengths[end] = token, length
        out: list[int] = []
        while n:
            token, length = tokens[n], lengths[n]
            if token == _UNKNOWN:
                out += [self.bytes[b] for b in reversed(chunk[n - 1].encode("utf-8"))]
            else:
                out.append(token)
            n -= length
        out.reverse()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The library's text: byte runs as UTF-8, the blank in front dropped."""
        text = self.text
        parts = [text[i] for i in ids.tolist()]
        raw = self.byte_of[ids]
        for start, end in _runs(raw >= 128, raw >= 0):
            parts[start:end] = [_utf8(bytes(raw[start:end].astype(np.uint8))), *[""] * (end - start - 1)]
        out = "".join(parts)
        first = next((i for i in ids.tolist() if i != self.end), None)
        return out[1:] if first is not None and self.byte_of[first] < 0 and self.piece[first].startswith(MARK) else out


def _utf8(raw: bytes) -> str:
    """Decoded with one replacement character for each byte that fits no sequence."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as wrong:
        return raw[:wrong.start].decode("utf-8") + "�" + _utf8(raw[wrong.start + 1:])


def _runs(wanted: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of ``inside`` that hold a wanted place."""
    if not wanted.any():
        return
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if wanted[start:end].any():
            yield start, end


class _Chunks(dict):
    """chunk -> its ids as int32 bytes; emptied when full."""

    def __init__(self, vocabulary: Vocabulary, front: str):
        self.vocabulary, self.front = vocabulary, front
        self.marks = {m: array("i", vocabulary.encode_chunk(m)).tobytes() for m in vocabulary.apart}

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1:] in self.vocabulary.apart and chunk[-2:-1].isalpha():
            out = self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            out = array("i", self.vocabulary.encode_chunk(self.front + chunk)).tobytes()
        if len(chunk) <= SHORT:
            if len(self) >= CACHED_CHUNKS:
                self.clear()
            self[chunk] = out
        return out


class Encoder:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.marked, self.bare = _Chunks(self.vocabulary, MARK), _Chunks(self.vocabulary, "")
        self.newline = self.bare["\n"]
        self.end = np.array([self.vocabulary.end], dtype="<i4").tobytes()
        self.odd = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian int32, the end id last."""
        if not text:
            return self.end
        out = []
        marked, bare = self.marked, self.bare
        for n, line in enumerate(text.split("\n")):
            if n:
                out.append(self.newline)
            if "  " in line or MARK in line or line[-1:] == " " or line[:1] == " ":
                whole = ("" if n else MARK) + line.replace(" ", MARK)
                out += [bare[c] for c in self.odd.findall(whole)]
                continue
            words = line.split(" ")
            if n:
                if words[0]:
                    out.append(bare[words[0]])
                out += map(marked.__getitem__, words[1:])
            else:
                out += map(marked.__getitem__, words)
        out.append(self.end)
        return b"".join(out)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    at = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), values],
                                      [*(batch.schema.names[i] for i in at), name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col``: the ids of each whole text and the end id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                raw = [own.encode(t) for t in batch.column(text_col).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(raw), dtype=np.int32))
                yield _with(batch, ids_col, pa.ListArray.from_arrays(pa.array(offsets), ids))
    return docs.mapInArrow(run, _schema(docs, ids_col, T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``: the text of the ids; null ids give null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(model_path).vocabulary
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                lists = batch.column(ids_col)
                values = lists.values.to_numpy()
                ends = lists.offsets.to_numpy()
                texts = [vocabulary.decode(values[a:b]) if ok else None
                         for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist())]
                yield _with(batch, text_col, pa.array(texts, pa.string()))
    return encoded.mapInArrow(run, _schema(encoded, text_col, T.StringType()))
