"""SentencePiece encoding that keeps byte offsets, and decoding.

A text is normalised by the model's compiled character map: at each position the longest prefix that the map's double-array trie holds
is replaced, and the source position of each normalised byte is recorded. Pieces are spans of normalised bytes, so
their spans in the original bytes follow from that alignment.

Where no piece of the vocabulary crosses from a letter to a following space mark, merges never cross one either, and a text's pieces
are its words' pieces: each distinct word of a batch is then encoded once. Other texts and other models are encoded text by text.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm import kernels as K
from changeloom.llm.common import bounded_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
SCHEMA = "doc_id long, ids array<int>, starts array<int>, ends array<int>, round_trip boolean"
#: Bytes of text whose distinct words are encoded together.
CHUNK = 1 << 20


class CharsMap:
    """A compiled character map: a double-array trie over UTF-8 prefixes, and the strings that replace them."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], np.uint32).tolist() if blob else []
        self.strings = blob[4 + size :] if blob else b""

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of text[at:] in the map and what it becomes."""
        if not self.units:
            return None
        node = self._offset(self.units[0])
        best = None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        return best and (best[0], self.strings[best[1] : self.strings.index(0, best[1])])

    @cached_property
    def plain(self) -> np.ndarray:
        """[256, 256]: whether a prefix that starts with these two bytes can't be in the map. The second index 0 stands for the end as well."""
        out = np.ones((256, 256), bool)
        if self.units:
            root = self._offset(self.units[0])
            for a in range(256):
                n1 = root ^ a
                if n1 < len(self.units) and self.units[n1] & 0x800000FF == a:
                    unit = self.units[n1]
                    n2 = n1 ^ self._offset(unit)
                    for b in range(256):
                        x = n2 ^ b
                        out[a, b] = not (unit >> 8 & 1 or (x < len(self.units) and self.units[x] & 0x800000FF == b and b))
        return out


class Normalizer:
    """Normalises a text and aligns each normalised byte with its source."""

    def __init__(self, spec: Any, fixed: tuple[bytes, ...] = ()) -> None:
        self.map = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.fixed = sorted(fixed, key=len, reverse=True)

    @property
    def identity(self) -> bool:
        return not self.map.units and not self.fixed and self.escape

    def prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        for s in self.fixed:
            if text.startswith(s, at):
                return len(s), s
        if found := self.map.longest(text, at):
            return found
        b = text[at]
        n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return n, text[at : at + n]

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them (and the end) the offset in text."""
        if self.identity and not self.squeeze:
            return self._identity(text)
        space = MARK if self.escape else b" "
        at, out, align = 0, bytearray(), []
        raw = np.frombuffer(text, np.uint8)
        follow = np.append(raw[1:], 0) if len(raw) else raw
        easy = self.map.plain[raw, follow] & (raw < 0x80) & (raw != 32) if not self.fixed else np.zeros(len(raw), bool)
        if self.squeeze:
            while at < len(text):
                n, s = self.prefix(text, at)
                if s != b" ":
                    break
                at += n
        if at >= len(text):
            return b"", np.zeros(1, np.int64) + at
        if self.dummy:
            out += space
            align += [at] * len(space)
        was_space = self.squeeze
        hard = np.flatnonzero(~easy)
        while at < len(text):
            if easy[at]:
                k = np.searchsorted(hard, at)
                e = int(hard[k]) if k < len(hard) else len(text)
                out += text[at:e]
                align += range(at, e)
                at, was_space = e, False
                continue
            n, s = self.prefix(text, at)
            while was_space and s.startswith(b" "):
                s = s[1:]
            if s:
                was_space = s.endswith(b" ")
                s = s.replace(b" ", space)
                out += s
                align += [at] * len(s)
            at += n
            was_space = was_space and self.squeeze
        end = at
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = align[len(out)]
                del align[len(out) :]
        return bytes(out), np.array([*align, end], np.int64)

    def _identity(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        raw = np.frombuffer(text, np.uint8)
        width = np.where(raw == 32, 3, 1)
        align = np.repeat(np.arange(len(raw)), width)
        out = text.replace(b" ", MARK)
        if self.dummy:
            out, align = MARK + out, np.concatenate([[0, 0, 0], align])
        return out, np.append(align, len(raw))


class Codec:
    """A model's encoder and decoder on bytes."""

    def __init__(self, path: str = MODEL, blob: bytes | None = None) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        if blob is None:
            with open(path, "rb") as f:
                blob = f.read()
        model = pb.ModelProto()
        model.ParseFromString(blob)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        kinds = [p.type for p in model.pieces]
        names = [p.piece.encode() for p in model.pieces]
        self.fixed = tuple(n for n, k in zip(names, kinds, strict=True) if k == 4)
        self.normalizer = Normalizer(model.normalizer_spec, self.fixed)
        #: What each piece stands for, in normalised bytes.
        self.bytes = [bytes([int(n[3:5], 16)]) if k == 6 else b"" if k == 3 else n for n, k in zip(names, kinds, strict=True)]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.unk = self.sp.unk_id()
        inner = any(MARK in n.lstrip(MARK) and not n.startswith(MARK) or MARK in n.replace(MARK, b"\0").lstrip(b"\0").replace(b"\0", MARK) for n, k in zip(names, kinds, strict=True) if k == 1)
        s = model.normalizer_spec
        self.wordwise = self.normalizer.identity and s.add_dummy_prefix and not s.remove_extra_whitespaces and not inner and bool(model.trainer_spec.byte_fallback)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and starts and ends of their spans in the text's bytes."""
        norm, align = self.normalizer(text)
        ids = np.array(self.sp.encode(text.decode()), np.int32)
        length = self.length[ids]
        if (ids == self.unk).any():  # an unknown run's length is only in the detailed result
            pieces = self.sp.encode(text.decode(), out_type="immutable_proto").pieces
            length = np.array([self.length[p.id] if p.id != self.unk else len(p.piece.encode()) for p in pieces], np.int64)
        edge = np.concatenate([[0], np.cumsum(length)])
        if edge[-1] != len(norm):
            raise ValueError("pieces don't add up to the normalised text")
        return ids, align[edge[:-1]].astype(np.int32), align[edge[1:]].astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The normalised text: pieces joined, space marks as spaces, without the dummy one in front."""
        n = self.length[ids]
        at = np.repeat(self.at[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out = self.flat[at].tobytes().replace(MARK, b" ")
        return out[1:] if self.normalizer.dummy and out.startswith(b" ") else out

    def encode_batch(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, starts, ends and row offsets of a batch of texts."""
        rows = len(off) - 1
        if self.wordwise and len(data):
            blank = data == 32
            bad = np.zeros(len(data), bool)
            bad[1:] = blank[1:] & blank[:-1]
            first, last = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0] - 1
            bad[first] = blank[first]
            bad[last] |= blank[last]
            slow = np.flatnonzero(np.add.reduceat(bad, first) > 0) if len(first) else np.empty(0, int)
            slow = np.flatnonzero(np.diff(off) > 0)[slow]
        else:
            slow = np.flatnonzero(np.diff(off) > 0)
        ids, starts, ends, count = [], [], [], np.zeros(rows, np.int64)
        edges = [0, *sorted({int(s) for s in slow} | {int(s) + 1 for s in slow}), rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            if hi == lo + 1 and lo in set(slow.tolist()):
                i, s, e = self.encode(data[off[lo] : off[hi]].tobytes())
                count[lo] = len(i)
            else:
                i, s, e, count[lo:hi] = self._words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            ids.append(i)
            starts.append(s)
            ends.append(e)
        cat = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int32)
        return cat(ids), cat(starts), cat(ends), np.concatenate([[0], np.cumsum(count)])

    def _words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r = K.Runs(data, off, cls=(data != 32).astype(np.uint8))
        if not len(r.hash):
            return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32), np.zeros(len(off) - 1, np.int64)
        _, where, which = np.unique(r.hash, return_index=True, return_inverse=True)
        raw = data.tobytes()
        pieces = self.sp.encode([raw[a:b] for a, b in zip(r.start[where].tolist(), r.end[where].tolist(), strict=True)], num_threads=1)
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        vocab = np.fromiter(chain.from_iterable(pieces), np.int32, n.sum())
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        m = n[which]
        edge = np.cumsum(m)
        # position in vocab of every piece of every word
        idx = np.repeat(at[which] - (edge - m), m) + np.arange(edge[-1])
        ids = vocab[idx]
        # A word is one mark (3 bytes) and its own bytes; piece edges in it follow from the lengths, once for each distinct word.
        size = self.length[vocab]
        run = np.cumsum(size)
        inner_end = run - np.repeat(run[at] - size[at], n)  # normalised end within the word
        e = np.maximum(inner_end - 3, 0)
        s = np.maximum(inner_end - size - 3, 0)
        # The mark's source is the space before the word, or nothing (the dummy) for a row's first word.
        base = np.repeat(r.start, m)
        ends = (base + e[idx]).astype(np.int32)
        starts = (base + s[idx]).astype(np.int32)
        head = (edge - m)
        first = np.zeros(len(r.row), bool)
        first[0] = True
        first[1:] = r.row[1:] != r.row[:-1]
        mid = head[~first]
        starts[mid] -= 1
        row0 = np.repeat(off[:-1][r.row], m)
        ragged = np.flatnonzero((inner_end - size < 3) & (inner_end - size > 0))
        if len(ragged):  # the mark itself fell into several pieces: all of them stand for the space
            inside = np.isin(idx, ragged) & ~np.repeat(first, m)
            starts[inside] = base[inside] - 1
        count = np.bincount(r.row, weights=m, minlength=len(off) - 1).astype(np.int64)
        short = np.flatnonzero(inner_end < 3)
        if len(short):
            inside = np.isin(idx, short) & ~np.repeat(first, m)
            ends[inside] = base[inside] - 1
        return ids, (starts - row0).astype(np.int32), (ends - row0).astype(np.int32), count


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: piece ids, and the byte span (start, end) of each piece in the original UTF-8 text.

    The dummy space in front has no source: a first piece that is only it gets span (0, 0). Pieces of a replaced sequence get that
    sequence's start. round_trip says whether decoding the ids gives the text back (it does but where normalisation changed the text). A null text has null ids
    and spans, an empty one empty ones. Repeated rows are encoded alike. `model` is a path that executors can read. Other columns are ignored.
    """
    bounded_batches(docs)
    @K.lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for b in it:
            data, off = K.text_of(b.column(1))
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            for lo, hi in K.slices(off, CHUNK):
                part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                ids, starts, ends, at = codec.encode_batch(part, o)
                raw = part.tobytes()
                same = [codec.decode(ids[at[i] : at[i + 1]]) == raw[o[i] : o[i + 1]] for i in range(hi - lo)]
                mask = pa.array(null[lo:hi])
                cols = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32()), mask=mask) for x in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *cols, pa.array(same, mask=null[lo:hi])], names=["doc_id", "ids", "starts", "ends", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from piece ids. Null ids give a null text, empty ones an empty text; bytes that aren't UTF-8 become U+FFFD."""
    bounded_batches(encoded)
    @K.lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for b in it:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
