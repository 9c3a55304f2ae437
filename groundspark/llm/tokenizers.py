"""The public tokenizers of a folder: exact token counts, and exact ids of the byte-level vocabulary.

Every counter remembers the counts of the pieces it has met (up to a bound), so repeated words cost a lookup.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import unicodedata

import numpy as np
import regex

FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT = regex.compile(SPLIT)
# The same pieces by the standard library, which is faster, for texts of characters of which it is known whether they are
# letters or figures: Latin, Greek, Cyrillic, Chinese and full-width ones, marks and spaces.
_L = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωЀ-ҁҊ-ԯ一-鿿Ａ-Ｚａ-ｚ"
_D = "0-9０-９"
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_D}]+| ?[^\s{_L}{_D}]+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile(rf"[^\x00-\x7f\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf×÷{_L}{_D}\u0300-\u036f\u2000-\u2064、。〈-】！-／：-＠]")
#: Pieces that a counter remembers, and characters of the longest of them.
KNOWN, LONG = 100_000, 64


def pieces(text: str) -> list[str]:
    return _PLAIN.findall(text) if text.isascii() or not _NOT_PLAIN.search(text) else _SPLIT.findall(text)


def ranks(name: str, folder: str = FOLDER) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a serialised protocol message."""

    def varint(n: int) -> bytes:
        n &= (1 << 64) - 1
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        return bytes(out)

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def piece_model(vocabulary: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model made directly from a byte-level vocabulary: byte b is the character 256 + b, a piece's score is
    its negative rank, text is not normalised, and no space is added or removed."""
    out = []
    for piece, rank in sorted(vocabulary.items(), key=lambda x: x[1]):
        out.append(_field(1, _field(1, "".join(chr(256 + b) for b in piece).encode()) + _field(2, float(-rank))))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(40, len(vocabulary)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def mapped(piece: str) -> str:
    return (np.frombuffer(piece.encode(), dtype=np.uint8).astype("<u2") + 256).tobytes().decode("utf-16-le")


class ByteEncoder:
    """ids(texts): exact ids of texts by a byte-level vocabulary, without special tokens; null and empty texts give no ids."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = FOLDER):
        import sentencepiece

        vocabulary = ranks(name, folder)
        self.bytes = {r: b for b, r in vocabulary.items()}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=piece_model(vocabulary))
        self.known: dict[str, list[int]] = {}
        self.sizes: dict[str, int] = {}

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        found, known, out = pieces(text), self.known, []
        new = [p for p in dict.fromkeys(found) if p not in known]
        told = dict(zip(new, self.model.encode([mapped(p) for p in new], num_threads=1), strict=True)) if new else {}
        for p in found:
            out += told[p] if p in told else known[p]
        if new:
            if len(known) > KNOWN:
                known.clear()
            # Long pieces, such as whole Chinese clauses, hardly come again.
            known.update((p, i) for p, i in told.items() if len(p) <= LONG)
        return out

    def text(self, ids: list[int]) -> str:
        """The inverse mapping."""
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        found, sizes = pieces(text), self.sizes
        try:
            return sum([sizes[p] for p in found])
        except KeyError:
            if len(sizes) > KNOWN:
                sizes.clear()
            new = [p for p in dict.fromkeys(found) if p not in sizes]
            told = dict(zip(new, map(len, self.model.encode([mapped(p) for p in new], num_threads=1)), strict=True))
            sizes.update((p, n) for p, n in told.items() if len(p) <= LONG)
            return sum([told[p] if p in told else sizes[p] for p in found])


class _Remembered:
    """Counts a text as the sum over chunks that the tokenizer never joins."""

    chunk: re.Pattern

    def __init__(self):
        self.known: dict[str, int] = {}

    def prepared(self, text: str) -> str:
        return text

    def split(self, text: str) -> list[str]:
        return self.chunk.findall(text)

    def counts(self, chunks: list[str]) -> list[int]:
        raise NotImplementedError

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        found, known = self.split(self.prepared(text)), self.known
        try:
            return sum([known[p] for p in found])
        except KeyError:
            pass
        if len(known) > KNOWN:
            known.clear()
        new = [p for p in dict.fromkeys(found) if p not in known]
        told = dict(zip(new, self.counts(new), strict=True))
        # Long chunks, such as whole Chinese texts, hardly come again.
        known.update((p, n) for p, n in told.items() if len(p) <= LONG)
        return sum([told[p] if p in told else known[p] for p in found])


class PieceCounter(_Remembered):
    """A sentencepiece vocabulary whose pieces hold a space only at their start: a chunk is a run of spaces and what follows."""

    chunk = re.compile(r" *[^ ]+| +")

    def __init__(self, name: str = "piece_bpe_32k", folder: str = FOLDER):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))

    def prepared(self, text: str) -> str:
        return " " + text.replace("▁", " ")

    def counts(self, chunks: list[str]) -> list[int]:
        # The model itself puts one space before what it is given, if that is not empty.
        return [len(x) or 1 for x in self.model.encode([c[1:] for c in chunks], num_threads=1)]


class WordCounter(_Remembered):
    """A vocabulary of lower-case words with word ends, which drops white space: a chunk is a word of the tokenizer's own split."""

    chunk = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_D}]|[^\s{_L}{_D}]+")

    def __init__(self, name: str = "word_bpe_49k", folder: str = FOLDER):
        super().__init__()
        # Each task has one core: more threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
        self.model.encode_special_tokens = True

    def prepared(self, text: str) -> str:
        return unicodedata.normalize("NFC", text).lower()

    def split(self, text: str) -> list[str]:
        return (self.plain if text.isascii() or not _NOT_PLAIN.search(text) else self.chunk).findall(text)

    def counts(self, chunks: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch_fast(chunks, add_special_tokens=False)]


def counter(name: str, folder: str = FOLDER):
    """The counter of a tokenizer by its file's name."""
    if os.path.exists(os.path.join(folder, f"{name}.tiktoken")):
        return ByteEncoder(name, folder)
    return PieceCounter(name, folder) if os.path.exists(os.path.join(folder, f"{name}.model")) else WordCounter(name, folder)
