"""Tokenizing inside tasks: a worker-wide encoder and a chunk-wise counter for very long texts."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# fixed value: how a byte-level pre-tokenizer cuts a text
_CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Latin letters and general punctuation: here the classes of both regex libraries are the same
_OTHER = re.compile("[^\\x00-\u024f\u2010-\u2027\u2030-\u205e]")


class TextEncoder:
    """Ids of whole texts as the tokenizer file gives them, several times faster on Latin texts.

    The file's vocabulary is handed to a second implementation of the same byte-level merges.
    Texts that hold a special string or a character outside Latin and general punctuation go to
    the file's own library.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        cutter = self.tokenizer.pre_tokenizer
        if type(cutter).__name__ != "ByteLevel" or self.tokenizer.normalizer is not None:
            raise ValueError("a byte-level tokenizer without normalizer is needed")
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.vocab_size <= 1 << 16 else np.dtype("<u4")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        byte_of = _byte_of_letter()
        ranks = {
            bytes(map(byte_of.__getitem__, piece)): rank
            for piece, rank in self.tokenizer.get_vocab(with_added_tokens=False).items()
            if piece not in special
        }
        self._fast = tiktoken.Encoding(
            path, pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str) -> list[int]:
        if _OTHER.search(text) or self._special.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        """Little-endian ids of ``text`` in ``dtype``."""
        if _OTHER.search(text) or self._special.search(text):
            return np.array(self.ids(text), self.dtype).tobytes()
        return self._fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype).tobytes()


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable letter: itself where it has one,
    else the next letter from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker and tokenizer file."""
    return TextEncoder(path)


def count_spliced(tokenizer, text: str, chunk: int, overlap: int) -> tuple[int, int, int]:
    """Tokens of ``text`` from overlapping chunks; also the splices made and the widenings.

    A *stable boundary* is a single space with a non-space character on either side. The
    byte-level pre-tokenizer lets a space only start a piece or stand in a run of white space, so
    a piece ends before such a space and a new one starts with it, whatever stands further left
    or right; special strings hold no space. Encoding both sides alone gives the ids of the whole.
    Neighbouring chunks share ``overlap`` characters. They are spliced at a stable boundary
    strictly inside the shared part at which a token ends in both encodings: what the left chunk
    has before it and the right chunk after it are the ids of the whole. Where the shared part
    holds none, it is doubled, up to the whole left chunk, and then the left chunk is doubled.
    """
    tokens = splices = widened = 0
    start, kept_from = 0, 0  # of the current chunk; all before kept_from is counted
    size = chunk
    ends = _token_ends(tokenizer, text, 0, min(size, len(text)))
    while (stop := min(start + size, len(text))) < len(text):
        width, cut = min(overlap, stop - start), None
        while cut is None:
            right = max(stop - width, kept_from)
            right_ends = _token_ends(tokenizer, text, right, min(right + chunk, len(text)))
            cut = _common_boundary(text, max(right, kept_from), stop, ends, right_ends)
            if cut is None:
                widened += 1
                if right == kept_from:
                    break
                width *= 2
        if cut is None:
            size *= 2
            ends = _token_ends(tokenizer, text, start, min(start + size, len(text)))
            continue
        tokens += int(np.searchsorted(ends, cut, "right") - np.searchsorted(ends, kept_from, "right"))
        splices += 1
        start, kept_from, ends = right, cut, right_ends
        size = chunk
    tokens += len(ends) - int(np.searchsorted(ends, kept_from, "right"))
    return tokens, splices, widened


def _token_ends(tokenizer, text: str, start: int, stop: int) -> np.ndarray:
    """End offset in ``text`` of each token of the chunk, ascending."""
    offsets = tokenizer.encode(text[start:stop], add_special_tokens=False).offsets
    return np.fromiter((end for _, end in offsets), np.int64, len(offsets)) + start


def _common_boundary(
    text: str, low: int, high: int, left_ends: np.ndarray, right_ends: np.ndarray
) -> int | None:
    """First stable boundary b, low < b < high - 1, where a token ends in both encodings."""
    both = np.intersect1d(left_ends, right_ends)
    for b in both[(both > low) & (both < high - 1)].tolist():
        if text[b] == " " and not text[b - 1].isspace() and not text[b + 1].isspace():
            return b
    return None


def text_slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts (null: empty) of the first two columns, few rows at a time."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
