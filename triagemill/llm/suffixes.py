"""Suffix-array dedup: remove every 50-byte string that an earlier document already holds.

1. The least hash of the 34-byte strings in a 50-byte window names the window. Equal windows have
   equal names, so only runs of windows whose name occurs in two different texts can hold a
   repeated string. 32 bits of the names are brought together in packed buckets; the rest is left
   behind.
2. The bytes of the remaining runs meet in the bucket of their name. A window that two different
   pieces share reaches 8 bytes beyond the named string on one side at least; pieces connected
   by such agreement are joined by separators and sorted as suffixes: Lyndon-prefix groups in descending
   order with previous-smaller pointers, then each group's order, without recursion. Neighbours in
   this order that agree in 50 bytes are one string, whose first document is the smallest. The
   runs of a name that more than ``HOT_TEXTS`` texts hold are cut into their windows, which are
   dealt out by their own bytes: equal windows meet, and there is nothing to sort.
3. Windows with an earlier first document are joined into spans, spans meet their texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from triagemill.session import materialize

LENGTH = 50
CONTEXT = 16
BUCKET_BYTES = 8 << 20
HOT_TEXTS = 1 << 14  # texts with one name up to which its pieces are sorted together
_SLICE = 1 << 20
_BASE = 0xD6E8FEB86659FD93


# --- suffix sorting -------------------------------------------------------------------------


def suffix_array(text: bytes | list[int]) -> list[int]:
    """Suffixes of ``text`` in order, by linear grouping.

    First pass: groups start as equal first symbols and are visited from the highest down. For
    each suffix of a group, the pointer to the nearest smaller suffix on its left is found over
    pointers already known. The suffixes pointed at prolong their Lyndon prefix by the group's:
    they leave their own group for new ones above it, those pointed at more often higher up. In
    the end a group holds the suffixes with one Lyndon prefix. Second pass: going up, the
    suffix before each one placed, and those its pointers lead to, are the next of their groups.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size, previous = [0] * n, [0] * n, [0] * (n + 1), [-2] * n
    start = 0
    for rank, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = rank
        place[i], group[i] = rank, start
        size[start] += 1
    end = n
    while end:
        here = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in order[here:end]:
            j = i - 1
            while j >= 0 and group[j] >= here:
                known = previous[j]
                j = known if known != -2 else j - 1
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = here
        moved: dict[int, list[tuple[int, int]]] = {}
        for j, times in pointed.items():
            moved.setdefault(group[j], []).append((times, j))
        for old, own in moved.items():
            if len(own) > 1:
                own.sort()
            slot = old + size[old] - len(own)
            size[old] -= len(own)
            times_before, first = 0, slot
            for times, j in own:
                other, from_slot = order[slot], place[j]
                order[slot], place[j] = j, slot
                order[from_slot], place[other] = other, from_slot
                if times != times_before:
                    times_before, first = times, slot
                group[j] = first
                size[first] += 1
                slot += 1
    out, front, placed = [0] * n, list(range(n)), bytearray(n)
    j, rank = n - 1, 0
    while True:
        while j >= 0 and not placed[j]:
            at = group[j]
            out[front[at]] = j
            front[at] += 1
            placed[j] = 1
            j = previous[j]
        if rank >= n:
            return out
        j = out[rank] - 1
        rank += 1


def first_owners(pieces: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window of each piece the smallest owner of a piece that holds its bytes."""
    if len(pieces) == 1:
        return [np.full(len(pieces[0]) - length + 1, owners[0])]
    joined: list[int] = []
    for p in pieces:
        joined.extend([x + 1 for x in p])
        joined.append(0)
    symbols = np.array(joined, np.int16)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes + 1) - 1
    order = np.array(suffix_array(joined))
    piece = np.searchsorted(ends, order, "right")
    whole = np.flatnonzero(order + length <= ends[np.minimum(piece, len(ends) - 1)])
    order, piece = order[whole], piece[whole]
    windows = np.lib.stride_tricks.sliding_window_view(symbols, length)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), 1 << 16):
        own = order[at - 1 : at + (1 << 16)]
        new[at : at + (1 << 16)] = (windows[own[1:]] != windows[own[:-1]]).any(axis=1)
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(owners[piece], starts)
    first = np.empty(len(symbols), owners.dtype)
    first[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
    begin = ends - sizes
    return [first[b : e - length + 1] for b, e in zip(begin.tolist(), ends.tolist())]


# --- names of windows -----------------------------------------------------------------------


def name_bytes(length: int) -> int:
    """Bytes of the strings that name windows: two more than a power of two, 18 at least, with 14
    bytes of the window or more beyond them."""
    power = 16
    while length - (2 * power + 2) >= 14:
        power *= 2
    return power + 2


def _rolled(data: np.ndarray, name: int, near: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``name`` and of the ``near`` bytes that start at each position."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    base = 1 << (name.bit_length() - 1)
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    width, ends, context = 1, None, h
    while width < base:
        h = h[:-width] * power(width) + h[width:]
        width *= 2
        if width == name - base:
            ends = h
        if width == near:
            context = h
    names = h[: len(data) - name + 1] * power(name - base)
    names = names + ends[base : base + len(names)]
    names = (names ^ (names >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return names ^ (names >> np.uint64(32)), context


def window_runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows with one name: (text number, start, windows, name) arrays."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    if len(data) < length:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    name = name_bytes(length)
    names, _ = _rolled(data, name)
    span, width = length - name + 1, 1
    while 2 * width <= span:
        names = np.minimum(names[:-width], names[width:])
        width *= 2
    if span > width:
        names = np.minimum(names[: -(span - width)], names[span - width :])
    text = np.searchsorted(ends, np.arange(len(names)), "right")
    inside = np.arange(len(names)) + length <= ends[text]
    cut = np.ones(len(names) + 1, bool)
    cut[1:-1] = (names[1:] != names[:-1]) | ~inside[:-1] | (text[1:] != text[:-1])
    edges = np.flatnonzero(cut)
    starts, stops = edges[:-1], edges[1:]
    # windows at the end of a text that reach into the next one are at the end of a run
    stops = np.minimum(stops, np.maximum(ends[text[starts]] - length + 1, starts))
    some = np.flatnonzero(stops > starts)
    starts, stops = starts[some], stops[some]
    begin = (ends - np.fromiter(map(len, texts), np.int64, len(texts)))[text[starts]]
    return text[starts], starts - begin, stops - starts, names[starts]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their UTF-8 texts (first column), about ``_SLICE`` bytes at a time."""
    for batch in batches:
        texts = [x.as_buffer().to_pybytes() for x in batch.column(0)]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= _SLICE or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def _bucket(names: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((names >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int32)


def _coded(names: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """What is known of a name where names meet: its bucket and 32 of its bits.

    Two names with one code only cost a look at more windows, as these are compared by their bytes.
    """
    return (bucket.astype(np.uint64) << np.uint64(32)) | (names & np.uint64(0xFFFFFFFF))


def _names(n_buckets: int, length: int):
    """Names of each text's runs, packed by bucket."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(_batches(batches)):
            keys, digests, of, found = [], [], [], []
            for rows, texts in group:
                text, _, _, name = window_runs(texts, length)
                of.append((text + len(keys)).astype(np.int32))
                found.append(name)
                keys += rows.column(1).to_pylist()
                digests += rows.column(2).to_pylist()
            of, found = np.concatenate(of), np.concatenate(found)
            keys, digests = np.array(keys, np.int64), np.array(digests, np.int64)
            bucket = _bucket(found, n_buckets)
            narrow = bucket.astype(np.uint16) if n_buckets < 1 << 16 else bucket
            order = np.argsort(narrow, kind="stable")  # texts stay in order within a bucket
            bucket, of, found = bucket[order], of[order], found[order].astype(np.uint32)
            for own in np.split(np.arange(len(of)), np.flatnonzero(np.diff(bucket)) + 1):
                if len(own):
                    begin = np.flatnonzero(np.diff(of[own], prepend=-1))
                    docs = of[own[begin]]
                    counts = np.diff(np.append(begin, len(own))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(bucket[own[0]])], pa.int32()),
                            pa.array([keys[docs].tobytes()], pa.binary()),
                            pa.array([digests[docs].tobytes()], pa.binary()),
                            pa.array([counts.tobytes()], pa.binary()),
                            pa.array([found[own].tobytes()], pa.binary()),
                        ],
                        names=["bucket", "keys", "digests", "counts", "names"],
                    )

    return names


def _gathered(parts, most: int = 12 << 20):
    """Lists of consecutive parts with about ``most`` bytes of text."""
    own, size = [], 0
    for rows, texts in parts:
        own.append((rows, texts))
        size += sum(map(len, texts))
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def _repeated(hot_texts: int, n_parts: int):
    return lambda table: _names_in_two(table, hot_texts, n_parts)


def _names_in_two(table: pa.Table, hot_texts: int, n_parts: int) -> pa.Table:
    """Names that occur in two different texts, packed for the first document of each text.

    The highest bit marks those that more than ``hot_texts`` texts hold.
    """
    keys, digests, counts, names = [], [], [], []
    for row in table.to_pylist():
        keys.append(np.frombuffer(row["keys"], np.int64))
        digests.append(np.frombuffer(row["digests"], np.int64))
        counts.append(np.frombuffer(row["counts"], np.int32))
        names.append(np.frombuffer(row["names"], np.uint32))
    keys, digests, counts, names = map(np.concatenate, (keys, digests, counts, names))
    # most names occur once and go before anything else is done with them
    sorted_names = np.sort(names)
    twice = sorted_names[1:][sorted_names[1:] == sorted_names[:-1]]
    at = np.searchsorted(twice, names)
    some = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == names) if len(twice) else at[:0]
    doc = np.repeat(np.arange(len(keys)), counts)[some]
    keys, digests, names = keys[doc], digests[doc], names[some]
    order = np.lexsort((keys, digests, names))
    keys, digests, names = keys[order], digests[order], names[order]
    new_name = np.ones(len(names), bool)
    new_name[1:] = names[1:] != names[:-1]
    first = new_name.copy()
    first[1:] |= digests[1:] != digests[:-1]
    number = np.cumsum(new_name) - 1
    n_texts = np.bincount(number[first])[number]
    kept = np.flatnonzero(first & (n_texts > 1))
    bucket = np.full(len(kept), table["bucket"][0].as_py())
    hot = (n_texts[kept] > hot_texts).astype(np.uint64) << np.uint64(63)
    codes = _coded(names[kept].astype(np.uint64), bucket) | hot
    return _packed(keys[kept], digests[kept], codes, n_parts)


def _parts(keys: np.ndarray, digests: np.ndarray, n_parts: int) -> np.ndarray:
    """Part of the documents that a key with its text belongs to; see ``_part``."""
    return ((keys ^ digests) % n_parts).astype(np.int32)


def _part(n_parts: int) -> Column:
    mixed = F.coalesce("key", F.lit(0).cast("long")).bitwiseXOR(F.col("digest"))
    return F.pmod(mixed, F.lit(n_parts)).cast("int")


_BY_PART = "part int, keys binary, digests binary, counts binary, values binary"


def _packed(keys: np.ndarray, digests: np.ndarray, values: np.ndarray, n_parts: int) -> pa.Table:
    """One row for each part of the documents: its keys and texts, and the values of each."""
    part = _parts(keys, digests, n_parts)
    order = np.lexsort((digests, keys, part))
    part, keys, digests, values = part[order], keys[order], digests[order], values[order]
    new = np.ones(len(part), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (digests[1:] != digests[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(part))).astype(np.int32)
    rows = []
    edges = [0, *(np.flatnonzero(np.diff(part[first])) + 1).tolist(), len(first)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            own = first[a:b]
            end = first[b] if b < len(first) else len(part)
            rows.append(
                (int(part[own[0]]), keys[own].tobytes(), digests[own].tobytes(),
                 counts[a:b].tobytes(), values[own[0] : end].tobytes())
            )
    columns = list(zip(*rows)) or [()] * 5
    kinds = [pa.int32(), *[pa.binary()] * 4]
    names = [f.split()[0] for f in _BY_PART.split(", ")]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def _by_document(packed: pa.Table, dtype: str, width: int = 1) -> dict[tuple[int, int], list[np.ndarray]]:
    """Values of the documents of a part, by key and text."""
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for row in packed.to_pylist():
        keys = np.frombuffer(row["keys"], np.int64).tolist()
        digests = np.frombuffer(row["digests"], np.int64).tolist()
        ends = np.cumsum(np.frombuffer(row["counts"], np.int32))
        values = np.frombuffer(row["values"], dtype).reshape(-1, width)
        for k, d, own in zip(keys, digests, np.split(values, ends[:-1])):
            found.setdefault((k, d), []).append(own)
    return found


# --- pieces and spans -----------------------------------------------------------------------


def _pieces(n_buckets: int, length: int):
    """Bytes of the runs with a repeated name, packed by bucket; equal pieces once a pack.

    Buckets from ``n_buckets`` on hold the windows of hot names, each one a piece.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _gathered(_batches(batches), 8 << 20):
            packs: dict[int, tuple[dict, list]] = {}
            for rows, texts in group:
                text, start, windows, name = window_runs(texts, length)
                keys, digests = rows.column(1).to_pylist(), rows.column(2).to_pylist()
                chosen = [np.frombuffer(b"".join(x), np.uint64) for x in rows.column(3).to_pylist()]
                hot = [
                    set(np.frombuffer(b"".join(x), np.uint64).tolist())
                    for x in rows.column(4).to_pylist()
                ]
                bounds = np.searchsorted(text, np.arange(len(texts) + 1))
                buckets = _bucket(name, n_buckets)
                code = _coded(name, buckets)
                for i, wanted in enumerate(chosen):
                    own = np.arange(bounds[i], bounds[i + 1])
                    own = own[np.isin(code[own], wanted)]
                    for b, s, w, h, c in zip(
                        buckets[own].tolist(), start[own].tolist(), windows[own].tolist(),
                        name[own].tolist(), code[own].tolist(),
                    ):
                        parts = [(b, s, texts[i][s : s + w + length - 1])]
                        if c in hot[i]:
                            windows_of = ((x, texts[i][x : x + length]) for x in range(s, s + w))
                            parts = [
                                (n_buckets + (zlib.crc32(p) + b) % n_buckets, x, p)
                                for x, p in windows_of
                            ]
                        for to, x, p in parts:
                            known, seen = packs.setdefault(to, ({}, []))
                            own_number = known.setdefault((h, p), len(known))
                            seen.append((own_number, keys[i], digests[i], x))
            for b, (known, seen) in packs.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b], pa.int32()),
                        pa.array([np.array([h for h, _ in known], np.uint64).tobytes()], pa.binary()),
                        pa.array([np.array([len(p) for _, p in known], np.int32).tobytes()], pa.binary()),
                        pa.array([b"".join(p for _, p in known)], pa.binary()),
                        pa.array([np.array(seen, np.int64).tobytes()], pa.binary()),
                    ],
                    names=["bucket", "names", "sizes", "pieces", "seen"],
                )

    return pieces


def _context(length: int) -> int:
    """Bytes beyond the named string that a shared window has on one side at least, by powers of two."""
    return min(CONTEXT, 1 << (((length - name_bytes(length) + 1) // 2).bit_length() - 1))


def _alike(names: np.ndarray, pieces: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Group number of each piece: pieces that may share a window are in one group.

    Around each occurrence of the named string, the bytes before and those after it link all
    pieces that have the same there.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    near, size = _context(length), name_bytes(length)
    named, context = _rolled(data, size, near)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    at = np.flatnonzero(named == names[owner[: len(named)]])
    piece = owner[at]
    at, piece = at[at + size <= ends[piece]], piece[at + size <= ends[piece]]
    left = at - near >= (ends - sizes)[piece]
    right = at + size + near <= ends[piece]
    keys = np.concatenate(
        [
            context[at[left] - near] ^ (names[piece[left]] << np.uint64(1)),
            ~context[at[right] + size] ^ (names[piece[right]] << np.uint64(1)),
        ]
    )
    holder = np.concatenate([piece[left], piece[right]])
    order = np.argsort(keys, kind="stable")
    keys, holder = keys[order], holder[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    a, b = holder[same], holder[same + 1]
    low = np.arange(len(pieces))
    while True:
        least = np.minimum(low[a], low[b])
        now = low.copy()
        np.minimum.at(now, low[a], least)
        np.minimum.at(now, low[b], least)
        now = now[now]
        if (now == low).all():
            return low
        low = now


def _shareable(names: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the part of each piece that can hold windows of other pieces.

    All windows of a piece hold the named string. Where it occurs once, a window shared with another
    piece lies within the bytes that both have beside it, and no piece agrees with more bytes on a
    side than a neighbour in the order of these bytes. A part shorter than a window holds none.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    begin = ends - sizes
    low, high = np.zeros(len(pieces), np.int64), sizes.copy()
    size = name_bytes(length)
    named, _ = _rolled(data, size)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    at = np.flatnonzero(named == names[owner[: len(named)]])
    at = at[at + size <= ends[owner[at]]]
    once = np.bincount(owner[at], minlength=len(pieces)) == 1
    at = at[once[owner[at]]]
    piece = owner[at]
    beyond = length - size
    for side in (-1, 1):
        first = at - 1 if side < 0 else at + size
        inside = np.where(side < 0, at - begin[piece], ends[piece] - at - size)
        agree = np.zeros(len(at), np.int64)
        where = first[:, None] + side * np.arange(beyond)
        beside = np.where(np.arange(beyond) < inside[:, None], data[np.clip(where, 0, len(data) - 1)], 0)
        width = -(-beyond // 8) * 8
        keys = np.zeros((len(at), width), np.uint8)
        keys[:, :beyond] = beside
        words = keys.view(">u8")
        order = np.lexsort((*words.T[::-1], names[piece]))
        same = (beside[order[1:]] == beside[order[:-1]]).cumprod(axis=1).sum(axis=1)
        same = np.where(names[piece[order[1:]]] == names[piece[order[:-1]]], same, 0)
        np.maximum.at(agree, order[1:], same)
        np.maximum.at(agree, order[:-1], same)
        agree = np.minimum(agree, inside)
        if side < 0:
            low[piece] = at - agree - begin[piece]
        else:
            high[piece] = at + size + agree - begin[piece]
    return low, high


def _spans(n_buckets: int, length: int):
    """Spans of windows whose first document is not their own, packed by part of the documents."""

    def spans(table: pa.Table) -> pa.Table:
        known: dict[tuple[int, bytes], int] = {}
        seen = []
        for row in table.to_pylist():
            names = np.frombuffer(row["names"], np.uint64).tolist()
            ends = np.cumsum(np.frombuffer(row["sizes"], np.int32)).tolist()
            number = np.array(
                [
                    known.setdefault((h, row["pieces"][a:b]), len(known))
                    for h, a, b in zip(names, [0, *ends], ends)
                ],
                np.int64,
            )
            own = np.frombuffer(row["seen"], np.int64).reshape(-1, 4).copy()
            own[:, 0] = number[own[:, 0]]
            seen.append(own)
        seen = np.concatenate(seen)
        owner = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(owner, seen[:, 0], seen[:, 1])
        pieces = [p for _, p in known]
        lanes: dict[int, list[int]] = {}
        first: list = [None] * len(known)
        if table["bucket"][0].as_py() >= n_buckets:
            first = list(owner[:, None])
        else:
            # outside of what pieces can share, a window's first document is that of its piece
            names = [h for h, _ in known]
            low, high = (x.tolist() for x in _shareable(np.array(names, np.uint64), pieces, length))
            parts: dict[tuple[int, bytes], int] = {}
            part_of = np.full(len(pieces), -1)
            for i, (h, p, a, b) in enumerate(zip(names, pieces, low, high)):
                if b - a >= length:
                    part_of[i] = parts.setdefault((h, p[a:b]), len(parts))
            least = np.full(len(parts), np.iinfo(np.int64).max)
            shares = part_of >= 0
            np.minimum.at(least, part_of[shares], owner[shares])
            texts = [p for _, p in parts]
            found: list = [None] * len(parts)
            if parts:
                group = _alike(np.array([h for h, _ in parts], np.uint64), texts, length)
                for i, g in enumerate(group.tolist()):
                    lanes.setdefault(g, []).append(i)
            for lane in lanes.values():
                for i, own in zip(lane, first_owners([texts[i] for i in lane], least[lane], length)):
                    found[i] = own
            sizes = [len(p) - length + 1 for p in pieces]
            whole = np.repeat(owner, sizes)
            first = np.split(whole, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(shares).tolist():
                first[i][low[i] : high[i] - length + 1] = found[part_of[i]]
        windows = np.fromiter(map(len, first), np.int64, len(first))
        begin = np.cumsum(windows) - windows
        flat = np.concatenate(first)
        keys, digests, lows, highs = [], [], [], []
        for at in range(0, len(seen), 100_000):
            part = seen[at : at + 100_000]
            n = windows[part[:, 0]]
            of = np.repeat(np.arange(len(part)), n)
            inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            earlier = flat[begin[part[of, 0]] + inner] < part[of, 1]
            edge = np.ones(len(of) + 1, bool)
            edge[1:-1] = (earlier[1:] != earlier[:-1]) | (of[1:] != of[:-1])
            cuts = np.flatnonzero(edge)
            low, high = cuts[:-1], cuts[1:] - 1
            low, high = low[earlier[low]], high[earlier[low]]
            doc = part[of[low]]
            keys.append(doc[:, 1])
            digests.append(doc[:, 2])
            lows.append(doc[:, 3] + inner[low])
            highs.append(doc[:, 3] + inner[high] + length)
        both = np.stack([np.concatenate(lows), np.concatenate(highs)], axis=1)
        return _packed(np.concatenate(keys), np.concatenate(digests), both, n_buckets)

    return spans


def _pieces_of_part(n_buckets: int, length: int):
    """``_pieces`` of a part's documents and the names that are repeated in them."""

    def pieces(docs: pa.Table, named: pa.Table) -> pa.Table:
        codes = _by_document(named, "<u8")
        top = np.uint64(1) << np.uint64(63)
        own = [(i, codes.get((k, d))) for i, (k, d) in enumerate(zip(docs["key"].to_pylist(), docs["digest"].to_pylist()))]
        own = [(i, np.concatenate(c)[:, 0]) for i, c in own if c]
        rows = docs.take(pa.array([i for i, _ in own], pa.int64())).combine_chunks()
        batch = pa.RecordBatch.from_arrays(
            [
                *[rows[c].combine_chunks() if len(own) else pa.array([], rows[c].type) for c in ("text", "key", "digest")],
                pa.array([[(c & ~top).tobytes()] for _, c in own], pa.list_(pa.binary())),
                pa.array([[(c[c >= top] & ~top).tobytes()] for _, c in own], pa.list_(pa.binary())),
            ],
            names=["text", "key", "digest", "names", "hot"],
        )
        return pa.Table.from_batches(_pieces(n_buckets, length)([batch]), _PIECES)

    return pieces


_PIECES = pa.schema(
    [("bucket", pa.int32()), *[(n, pa.binary()) for n in ("names", "sizes", "pieces", "seen")]]
)


def _kept_of_part(length: int, kind: pa.DataType):
    """``_kept`` of a part's documents and their spans."""

    def kept(docs: pa.Table, spans: pa.Table) -> pa.Table:
        found = _by_document(spans, "<i8", 2)
        keys = docs["key"].to_pylist()
        own = [
            [x.tobytes() for x in found.get((k, d), [])] if k is not None else []
            for k, d in zip(keys, docs["digest"].to_pylist())
        ]
        batch = pa.RecordBatch.from_arrays(
            [
                docs["text"].combine_chunks() if len(keys) else pa.array([], pa.binary()),
                pa.array(keys, pa.int64()).cast(kind),
                pa.nulls(len(keys)),
                pa.array(own, pa.list_(pa.binary())),
            ],
            names=["text", "doc_id", "digest", "spans"],
        )
        return pa.Table.from_batches(list(_kept(length)([batch])))

    return kept


def _kept(length: int):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_buffer() for x in batch.column(0)]
            out = [
                _without(memoryview(t), spans or [])
                for t, spans in zip(texts, batch.column(3).to_pylist())
            ]
            n_removed, n_spans, digest = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array(digest, pa.string()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return kept


def _without(text: memoryview, spans: list[bytes]) -> tuple[int, int, str]:
    digest, at, removed, n_spans = hashlib.sha256(), 0, 0, 0
    pairs = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
    for low, high in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
        if low > at or not n_spans:
            digest.update(text[at:low])
            n_spans += 1
            removed += high - low
            at = high
        elif high > at:
            removed += high - at
            at = high
    digest.update(text[at:])
    return removed, n_spans, digest.hexdigest()


# --- the operator ---------------------------------------------------------------------------


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    hot_texts: int = HOT_TEXTS,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte is removed if a string of ``length`` bytes that covers it also starts in a row with a
    smaller key; strings do not cross rows and are judged on the input. Exact copies of a text are
    recognized by their digest and removed as a whole, so only one of them is searched. Null texts
    count as empty. Rows without an integer key stay whole and remove nothing elsewhere; rows with
    equal keys remove nothing of each other. Other columns are ignored; an empty table gives an
    empty result. Texts are dealt to parts by key and content; a part's texts, about ``BUCKET_BYTES``
    of them, and the names and spans of its documents meet in one task.
    """
    if length < 32:
        raise ValueError("length is too small for the names of windows")
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        own.cast("binary").alias("text"),
        F.col(key).cast("long").alias("key"),
        F.xxhash64(own).alias("digest"),
    )
    narrow = materialize(
        docs.select(
            F.col(key).cast("long").alias("key"), F.xxhash64(own).alias("digest"),
            F.md5(own.cast("binary")).alias("_md5"), F.octet_length(own).cast("long").alias("_n"),
        ).filter("key is not null"),
        "texts",
    )
    total = narrow.agg(F.sum("_n")).first()[0] or 0
    n_buckets = max(1, -(-total // BUCKET_BYTES))
    wide = rows.filter(F.col("key").isNotNull() & (F.octet_length("text") >= length))
    names = wide.mapInArrow(
        _names(n_buckets, length),
        "bucket int, keys binary, digests binary, counts binary, names binary",
    )
    repeated = names.groupBy("bucket").applyInArrow(_repeated(hot_texts, n_buckets), _BY_PART)
    repeated = materialize(repeated, "names")
    dealt = rows.withColumn("part", _part(n_buckets))
    spans = (
        dealt.groupBy("part")
        .cogroup(repeated.groupBy("part"))
        .applyInArrow(
            _pieces_of_part(n_buckets, length),
            "bucket int, names binary, sizes binary, pieces binary, seen binary",
        )
        .groupBy("bucket")
        .applyInArrow(_spans(n_buckets, length), _BY_PART)
    )
    first = narrow.groupBy("_md5").agg(F.min("key").alias("_first"))
    copies = narrow.join(first, "_md5").filter(
        (F.col("key") > F.col("_first")) & (F.col("_n") >= length)
    )
    whole = F.concat(_long_bytes(F.lit(0).cast("long")), _long_bytes(F.col("_n")))
    copies = copies.select("key", "digest", "_n").distinct().select(
        _part(n_buckets).alias("part"),
        _long_bytes(F.col("key")).alias("keys"),
        _long_bytes(F.col("digest")).alias("digests"),
        F.unhex(F.lit("01000000")).alias("counts"),
        whole.alias("values"),
    )
    field = docs.select(key).schema[0].dataType
    return (
        dealt.groupBy("part")
        .cogroup(spans.unionByName(copies).groupBy("part"))
        .applyInArrow(
            _kept_of_part(length, to_arrow_type(field)),
            f"doc_id {field.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        )
    )


def _long_bytes(number: Column) -> Column:
    """The eight bytes of a long, lowest first."""
    text = F.lpad(F.hex(number), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, i, 2) for i in range(15, 0, -2)]))
