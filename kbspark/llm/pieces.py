"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut into units that no piece crosses (white space opens a unit; characters outside the vocabulary are units of their
own). The units not met before are concatenated and indexed by a suffix array over as many characters as the longest piece has. Every piece is
found by binary search as a range of suffixes; each suffix in the range is an edge from its position over the piece. The edges are sorted by
position and relaxed in that order: a piece may follow the best piece that ends where it begins if merging could not have joined them
otherwise. Of the edges into a position exactly one is left, so what reaches the end of a unit is the encoding that the model's merges give.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, extended, fresh

SPACE = "▁"  # stands for a space in pieces
MODEL = "piece_bpe_32k.model"
_CACHE = 300_000  # encoded units that a worker keeps
_UNIT = 48  # longer units are not kept
_DOCS = 1024
_SIEVE = 1 << 22
_ONE = " "


class Model:
    """Vocabulary with the order of merges. Pieces are renumbered: single characters first, then by the order in which merges apply."""

    def __init__(self, path: str):
        import sentencepiece

        raw = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(raw.get_piece_size()) if not (raw.is_control(i) or raw.is_byte(i) or raw.is_unknown(i) or raw.is_unused(i))]
        text = {i: raw.id_to_piece(i) for i in ids}
        score = {i: raw.get_score(i) for i in ids}
        self.bytes = [raw.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.runs = {len(t): i for i, t in text.items() if set(t) == {SPACE}}
        single = [i for i in ids if len(text[i]) == 1]
        merged = sorted((i for i in ids if len(text[i]) > 1 and set(text[i]) != {SPACE}), key=lambda i: (-score[i], i))
        self.ids = np.array(single + merged, dtype=np.int64)
        self.texts = [text[i] for i in self.ids.tolist()]
        self.number = {t: k for k, t in enumerate(self.texts)}
        self.leaves = len(single)
        self.longest = max(map(len, self.texts))
        self.plain = {i: t.replace(SPACE, " ").encode() for i, t in text.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self._letters()
        self._merges()

    def _letters(self) -> None:
        """Characters as small numbers, in the order of their code points; 0 ends a unit."""
        letters = sorted({c for t in self.texts for c in t})
        self.letter = {c: k + 1 for k, c in enumerate(letters)}
        self.bits = (len(letters) + 1).bit_length()
        self.wide = 62 // self.bits  # characters in one sort key
        self.other = re.compile("([^" + "".join(map(re.escape, letters)) + "])")
        self.of_point = np.zeros(ord(letters[-1]) + 1, dtype=np.int64)
        self.of_point[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        rows = np.zeros((len(self.texts), self.longest), dtype=np.int64)
        for k, t in enumerate(self.texts):
            rows[k, : len(t)] = [self.letter[c] for c in t]
        self.rows, self.lengths = rows, np.array([len(t) for t in self.texts], dtype=np.int64)

    def _merges(self) -> None:
        """The last merge of each piece (left, right), and every pair of pieces that joins to a piece."""
        n = len(self.texts)
        self.left, self.right = np.arange(n), np.arange(n)
        self.made = np.ones(n, dtype=bool)
        keys, values = [], []
        for k in range(self.leaves, n):
            t = self.texts[k]
            for cut in range(1, len(t)):
                a, b = self.number.get(t[:cut]), self.number.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    values.append(k)
            found = merge_all(self, t)
            if found is None:
                self.made[k] = False
            else:
                self.left[k], self.right[k] = found
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = np.array(keys, dtype=np.int64)[order], np.array(values, dtype=np.int64)[order]
        self.maybe = np.zeros(_SIEVE, dtype=bool)  # most pairs join to nothing, which a bit of their key tells
        self.maybe[self.pair_keys & (_SIEVE - 1)] = True

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two pieces join to; a number above all pieces if none."""
        key, out = a * len(self.texts) + b, np.full(len(a), 1 << 40)
        some = np.flatnonzero(self.maybe[key & (_SIEVE - 1)])
        at = np.minimum(np.searchsorted(self.pair_keys, key[some]), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == key[some]
        out[some[found]] = self.pair_made[at[found]]
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave piece b after piece a as they are.

        Their last merges are undone, the later one first; a merge across the border that comes before the one undone would have been made.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 30)
        ok, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            bad = self.joined(x, y) < limit[live]
            ok[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            first = x > y  # undo the left piece; else the right one
            leaf_x, leaf_y = x < self.leaves, y < self.leaves
            done = leaf_x & leaf_y
            go_left = (first & ~leaf_x) | leaf_y
            limit[live] = np.where(go_left, x, y + 1)
            a[live] = np.where(go_left, self.right[x], x)
            b[live] = np.where(go_left, y, self.left[y])
            live = live[~done]
        return ok


def merge_all(model: Model, text: str) -> tuple[int, int] | None:
    """The last merge when a text is merged by itself, or None if it does not become one piece."""
    parts, last = [model.number.get(c) for c in text], None
    if None in parts:
        return None
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            k = model.number.get(model.texts[parts[i]] + model.texts[parts[i + 1]])
            if k is not None and (best is None or k < best):
                best, at = k, i
        if best is None:
            return None
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [best]
    return last


@lru_cache(maxsize=1)
def model(path: str) -> Model:
    return Model(path)


@lru_cache(maxsize=4096)
def _run(own: tuple[tuple[int, int], ...], n: int) -> tuple[int, ...]:
    """Ids of n spaces in a row: pairs join from the left while their number is that of a piece."""
    runs = dict(own)
    if n > 4096:  # only the longest piece repeats in so long a run
        most = max(runs)
        return (runs[most],) * ((n - 2048) // most) + _run(own, n - (n - 2048) // most * most)
    parts = [1] * n
    following = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [i for i in range(n - 1)]
    while heap:
        i = heapq.heappop(heap)
        j = following[i] if parts[i] else n
        if j >= n or not parts[i] or parts[i] + parts[j] not in runs:
            continue
        parts[i] += parts[j]
        parts[j] = 0
        following[i] = following[j]
        if following[i] < n:
            before[following[i]] = i
            heapq.heappush(heap, i)
        if before[i] >= 0:
            heapq.heappush(heap, before[i])
    return tuple(runs[p] for p in parts if p)


def _ordered(values: np.ndarray, most: int) -> np.ndarray:
    """The order of small numbers up to ``most``: each is sorted together with its place where both fit one number, which is several times faster."""
    bits = max(len(values) - 1, 1).bit_length()
    if most.bit_length() + bits > 62:
        return np.argsort(values)
    return np.sort((values << bits) | np.arange(len(values))) & ((1 << bits) - 1)


def suffix_array(letters: np.ndarray, bits: int, wide: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of the letters up to the unit's end (at most ``depth``), and the packed first ``wide`` letters of each position.

    Only positions that are equal so far and have not met the end of their unit are sorted further, by the next ``wide`` letters.
    """
    n = len(letters)
    padded = np.concatenate([letters, np.zeros(depth + wide, dtype=np.int64)])
    key = np.zeros(n + depth, dtype=np.int64)
    for k in range(wide):
        key = (key << bits) | padded[k : k + len(key)]
    ends = np.append(np.flatnonzero(letters == 0), n)
    left = np.repeat(ends, np.diff(ends, prepend=-1))[:n] - np.arange(n)  # letters up to the end of the unit
    order = np.argsort(key[:n])
    ranked = key[order]
    first = np.append(True, ranked[1:] != ranked[:-1])  # of the positions that are equal so far
    rank = np.zeros(n + depth, dtype=np.int64)
    rank[order] = np.cumsum(first)
    for start in range(wide, depth, wide):
        place = np.flatnonzero((left[order] >= start) & ~(first & np.append(first[1:], True)))
        if not len(place):
            break
        at, group = order[place], np.cumsum(first[place])
        most = int(group[-1]) * (n + 2) + n
        value = group * (n + 2) + rank[at + start]
        by = _ordered(value, most)
        order[place], value = at[by], value[by]
        first[place[1:]] |= value[1:] != value[:-1]
    return order, key


def occurrences(own: Model, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, piece) of every occurrence of every piece, by binary search in the suffix array."""
    order, key = suffix_array(letters, own.bits, own.wide, own.longest)
    n = len(order)
    low, high = np.zeros(len(own.texts), dtype=np.int64), np.full(len(own.texts), n, dtype=np.int64)
    low[~own.made] = high[~own.made] = 0
    for start in range(0, own.longest, own.wide):
        todo = np.flatnonzero((own.lengths > start) & (low < high))
        part = own.rows[todo, start : start + own.wide]
        width = np.minimum(own.lengths[todo] - start, own.wide)
        least = np.zeros(len(todo), dtype=np.int64)
        for k in range(own.wide):
            least = (least << own.bits) | (part[:, k] if k < part.shape[1] else 0)
        most = least + (np.int64(1) << (own.bits * (own.wide - width))) - 1
        low[todo], high[todo] = (
            _bound(order, key, start, low[todo], high[todo], least, False), _bound(order, key, start, low[todo], high[todo], most, True)
        )
    counts = high - low
    piece = np.repeat(np.arange(len(counts)), counts)
    offsets = np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)
    return order[np.repeat(low, counts) + offsets], piece


def _bound(order: np.ndarray, key: np.ndarray, start: int, low: np.ndarray, high: np.ndarray, value: np.ndarray, after: bool) -> np.ndarray:
    """First place in [low, high) whose letters from ``start`` on are not below ``value`` (or are above it)."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        found = key[order[middle] + start]
        below = found <= value[open_] if after else found < value[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]


def encode_units(own: Model, units: list[str]) -> list[bytes]:
    """Ids of each unit as little-endian unsigned 32-bit numbers; units hold letters of the vocabulary only and none is empty."""
    lengths = np.array([len(u) for u in units], dtype=np.int64)
    points = np.frombuffer("\0".join(units).encode("utf-32-le"), dtype="<u4")
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    letters = own.of_point[points]
    position, piece = occurrences(own, letters)
    offset = np.arange(len(letters)) - np.repeat(starts, np.append(lengths[:-1] + 1, lengths[-1]))
    ends = offset[position] + own.lengths[piece]  # of an edge, in its unit
    by_end = np.argsort(ends.astype(np.uint16) if len(ends) and ends.max() < 1 << 16 else ends, kind="stable")
    position, piece, ends = position[by_end], piece[by_end], ends[by_end]
    best = np.full(len(letters) + 1, -1, dtype=np.int64)  # the last piece of what ends here
    borders = np.searchsorted(ends, np.arange(1, int(lengths.max()) + 2))
    for lo, hi in zip(borders[:-1], borders[1:], strict=True):
        at, p = position[lo:hi], piece[lo:hi]
        opening = offset[at] == 0
        before = best[at]
        good = opening.copy()
        inner = np.flatnonzero(~opening & (before >= 0))
        good[inner] = own.may_follow(before[inner], p[inner])
        best[at[good] + own.lengths[p[good]]] = p[good]
    # back from the ends, all units at once
    at, alive, steps = starts + lengths, np.arange(len(units)), []
    while len(alive):
        last = best[at[alive]]
        steps.append((alive, own.ids[last]))
        at[alive] -= own.lengths[last]
        alive = alive[at[alive] > starts[alive]]
    unit = np.concatenate([s[0] for s in steps])
    ids = np.concatenate([s[1] for s in steps])
    order = np.argsort(unit[::-1], kind="stable")
    order = len(unit) - 1 - order  # the last step is the first piece
    whole = ids[order].astype("<u4").tobytes()
    ends = (4 * np.cumsum(np.bincount(unit, minlength=len(units)))).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    def __init__(self, own: Model):
        self.own = own
        self.known: dict[str, bytes] = {}
        self._runs = tuple(sorted({1: int(own.ids[own.number[SPACE]]), **own.runs}.items()))
        self._space = self.known_bytes([self._runs[0][1]])

    @staticmethod
    def known_bytes(ids) -> bytes:
        return np.asarray(ids, dtype="<u4").tobytes()

    def units(self, text: str) -> tuple[list[str], bool]:
        """Parts of a text, with its dummy space, that no piece crosses: words, each with the space before it, and runs of further spaces.

        The space before a word is not written here. The second value tells whether there are runs.
        """
        words = text.replace(SPACE, _ONE).split(_ONE)
        if "" not in words:
            return words, False
        out, spaces = [], 1
        for i, word in enumerate(words):
            spaces += i > 0
            if word:
                out += [_ONE * (spaces - 1), word] if spaces > 1 else [word]
                spaces = 0
        if spaces:
            out.append(_ONE * spaces)
        return out, True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        known = self.known
        split = [self.units(t) if t else ([], False) for t in texts]
        met = set().union(*[units for units, _ in split])
        new = met.difference(known)
        if len(known) > _CACHE:  # what this batch has stays
            kept = {u: known[u] for u in met - new}
            known.clear()
            known.update(kept)
        whole, parts, local = [], {}, {}
        search = self.own.other.search
        for u in new:
            if u[0] == _ONE:
                local[u] = self.known_bytes(_run(self._runs, len(u)))
            elif search(u) is None:
                whole.append(u)
            else:
                parts[u] = [x for x in self.own.other.split(SPACE + u) if x]
        more = list({x for own in parts.values() for x in own if x[0] in self.own.letter and x != SPACE})
        coded = encode_units(self.own, [SPACE + u for u in whole] + more) if whole or more else []
        local.update(zip(whole, coded))
        of_part = dict(zip(more, coded[len(whole):], strict=True))
        of_part[SPACE] = self._space
        bytes_of = self.own.bytes
        for u, own in parts.items():
            local[u] = b"".join(of_part[x] if x in of_part else self.known_bytes([bytes_of[b] for b in x.encode()]) for x in own)
        known.update(local if max(map(len, local), default=0) <= _UNIT else {u: b for u, b in local.items() if len(u) <= _UNIT})
        out = []
        for units, runs in split:
            if runs:
                out.append(self._with_runs(units, local))
            else:
                try:
                    out.append(b"".join(map(known.__getitem__, units)))
                except KeyError:  # a long unit
                    out.append(b"".join([known[u] if u in known else local[u] for u in units]))
        return out

    def _with_runs(self, units: list[str], local: dict[str, bytes]) -> bytes:
        """A further run of spaces joins the space of the next word if that stayed a piece of its own."""
        known = self.known
        found = [known[u] if u in known else local[u] for u in units]
        for i, u in enumerate(units[:-1]):
            if u[0] == _ONE and (word := found[i + 1]).startswith(self._space):
                found[i], found[i + 1] = self.known_bytes(_run(self._runs, len(u) + 1)), word[4:]
        return b"".join(found)


def decode(own: Model, ids: bytes) -> bytes:
    """UTF-8 of the text that ids stand for, without the space put before it."""
    text = b"".join(map(own.plain.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
    return text[1:] if text[:1] == b" " else text


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = Encoder(model(public_tokenizers.path(name)))
    return _encoders[name]


def with_pieces(docs: DataFrame, text: str, name: str = MODEL, with_ids: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (binary, if asked for), ``n_ids``, ``ids_crc32`` and ``decoded_crc32`` (of the UTF-8 text the ids decode to).

    A null or empty text has no ids. Repeated rows get equal answers; an empty table stays empty. The sign U+2581 is a space to the model, so it
    decodes to one.
    """
    names = fresh(docs, *(["ids"] if with_ids else []), "n_ids", "ids_crc32", "decoded_crc32")
    kinds = [*(["binary"] if with_ids else []), "long", "long", "long"]
    schema, at = extended(docs, **dict(zip(names, kinds, strict=True))), docs.columns.index(text)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(name)
        for batch in batches(source, _DOCS):
            ids = use.encode([x or "" for x in batch.column(at).to_pylist()])
            more = [pa.array(ids, pa.binary())] if with_ids else []
            more += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(zlib.crc32, ids)), pa.int64())]
            more.append(pa.array([zlib.crc32(decode(use.own, x)) for x in ids], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def with_text(docs: DataFrame, ids: str, name: str = MODEL) -> DataFrame:
    """``docs`` with ``decoded``, the text of the binary ids; null ids decode to null, ids that end inside a character to a replacement sign."""
    (out,) = fresh(docs, "decoded")
    schema, at = extended(docs, **{out: "string"}), docs.columns.index(ids)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name).own
        for batch in batches(source, _DOCS):
            texts = [None if x is None else decode(own, x).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)
