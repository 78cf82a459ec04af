"""Alignment of two tokenizers by galloping intersection.

Both tokenizers cut the same bytes; each gives a rising list of byte offsets at which its tokens end. The shorter list drives: every end of it
is sought in the longer list by exponential steps from the place of an earlier end, then by binary search between the last two steps. All ends
of a batch are sought at once: a few far apart from the start of the list, then four times as many, each from the place of the one before it
that is known, and so on down to all.
Ends in both lists cut the tokens into groups; the ranks of two neighbouring common ends differ by the number of tokens on each side, and each
token of one side in a group overlaps the range of the other side's.

How many documents hold a pair of ids is counted over the whole corpus. The pairs of a document meet their counts in two ways: pairs above a
share of all pairs number as many as that share allows and are broadcast; all others are shuffled, and none of these is frequent.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import batches, materialise
from .packing import encoder

A, B = "byte_bpe_50k", "piece_bpe_32k.model"
SPACE = "▁"
HOT_PAIRS = 200_000  # pairs that are broadcast, at most
_STRIDE = 4
_BYTES = 1 << 20  # texts aligned at once
_LINKS = 1 << 20  # links expanded at once
_WIDE = 4096  # links of a group that is expanded by distinct ids
_UNITS = 500_000  # encoded units that a worker keeps
_LONG = 48  # characters of a unit that is kept, at most
_JOINED = 20_000  # units that A encodes at once
_GROUPS = 1 << 16  # groups written at once
# A single space between two others is a boundary of the vocabulary's pattern, so what stands between such spaces can be encoded by itself.
_GAP = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r" \s|\s ")


def _from(longer: np.ndarray, start: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """First place at ``start`` or later whose value is not below ``sought``, by exponential steps and binary search, for all at once."""
    last = len(longer)
    below, above = start - 1, start.copy()
    live = np.flatnonzero((above < last) & (longer[np.minimum(above, last - 1)] < sought))
    step = 1
    while len(live):
        below[live] = above[live]
        above[live] = np.minimum(above[live] + step, last)
        at = above[live]
        live = live[(at < last) & (longer[np.minimum(at, last - 1)] < sought[live])]
        step *= 2
    live = np.flatnonzero(above - below > 1)
    while len(live):
        middle = (above[live] + below[live]) // 2
        less = longer[middle] < sought[live]
        below[live] = np.where(less, middle, below[live])
        above[live] = np.where(less, above[live], middle)
        live = live[above[live] - below[live] > 1]
    return above


def gallop(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each value of the rising list ``shorter``, the place of the first value of ``longer`` that is not below it."""
    n = len(shorter)
    place = np.zeros(n, dtype=np.int64)
    stride, outer = 1, None
    while stride * _STRIDE < n:
        stride *= _STRIDE
    while stride:
        at = np.arange(0, n, stride)
        start = np.zeros(len(at), dtype=np.int64) if outer is None else place[at // outer * outer]
        place[at] = _from(longer, start, shorter[at])
        outer, stride = stride, stride // _STRIDE
    return place


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and in ``b`` of the values that both rising lists have."""
    shorter, longer = (a, b) if len(a) <= len(b) else (b, a)
    if not len(shorter):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = gallop(shorter, longer)
    hit = (place < len(longer)) & (longer[np.minimum(place, len(longer) - 1)] == shorter)
    ranks = np.flatnonzero(hit), place[hit]
    return ranks if len(a) <= len(b) else ranks[::-1]


def _laid(flat: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` of ``many`` values from ``start``, end to end."""
    return flat[np.arange(many.sum()) + np.repeat(start - (many.cumsum() - many), many)]


def _numerals(size: int, end: str) -> np.ndarray:
    """The numbers below ``size`` in decimal with ``end`` behind, eight bytes each, filled up with zero bytes."""
    return np.array([f"{i}{end}" for i in range(size)], dtype="S8").view(np.uint64)


class Tokenizers:
    """Both vocabularies: ids of units of a text, bytes and decimal forms of ids."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece

        with open(public_tokenizers.path(f"{a}.tiktoken"), "rb") as f:
            ranks = [(int(rank), len(base64.b64decode(token))) for token, rank in map(bytes.split, f)]
        self.a_bytes = np.zeros(max(r for r, _ in ranks) + 1, dtype=np.int64)
        self.a_bytes[[r for r, _ in ranks]] = [n for _, n in ranks]
        self.words = encoder(a)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        size = self.pieces.get_piece_size()
        text = [self.pieces.id_to_piece(i) for i in range(size)]
        self.b_tokens = [bytes([int(t[3:5], 16)]) if self.pieces.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(text)]
        self.b_bytes = np.array([len(t) for t in self.b_tokens], dtype=np.int64)
        # A text may be cut before a single space if no piece has a space behind another character.
        self.cut = not any(SPACE in t.lstrip(SPACE) for t in text)
        self.a_decimal = [_numerals(len(self.a_bytes), end) for end in ",|"]
        self.b_decimal = [_numerals(size, end) for end in ",;"]
        self._forget()

    def _forget(self) -> None:
        """No unit is known. The ids of unit k by A are ``many[0][k]`` values of ``ids[0]`` from ``start[0][k]``; by B the same at 1."""
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32)] * 2
        self.start, self.many = [[np.zeros(0, np.int64)] * 2 for _ in range(2)]
        self.whole = np.zeros(0, dtype=bool)

    def _cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units of the texts, the place of each unit in them and the number of units of each text."""
        parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = parts.flatten().dictionary_encode()
        units, place, held = coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.diff(parts.offsets.to_numpy())
        edges = np.concatenate([[0], held.cumsum()])
        # a text without white space beside a space can be cut at all its spaces
        odd = np.array([not (t and self.cut) or t[0] == " " or t[-1] == " " or _RUN.search(t) is not None for t in texts], dtype=bool)
        if odd.any():
            known, pieces = {u: k for k, u in enumerate(units)}, np.split(place, edges[1:-1])
            for i in np.flatnonzero(odd).tolist():
                own = (_GAP.split(texts[i]) if self.cut else [texts[i]]) if texts[i] else []
                pieces[i] = np.array([known.setdefault(u, len(known)) for u in own], dtype=np.int64)
            held, units = np.array([len(x) for x in pieces]), list(known)
            used, place = np.unique(np.concatenate(pieces), return_inverse=True)
            units = [units[k] for k in used.tolist()]
        return units, place, held

    def _by_a(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space+unit by A, end to end, and their number for each unit. Units without white space at their ends or a space inside are
        encoded in one text, which A's pattern cuts before every space."""
        many = np.zeros(len(units), dtype=np.int64)
        plain = [k for k, u in enumerate(units) if u and " " not in u and not u[0].isspace() and not u[-1].isspace()]
        found, order = [], []
        for low in range(0, len(plain), _JOINED):
            at = plain[low : low + _JOINED]
            text = "".join([f" {units[k]}" for k in at])
            ids = np.array(self.words.encode(text), dtype=np.int32)
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            upto = np.searchsorted(self.a_bytes[ids].cumsum(), np.append(np.flatnonzero(raw == 32)[1:], len(raw))) + 1
            many[at] = np.diff(upto, prepend=0)
            found.append(ids)
            order += at
        for k in sorted(set(range(len(units))).difference(plain)) if len(plain) < len(units) else []:
            found.append(np.array(self.words.encode(f" {units[k]}"), dtype=np.int32))
            many[k] = len(found[-1])
            order.append(k)
        ids = np.concatenate([*found, np.zeros(0, np.int32)])
        if len(plain) < len(units):  # into the order of the units
            start = np.zeros(len(units), dtype=np.int64)
            start[order] = many[order].cumsum() - many[order]
            ids = _laid(ids, start, many)
        return ids, many

    def _by_b(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each unit by B, end to end, their number for each unit, and whether they give space+unit again."""
        lists = self.pieces.encode(units, num_threads=1)
        many = np.fromiter(map(len, lists), np.int64, len(units))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, many.sum())
        want = [f" {u}".encode() for u in units]
        length = np.fromiter(map(len, want), np.int64, len(units))
        ends = np.concatenate([[0], self.b_bytes[ids].cumsum()])
        upto = many.cumsum()
        start = ends[upto - many]
        whole = ends[upto] - start == length
        given, wanted = b"".join(map(self.b_tokens.__getitem__, ids.tolist())), b"".join(want)
        if given != wanted and whole.any():
            own = length[whole]
            given, wanted = [
                _laid(np.frombuffer(x, dtype=np.uint8), at[whole], own) for x, at in ((given, start), (wanted, length.cumsum() - length))
            ]
            whole[whole] = ~np.logical_or.reduceat(given != wanted, own.cumsum() - own)
        return ids, many, whole

    def _learn(self, units: list[str]) -> None:
        a, n_a = self._by_a(units)
        b, n_b, whole = self._by_b(units)
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        for i, (ids, many) in enumerate(((a, n_a), (b, n_b))):
            self.start[i] = np.concatenate([self.start[i], len(self.ids[i]) + many.cumsum() - many])
            self.many[i] = np.concatenate([self.many[i], many])
            self.ids[i] = np.concatenate([self.ids[i], ids])
        self.whole = np.concatenate([self.whole, whole])

    def _drop(self, units: list[str]) -> None:
        """Forget the last units that were learned."""
        for u in units:
            del self.known[u]
        left = len(self.known)
        for i in range(2):
            self.start[i], self.many[i] = self.start[i][:left], self.many[i][:left]
            self.ids[i] = self.ids[i][: int(self.many[i].sum())]
        self.whole = self.whole[:left]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Which texts have tokens (they are not empty and B's tokens give them again), and of these the ids by A and by B, end to end, and the
        number of ids of each. Units not met before are encoded together."""
        units, place, held = self._cut(texts)
        unit = np.array([self.known.get(u, -1) for u in units], dtype=np.int64)
        if len(self.known) + int((unit < 0).sum()) > _UNITS:
            self._forget()
            unit[:] = -1
        new = np.flatnonzero(unit < 0).tolist()
        long = [k for k in new if len(units[k]) > _LONG]
        if new:
            new = [k for k in new if len(units[k]) <= _LONG] + long
            unit[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([units[k] for k in new])
        unit = unit[place]
        edges = np.concatenate([[0], held.cumsum()])
        broken = np.concatenate([[0], (~self.whole[unit]).cumsum()])
        has = held > 0
        for i in np.flatnonzero(np.diff(broken[edges])).tolist():  # the pieces of the whole text decide
            own = unit[edges[i] : edges[i + 1]]
            b = _laid(self.ids[1], self.start[1][own], self.many[1][own])
            has[i] = b"".join([self.b_tokens[k] for k in b.tolist()]) == f" {texts[i]}".encode()
        unit, held = unit[np.repeat(has, held)], held[has]
        first = held.cumsum() - held
        ids = [_laid(self.ids[i], self.start[i][unit], self.many[i][unit]) for i in range(2)]
        many = [np.add.reduceat(self.many[i][unit], first) if len(first) else held for i in range(2)]
        self._drop([units[k] for k in long])
        return np.flatnonzero(has), ids, many


@dataclass
class Groups:
    """Groups of consecutive tokens; a row per group. ``doc`` is the number of the text in its batch."""

    a: np.ndarray
    b: np.ndarray
    a_start: np.ndarray
    b_start: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    doc: np.ndarray


def grouped(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, doc_ends: np.ndarray) -> Groups:
    """Cut the tokens of texts laid end to end where tokens of both end. Every text's last end is common."""
    i, j = common_ends(a_ends, b_ends)
    a_start, b_start = np.concatenate([[0], i[:-1] + 1]), np.concatenate([[0], j[:-1] + 1])
    return Groups(a, b, a_start, b_start, i + 1 - a_start, j + 1 - b_start, np.searchsorted(doc_ends, a_ends[i]))


def _written(groups: Groups, low: int, high: int, tokens: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``a1,a2|b1;a3|b2,b3;`` for the groups from ``low`` to ``high``, and where each group ends in them."""
    n_a, n_b = groups.n_a[low:high], groups.n_b[low:high]
    a0, b0 = int(groups.a_start[low]), int(groups.b_start[low])
    a, b = groups.a[a0 : a0 + int(n_a.sum())], groups.b[b0 : b0 + int(n_b.sum())]
    a_upto, b_upto = n_a.cumsum(), n_b.cumsum()
    parts = np.empty(len(a) + len(b), dtype=np.uint64)
    for ids, upto, forms, at in (
        (a, a_upto, tokens.a_decimal, np.arange(len(a)) + np.repeat(b_upto - n_b, n_a)),
        (b, b_upto, tokens.b_decimal, np.arange(len(b)) + np.repeat(a_upto, n_b)),
    ):
        own = forms[0][ids]
        own[upto - 1] = forms[1][ids[upto - 1]]
        parts[at] = own
    text = parts.view(np.uint8)
    used = text != 0
    ends = used.reshape(-1, 8).sum(axis=1).cumsum()[a_upto + b_upto - 1]
    return text[used], ends


def digests(groups: Groups, edges: list[int], tokens: Tokenizers) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text; text k has the groups from ``edges[k]`` to ``edges[k + 1]``."""
    out = [hashlib.sha256() for _ in edges[1:]]
    for low in range(0, edges[-1], _GROUPS):
        high = min(edges[-1], low + _GROUPS)
        text, ends = _written(groups, low, high, tokens)
        upto = [0, *ends.tolist()]
        for k in range(int(groups.doc[low]), int(groups.doc[high - 1]) + 1):
            first, last = max(edges[k], low), min(edges[k + 1], high)
            out[k].update(text[upto[first - low] : upto[last - low] - (last == edges[k + 1])])
    return [x.hexdigest() for x in out]


def linked(groups: Groups, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct linked id pairs of each text: (text number, a * size_b + b, links). All tokens of a group are linked."""
    links = groups.n_a * groups.n_b
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g in np.flatnonzero(links > _WIDE).tolist():
        a, a_times = np.unique(groups.a[groups.a_start[g] : groups.a_start[g] + groups.n_a[g]], return_counts=True)
        b, b_times = np.unique(groups.b[groups.b_start[g] : groups.b_start[g] + groups.n_b[g]], return_counts=True)
        pair = (a.astype(np.int64)[:, None] * size_b + b[None, :]).ravel()
        found.append((np.full(len(pair), groups.doc[g]), pair, (a_times[:, None] * b_times[None, :]).ravel()))
    narrow = np.flatnonzero(links <= _WIDE)
    single = links[narrow] == 1
    one, narrow = narrow[single], narrow[~single]
    if len(one):
        pair = groups.a[groups.a_start[one]].astype(np.int64) * size_b + groups.b[groups.b_start[one]]
        found.append(_summed(groups.doc[one], pair))
    upto = links[narrow].cumsum()
    for at in np.split(narrow, np.flatnonzero(np.diff(upto // _LINKS)) + 1) if len(narrow) else []:
        many = links[at]
        g = np.repeat(at, many)
        inside = np.arange(len(g)) - np.repeat(many.cumsum() - many, many)
        pair = groups.a[groups.a_start[g] + inside // groups.n_b[g]].astype(np.int64) * size_b + groups.b[groups.b_start[g] + inside % groups.n_b[g]]
        found.append(_summed(groups.doc[g], pair))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return found[0] if len(found) == 1 else _summed(*[np.concatenate(x) for x in zip(*found, strict=True)])


def _summed(doc: np.ndarray, pair: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, pair) in order with the sum of ``times``, by default their number."""
    wide = int(pair.max()) + 1
    both = doc.astype(np.int64) * wide + pair
    if times is None:
        both.sort()
    else:
        order = np.argsort(both)
        both, times = both[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    many = np.diff(new, append=len(both)) if times is None else np.add.reduceat(times, new)
    return *np.divmod(both[new], wide), many


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a: str, b: str) -> Tokenizers:
    if (a, b) not in _loaded:
        _loaded[a, b] = Tokenizers(a, b)
    return _loaded[a, b]


def aligned(docs: DataFrame, key: str, text: str, a: str = A, b: str = B) -> DataFrame:
    """A row per document: ``row`` (a number of the row), ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, the distinct
    linked ``pairs`` (a * size of B + b) and the ``times`` each is linked.

    Texts that are null or empty or that B does not give back have no tokens: zeros, an empty digest, no pairs.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    schema = f"row long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<bigint>"

    def chunk(texts: list[str | None], tokens: Tokenizers) -> list[pa.Array]:
        has, (ids_a, ids_b), (n_a, n_b) = tokens.encode([t or "" for t in texts])
        numbers = np.zeros((4, len(texts)), dtype=np.int64)
        digest, offsets = [""] * len(texts), np.zeros(len(texts) + 1, dtype=np.int32)
        pairs = times = np.zeros(0, np.int64)
        if len(has):
            numbers[0, has], numbers[1, has] = n_a, n_b
            a_ends, b_ends = tokens.a_bytes[ids_a].cumsum(), tokens.b_bytes[ids_b].cumsum()
            groups = grouped(ids_a, ids_b, a_ends, b_ends, a_ends[n_a.cumsum() - 1])
            edges = np.searchsorted(groups.doc, np.arange(len(has) + 1))
            numbers[2, has] = np.diff(edges)
            numbers[3, has] = np.add.reduceat(groups.n_a * groups.n_b, edges[:-1])
            for i, x in zip(has.tolist(), digests(groups, edges.tolist(), tokens), strict=True):
                digest[i] = x
            doc, pairs, times = linked(groups, len(tokens.b_bytes))
            held = np.zeros(len(texts), dtype=np.int64)
            held[has] = np.bincount(doc, minlength=len(has))
            offsets[1:] = held.cumsum()
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, pa.int64())) for x in (pairs, times)]
        return [*[pa.array(n) for n in numbers], pa.array(digest, pa.string()), *lists]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizers(a, b)
        names = ["row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        for batch in batches(source, 256):
            texts = batch.column(2).to_pylist()
            low, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= _BYTES or i + 1 == len(texts):
                    part = batch.slice(low, i + 1 - low)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *chunk(texts[low : i + 1], tokens)], names=names)
                    low, size = i + 1, 0

    return own.mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """How many documents of :func:`aligned` hold each pair linked: (pair, n)."""
    return found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def with_counts(found: DataFrame, size_b: int, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Stored rows of :func:`aligned` with ``n_best`` (links whose pair is held by as many documents as any of its A id) and ``count_sum`` (the
    number of documents that hold the pair, summed over links).

    The best count of each A id is a table as large as the vocabulary, and is broadcast.
    """
    counts = materialise(pair_counts(found), "pair-counts")
    a_id = F.floor(F.col("pair") / size_b)
    best = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("most"))
    told = counts.join(F.broadcast(best), a_id == F.col("a_id")).select(F.col("pair").alias("told"), "n", (F.col("n") == F.col("most")).alias("best"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.col("n") > total // hot_pairs  # of numbers with a sum, so many at most are above that share
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    few = F.broadcast(told.where(hot))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    often = links.join(few, F.col("pair") == F.col("told")).groupBy("row").agg(*sums)
    rest = links.join(few.select("told"), F.col("pair") == F.col("told"), "left_anti")
    seldom = rest.join(told.where(~hot), F.col("pair") == F.col("told")).groupBy("row").agg(*sums)
    both = often.union(seldom).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.drop("pairs", "times").join(both.withColumnRenamed("row", "of_row"), F.col("row") == F.col("of_row"), "left")
    return out.drop("row", "of_row").fillna(0, ["n_best", "count_sum"])


def align(docs: DataFrame, key: str, text: str, a: str = A, b: str = B) -> DataFrame:
    """Alignment of every document under the name of ``key``, with the corpus-wide counts of its links.

    Null keys and repeated rows stay rows of their own and count as documents. An empty table gives an empty one. Other columns are not read.
    """
    import public_tokenizers
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b)).get_piece_size()
    found = materialise(aligned(docs, key, text, a, b), "alignment")
    return with_counts(found, size_b).withColumnRenamed("key", key)
