"""Near-duplicates by SuperMinHash signatures.

Every shingle of a document's set draws a random permutation of the 128 places of the signature, place after place; the value it offers to the
j-th place drawn is j plus a random fraction. A place keeps the least value offered. Once all places hold values below j, no later draw can
matter and the document is done: long sets stop after a draw or two. The ranks of one shingle are all different, so the places of a signature
are less alike than independent ones and estimate the similarity with less variance.

Documents with one set are one node. Nodes meet in bands of four places; at a similarity of 0.8 all 32 bands miss with a probability of 5e-8.
A band's group is never paired with itself. Its members are first compared with its most shared member, whose links join most of a group of
copies. What is left are members outside the largest component of a group; only these ask the group, in parts of bounded size, for members of
other components whose signatures agree well enough, and a part passes on the links of a forest. All links are confirmed on whole sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_ROWS, batches, materialise, small
from .simhash import components

WORDS = 4  # words of a shingle
PERCENT = 80  # least similarity of a link
PLACES = 128  # of a signature, 16 bits each
ROWS = 4  # places of a band; as 64 bits they are the band's value
BANDS = PLACES // ROWS
# Least number of equal places for a pair to be confirmed: 5 standard deviations below what a similarity of 0.8 gives.
ALIKE = 79
PART, BLOCK = 128, 256  # members of a group that are asked, and that ask, in one task
PART_SHINGLES = 1 << 21  # of all sets on one side
_LINKS_PER_COPY = 256  # links that meet one copy of a set
_SLICE = 1 << 16  # shingles signed at once
_TEXT = 1 << 20  # bytes split into words at once
_HASHED = 150_000  # word hashes that a worker keeps
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]  # splitmix64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLIERS[1]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLIERS[2]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _HASHED:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            self[word] = out
        return out


def _slices(text: bytes) -> Iterator[bytes]:
    low = 0
    while len(text) - low > _TEXT:
        found = _SPACE.search(text, low + _TEXT)
        if found is None:
            break
        yield text[low : found.start()]
        low = found.end()
    yield text[low:]


def shingles(text: bytes, words: dict[bytes, int]) -> np.ndarray:
    """The set of hashed word shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    parts = [np.array([words[w] for w in part.lower().split()], dtype=np.uint64) for part in _slices(text)]
    hashed = np.concatenate(parts)
    if not len(hashed):
        return hashed
    width = min(WORDS, len(hashed))
    n = len(hashed) - width + 1
    out = _mixed(hashed[:n] + np.uint64(width))
    for k in range(1, width):
        out = _mixed(out * _MULTIPLIERS[0] + hashed[k : k + n])
    return np.unique(out)


def offer(least: np.ndarray, elements: np.ndarray, doc: np.ndarray) -> None:
    """Lower the values in ``least`` (a row of places per document) by what the elements of the documents offer."""
    flat, state = least.reshape(-1), elements.copy()
    left = np.tile(np.arange(PLACES, dtype=np.uint8), (len(elements), 1))  # places not drawn yet stand from column j on
    live, active = np.arange(len(elements)), np.arange(len(least))
    for j in range(PLACES):
        # values below j stay whatever comes
        over = np.zeros(len(least), dtype=bool)
        over[active] = least[active].max(axis=1) >= np.uint64(j << 48)
        active = active[over[active]]
        live = live[over[doc[live]]]
        if not len(live):
            return
        state[live] += _MULTIPLIERS[0]
        drawn = _mixed(state[live])
        column = j + ((drawn >> np.uint64(48)) * np.uint64(PLACES - j) >> np.uint64(16)).astype(np.int64)
        place = left[live, column]
        left[live, column] = left[live, j]
        np.minimum.at(flat, doc[live] * PLACES + place, (drawn & np.uint64((1 << 48) - 1)) | np.uint64(j << 48))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit values per set. The signature of an empty set says nothing."""
    least = np.full((len(sets), PLACES), np.uint64((1 << 64) - 1))
    low = 0
    while low < len(sets):
        high, size = low, 0
        while high < len(sets) and (high == low or size + len(sets[high]) <= _SLICE):
            size += len(sets[high])
            high += 1
        doc = np.repeat(np.arange(low, high), [len(s) for s in sets[low:high]])
        elements = np.concatenate(sets[low:high])
        for at in range(0, size, _SLICE):  # a long set is offered slice by slice
            offer(least[low:high], elements[at : at + _SLICE], doc[at : at + _SLICE] - low)
        low = high
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per document: ``row`` (its number), ``key``, ``n`` (shingles), ``high`` and ``low`` (hash of the set), ``signature`` and ``shingles``."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    kind = own.schema["key"].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches(source, 256):
            if not batch.num_rows:
                continue
            sets = [shingles(b"" if t is None else t, words) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            found = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8") for s in sets])
            n = np.array([len(s) for s in sets], dtype=np.int64)
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
            codes = pa.array([s.tobytes() for s in signatures(sets)], pa.binary())
            columns = [batch.column(0), batch.column(1), pa.array(n), pa.array(found[:, 0]), pa.array(found[:, 1]), codes, held]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "n", "high", "low", "signature", "shingles"])

    return own.mapInArrow(run, f"row long, key {kind}, n long, high long, low long, signature binary, shingles array<bigint>")


def _banded(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source, 4096):
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<i8").reshape(-1, BANDS)
            each = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            band = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), band, pa.array(values.reshape(-1))], names=["node", "n", "band", "value"])


def members(nodes: DataFrame) -> DataFrame:
    """Nodes (node, n, signature) in the groups that hold several: (node, n, band, value, size)."""
    all_members = nodes.select("node", "n", "signature").mapInArrow(_banded, "node long, n long, band int, value long")
    met = all_members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return all_members.join(met, ["band", "value"])


def _fits(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def stars(met: DataFrame) -> DataFrame:
    """Each member with the member of its group that meets most others: (src, dst)."""
    shared = met.groupBy("node").agg(F.sum("size").alias("shared"))
    known = met.join(shared, "node")
    centre = known.groupBy("band", "value").agg(F.max(F.struct("shared", "n", (-F.col("node")).alias("low"))).alias("centre"))
    told = centre.select("band", "value", (-F.col("centre.low")).alias("dst"), F.col("centre.n").alias("dst_n"))
    links = met.join(told, ["band", "value"]).where((F.col("node") != F.col("dst")) & _fits(F.col("n"), F.col("dst_n")))
    return links.select(F.col("node").alias("src"), "dst").distinct()


def _with_set(links: DataFrame, column: str, sets: DataFrame, name: str) -> DataFrame:
    """Links with the set of the node in ``column``. The set of a node with many links comes in copies, each for a share of them."""
    per = links.groupBy(column).agg(F.ceil(F.count(F.lit(1)) / _LINKS_PER_COPY).cast("int").alias("copies"))
    many = materialise(per.where("copies > 1"), "many-links").withColumnRenamed(column, "many")
    dealt = links.join(small(many), F.col(column) == F.col("many"), "left")
    dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("src", "dst"), F.coalesce("copies", F.lit(1))).cast("int")).drop("many", "copies")
    linked = sets.join(small(materialise(per, "linked").withColumnRenamed(column, "wanted")), F.col("node") == F.col("wanted"))
    copied = linked.select("wanted", F.col("shingles").alias(name), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("of_copy"))
    return dealt.join(copied, (F.col(column) == F.col("wanted")) & (F.col("copy") == F.col("of_copy"))).drop("wanted", "copy", "of_copy")


def confirmed(links: DataFrame, sets: DataFrame) -> DataFrame:
    """The stored ``links`` (src, dst) whose sets (node, shingles) are similar enough."""
    both = _with_set(_with_set(links, "src", sets, "one"), "dst", sets, "other")
    common = F.size(F.array_intersect("one", "other"))
    return both.where(100 * common >= PERCENT * (F.size("one") + F.size("other") - common)).select("src", "dst")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


class _Forest:
    """Which nodes of a part are joined already."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[self.find(x)] = self.find(y)


def _asked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the asking members and the others of a part and block, those of a forest; in the rows the others come first."""
    key, there, forest = None, None, _Forest()

    def links(here: dict) -> Iterator[tuple[int, int]]:
        for low in range(0, len(here["node"]), 64):
            code = here["code"][low : low + 64]
            alike = (code[:, None, :] == there["code"][None, :, :]).sum(axis=2)
            n = here["n"][low : low + 64, None]
            fits = 100 * np.minimum(n, there["n"]) >= PERCENT * np.maximum(n, there["n"])
            twice = there["asks"] & (there["node"] < here["node"][low : low + 64, None])  # both ask
            ok = (alike >= ALIKE) & fits & ~twice
            for i in np.flatnonzero(ok.any(axis=1)).tolist():
                own, root = here["sets"][low + i], int(here["root"][low + i])
                found = np.flatnonzero(ok[i])
                for j in found[np.argsort(-alike[i, found], kind="stable")].tolist():
                    other = int(there["root"][j])
                    if forest.find(root) == forest.find(other):
                        continue
                    common = _common(own, there["sets"][j])
                    if 100 * common >= PERCENT * (len(own) + len(there["sets"][j]) - common):
                        forest.join(root, other)
                        yield int(here["node"][low + i]), int(there["node"][j])

    for batch in batches(source, 512):
        if not batch.num_rows:
            continue
        numbers = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
        role = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        data = {k: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for k, c in {"node": 4, "n": 5, "root": 6}.items()}
        data["asks"] = batch.column(7).to_numpy(zero_copy_only=False).astype(bool)
        data["code"] = np.frombuffer(b"".join(batch.column(8).to_pylist()), dtype="<u2").reshape(-1, PLACES)
        flat, ends = batch.column(9).flatten().to_numpy(zero_copy_only=False), np.append(0, data["n"].cumsum())
        edges = np.flatnonzero((numbers[1:] != numbers[:-1]).any(axis=1) | (role[1:] != role[:-1])) + 1
        found = []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(role)], strict=True):
            part = {k: v[a:b] for k, v in data.items()}
            part["sets"] = [flat[ends[i] : ends[i + 1]] for i in range(a, b)]
            if tuple(numbers[a].tolist()) != key:
                key, there, forest = tuple(numbers[a].tolist()), None, _Forest()
            if role[a] == 0:
                there = part if there is None else {k: there[k] + part[k] if k == "sets" else np.concatenate([there[k], part[k]]) for k in part}
            elif there is not None:
                found += links(part)
        if found:
            table = np.array(found, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"src": table[:, 0], "dst": table[:, 1]})


def asked(met: DataFrame, roots: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (src, dst) between members of groups that are in different components, enough to join what all of them would.

    Members outside the largest component of a group ask all members of the groups with that component, whichever band they met in. Both sides
    are cut into parts of bounded size, so a large group becomes many tasks and nothing of it is left out.
    """
    rooted = met.join(roots, F.col("node") == F.col("of_node"), "left").select(*met.columns, F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy("band", "value", "root").agg(F.count(F.lit(1)).alias("share"))
    main = split.groupBy("band", "value").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("share", "root")).alias("top")).where("roots > 1")
    open_groups = main.select("band", "value", F.col("top.root").alias("main_root"))
    cluster = rooted.join(open_groups, ["band", "value"]).select("main_root", "node", "n", "root").distinct()
    cluster = materialise(cluster.withColumn("asks", F.col("root") != F.col("main_root")), "open-clusters")

    def parts(rows: Column, shingles: Column, most: int) -> Column:
        return F.greatest(F.ceil(rows / most), F.ceil(shingles / PART_SHINGLES)).cast("int")

    asking = F.col("asks").cast("int")
    sizes = cluster.groupBy("main_root").agg(
        parts(F.count(F.lit(1)), F.sum("n"), PART).alias("parts"), parts(F.sum(asking), F.sum(asking * F.col("n")), BLOCK).alias("blocks")
    )
    sizes = materialise(sizes.withColumnRenamed("main_root", "of_root"), "cluster-sizes")
    placed = cluster.join(small(sizes), F.col("main_root") == F.col("of_root")).join(nodes.select("node", "signature"), "node").join(sets, "node")
    number = F.xxhash64("node")
    there = placed.withColumns({"part": F.pmod(number, F.col("parts")).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    here = placed.where("asks").withColumns({"block": F.pmod(number, F.col("blocks")).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    keys = ["main_root", "part", "block"]
    columns = ["node", "n", "root", "asks", "signature", "shingles"]
    rows = there.select(*keys, F.lit(0).alias("role"), *columns).union(here.select(*keys, F.lit(1).alias("role"), *columns))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "role").mapInArrow(_asked, "src long, dst long").distinct()


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Stored (of_node, root) of all nodes with links, after ``links`` between nodes are added to the components ``roots``."""
    src, dst = roots.select(F.col("of_node").alias("s"), F.col("root").alias("s_root")), roots.select(F.col("of_node").alias("d"), F.col("root").alias("d_root"))
    between = links.join(src, F.col("src") == F.col("s"), "left").join(dst, F.col("dst") == F.col("d"), "left")
    between = between.select(F.coalesce("s_root", "src").alias("src"), F.coalesce("d_root", "dst").alias("dst")).distinct()
    now = materialise(components(between).select(F.col("node").alias("from_root"), F.col("root").alias("to_root")), "new-roots")
    moved = roots.join(now, F.col("root") == F.col("from_root"), "left").select("of_node", F.coalesce("to_root", "root").alias("root"))
    fresh_nodes = now.join(roots, F.col("from_root") == F.col("of_node"), "left_anti").select(F.col("from_root").alias("of_node"), F.col("to_root").alias("root"))
    return materialise(moved.union(fresh_nodes), "roots")


def linked_roots(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Smallest node reachable over links from each node that has one: (of_node, root). ``nodes`` (node, n, signature) and ``rows`` (row,
    shingles, a row per node among others) are stored tables. Sets are read again only for nodes that share a band with another."""
    met = materialise(members(nodes), "band-members")
    wanted = materialise(met.select("node").distinct(), "candidates")
    sets = rows.select(F.col("row").alias("node"), "shingles").join(small(wanted), "node", "left_semi")
    sets = materialise(sets, "candidate-sets")
    links = materialise(stars(met), "star-links")
    first = materialise(confirmed(links, sets), "confirmed")
    roots = materialise(components(first).select(F.col("node").alias("of_node"), "root"), "roots")
    return joined_roots(roots, materialise(asked(met, roots, nodes, sets), "asked-links"))


def membership(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per document: ``key``, ``n_shingles`` and ``component`` (the smallest key reachable over links, its own included).

    Null texts and texts without words are linked with nothing. A null key is the smallest only if all keys of a component are null. Repeated
    rows stay. An empty table gives an empty one; only the two columns are read, so other columns may have any name.
    """
    rows = materialise(signed(docs, key, text), "signatures")
    least = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"))).alias("least")
    grouped = rows.where("n > 0").groupBy("high", "low").agg(F.min("row").alias("node"), least, F.count(F.lit(1)).alias("copies"))
    sets = materialise(grouped, "sets")
    nodes = rows.select(F.col("row").alias("node"), "n", "signature").join(sets.select("node"), "node", "left_semi")
    roots = linked_roots(materialise(nodes, "nodes"), rows)
    rooted = sets.join(roots, F.col("node") == F.col("of_node"), "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = materialise(rooted.drop("least").join(smallest, "root").select("high", "low", "copies", "component"), "set-classes")
    own = rows.select("key", "n", "high", "low")
    empty = own.where("n = 0").select("key", F.col("n").alias("n_shingles"), F.col("key").alias("component"))
    return _joined(own.where("n > 0"), classes).select("key", F.col("n").alias("n_shingles"), F.col("component.key").alias("component")).union(empty)


def _joined(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Each row with the component of its set. A set that over a thousandth of all rows have meets a broadcast: a thousand sets at most."""
    total, count = classes.agg(F.sum("copies"), F.count(F.lit(1))).first()
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(classes), ["high", "low"])
    hot = F.col("copies") > total // 1000
    often = rows.join(F.broadcast(classes.where(hot)), ["high", "low"])
    rest = rows.join(F.broadcast(classes.where(hot).select("high", "low")), ["high", "low"], "left_anti").join(classes.where(~hot), ["high", "low"])
    return often.union(rest)


def near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: ``key``, ``n_shingles``, ``component_id`` and ``kept`` (it has the smallest key of its component); see :func:`membership`."""
    out = membership(docs, key, text)
    return out.select(F.col("key").alias(key), "n_shingles", F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept"))
