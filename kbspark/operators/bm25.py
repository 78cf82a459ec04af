"""Text search with BM25 and phrase match for a table of queries.

Statistics (rows, lengths, document frequencies) are those of the whole table, filters only restrict candidates.
Scoring keeps a document's tokens together, so a term that occurs in almost every document costs one addition per
document and query inside a task and is never joined or shuffled as postings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import BM25_B, BM25_K1, K_BM25
from ..functions.text import tokens
from ..session import scratch_path, stored
from . import topk

MAX_TERMS = 200_000
ALL = ""  # pseudo term that every document has; carries the table totals


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """Distinct terms of every query with their number of occurrences."""
    return queries.select("query_id", F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(
        F.count(F.lit(1)).cast("double").alias("qtf")
    )


def term_statistics(docs: DataFrame, vocabulary: DataFrame | None = None, text: str = "text", max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, df, dl): document frequency per term, and in the row with the empty term the number of documents and tokens.

    One scan. Only the terms of ``vocabulary`` are counted when it is given: up to ``max_terms`` are broadcast and filter
    the tokens before they are counted, more meet the counted terms, so single tokens are never shuffled.
    """
    # no filter on the tokens: it would be pushed below the projection and tokenise every text twice
    toks = docs.select(tokens(F.col(text)).alias("t"))
    once = F.when(F.size("t") > 0, F.concat(F.array(F.lit(ALL)), F.array_distinct("t")))
    terms = toks.select(F.size("t").alias("n"), F.explode(once).alias("term"))
    wanted = few = None
    if vocabulary is not None:
        wanted = vocabulary.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit(ALL).alias("term")))
        few = topk.bounded_rows(wanted, max_terms + 1, F.length("term"))
    if few is not None:
        terms = terms.join(F.broadcast(docs.sparkSession.createDataFrame([(r["term"],) for r in few], "term string")), "term", "left_semi")
    counts = terms.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term") == ALL, F.col("n"))).alias("dl")
    )
    return counts.join(wanted, "term", "left_semi") if wanted is not None and few is None else counts


def idf(n, df):
    """ln(1 + (N - df + 0.5) / (df + 0.5)) as a column or a number."""
    if isinstance(n, (int, float)):
        return np.log(1.0 + (n - df + 0.5) / (df + 0.5))
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


# --- kernel inputs -------------------------------------------------------------------------------------------


class Pack:
    """Queries of one key as a term index: for every vocabulary term the queries that hold it and their weights."""

    def __init__(self, term_lists: list[list[str]], weight_lists: list[list[float]], k1b: tuple[float, float]):
        terms = sorted({t for ts in term_lists for t in ts})
        code = {t: i for i, t in enumerate(terms)}
        triples = sorted(
            (code[t], q, w) for q, (ts, ws) in enumerate(zip(term_lists, weight_lists)) for t, w in zip(ts, ws)
        )
        self.vocabulary = terms
        self.n = len(term_lists)
        self.query = np.array([q for _, q, _ in triples], dtype=np.int64)
        self.weight = np.array([w for _, _, w in triples])
        counts = np.bincount([c for c, _, _ in triples], minlength=len(terms)) if triples else np.zeros(len(terms), dtype=int)
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.base, self.slope = k1b  # tf / (tf + base + slope * dl)

    def only(self, queries: np.ndarray) -> Pack:
        """The same vocabulary with some of the queries, numbered anew."""
        number = np.full(self.n, -1)
        number[queries] = np.arange(len(queries))
        kept = number[self.query] >= 0
        out = object.__new__(Pack)
        out.vocabulary, out.n, out.base, out.slope = self.vocabulary, len(queries), self.base, self.slope
        out.query, out.weight = number[self.query[kept]], self.weight[kept]
        out.start = np.concatenate([[0], np.cumsum(kept)])[self.start].astype(np.int64)
        return out


class Docs:
    """Token lists of a batch as one flat array with offsets."""

    def __init__(self, flat: pa.Array, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _load_arrow(batch: pa.RecordBatch) -> Docs:
    column = batch.column("tokens")
    return Docs(column.flatten(), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))


def _take(docs: Docs, part: np.ndarray) -> Docs:
    if len(part) == len(docs.lengths):
        return docs
    if len(part) and part[-1] - part[0] + 1 == len(part):
        lo, hi = docs.offsets[part[0]], docs.offsets[part[-1] + 1]
        return Docs(docs.flat.slice(lo, hi - lo), docs.lengths[part])
    lengths = docs.lengths[part]
    index = np.repeat(docs.offsets[part] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    return Docs(docs.flat.take(pa.array(index)), lengths)


def _codes(vocabulary: list[str], flat: pa.Array) -> np.ndarray:
    found = pc.index_in(flat, value_set=pa.array(vocabulary, pa.string()))
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _scores(pack: Pack, docs: Docs) -> np.ndarray:
    """BM25 of every query and document of the batch; -inf where no term matches."""
    n_docs, width = len(docs.lengths), max(1, len(pack.vocabulary))
    codes = _codes(pack.vocabulary, docs.flat)
    doc_of = np.repeat(np.arange(n_docs), docs.lengths)
    hit = codes >= 0
    pair, tf = np.unique(doc_of[hit] * width + codes[hit], return_counts=True)
    return accumulate(pack, pair // width, pair % width, tf, docs.lengths)


def accumulate(pack: Pack, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """BM25 of every query and document from postings (document, term of the pack, occurrences); -inf where no term matches."""
    n_docs = len(lengths)
    saturation = tf / (tf + pack.base + pack.slope * lengths[doc])
    out = np.zeros(pack.n * n_docs)
    fan = pack.start[term + 1] - pack.start[term]
    # expand (doc, term) to the queries of the term, a bounded slice at a time
    edges = np.concatenate([[0], np.cumsum(fan)])
    lo = 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + topk.MAX_CELLS, side="right")) - 1)
        f = fan[lo:hi]
        slots = np.repeat(pack.start[term[lo:hi]] - np.concatenate([[0], np.cumsum(f)[:-1]]), f) + np.arange(f.sum())
        cell = pack.query[slots] * n_docs + np.repeat(doc[lo:hi], f)
        out += np.bincount(cell, weights=pack.weight[slots] * np.repeat(saturation[lo:hi], f), minlength=len(out))
        lo = hi
    out = np.round(out, 6).reshape(pack.n, n_docs)
    out[out <= 0] = -np.inf
    return out


class PhrasePack:
    """Queries as token sequences; the rarest token of each one is its anchor."""

    def __init__(self, sequences: list[list[str]], weights: list[float], df: dict[str, float], k1b: tuple[float, float]):
        terms = sorted({t for s in sequences for t in s})
        code = {t: i for i, t in enumerate(terms)}
        self.vocabulary = terms
        self.sequences = [np.array([code[t] for t in s], dtype=np.int64) for s in sequences]
        self.anchors = [int(np.argmin([df.get(t, 0.0) for t in s])) if s else 0 for s in sequences]
        self.weights = weights
        self.base, self.slope = k1b


def phrase_frequencies(pack: PhrasePack, docs: Docs) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the documents that hold the phrase and how often."""
    codes = _codes(pack.vocabulary, docs.flat)
    doc_of = np.repeat(np.arange(len(docs.lengths)), docs.lengths)
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    out = []
    for seq, anchor in zip(pack.sequences, pack.anchors):
        if len(seq) == 0:
            out.append((np.empty(0, dtype=np.int64), np.empty(0)))
            continue
        lo, hi = np.searchsorted(ordered, [seq[anchor], seq[anchor] + 1])
        start = order[lo:hi] - anchor
        start = start[(start >= 0) & (start + len(seq) <= len(codes))]
        for i, term in enumerate(seq):
            start = start[codes[start + i] == term]
            if len(start) == 0:
                break
        start = start[doc_of[start] == doc_of[start + len(seq) - 1]] if len(start) else start
        docs_hit, freq = np.unique(doc_of[start], return_counts=True)
        out.append((docs_hit, freq.astype(float)))
    return out


def _phrase_scores(pack: PhrasePack, docs: Docs) -> np.ndarray:
    out = np.full((len(pack.sequences), len(docs.lengths)), -np.inf)
    for q, (doc, freq) in enumerate(phrase_frequencies(pack, docs)):
        if len(doc):
            out[q, doc] = np.round(pack.weights[q] * freq / (freq + pack.base + pack.slope * docs.lengths[doc]), 6)
    return out


@F.arrow_udf(T.DoubleType())
def pair_score(tokens: pa.Array, terms: pa.Array, weights: pa.Array, average: pa.Array) -> pa.Array:
    """BM25 of a query and one text in the same row, for short lists of candidates; all rows of a batch at once."""
    n = len(tokens)
    lengths = _sizes(tokens)
    per_row = _sizes(terms)
    flat, asked = tokens.flatten(), terms.flatten()
    coded = pa.chunked_array([flat.cast(pa.string()), asked.cast(pa.string())]).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(coded.dictionary))
    held, tf = np.unique(np.repeat(np.arange(n), lengths) * width + codes[: len(flat)], return_counts=True)
    row = np.repeat(np.arange(n), per_row)
    wanted = row * width + codes[len(flat) :]
    at = np.minimum(np.searchsorted(held, wanted), max(0, len(held) - 1))
    found = np.where(held[at] == wanted, tf[at], 0) if len(held) else np.zeros(len(wanted), dtype=np.int64)
    mean = pc.fill_null(average, 1.0).to_numpy(zero_copy_only=False).astype(float)
    norm = BM25_K1 * (1 - BM25_B) + BM25_K1 * BM25_B / np.where(mean > 0, mean, 1.0) * lengths
    part = weights.flatten().to_numpy(zero_copy_only=False).astype(float) * found / (found + norm[row])
    return pa.array(np.bincount(row, weights=part, minlength=n))


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def phrase_frequency(tokens: Column, phrase: Column) -> Column:
    """How often a token array holds another one in a row; occurrences may overlap, as in the phrase search. An empty phrase never occurs."""
    n, m = F.size(tokens), F.size(phrase)
    starts = F.filter(F.sequence(F.lit(1), n - m + 1), lambda i: (F.get(tokens, i - 1) == F.get(phrase, F.lit(0))) & (F.slice(tokens, i, m) == phrase))
    return F.when((m > 0) & (n >= m), F.size(starts)).otherwise(0).cast("double")


def _shape(total_docs: float, total_tokens: float) -> tuple[float, float]:
    average = total_tokens / max(total_docs, 1)
    return BM25_K1 * (1 - BM25_B), BM25_K1 * BM25_B / max(average, 1e-9)


# --- search --------------------------------------------------------------------------------------------------


def search(
    queries: DataFrame,
    docs: DataFrame,
    by: tuple[str, ...] = (),
    k: int = K_BM25,
    phrase: bool = False,
    statistics: DataFrame | None = None,
    max_queries: int = topk.MAX_QUERIES,
    max_terms: int = MAX_TERMS,
) -> DataFrame:
    """The ``k`` best documents per query; any query term may match, or with ``phrase`` all of them in a row.

    ``queries``: query_id, text, ``by``, optionally ``k``. ``docs``: doc_id, text, ``by``. ``statistics`` may be a
    stored result of :func:`term_statistics`.
    """
    kcol = F.col("k").cast("int") if "k" in queries.columns else F.lit(k)
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), kcol.alias("k"), topk.key_column(by).alias("_key"), "text", *by)
    q = q.groupBy("query_id", "_key", *by).agg(F.min("text").alias("text"), F.max("k").alias("k")).withColumn("terms", tokens(F.col("text"))).drop("text")
    rows = topk.matching(docs, q, by).select("doc_id", topk.key_column(by).alias("_key"), tokens(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"))
    q = q.drop(*by)
    id_type = topk.id_type_of(docs)
    vocabulary = q.select(F.explode("terms").alias("term")).distinct()
    stats = statistics if statistics is not None else term_statistics(docs, vocabulary)
    small = topk.bounded_rows(q, max_queries, F.size("terms"))
    if small is not None and len({t for r in small for t in r["terms"]}) <= max_terms:
        if statistics is not None:
            stats = stats.join(vocabulary.unionByName(docs.sparkSession.range(1).select(F.lit(ALL).alias("term"))), "term", "left_semi")
        known = {r["term"]: r for r in stats.collect()}  # at most max_terms + 1 rows
        if ALL not in known:
            known[ALL] = {"df": 0, "dl": 0}
        n, df = float(known[ALL]["df"]), {t: float(r["df"]) for t, r in known.items() if t != ALL}
        k1b = _shape(n, float(known[ALL]["dl"] or 0))
        packs = {}
        for key in {r["_key"] for r in small}:
            mine = [r for r in small if r["_key"] == key]
            if phrase:
                pack = PhrasePack([r["terms"] for r in mine], [sum(idf(n, df.get(t, 0.0)) for t in r["terms"]) for r in mine], df, k1b)
            else:
                counted = [pd.Series(r["terms"], dtype=object).value_counts() if r["terms"] else pd.Series(dtype=float) for r in mine]
                kept = [[(t, c * idf(n, df[t])) for t, c in cs.items() if t in df] for cs in counted]
                pack = Pack([[t for t, _ in ts] for ts in kept], [[w for _, w in ts] for ts in kept], k1b)
            packs[key] = (np.array([r["query_id"] for r in mine], dtype=object), np.array([r["k"] for r in mine]), pack)
        local = topk.scan_topk(rows, packs, _load_arrow, _take, _phrase_scores if phrase else _scores, id_type)
    else:
        local = _search_blocks(q, rows, stats, phrase, id_type)
    return topk.merge_topk(local).select("query_id", "doc_id", F.col("value").alias("score"), "rank")


def _search_blocks(q: DataFrame, rows: DataFrame, stats: DataFrame, phrase: bool, id_type: str) -> DataFrame:
    """Many queries: weights are joined by term, then block pairs of queries and documents meet."""
    stats = stored(stats, scratch_path(rows.sparkSession, "statistics"))
    totals = stats.where(F.col("term") == ALL).select("df", "dl")
    n = totals.select(F.col("df").cast("double")).scalar()
    average = totals.select(F.col("dl") / F.col("df")).scalar()
    positions = q.select("query_id", "_key", F.posexplode("terms").alias("pos", "term"))
    weighted = positions.join(stats.where(F.col("term") != ALL).select("term", "df"), "term", "left")
    weighted = weighted.withColumns({"df": F.coalesce(F.col("df"), F.lit(0)).cast("double"), "n": n}).withColumn("idf", idf(F.col("n"), F.col("df")))
    per_query = weighted.groupBy("query_id", "_key").agg(
        F.sort_array(F.collect_list(F.struct("pos", "term", "idf", "df"))).alias("t")
    )
    ready = q.select("query_id", "_key", "k").join(per_query, ["query_id", "_key"]).select(
        "query_id", "_key", "k", F.col("t.term").alias("terms"), F.col("t.idf").alias("weights"), F.col("t.df").alias("dfs"), average.alias("average")
    )

    def pack(frame: pd.DataFrame):
        average_length = float(frame["average"].iloc[0] or 1.0)
        k1b = (BM25_K1 * (1 - BM25_B), BM25_K1 * BM25_B / average_length)
        if phrase:
            df = {t: d for ts, ds in zip(frame["terms"], frame["dfs"]) for t, d in zip(ts, ds)}
            return PhrasePack([list(t) for t in frame["terms"]], [float(np.sum(w)) for w in frame["weights"]], df, k1b)
        term_lists, weight_lists = [], []
        for ts, ws, ds in zip(frame["terms"], frame["weights"], frame["dfs"]):
            sums: dict[str, float] = {}
            for t, w, d in zip(ts, ws, ds):
                if d > 0:
                    sums[t] = sums.get(t, 0.0) + float(w)
            term_lists.append(list(sums))
            weight_lists.append(list(sums.values()))
        return Pack(term_lists, weight_lists, k1b)

    return topk.block_topk(rows.withColumn("_size", F.size("tokens")), ready.withColumn("_size", F.size("terms")), pack, _load_arrow, _take, _phrase_scores if phrase else _scores, id_type)
