"""Lexical retrieval: inverted index, term statistics and BM25 with phrase, all-term and any-term queries.

Documents stay where they are: every task indexes its own in shards, evaluates a block of queries against each shard
and hands on the best hits, so no posting list of a frequent word is ever joined or shuffled. Statistics of the whole
index (document counts of terms and phrases) come from a pass before.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.config import LexicalConfig
from folioflow.functions.best import Best, joined, packed_schema
from folioflow.functions.lineage import settle, spread

TOKEN = "[\\p{L}\\p{N}]+"


def _latin_folding() -> tuple[str, str]:
    """Latin letters with diacritics and their plain letters."""
    pairs = []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c)).lower()
        if len(plain) == 1 and plain.isascii() and plain != chr(cp):
            pairs.append((chr(cp), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


LATIN_FROM, LATIN_TO = _latin_folding()


def tokens(text: Column | str) -> Column:
    """Index tokens: letters and digits, lower case, Latin letters without diacritics."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.translate(c, LATIN_FROM, LATIN_TO)), F.lit(TOKEN), F.lit(0))


@dataclass(frozen=True)
class Index:
    """tokens of each document, its postings and the statistics of its terms."""

    docs: DataFrame  # doc_id, tokens, dl
    postings: DataFrame  # term, doc_id, tf, dl
    terms: DataFrame  # term, df
    totals: DataFrame  # n_docs, avg_dl (one row)
    settled: bool = False  # docs are written


def build_index(df: DataFrame, key: str, text: str) -> Index:
    """Index of the texts; null texts count as documents without terms."""
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(tokens(text), F.array().cast("array<string>")).alias("tokens"))
    docs = docs.withColumn("dl", F.size("tokens").cast("long"))
    postings = docs.select("doc_id", "dl", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    totals = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    return Index(docs, postings, terms, totals)


def written(index: Index) -> Index:
    """The index with its documents written once to the shared folder, for searches that read it several times."""
    if index.settled:
        return index
    docs = settle(spread(index.docs))
    return Index(docs, index.postings, index.terms, docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl")), True)


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """key, tokens (in order, repeats kept) and terms (distinct, in order of first use) of queries with any."""
    rows = queries.select(F.col(key).alias("query_id"), tokens(text).alias("q_tokens"))
    return rows.withColumn("q_terms", F.array_distinct("q_tokens")).where("size(q_terms) > 0")


def idf(n: float, df: np.ndarray, config: LexicalConfig) -> np.ndarray:
    raw = np.log((n - df + 0.5) / (df + 0.5))
    return np.where(raw <= 0, config.least_idf, raw)


def any_terms(terms: list[str], config: LexicalConfig) -> list[str]:
    """Terms of an any-term query: without stopwords and single characters, unless nothing is left."""
    return [t for t in terms if t not in config.stopwords and len(t) > 1] or terms


PHRASE, ALL, ANY = 0, 1, 2
MODES = ("phrase", "all_terms", "any_terms")
QUERY_STEP = 1000  # queries whose hits in a shard are held at once


class Ragged:
    """Lists of numbers in one array."""

    def __init__(self, flat: np.ndarray, off: np.ndarray) -> None:
        self.flat, self.off = flat, off

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.off[k] : self.off[k + 1]]

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self[k] for k in range(len(self.off) - 1))


class Batch:
    """A block of queries as term numbers, what every worker needs to evaluate them."""

    def __init__(self, rows: pa.Table, config: LexicalConfig) -> None:
        """rows: query_id, q_tokens, q_terms (distinct)"""
        self.config = config
        self.ids = _one(rows.column("query_id"))
        listed = [_one(rows.column(c)) for c in ("q_tokens", "q_terms")]
        names = listed[1].flatten().unique()
        self.names = names.take(pc.sort_indices(names)).cast(pa.string())
        self.tokens, self.terms = (
            Ragged(pc.index_in(x.flatten(), value_set=self.names).to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))]) for x in listed
        )
        # As any_terms, for all queries at once.
        asked = np.array([t not in config.stopwords and len(t) > 1 for t in self.names.to_pylist()], bool)[self.terms.flat]
        size = np.diff(self.terms.off)
        own = np.repeat(np.arange(len(size)), size)
        kept = asked | (np.bincount(own[asked], minlength=len(size)) == 0)[own]
        self.any = Ragged(self.terms.flat[kept], np.r_[0, np.cumsum(np.bincount(own[kept], minlength=len(size)))])
        self.modes: list[int | None] = [None] * len(self.ids)
        self.weights = np.zeros(len(self.names))
        self.phrase_weights = np.zeros(len(self.ids))
        self.average = 1.0


class Shard:
    """Some documents, indexed by the terms of a batch of queries: postings and positions by term."""

    def __init__(self, docs: pa.Table, batch: Batch) -> None:
        self.ids = _one(docs.column("doc_id"))
        listed = _one(docs.column("tokens"))
        self.n = len(self.ids)
        off = listed.offsets.to_numpy()
        self.off = (off - off[0]).astype(np.int64)
        found = pc.index_in(listed.flatten(), value_set=batch.names)
        self.term_at = found.fill_null(-1).to_numpy(zero_copy_only=False)
        self.doc_at = np.repeat(np.arange(self.n), np.diff(self.off))
        self.size = np.diff(self.off).astype(np.float64)
        known = np.flatnonzero(self.term_at >= 0)
        self.places = known[np.argsort(self.term_at[known], kind="stable")]  # by term, then in order
        v = np.arange(len(batch.names) + 1)
        self.place_off = np.searchsorted(self.term_at[self.places], v)
        key, self.tf = np.unique(self.term_at[known].astype(np.int64) * max(1, self.n) + self.doc_at[known], return_counts=True)
        self.docs = key % max(1, self.n)
        self.posting_off = np.searchsorted(key // max(1, self.n), v)
        self.df = np.diff(self.posting_off)
        config = batch.config
        self.length = config.k1 * (1 - config.b + config.b * self.size / batch.average)
        self.gain = -np.repeat(batch.weights, self.df) * self.tf * (config.k1 + 1) / (self.tf + self.length[self.docs])
        self._order: np.ndarray | None = None

    def holding_all(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold all terms, and their scores: the rarest term's list is thinned by one list after another."""
        none = np.zeros(0, np.int64)
        if not len(terms) or not self.df[terms].all():
            return none, np.zeros(0)
        docs, score = None, None
        for t in terms[np.argsort(self.df[terms], kind="stable")]:
            a, b = self.posting_off[t], self.posting_off[t + 1]
            if docs is None:
                docs, score = self.docs[a:b], self.gain[a:b]
                continue
            at = np.minimum(np.searchsorted(self.docs[a:b], docs), b - a - 1)
            same = self.docs[a:b][at] == docs
            docs, score = docs[same], score[same] + self.gain[a:b][at[same]]
            if not len(docs):
                return none, np.zeros(0)
        return docs, score

    def holding_any(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score = np.zeros(self.n)
        for t in terms:
            a, b = self.posting_off[t], self.posting_off[t + 1]
            score[self.docs[a:b]] += self.gain[a:b]
        docs = np.flatnonzero(score)
        return docs, score[docs]

    def holding_phrase(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents in which the tokens follow one another, and how often: the places of the rarest token are thinned."""
        none = np.zeros(0, np.int64)
        counts = np.diff(self.place_off)[tokens]
        if not len(tokens) or not counts.all():
            return none, none
        order = np.argsort(counts, kind="stable")
        first = int(order[0])
        anchor = self.places[self.place_off[tokens[first]] : self.place_off[tokens[first] + 1]]
        doc = self.doc_at[anchor]
        start = anchor - first
        inside = (start >= self.off[doc]) & (start + len(tokens) <= self.off[doc + 1])
        start, doc = start[inside], doc[inside]
        for k in order[1:]:
            same = self.term_at[start + k] == tokens[k]
            start, doc = start[same], doc[same]
            if not len(start):
                return none, none
        return np.unique(doc, return_counts=True)

    def scored(self, batch: Batch, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that answer query k in its mode, and their scores."""
        if batch.modes[k] == PHRASE:
            found, tf = self.holding_phrase(batch.tokens[k])
            return found, -batch.phrase_weights[k] * tf * (batch.config.k1 + 1) / (tf + self.length[found])
        return self.holding_all(batch.terms[k]) if batch.modes[k] == ALL else self.holding_any(batch.any[k])

    def best(self, docs: np.ndarray, score: np.ndarray, limit: int | None) -> tuple[np.ndarray, np.ndarray]:
        """At most ``limit`` documents in the order of ``ranked``."""
        if limit is None or len(docs) <= limit:
            return docs, score
        # Only what may be among the best at nine decimals is rounded.
        near = np.flatnonzero(score <= np.partition(score, limit - 1)[limit - 1] + 2e-9)
        if self._order is None:
            self._order = np.empty(self.n, np.int64)
            self._order[pc.sort_indices(self.ids).to_numpy()] = np.arange(self.n)
        kept = near[np.lexsort((self._order[docs[near]], np.round(score[near], 9)))[:limit]]
        return docs[kept], score[kept]


def _one(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def shards(batches: Iterator[pa.RecordBatch], batch: Batch) -> Iterator[Shard]:
    """Documents of a partition in shards of about ``shard_tokens`` tokens; a longer document stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for part in batches:
        total = np.cumsum(pc.list_value_length(part.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < part.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + batch.config.shard_tokens - size, "right")))
            held.append(part.slice(start, end - start))
            size += int(total[end - 1] - base)
            start = end
            if size >= batch.config.shard_tokens or start < part.num_rows:
                yield Shard(pa.Table.from_batches(held), batch)
                held, size = [], 0
    if held:
        yield Shard(pa.Table.from_batches(held), batch)


def _counts(docs: DataFrame, batch: Batch, want: tuple[bool, bool, bool]) -> list[np.ndarray]:
    """Over all documents: df of every term and, if wanted, documents that hold each query's phrase and all its terms.
    Sums leave every task, so what is collected is as large as the batch of queries."""
    shared = docs.sparkSession.sparkContext.broadcast(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        sums = [np.zeros(len(asked.names), np.int64), np.zeros(len(asked.ids), np.int64), np.zeros(len(asked.ids), np.int64)]
        for shard in shards(batches, asked):
            sums[0] += shard.df
            for k in range(len(asked.ids)):
                if want[1] and len(asked.terms[k]) > 1:
                    sums[1][k] += len(shard.holding_phrase(asked.tokens[k])[0])
                if want[2]:
                    sums[2][k] += len(shard.holding_all(asked.terms[k])[0])
        for kind, n in enumerate(sums):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), pa.array(n[at])], names=["kind", "at", "n"])

    found = docs.select("doc_id", "tokens").mapInArrow(run, "kind long, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toArrow()
    out = [np.zeros(len(batch.names)), np.zeros(len(batch.ids)), np.zeros(len(batch.ids))]
    for kind in range(3):
        mine = found.filter(pc.equal(found["kind"], kind))
        out[kind][mine["at"].to_numpy()] = mine["n"].to_numpy()
    return out


def _evaluated(docs: DataFrame, batch: Batch, limit: int | None, id_field: T.StructField) -> DataFrame:
    """query_id, doc_id, score, mode of the best ``limit`` documents of each query and shard."""
    shared = docs.sparkSession.sparkContext.broadcast(batch)
    schema = T.StructType([id_field, docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("mode", T.StringType())])
    kind = to_arrow_type(id_field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for shard in shards(batches, asked):
            rows, docs_, scores, modes = [], [], [], []
            for k, mode in enumerate(asked.modes):
                if mode is None:
                    continue
                found, score = shard.scored(asked, k)
                if not len(found):
                    continue
                found, score = shard.best(found, score, limit)
                rows.append(np.full(len(found), k))
                docs_.append(found)
                scores.append(score)
                modes.append(np.full(len(found), mode, np.int32))
            if rows:
                at = pa.array(np.concatenate(rows))
                named = pa.array(MODES).take(pa.array(np.concatenate(modes)))
                yield pa.RecordBatch.from_arrays(
                    [asked.ids.cast(kind).take(at), shard.ids.take(pa.array(np.concatenate(docs_))), pa.array(np.concatenate(scores)), named], names=schema.names
                )

    return docs.select("doc_id", "tokens").mapInArrow(run, schema)


def _batches(queries: DataFrame, config: LexicalConfig) -> Iterator[Batch]:
    """The queries in blocks of about ``query_block`` queries and ``token_block`` tokens, so what a worker gets is
    bounded; repeated rows count once."""
    asked = queries.select("query_id", "q_tokens", "q_terms").distinct()
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("q_tokens")), F.lit(0))).collect()[0]
    blocks = max(1, math.ceil(n / config.query_block), math.ceil(size / config.token_block))
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = mine.toArrow()
        if rows.num_rows:
            yield Batch(rows.take(pc.sort_indices(rows.column("query_id"))), config)


def _asked(index: Index, queries: DataFrame, mode: str, config: LexicalConfig) -> Iterator[Batch]:
    """Blocks of the queries with the weights and modes that the whole index gives them."""
    docs = index.docs
    n_docs, average = index.totals.select("n_docs", "avg_dl").collect()[0]
    for batch in _batches(settle(queries), config):
        batch.average = average or 1.0
        df, phrases, every = _counts(docs, batch, (True, mode in ("auto", "phrase"), mode == "auto"))
        batch.weights = idf(n_docs, df, config)
        batch.phrase_weights = idf(n_docs, phrases, config)
        for k, terms in enumerate(batch.terms):
            if mode == "auto":
                batch.modes[k] = PHRASE if phrases[k] else ALL if every[k] else ANY
            elif mode == "phrase" and len(terms) == 1:  # a single term repeated is no phrase of several terms
                batch.modes[k] = PHRASE
                batch.phrase_weights[k] = batch.weights[terms[0]]
            else:
                batch.modes[k] = MODES.index(mode)
        yield batch


def search(index: Index, queries: DataFrame, mode: str = "auto", limit: int | None = None, config: LexicalConfig = LexicalConfig()) -> DataFrame:
    """query_id, doc_id, score, mode of the documents that answer each query.

    mode: phrase (the tokens follow one another; the phrase scores as one term), all_terms, any_terms or auto: phrase
    for queries of several terms, else all terms, else any, the first that any document of the whole index answers.
    ``limit``: of each query at most so many of the best hits leave a shard, so ``ranked`` with this limit is exact;
    None keeps all.

    The documents are read where they are, in shards that each task indexes by the terms asked for; the queries come to
    them in blocks. Only sums by term and query and the best hits of each shard are shuffled. Empty queries have no
    hits.
    """
    index = written(index)
    docs = index.docs
    out = None
    for batch in _asked(index, queries, mode, config):
        found = _evaluated(docs, batch, limit, queries.schema["query_id"])
        out = found if out is None else out.unionByName(found)
    if out is None:
        empty = T.StructType([queries.schema["query_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("mode", T.StringType())])
        return docs.sparkSession.createDataFrame([], empty)
    return out


def top_lists(index: Index, queries: DataFrame, mode: str, limit: int, config: LexicalConfig = LexicalConfig()) -> DataFrame | None:
    """query_id, ids and scores of the ``limit`` best documents of each query in the order of ``ranked``; None without
    queries. As ``search``, but every task keeps the best of all its shards and hands on one row per query."""
    index = written(index)
    docs, id_field = index.docs, queries.schema["query_id"]
    schema, kind = packed_schema(id_field, docs.schema["doc_id"].dataType), to_arrow_type(id_field.dataType)
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    out = None
    for batch in _asked(index, queries, mode, config):
        shared = docs.sparkSession.sparkContext.broadcast(batch)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, best = shared.value, Best(limit)
            for shard in shards(batches, asked):
                base = best.documents(shard.ids)
                for s in range(0, len(asked.ids), QUERY_STEP):
                    own = np.arange(s, min(s + QUERY_STEP, len(asked.ids)))
                    worst = best.worst(s, own) + 2e-9
                    found = []
                    for k in own:
                        at, score = shard.scored(asked, k)
                        if base:
                            near = np.flatnonzero(score <= worst[k - s])
                            at, score = at[near], score[near]
                        found.append(shard.best(at, score, limit))
                    best.add(s, np.repeat(own, [len(f[0]) for f in found]), np.concatenate([f[0] for f in found]) + base, np.concatenate([f[1] for f in found]))
            for _, columns in best.rows(asked.ids.cast(kind)):
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        packed = docs.select("doc_id", "tokens").coalesce(tasks).mapInArrow(run, schema)
        found = joined(packed, "query_id", len(batch.ids), tasks, limit)
        out = found if out is None else out.unionByName(found)
    return out


def search_all(index: Index, queries: DataFrame, limit: int | None = None, config: LexicalConfig = LexicalConfig()) -> DataFrame:
    """query_id, doc_id, score of documents that hold all terms of a query."""
    return search(index, queries, "all_terms", limit, config).drop("mode")


def search_any(index: Index, queries: DataFrame, limit: int | None = None, config: LexicalConfig = LexicalConfig()) -> DataFrame:
    return search(index, queries, "any_terms", limit, config).drop("mode")


def search_phrase(index: Index, queries: DataFrame, limit: int | None = None, config: LexicalConfig = LexicalConfig()) -> DataFrame:
    return search(index, queries, "phrase", limit, config).drop("mode")


def search_auto(index: Index, queries: DataFrame, limit: int | None = None, config: LexicalConfig = LexicalConfig()) -> DataFrame:
    return search(index, queries, "auto", limit, config)


def ranked(hits: DataFrame, limit: int, *extra: str) -> DataFrame:
    """The best ``limit`` hits of each query with their rank; smaller scores are better, ties go by document."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9), "doc_id")
    out = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return out.select("query_id", "rank", "doc_id", F.round("score", 6).alias("bm25"), *extra)


def excerpt(words: Column, terms: Column, n: int = 24) -> Column:
    """At most ``n`` of the words (a column of index tokens) from near the first query term on, query terms in brackets."""
    places = F.filter(F.transform(terms, lambda t: F.array_position(words, t)), lambda p: p > 0)
    start = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - n // 4, F.lit(1)).cast("int")
    cut = F.slice(words, start, n)
    shown = F.array_join(F.transform(cut, lambda w: F.when(F.array_contains(terms, w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")
    return F.concat(F.when(start > 1, "… ").otherwise(""), shown, F.when(start + n - 1 < F.size(words), " …").otherwise(""))
