"""One search call: lexical and dense retrieval, fusion, evidence, decision and response for a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.config import FusionConfig, LexicalConfig, PolicyConfig
from folioflow.functions.lineage import settle, spread
from folioflow.functions.normalize import normalize_search_alias, snippet
from folioflow.operators import dense, evidence, fusion, lexical, policy
from folioflow.sources.tables import fail_if_any


@dataclass(frozen=True)
class Corpus:
    """What is searched: index, vectors (key, vector), stored passages, scope catalog (see evidence) and zones."""

    index: lexical.Index
    vectors: DataFrame
    encoder: dense.Encoder
    store: DataFrame
    aliases: DataFrame
    entity_versions: DataFrame
    zones: DataFrame
    query_prefix: str = ""


@dataclass(frozen=True)
class Lists:
    """The rankings of a run as one row per query, by passage numbers: 100 hits with their ids would take a hundred times
    the room of the query."""

    passages: DataFrame  # passage_no (rising with passage_id), passage_id
    found: DataFrame  # query_id, lexical and dense (passage numbers in order of rank), lexical_scores, dense_scores
    hybrid: DataFrame  # as Run.hybrid, with passage_no for passage_id


@dataclass(frozen=True)
class Run:
    """Hits of each ranking, with ranks from 1."""

    lexical: DataFrame  # query_id, passage_id, lexical_rank, lexical_bm25_score
    dense: DataFrame  # query_id, passage_id, dense_rank, dense_cosine_score
    hybrid: DataFrame  # query_id, hybrid_rank, passage_id, fusion_score, lexical_rank, dense_rank
    lists: Lists | None = None  # the same in less room, where the run was made by hybrid_search
    config: FusionConfig = FusionConfig()  # what the ranks were fused by


def dense_lists(vectors: DataFrame, corpus: Corpus, queries: DataFrame, text: str, limit: int) -> DataFrame | None:
    """Dense hits (see dense.top_lists) of queries with a text; the queries come to the vectors in blocks that a worker can hold."""
    asked = queries.where(F.coalesce(F.trim(text), F.lit("")) != "").select("query_id", dense.encoded(F.col(text), corpus.encoder, corpus.query_prefix).alias("vector"))
    asked = settle(asked)
    size, n = asked.select(F.max(F.size("vector")), F.count("*")).first()
    blocks = max(1, -(-(n * (size or 1)) // dense.MAX_QUERY_FLOATS))
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks)).isin(2 * b, 2 * b + 1))
        hits = dense.top_lists(vectors, "key", "vector", part, "query_id", limit)
        if hits is not None:
            found = hits if found is None else found.unionByName(hits)
    return found


def _numbered(corpus: Corpus) -> tuple[DataFrame, lexical.Index, DataFrame]:
    """Numbers of the passages in order of their ids; the index, written once, and the vectors by these numbers."""
    ids = corpus.index.docs.select(F.col("doc_id").alias("passage_id")).union(corpus.vectors.select("key")).distinct().orderBy("passage_id")
    passages = settle(ids.select(F.monotonically_increasing_id().alias("passage_no"), "passage_id"))
    same = lambda c: F.col(c).eqNullSafe(F.col("passage_id"))
    docs = settle(spread(corpus.index.docs.select("doc_id", F.array_join("tokens", " ").alias("words")).join(passages, same("doc_id")).select("passage_no", "words")))
    words = F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", " "))
    docs = docs.select(F.col("passage_no").alias("doc_id"), words.alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    totals = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    vectors = corpus.vectors.join(passages, same("key")).select(F.col("passage_no").alias("key"), "vector")
    return passages, lexical.Index(docs, corpus.index.postings, corpus.index.terms, totals, True), vectors


def _named(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """Hits with passage_id in place of passage_no."""
    return hits.join(passages, "passage_no").select(*("passage_id" if c == "passage_no" else c for c in hits.columns))


def hybrid_search(corpus: Corpus, queries: DataFrame, text: str, mode: str = "auto", limit: int | None = None, config: FusionConfig = FusionConfig(), lexical_config: LexicalConfig = LexicalConfig()) -> Run:
    """Both rankings of each query (query_id, ``text``) to ``candidate_limit`` and their fusion to ``limit`` hits.

    The lexical side reads the search-alias view, the dense side the text behind the encoder's prefix. A query without
    a text has no hits.
    """
    limit = config.limit if limit is None else limit
    if not 1 <= limit <= config.candidate_limit:
        raise ValueError("limit lies between 1 and candidate_limit")
    passages, index, vectors = _numbered(corpus)
    none = queries.select("query_id", F.array().cast("array<long>").alias("ids"), F.array().cast("array<double>").alias("scores")).where(F.lit(False))
    terms = lexical.query_terms(queries.select("query_id", normalize_search_alias(text).alias("q")), "query_id", "q")
    found = lexical.top_lists(index, terms, mode, config.candidate_limit, lexical_config)
    found = (none if found is None else found).select("query_id", F.col("ids").alias("lexical"), F.transform("scores", lambda s: F.round(s, 6)).alias("lexical_scores"))
    near = dense_lists(vectors, corpus, queries, text, config.candidate_limit)
    near = (none if near is None else near).select("query_id", F.col("ids").alias("dense"), F.transform("scores", lambda s: F.round(-s, 6)).alias("dense_scores"))
    lists = settle(found.join(near, "query_id", "full_outer"))
    rank = lambda c, name, other: F.coalesce(F.transform(c, lambda p, i: F.struct(p.alias("p"), (i + 1).alias(name), F.lit(None).cast("int").alias(other))), F.array())
    hits = F.concat(rank("lexical", "a", "b"), F.transform(rank("dense", "b", "a"), lambda h: F.struct(h.p.alias("p"), h.a.alias("a"), h.b.alias("b"))))
    # By query first, so that the hits, a hundred times as many, stay where they come from.
    both = lists.select("query_id", "lexical", "dense").repartition("query_id").select("query_id", F.explode(hits).alias("h"))
    both = both.groupBy("query_id", F.col("h.p").alias("passage_id")).agg(F.max("h.a").alias("lexical_rank"), F.max("h.b").alias("dense_rank"))
    fused = fusion.scored(both, FusionConfig(config.lexical_weight, config.dense_weight, config.rrf_constant, config.candidate_limit, limit))
    fused = fused.withColumnRenamed("passage_id", "passage_no")
    shown = lambda c, score: _named(lists.select("query_id", F.posexplode(F.arrays_zip(F.col(c).alias("p"), F.col(f"{c}_scores").alias("s"))).alias("r", "h")).select(
        "query_id", F.col("h.p").alias("passage_no"), (F.col("r") + 1).alias(f"{c}_rank"), F.col("h.s").alias(score)), passages)
    return Run(shown("lexical", "lexical_bm25_score"), shown("dense", "dense_cosine_score"), _named(fused, passages), Lists(passages, lists, fused), config)


def run_violations(run: Run) -> DataFrame:
    """query_id, passage_id, issue: hybrid hits whose ranks point at another hit of a component or leave out that a
    component has them, or whose score isn't what the ranks of the components give. No row is right."""
    if run.lists:
        key = "passage_no"
        place = lambda c: F.nullif(F.array_position(c, F.col(key)), F.lit(0))
        rows = run.lists.hybrid.join(run.lists.found, "query_id", "left").withColumns({"a": place("lexical"), "b": place("dense")})
    else:
        key = "passage_id"
        own = lambda hits, rank, c: hits.select("query_id", key, F.col(rank).alias(c))
        rows = run.hybrid.join(own(run.lexical, "lexical_rank", "a"), ["query_id", key], "left").join(own(run.dense, "dense_rank", "b"), ["query_id", key], "left")
    issues = []
    for name, c in (("lexical", "a"), ("dense", "b")):
        rank = F.col(f"{name}_rank")
        issues.append(F.when(rank.isNotNull() & ~rank.eqNullSafe(F.col(c)), f"{name}_rank_of_another_hit").when(rank.isNull() & F.col(c).isNotNull(), f"{name}_rank_left_out"))
    given = F.abs(F.col("fusion_score") - fusion.score("a", "b", run.config))
    issues.append(F.when(given.isNull() | (given > 1e-9), "score_of_other_ranks"))
    wrong = rows.select("query_id", key, F.explode(F.array_compact(F.array(*issues))).alias("issue"))
    return (wrong.join(run.lists.passages, key) if run.lists else wrong).select("query_id", "passage_id", "issue")


def alignment_violations(features: DataFrame, scope: DataFrame, roles: DataFrame) -> DataFrame:
    """query_id, issue: evidence that isn't about the same queries or hits: no scope evidence, roles of more or fewer hits
    than the ranking has, counts beyond their bounds."""
    rows = features.join(scope.select("query_id", F.lit(True).alias("s"), "matching_rate"), "query_id", "left").join(roles.select("query_id", "n_hits", "top_is_paratext", "top_is_mixed"), "query_id", "left")
    issues = F.array_compact(F.array(
        F.when(F.col("s").isNull(), "no_scope_evidence"), F.when(F.coalesce("n_hits", F.lit(0)) != F.least("hybrid_hits", F.lit(10)), "roles_of_other_hits"),
        F.when(F.col("overlap_at_10") > F.least("lexical_hits", "dense_hits"), "overlap_beyond_hits"), F.when(~F.col("matching_rate").between(0, 1), "rate_out_of_range"),
        F.when(F.col("top_is_paratext") & F.col("top_is_mixed"), "two_roles_of_one_hit"),
    ))
    return rows.select("query_id", F.explode(issues).alias("issue"))


def catalog_violations(aliases: DataFrame, versions: DataFrame) -> DataFrame:
    """entity_id, issue: an entity of two kinds or on both sides, an alias that names two entities, works and authors of
    the versions (author_id, work_id) that the catalog lacks, and entities in the corpus without a version."""
    from folioflow.functions.normalize import normalize_scope

    named = aliases.withColumn("n", normalize_scope("alias"))
    kinds = named.groupBy("entity_id").agg(F.countDistinct("kind").alias("k"), F.countDistinct("in_corpus").alias("c"))
    double = kinds.where("k > 1 OR c > 1").select("entity_id", F.lit("repeated_entity").alias("issue"))
    shared = named.where("n <> ''").groupBy("n").agg(F.countDistinct("entity_id").alias("e")).where("e > 1").select("n")
    clash = named.join(F.broadcast(shared), "n", "left_semi").select("entity_id", F.lit("shared_alias").alias("issue")).distinct()
    own = versions.select(F.col("author_id").alias("entity_id")).union(versions.select("work_id")).where("entity_id IS NOT NULL").distinct()
    inside = named.where("in_corpus").select("entity_id").distinct()
    lacking = own.join(inside, "entity_id", "left_anti").withColumn("issue", F.lit("not_in_catalog"))
    empty = inside.join(own, "entity_id", "left_anti").withColumn("issue", F.lit("without_version"))
    return double.unionByName(clash).unionByName(lacking).unionByName(empty)


def serialized(hits: DataFrame, store: DataFrame) -> DataFrame:
    """query_id and passages: the hits in order with their reference, texts, neighbours and scores."""
    rows = policy.enrich(hits, store)
    shown = F.struct(
        F.col("hybrid_rank").alias("rank"), "passage_id",
        F.struct("version_id", "author_id", "author_name", "work_id", "work_title", "ordinal").alias("reference"), snippet("display_text").alias("snippet"), "display_text",
        F.struct("previous_passage_id", "next_passage_id").alias("neighbors"),
        F.struct("fusion_score", "lexical_rank", "dense_rank", "lexical_bm25_score", "dense_cosine_score").alias("scores"),
    )
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("passages"))


def search(corpus: Corpus, queries: DataFrame, text: str, mode: str = "auto", limit: int | None = None, config: FusionConfig = FusionConfig(), rules: PolicyConfig = PolicyConfig()) -> DataFrame:
    """query_id, action, reason, message, passages, n_diagnostic of each query: what a reader is answered.

    An abstaining answer shows no passage. A hit that isn't stored stops the search. Of a query id with several texts
    each must be asked under an id of its own.
    """
    run = hybrid_search(corpus, queries, text, mode, limit, config)
    lists = replace(run.lists, hybrid=settle(run.lists.hybrid))
    run = replace(run, hybrid=_named(lists.hybrid, lists.passages), lists=lists)
    own = corpus.store.select("passage_id", "version_id", "kind", "author_id", "author_name", "work_id", "work_title", "ordinal", "display_text", "previous_passage_id", "next_passage_id")
    fail_if_any(policy.missing_passages(run.hybrid, own), "hits that aren't stored")
    placed = run.hybrid.join(own.select("passage_id", "version_id"), "passage_id")
    features = evidence.list_features(run.hybrid, run.lists.found)
    features = queries.select("query_id").distinct().join(features, "query_id", "left").na.fill(0, ["hybrid_hits", "lexical_hits", "dense_hits", "overlap_at_10", "overlap_at_100", "dual_support"])
    mentions = evidence.scope_mentions(queries.where(F.col(text).isNotNull()), text, corpus.aliases)
    scope = evidence.scope_evidence(queries, mentions, corpus.entity_versions, placed)
    decisions = policy.decide(features, scope, evidence.role_evidence(evidence.content_roles(placed, corpus.zones)), rules)
    at = lambda name: F.get(f"{name}_scores", F.col(f"{name}_rank") - 1)
    scored = run.lists.hybrid.join(run.lists.found, "query_id").withColumns({"lexical_bm25_score": at("lexical"), "dense_cosine_score": at("dense")})
    scored = _named(scored.drop(*(c for c in run.lists.found.columns if c != "query_id")), run.lists.passages)
    out = decisions.join(serialized(scored, own), "query_id", "left")
    answer = F.col("action") == "return_results"
    kept = F.when(answer, F.coalesce("passages", F.array())).otherwise(F.array())
    return out.select("query_id", "action", "reason", policy.message(F.col("reason")).alias("message"), kept.alias("passages"), F.coalesce(F.size("passages"), F.lit(0)).alias("n_diagnostic"))


def restricted(work: Column, query: Column) -> Column:
    """A query put again to the text of one work alone."""
    return F.format_string("فقط بر اساس متن اصلی %s: %s", work, query)
