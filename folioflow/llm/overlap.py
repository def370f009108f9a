"""Same or near-same records across splits.

Method: weighted cosine join. Every text is a vector of term weights: a term is a word and the number of its occurrence,
its weight w its rarity among the texts. Terms stand in one global order from the heaviest on. A partner that shares
the asked part of the words of x has a dot product of at least T(x), the squared norm of x less its heaviest terms that
may be lacking, so the cosine of two such texts is at least ``t``, the least T(x) / |x|^2 of any text.

Inverted lists hold a term of x only while what is left from it on may still reach T(x). Two bounds say what is left:
the residual norm, and the sum of the weights times the maximum weight of each list on the other side (a term that
the other side lacks adds nothing and has no list). Texts of few words are listed under pairs of such terms, which no
frequent word makes long; longer ones under single terms. Within a list, a pair goes on only if its lengths fit and
the weight of the term and of the rest of both vectors reaches the greater T. Exact dot products and the cosine follow,
and the order of the common words is checked last. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.lineage import settle
from folioflow.functions.normalize import search_alias_view


@dataclass(frozen=True)
class OverlapConfig:
    share: float = 0.85  # of the words of the longer text, in the same order
    paired_words: int = 40  # texts of so many words are listed under pairs of terms


def merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left joined to right by sorting both, so neither side goes through the driver.

    The planner's estimates of exploded rows are far too low: under a broadcast limit of 10 MB it sent 100 MB of them.
    """
    return left.join(right.hint("merge"), on, how)


def words(text: Column) -> Column:
    """Words of a text in search-alias view, lower case, without punctuation."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}\p{M}]+"), F.lit(0))


def text_classes(queries: DataFrame, key: str, text: str) -> DataFrame:
    """key, class_id and words of each row that has a word; equal word sequences share a class."""
    view = search_alias_view(queries.where(F.col(text).isNotNull()).select(key, text), text, "__view")
    listed = view.select(F.col(key), words(F.col("__view")).alias("words")).where(F.size("words") > 0)
    return listed.distinct().withColumn("class_id", F.md5(F.array_join("words", " ")))


def may_lack(n: Column, longest: Column, config: OverlapConfig) -> Column:
    """Words of a text of ``n`` that a partner may lack where the longer of both has ``longest``."""
    return (n - F.ceil(F.lit(config.share) * longest - 1e-9)).cast("int")


def weighted_terms(classes: DataFrame, sides: DataFrame, config: OverlapConfig) -> DataFrame:
    """class_id, n (words), norm (squared), least (T) and terms of each class from the heaviest on: term (hash), w2
    (its weight squared: 1 + idf / max idf), rest (squared norm after it), met (the same, of terms that the other side
    has)."""
    numbered = F.expr("transform(words, (w, i) -> xxhash64(w, size(filter(slice(words, 1, i + 1), v -> v = w))))")
    own = classes.select("class_id", F.size("words").alias("n"), F.explode(numbered).alias("term"))
    total = classes.agg(F.count("*").alias("total"))
    on = merged(own, sides, "class_id")
    df = on.groupBy("term").agg(F.count("*").alias("df"), F.max("left").alias("in_left"), F.max("right").alias("in_right"))
    idf = df.join(F.broadcast(total)).select("term", "in_left", "in_right", (1 + F.log((F.col("total") + 1) / F.col("df")) / F.log(F.col("total") + 2)).alias("w2"))
    # The weight of a term is the same in every text, so its maximum weight on the other side is its weight, or 0.
    weighed = merged(on, idf, "term").withColumn("other", F.when(F.col("left") & F.col("in_right") | F.col("right") & F.col("in_left"), F.col("w2")).otherwise(0.0))
    gathered = weighed.groupBy("class_id", "n").agg(F.sort_array(F.collect_list(F.struct("w2", "term", "other")), False).alias("terms"), F.sum("w2").alias("norm"))
    lacking = F.aggregate(F.slice("terms", F.lit(1), may_lack(F.col("n"), F.col("n"), config)), F.lit(0.0), lambda s, t: s + t["w2"])
    return gathered.withColumn("least", F.col("norm") - lacking)


def listed_terms(vectors: DataFrame, config: OverlapConfig) -> DataFrame:
    """class_id, n, least and key of every inverted list a vector is in, with ``gain``: the most that the terms of the
    key and those after them can add to a dot product."""
    # rest: what the terms from each on can add, by maximum weight (0 for terms that the other side lacks) and norm.
    after = F.expr("transform(terms, (t, i) -> struct(t.term AS term, t.other AS other, aggregate(slice(terms, i + 1, size(terms)), 0D, (s, u) -> s + u.other) AS rest))")
    rows = vectors.select("class_id", "n", "least", after.alias("terms"))
    alive = F.filter("terms", lambda t: (t["other"] > 0) & (t["rest"] >= F.col("least") - 1e-6))
    rows = rows.withColumn("first", alive)
    single = rows.where(F.col("n") > config.share * config.paired_words - 1e-9).select("class_id", "n", "least", F.explode("first").alias("t"))
    single = single.select("class_id", "n", "least", F.xxhash64(F.lit(1), "t.term").alias("key"), F.col("t.rest").alias("gain"))
    # Both the first and the second common term of a pair of texts are among the terms whose rest, with the one before,
    # reaches T. Two words at least must agree, so texts of a single word are their own list.
    paired = rows.where(F.col("n") <= config.paired_words)
    second = F.expr(
        "flatten(transform(first, a -> transform(filter(terms, b -> b.other > 0 AND b.rest < a.rest AND a.other + b.rest >= least - 1e-6), "
        "b -> struct(xxhash64(2, a.term, b.term) AS key, a.other + b.rest AS gain))))"
    )
    alone = F.transform("first", lambda a: F.struct(F.xxhash64(F.lit(1), a["term"]).alias("key"), a["rest"].alias("gain")))
    paired = paired.select("class_id", "n", "least", F.explode(F.when(F.col("n") == 1, alone).otherwise(second)).alias("p"))
    return single.unionByName(paired.select("class_id", "n", "least", "p.key", "p.gain"))


def common_in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a machine word of bits at a time."""
    where: dict[str, int] = {}
    for k, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << k
    row = (1 << len(a)) - 1
    full = row
    for w in b:
        m = where.get(w, 0)
        u = row & m
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def verified(candidates: DataFrame, config: OverlapConfig) -> DataFrame:
    """candidates (x, y, cosine, words_x, words_y) that share enough words in the same order: x, y, cosine, common."""
    schema = T.StructType([*candidates.schema.fields[:3], T.StructField("common", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            common = np.array([common_in_order(p, q) for p, q in zip(a, b)], np.int32)
            longest = np.array([max(len(p), len(q)) for p, q in zip(a, b)])
            good = pa.array(common >= config.share * longest - 1e-9)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(common)], names=schema.names)
            yield out.filter(good)

    return candidates.mapInArrow(run, schema)


def class_links(left: DataFrame, right: DataFrame, classes: DataFrame, config: OverlapConfig = OverlapConfig()) -> DataFrame:
    """Links (x, y, cosine, common) between different text classes of ``left`` and of ``right`` (columns class_id)."""
    sides = left.select("class_id", F.lit(True).alias("left"), F.lit(False).alias("right")).union(right.select("class_id", F.lit(False), F.lit(True)))
    sides = sides.groupBy("class_id").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    texts = merged(classes.select("class_id", "words").dropDuplicates(["class_id"]), sides, "class_id", "left_semi")
    vectors = settle(weighted_terms(texts, sides, config))
    least = vectors.agg(F.coalesce(F.min(F.col("least") / F.col("norm")), F.lit(1.0))).collect()[0][0]  # t
    keys = settle(merged(listed_terms(vectors, config), sides, "class_id"))
    a = keys.where("left").select("key", F.col("class_id").alias("x"), F.col("n").alias("nx"), F.col("least").alias("lx"), F.col("gain").alias("gx"))
    b = keys.where("right").select("key", F.col("class_id").alias("y"), F.col("n").alias("ny"), F.col("least").alias("ly"), F.col("gain").alias("gy"))
    fits = (F.col("x") != F.col("y")) & (F.least("nx", "ny") >= config.share * F.greatest("nx", "ny") - 1e-9) & (F.least("gx", "gy") >= F.greatest("lx", "ly") - 1e-6)
    pairs = merged(a, b, "key").where(fits).select("x", "y").distinct()
    terms = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), t["w2"].alias("w2")))
    vx = vectors.select(F.col("class_id").alias("x"), F.col("n").alias("nx"), F.col("norm").alias("ox"), terms.alias("tx"))
    vy = vectors.select(F.col("class_id").alias("y"), F.col("n").alias("ny"), F.col("norm").alias("oy"), terms.alias("ty"))
    dot = F.expr("aggregate(array_intersect(tx, ty), 0D, (s, t) -> s + t.w2)")
    # T of the pair: what may be lacking depends on the longer of both.
    lacking = lambda c, n: F.aggregate(F.slice(c, F.lit(1), may_lack(F.col(n), F.greatest("nx", "ny"), config)), F.lit(0.0), lambda s, t: s + t["w2"])
    scored = merged(merged(pairs, vx, "x"), vy, "y").withColumn("dot", dot)
    scored = scored.withColumn("cosine", F.col("dot") / F.sqrt(F.col("ox") * F.col("oy"))).where(F.col("cosine") >= least - 1e-9)
    scored = scored.where((F.col("dot") >= F.col("ox") - lacking("tx", "nx") - 1e-6) & (F.col("dot") >= F.col("oy") - lacking("ty", "ny") - 1e-6))
    words_of = texts.select("class_id", "words")
    worded = merged(scored.select("x", "y", "cosine"), words_of.select(F.col("class_id").alias("x"), F.col("words").alias("words_x")), "x")
    worded = merged(worded, words_of.select(F.col("class_id").alias("y"), F.col("words").alias("words_y")), "y")
    return verified(worded.select("x", "y", "cosine", "words_x", "words_y"), config)


def listed_ids(splits: DataFrame, side: str) -> DataFrame:
    """split_id and query_id of every id in a list of this side; nulls and repeats are dropped."""
    return splits.select("split_id", F.explode(f"{side}.query_ids").alias("query_id")).where("query_id IS NOT NULL").distinct()


@dataclass(frozen=True)
class SplitClasses:
    calibration: DataFrame  # query_id, class_id
    validation: DataFrame
    links: DataFrame  # x, y, cosine: class pairs of calibration (x) and validation (y), equal classes included


def split_classes(queries: DataFrame, splits: DataFrame, config: OverlapConfig = OverlapConfig()) -> SplitClasses:
    listed = listed_ids(splits, "calibration").union(listed_ids(splits, "validation")).select("query_id").distinct()
    classes = settle(text_classes(merged(queries, listed, "query_id", "left_semi"), "query_id", "query_text"))
    member = classes.select("query_id", "class_id")
    sides = [settle(merged(member, listed_ids(splits, s).select("query_id").distinct(), "query_id", "left_semi")) for s in ("calibration", "validation")]
    links = class_links(sides[0], sides[1], classes, config).select("x", "y", "cosine")
    # A text has the cosine 1 with itself: a vector meets itself in all of its lists, so equal vectors need no list.
    same = merged(sides[0].select("class_id").distinct(), sides[1].select("class_id").distinct(), "class_id", "left_semi")
    links = links.unionByName(same.select(F.col("class_id").alias("x"), F.col("class_id").alias("y"), F.lit(1.0).alias("cosine")))
    return SplitClasses(sides[0], sides[1], settle(links))


def overlap_classes(queries: DataFrame, splits: DataFrame, config: OverlapConfig = OverlapConfig()) -> DataFrame:
    """One row per listed query and side: side (calibration, validation), query_id, class_id, n_links: queries of the
    other side with the same or nearly the same text. Nothing is spread over members, so a text that a third of all
    queries share costs one row each."""
    s = split_classes(queries, splits, config)
    out = None
    for side, mine, own, others, theirs in (("calibration", s.calibration, "x", s.validation, "y"), ("validation", s.validation, "y", s.calibration, "x")):
        size = others.groupBy(F.col("class_id").alias(theirs)).agg(F.count("*").alias("size"))
        links = merged(s.links, size, theirs).groupBy(F.col(own).alias("class_id")).agg(F.sum("size").alias("n_links"))
        rows = merged(mine, links, "class_id", "left").select(F.lit(side).alias("side"), "query_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        out = rows if out is None else out.unionByName(rows)
    return out


def overlapping_pairs(queries: DataFrame, splits: DataFrame, config: OverlapConfig = OverlapConfig()) -> DataFrame:
    """query_id_a <= query_id_b, cosine of every calibration and validation query with the same or nearly the same text.

    A query listed on both sides pairs with itself. Queries without a text or a word pair with none; repeated rows
    and ids count once; of a query with several texts each counts. Links are found between classes of equal texts;
    only here they are spread over the members (see ``overlap_classes`` for the form that isn't).
    """
    s = split_classes(queries, splits, config)
    a = s.calibration.select(F.col("class_id").alias("x"), F.col("query_id").alias("p"))
    b = s.validation.select(F.col("class_id").alias("y"), F.col("query_id").alias("q"))
    pairs = merged(merged(s.links, a, "x"), b, "y")
    named = pairs.select(F.least("p", "q").alias("query_id_a"), F.greatest("p", "q").alias("query_id_b"), "cosine")
    return named.groupBy("query_id_a", "query_id_b").agg(F.round(F.max("cosine"), 6).alias("cosine"))


def overlap_report(queries: DataFrame, splits: DataFrame, config: OverlapConfig = OverlapConfig()) -> DataFrame:
    """Per split_id and source of validation queries: n_listed, n_leaked (with an equal or near text in any
    calibration list) and leaked_share. A query without a source counts under 'unknown'."""
    s = split_classes(queries, splits, config)
    hit = merged(s.validation, s.links.select(F.col("y").alias("class_id")).distinct(), "class_id", "left_semi").select("query_id").distinct()
    sources = queries.groupBy("query_id").agg(F.min("source").alias("source"))
    listed = merged(listed_ids(splits, "validation"), sources, "query_id", "left").withColumn("source", F.coalesce("source", F.lit("unknown")))
    flagged = merged(listed, hit.withColumn("leaked", F.lit(1)), "query_id", "left")
    out = flagged.groupBy("split_id", "source").agg(F.count("*").alias("n_listed"), F.coalesce(F.sum("leaked"), F.lit(0)).alias("n_leaked"))
    return out.withColumn("leaked_share", F.round(F.col("n_leaked") / F.col("n_listed"), 6))
