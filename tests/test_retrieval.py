import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.config import FusionConfig, LexicalConfig, PassageConfig, profile_differences
from folioflow.functions import ordered
from folioflow.operators import dense, evaluation, evidence, fusion, lexical, passages, policy


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([("d1", "alpha beta gamma"), ("d2", "alpha beta"), ("d3", "beta alpha delta delta"), ("d4", None), ("d5", "")], "id string, t string")
    return lexical.build_index(docs, "id", "t")


def asked(spark, *texts):
    return lexical.query_terms(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t")


def test_bm25_by_hand(spark, index):
    got = {r.doc_id: r.score for r in lexical.search_any(index, asked(spark, "delta")).collect()}
    idf = math.log((5 - 1 + 0.5) / (1 + 0.5))
    assert got == {"d3": pytest.approx(-idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / 1.8)))}


def test_modes(spark, index):
    q = asked(spark, "beta alpha", "alpha beta gamma", "gamma delta", "zeta", "از")
    auto = {(r.query_id, r.doc_id): r.mode for r in lexical.search_auto(index, q).collect()}
    assert auto == {(0, "d3"): "phrase", (1, "d1"): "phrase", (2, "d1"): "any_terms", (2, "d3"): "any_terms"}
    assert {(r.query_id, r.doc_id) for r in lexical.search_all(index, q).collect()} == {(0, "d1"), (0, "d2"), (0, "d3"), (1, "d1")}


def test_shards_and_blocks_change_nothing(spark):
    rng = np.random.default_rng(11)
    names = [f"w{k}" for k in range(12)]
    docs = [(f"d{k:02d}", " ".join(rng.choice(names, int(rng.integers(0, 9))))) for k in range(60)] + [("d98", None), ("d99", "w1 w2 w1 w2")]
    docs += [(f"e{k:02d}", "w3 w4 w5") for k in range(20)]  # copies tie
    texts = [" ".join(rng.choice(names, int(rng.integers(1, 4)))) for _ in range(15)] + ["w1 w2", "w3 w4", "nowhere", "w1 nowhere"]
    ix = lexical.build_index(spark.createDataFrame(docs, "id string, t string").withColumn("tokens", F.lit("clash")), "id", "t")
    q = asked(spark, *texts)
    small = LexicalConfig(shard_tokens=10, query_block=4)
    for mode in ("phrase", "all_terms", "any_terms", "auto"):
        whole = lexical.search(ix, q, mode)
        best = {tuple(r) for r in lexical.ranked(whole, 3, "mode").collect()}
        assert best == {tuple(r) for r in lexical.ranked(lexical.search(ix, q, mode, 3, small), 3, "mode").collect()}
        found = {(r.query_id, r.doc_id) for r in whole.collect()}
        for k, text in enumerate(texts):
            want, terms = text.split(), set(text.split())
            held = {
                "phrase": lambda ws: any(ws[i : i + len(want)] == want for i in range(len(ws))),
                "all_terms": lambda ws: terms <= set(ws), "any_terms": lambda ws: bool(terms & set(ws)),
            }
            if mode != "auto":
                assert {d for q_, d in found if q_ == k} == {d for d, t in docs if t and held[mode](t.split())}
    assert lexical.search(ix, q.limit(0)).count() == 0


def test_common_term_is_floored(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "id string, t string")
    hits = lexical.search_any(lexical.build_index(docs, "id", "t"), asked(spark, "x")).collect()
    assert [r.score for r in hits] == [pytest.approx(-1e-6)] * 3


def test_fusion(spark):
    lex = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, passage_id string, lexical_rank int")
    den = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "query_id string, passage_id string, dense_rank int")
    rows = fusion.fuse(lex, den).orderBy("hybrid_rank").collect()
    assert [r.passage_id for r in rows] == ["b", "a", "c"]
    assert rows[0].fusion_score == pytest.approx(2 / 62 + 1 / 61, abs=1e-9)
    only = fusion.fuse(lex.limit(0), den).orderBy("hybrid_rank").collect()
    assert [r.passage_id for r in only] == ["b", "c"]
    assert profile_differences(FusionConfig(rrf_constant=61)) == ["rrf_constant"]
    twice = lex.union(lex).withColumn("dense_rank", F.lit(0))
    assert {r.issue for r in fusion.integrity(twice).collect()} == {"repeated_passage", "repeated_lexical_rank", "repeated_dense_rank", "invalid_dense_rank"}


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[7] = m[3]
    v = spark.createDataFrame([(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(m)] + [(999, None)], "id long, e array<float>")
    q = v.where("id < 5").select(F.col("id").alias("qid"), "e")
    got = dense.top_k(v, "id", "e", q, "qid", 4, block=50)
    m = np.asarray(m, np.float32).astype(float)
    for k in range(5):
        s = np.round(m @ m[k] / np.linalg.norm(m[k]), 9)
        want = sorted(range(300), key=lambda i: (-s[i], i))[:4]
        assert [r.id for r in got.where(f"qid = {k}").orderBy("rank").collect()] == want
    assert dense.top_k(v, "id", "e", q.limit(0), "qid", 4).count() == 0
    assert dense.validation(v, "e").first().asDict() == {"n_vectors": 301, "n_null": 1, "least_size": 8, "most_size": 8, "n_not_finite": 0, "n_not_unit": 0}


def test_metrics(spark):
    schema = "query_id string, query_type string, judgments array<struct<passage_id: string, grade: int, rationale: string>>, include_in_metrics boolean"
    q = spark.createDataFrame([("a", "semantic", [("p1", 3, None), ("p2", 1, None)], True), ("o", "out_of_corpus", [], True), ("n", "semantic", [], True), ("x", "entity", [], False)], schema)
    r = spark.createDataFrame([("a", "noise", 1), ("a", "p2", 2), ("a", "p1", 3)], "query_id string, passage_id string, rank int")
    got = {(x.query_id, x.k): x for x in evaluation.query_metrics(q, r, (3, 1, 2, 1)).collect()}
    assert [got["a", k].recall for k in (1, 2, 3)] == [0, 0.5, 1]
    assert got["a", 2].reciprocal_rank == 0.5
    assert got["a", 3].ndcg == pytest.approx((1 / math.log2(3) + 7 / 2) / (7 + 1 / math.log2(3)), abs=1e-6)
    assert got["o", 1].negative_hit == 0 and got["o", 1].recall is None and got["n", 1].recall == 0
    assert {k for k, _ in got} == {"a", "o", "n"}
    lat = evaluation.latency_summary(spark.createDataFrame([("g", 3.0), ("g", 1.0), ("g", 2.0), ("g", None)], "g string, v double"), "g", "v").first()
    assert (lat.mean, lat.median, lat.p95, lat.most) == (2, 2, 3, 3)


def test_verse_windows(spark):
    v = spark.createDataFrame([("d", i, 2) for i in range(10)] + [("m", i, 6) for i in range(10)] + [("s", 0, 2)], "run string, i int, least int")
    got = {}
    for r in passages.verse_windows(v, ["run"], "i", "least").orderBy("window_no").collect():
        got.setdefault(r.run, []).append((r.first_verse, r.size))
    assert got == {"d": [(1, 8), (8, 3)], "m": [(1, 8), (3, 8)], "s": [(1, 1)]}


def test_packing():
    assert passages.packed([100, 100, 100]) == [0, 2, 3]
    assert passages.packed([150, 40, 30]) == [0, 3]
    assert passages.packed([]) == [0]
    with pytest.raises(ValueError):
        passages.packed([301])
    with pytest.raises(ValueError):
        PassageConfig(verse_overlap=8)


@given(st.lists(st.integers(0, 300), max_size=60))
def test_packing_keeps_its_limits(sizes):
    cuts = passages.packed(sizes)
    assert cuts[0] == 0 and cuts[-1] == len(sizes) and cuts == sorted(set(cuts))
    words = [sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])]
    assert all(w <= 300 for w in words)
    for w, b in zip(words[:-2], cuts[1:]):  # all but the two evened out: full, or the next would not have fitted
        assert w >= 180 or w + sizes[b] > 300
    if len(words) > 1 and words[-1] < 80:  # a short tail could neither be filled nor joined
        a, b = cuts[-3], cuts[-2]
        assert words[-2] + words[-1] > 300 or b == a + 1
        assert b == a + 1 or words[-2] - sizes[b - 1] < 80 or words[-1] + sizes[b - 1] > 300


def test_long_paragraphs_are_split():
    sentence = lambda n, c: " ".join([c] * (n - 1) + [c + "."])
    parts, apart = passages.split_paragraph(" ".join(sentence(170, c) for c in "abcd"))
    assert [len(p.split()) for p in parts] == [170, 170, 170, 170] and not apart
    parts, apart = passages.split_paragraph(sentence(100, "a") + " " + sentence(400, "b") + " " + sentence(60, "c") + " " + sentence(130, "d"))
    assert [len(p.split()) for p in parts] == [100, 180, 180, 40, 190] and apart
    assert passages.split_paragraph("x " * 200)[1]


def test_order_dependent_columns_over_blocks(spark):
    rows = [(k % 3 or None, k, k % 7 if k % 5 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, o int, v int")
    b = ordered.blocked(df, ["g"], ["o"], parts=7)
    b = ordered.last_so_far(ordered.running_sum(ordered.neighbours(b, ["o"], "p", "n"), "v", "s"), {"l": F.col("v")})
    got = {(r.g, r.o): (r.p and r.p.o, r.n and r.n.o, r.s, r.l) for r in ordered.plain(b).collect()}
    for g in (None, 1, 2):
        mine = [(o, v) for gg, o, v in rows if gg == g]
        for k, (o, v) in enumerate(mine):
            seen = [x for _, x in mine[: k + 1] if x is not None]
            assert got[g, o] == (mine[k - 1][0] if k else None, mine[k + 1][0] if k + 1 < len(mine) else None, sum(x or 0 for _, x in mine[:k]), seen[-1] if seen else None)


def test_pack_prose_streams_runs(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{k}", o, int(rng.integers(0, 300))) for k in range(40) for o in range(int(rng.integers(1, 30)))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.run, r.o): r.passage_no for r in passages.pack_prose(spark.createDataFrame(rows, "run string, o int, w int"), ["run"], "o", "w").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(40):
        mine = sorted((o, w) for r, o, w in rows if r == f"r{k}")
        cuts = passages.packed([w for _, w in mine])
        assert [got[f"r{k}", o] for o, _ in mine] == np.repeat(np.arange(1, len(cuts)), np.diff(cuts)).tolist()


def test_runs_and_links(spark):
    u = spark.createDataFrame([("v", 1, "h", False), ("v", 2, "h", False), ("v", 3, None, False), ("v", 4, None, True), ("v", 5, None, False)], "k string, o int, h string, b boolean")
    got = {r.o: r.run_id for r in passages.runs(u, "k", "o", ["h"], "b").collect()}
    assert got[1] == got[2] != got[3] and got[4] is None and got[5] not in (got[3], None)


def decisions(spark, score, overlap, **flags):
    f = spark.createDataFrame([("q", 2, score, overlap, "p")], "query_id string, hybrid_hits int, dense_top_1 double, overlap_at_10 int, top_passage_id string")
    s = spark.createDataFrame([("q", flags.get("out", False), flags.get("conflict", False))], "query_id string, out_of_corpus_mentioned boolean, source_conflict boolean")
    r = spark.createDataFrame([("q", 2, flags.get("para", False), False)], "query_id string, n_hits int, top_is_paratext boolean, top_is_mixed boolean")
    return policy.decide(f, s, r).first()


def test_policy(spark):
    assert decisions(spark, 0.863, 0).reason == "baseline_evidence_passed"
    assert decisions(spark, 0.860086, 0).reason == "weak_cross_retriever_evidence"
    assert decisions(spark, 0.860086, 1).action == "return_results"
    assert decisions(spark, None, 0).action == "return_results"
    both = decisions(spark, 0.1, 0, conflict=True, para=True)
    assert both.triggered == "source_attribution_conflict,top_hit_paratext,weak_cross_retriever_evidence"


def test_scope(spark):
    aliases = spark.createDataFrame([("a1", "author", True, "حافظ شیرازی"), ("a1", "author", True, "حافظ"), ("w1", "work", True, "دیوان"), ("x", "author", False, "سعدی")], "entity_id string, kind string, in_corpus boolean, alias string")
    q = spark.createDataFrame([("1", "شعر حافظ شیرازی در ديوان"), ("2", "حافظ؟"), ("3", "از سعدی")], "query_id string, t string")
    m = evidence.scope_mentions(q, "t", aliases)
    assert {(r.query_id, r.entity_id, r.alias) for r in m.collect()} == {("1", "a1", "حافظ شیرازی"), ("1", "w1", "دیوان"), ("3", "x", "سعدی")}
    links = spark.createDataFrame([("a1", "v1"), ("a1", "v2"), ("w1", "v2")], "entity_id string, version_id string")
    hits = spark.createDataFrame([("1", 1, "v1"), ("1", 2, "v2")], "query_id string, hybrid_rank int, version_id string")
    e = {r.query_id: r for r in evidence.scope_evidence(q, m, links, hits).collect()}
    assert (e["1"].n_requested, e["1"].matching_hits, e["1"].matching_rate, e["1"].source_conflict) == (1, 1, 0.5, True)
    assert e["3"].out_of_corpus_mentioned and e["3"].matching_rate is None and not e["3"].source_conflict


def test_zones(spark):
    z = spark.createDataFrame([("v", 1, 2, "paratext", 5), ("v", 4, 5, "authorial", 5)], "version_id string, start_ordinal int, end_ordinal int, role string, expected_passage_count int")
    assert [r.issue for r in evidence.zone_violations(z).collect()] == ["gap_or_overlap"]
    h = spark.createDataFrame([("q", 1, "v:passage_000002", "v"), ("q", 2, "v:passage_000003", "v"), ("q", 3, "w:passage_000001", "w")], "query_id string, hybrid_rank int, passage_id string, version_id string")
    roles = evidence.content_roles(h, z)
    assert [r.role for r in roles.orderBy("hybrid_rank").collect()] == ["paratext", "outside", "unknown"]
    assert evidence.role_evidence(roles).first().top_is_paratext


def test_hits_leave_a_task_once_a_query(spark):
    """However many vectors and shards a task holds, one row per query is handed on, with the hits in order."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(600, 8)).round(1)  # rounded, so that scores tie
    v = spark.createDataFrame([(int(k), [float(x) for x in m[k % 500]]) for k in rng.permutation(600)], "id long, e array<float>").repartition(3)
    q = v.where("id < 40").select(F.col("id").alias("qid"), "e")
    lists = dense.top_lists(v, "id", "e", q, "qid", 7, block=50)
    m = np.asarray(m, np.float32).astype(float)[np.arange(600) % 500]
    for r in lists.collect():
        s = np.round(m @ (m[r.qid] / np.linalg.norm(m[r.qid])), 9)
        assert r.ids == sorted(range(600), key=lambda i: (-s[i], i))[:7] and [-x for x in r.scores] == [s[i] for i in r.ids]
    assert lists.count() == 40
    words = ["red", "sea", "sky", "rose", "the"]
    p = spark.createDataFrame([(int(k), " ".join(rng.choice(words, rng.integers(1, 9)))) for k in range(400)], "id long, t string").repartition(3)
    ix = lexical.written(lexical.build_index(p, "id", "t"))
    q = lexical.query_terms(spark.createDataFrame([(f"q{k}", " ".join(rng.choice(words, rng.integers(1, 4)))) for k in range(30)] + [("none", "absent")], "query_id string, q string"), "query_id", "q")
    small = LexicalConfig(shard_tokens=100, query_block=20)
    for mode in ("auto", *lexical.MODES):
        got = {(r.query_id, k + 1, d) for r in lexical.top_lists(ix, q, mode, 5, small).collect() for k, d in enumerate(r.ids)}
        assert got == {(r.query_id, r["rank"], r.doc_id) for r in lexical.ranked(lexical.search(ix, q, mode), 5).collect()}
