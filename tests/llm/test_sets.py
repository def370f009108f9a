import itertools

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import canonical, leaks, mixing, overlap, queries, rankwalk

QUERY = "query_id string, query_text string, source string"
SPLIT = "split_id string, calibration struct<query_ids: array<string>>, validation struct<query_ids: array<string>>"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_in_order():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 12))) for _ in "xy")
        assert overlap.common_in_order(a, b) == lcs(a, b)


def test_overlaps_against_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(40)]
    base = [list(rng.choice(words, rng.integers(1, 22))) for _ in range(40)]
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(2):
            u = list(t)
            for _ in range(int(rng.integers(0, 4))):
                k = int(rng.integers(0, len(u) + 1))
                u[k : k + int(rng.integers(0, 2))] = [str(rng.choice(words))] if rng.random() < 0.6 else []
            texts.append(u)
    rows = [(f"q{k:03d}", " ".join(t).replace("w1 ", "W1, "), None) for k, t in enumerate(texts)] + [("none", None, "s"), ("blank", " !", "s")]
    q = spark.createDataFrame(rows + rows[:5], QUERY).withColumn("class_id", F.lit("clash"))
    ids = [r[0] for r in rows]
    side = rng.integers(0, 3, len(ids))
    cal, val = ([i for i, s in zip(ids, side) if s in keep] for keep in ((0, 2), (1, 2)))
    s = spark.createDataFrame([("a", (cal[::2] + [None],), (val[1::2] + val[1:2],)), ("b", (cal[1::2],), (val[::2],))], SPLIT)
    text = {i: t for i, t in zip(ids, texts)}
    want = set()
    for a, b in itertools.product(cal, val):
        x, y = text.get(a, []), text.get(b, [])
        if x and y and lcs(x, y) >= 0.85 * max(len(x), len(y)) - 1e-9:
            want.add((min(a, b), max(a, b)))
    got = {tuple(r) for r in overlap.overlapping_pairs(q, s).select("query_id_a", "query_id_b").collect()}
    assert got == want and len(want) > 20
    report = overlap.overlap_report(q, s).collect()
    hit = {b if b in val and (a in cal) else a for a, b in want} | {a for a, b in want if a in val and b in cal}
    assert sum(r.n_leaked for r in report) == len({x for x in hit if x in val})
    assert overlap.overlapping_pairs(q.limit(0), s.limit(0)).count() == 0


def direct_walk(values, config):
    n, s = values.shape
    p = np.full(n, 1 / n)
    m = np.zeros((n, n))
    for k in range(s):
        v = np.where(np.isnan(values[:, k]), -np.inf, values[:, k])
        better = (v[None, :] > v[:, None]).astype(float)
        if config.jump == "draw":
            m += better / n + np.diag(1 - better.sum(1) / n)
        else:
            m += np.where(better.sum(1, keepdims=True) > 0, better / np.maximum(1, better.sum(1, keepdims=True)), np.eye(n))
    for _ in range(config.steps):
        p = (1 - config.damping) / n + config.damping * (p @ m) / s
    return p


@pytest.mark.parametrize("jump", ["draw", "higher"])
def test_walk_against_matrix(jump):
    rng = np.random.default_rng(4)
    config = rankwalk.RankWalkConfig(jump=jump)
    groups = [rng.integers(0, 6, (n, 3)).astype(float) for n in (1, 2, 7, 13)]
    groups[2][3, 1] = groups[3][0, 0] = np.nan
    off = np.cumsum([0] + [len(g) for g in groups])
    got, ahead = rankwalk.stationary(np.concatenate(groups), off, config)
    for g, a, b in zip(groups, off, off[1:]):
        assert got[a:b] == pytest.approx(direct_walk(g, config), abs=1e-11)
        v = np.where(np.isnan(g), -np.inf, g)
        assert ahead[a:b].tolist() == (v[None] > v[:, None]).sum((1, 2)).tolist()
    assert rankwalk.stationary(np.zeros((0, 3)), np.zeros(1, np.int64))[0].size == 0
    with pytest.raises(ValueError):
        rankwalk.RankWalkConfig(jump="far")


@pytest.mark.parametrize("jump", ["draw", "higher"])
def test_large_groups_walk_the_same(spark, jump):
    rng = np.random.default_rng(5)
    rows = [(q, f"p{k:02d}", *(None if rng.random() < 0.2 else float(rng.integers(0, 9)) for _ in range(3))) for q, n in (("a", 30), ("b", 5), (None, 13)) for k in range(n)]
    df = spark.createDataFrame(rows + rows[:4], "q string, p string, x double, y double, z double").withColumn("score", F.lit(1)).withColumn("size", F.lit(2))
    scores = [("x", True), ("y", False), ("z", True)]
    small, large = (
        {(r.q, r.p): (round(r.stationarity, 9), round(r.mean_rank, 6), r.walk_rank) for r in rankwalk.rank_walk(df, "q", "p", scores, c).collect()}
        for c in (rankwalk.RankWalkConfig(steps=5, jump=jump), rankwalk.RankWalkConfig(steps=5, jump=jump, group_limit=10, blocks=4, checkpoint_every=3))
    )
    assert small == large and len(small) == 48
    assert rankwalk.first_places(df.limit(0), "q", "p", scores).count() == 0


def test_ties_go_by_mean_rank_then_item(spark):
    rows = [("q", x, 1.0, 1.0) for x in "cab"] + [("r", "z", None, None), ("r", "y", None, float("nan"))]
    df = spark.createDataFrame(rows, "q string, p string, x double, y double")
    got = {(r.q, r.p): (r.walk_rank, r.mean_rank) for r in rankwalk.rank_walk(df, "q", "p", [("x", True), ("y", True)]).collect()}
    assert got == {("q", "a"): (1, 1.0), ("q", "b"): (2, 1.0), ("q", "c"): (3, 1.0), ("r", "y"): (1, 1.0), ("r", "z"): (2, 1.0)}


def test_range_does_not_dominate(spark):
    rows = [("q", "steady", 2.0, 2.0, 2.0), ("q", "outlier", 9.0, 9.0, 1e9), ("q", "two", 1.0, 1.0, None), ("q", "rest", 5.0, 6.0, 1.0), ("q", "last", 7.0, 8.0, 0.5)]
    df = spark.createDataFrame(rows, "q string, p string, a double, b double, f double")
    assert rankwalk.first_places(df, "q", "p", [("a", False), ("b", False), ("f", True)]).first().p == "steady"


def longest_run(item, doc):
    best = 0
    for i in range(len(item)):
        for j in range(len(doc)):
            k = 0
            while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(300)]
    items = [(k, list(rng.choice(words, int(rng.integers(3, 30))))) for k in range(30)]
    docs = []
    for k in range(120):
        d = list(rng.choice(words, 40))
        if k % 2:
            it = items[int(rng.integers(0, 30))][1]
            n = int(rng.integers(1, len(it) + 1))
            s = int(rng.integers(0, len(it) - n + 1))
            d[10:10] = it[s : s + n]
        docs.append((k, d))
    noisy = lambda d: " ".join(w.upper() if i % 5 == 0 else w + "," if i % 7 == 0 else w for i, w in enumerate(d)).replace(" b", "\n~~b").replace("e", "е")
    held = spark.createDataFrame([(k, " ".join(t)) for k, t in items] + [(98, None), (99, "!?")], "item_id long, text string")
    rows = [(k, noisy(d)) for k, d in docs] + [(900, None), (901, ""), (902, "اَلكِتاب ۱۲")]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("item_id", F.lit(5))
    found = leaks.leaks(df, "doc_id", "text", held, "item_id", "text")
    got = {(r.item_id, r.doc_id) for r in found.where("2 * words >= item_words").collect()}
    few = leaks.leaks(df, "doc_id", "text", held, "item_id", "text", leaks.LeakConfig(hits_at_once=3))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in few.collect()}
    want = {(i, k) for i, t in items for k, d in docs if 2 * longest_run(t, d) >= len(t)}
    assert want <= got and len(want) > 20
    joined = lambda t: "".join(t)
    for i, k in got - want:  # runs that only word boundaries set apart
        t = items[i][1]
        need = -(-len(t) // 2)
        assert any(joined(t[s : s + need]) in joined(docs[k][1]) for s in range(len(t) - need + 1))
    assert leaks.leaks(df.limit(0), "doc_id", "text", held.limit(0), "item_id", "text").count() == 0
    with pytest.raises(ValueError):
        leaks.leaks(df, "doc_id", "text", held, "item_id", "text", leaks.LeakConfig(max_items=3))


def test_alignment_passes_over_edits(spark):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghiklmnopqrst"), rng.integers(4, 9))) for _ in range(400)]
    items = [list(rng.choice(words, 17)) for _ in range(20)]
    held = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    rows, want = [], {}
    for k, w in enumerate(items):
        middle = w[8]
        for j, changed in enumerate((middle, "z" + middle[1:], middle[:2] + middle[3:], middle[:2] + "zz" + middle[2:], middle[:1] + "zzzz" + middle[1:])):
            rows.append((100 * j + k, " ".join([*rng.choice(words, 6), *w[:8], changed, *w[9:], *rng.choice(words, 6)])))
            want[k, 100 * j + k] = 17 if j < 3 else 9 if j == 4 else None  # q-grams of 16 letters allow a run of so few for one edit
    # Markers of pages and milestones stand within the text.
    rows.append((999, " ".join([*items[0][:4], "PageV01P105", *items[0][4:7], "ms12", *items[0][7:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.item_id, r.doc_id): r for r in leaks.leaks(df, "doc_id", "text", held, "item_id", "text").collect()}
    for key, n in want.items():
        if n:
            assert got[key].aligned_words == n and got[key].n_edits <= 1
            assert (2 * got[key].words >= 17) == (key[1] < 100)
    assert got[0, 999].words == 17


def test_flow_is_cheapest():
    flows = mixing.route([(("a",), 10, 0), (("a", "b"), 10, 0)], {"a": 15, "b": 10}, {"a": 2, "b": 1})
    assert sum(v for (p, s), v in flows.items() if s == "a") == 15
    assert flows[1, "b"] == 10
    # Two sources want what only the shared texts hold: those are repeated before anything is given up.
    shared = mixing.route([(("a", "b"), 10, 0)], {"a": 8, "b": 7}, {"a": 1, "b": 1})
    assert shared == {(0, "a"): 8, (0, "b"): 7}
    # Fresh texts are used before further copies, and those before anything is used again.
    spread = mixing.route([(("a",), 10, 0), (("a",), 10, 1)], {"a": 15}, {"a": 3})
    assert spread == {(0, "a"): 15} or spread[0, "a"] >= 10
    assert mixing.turn_levels(0) == [] and mixing.turn_levels(11) == [1, 1, 2, 4, 3]


def test_flow_of_many_copies_and_patterns():
    began = time.time()
    n = 1_000_000
    flows = mixing.route([(("a",), 7, 0), (("a",), 7 * (n - 1), 1), (("a", "b"), 50, 0)], {"a": 7 * n * 3 // 2, "b": 80}, {"a": 2, "b": 3})
    assert flows[0, "a"] + flows[1, "a"] + flows[2, "a"] == 7 * n * 3 // 2 and flows[2, "b"] == 80
    rng = np.random.default_rng(3)
    names = [f"s{k}" for k in range(12)]
    patterns = [(tuple(sorted(rng.choice(names, rng.integers(1, 4), replace=False).tolist())), int(rng.integers(1, 99)), 0) for _ in range(5000)]
    flows = mixing.route(patterns, dict.fromkeys(names, 30_000), dict.fromkeys(names, 2))
    assert all(v <= 2 * patterns[p][1] for (p, _), v in flows.items()) and sum(flows.values()) <= 360_000
    assert time.time() - began < 5


def test_mix_with_many_copies_keeps_caps(spark):
    text = "the same words in every copy"
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.6, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(rows, "doc_id", "text", "source", targets)
    got = {r.source: r for r in m.selection.groupBy("source").agg(F.sum("uses").alias("n"), F.max("uses").alias("most"), F.count("*").alias("docs"), F.countDistinct("doc_id").alias("ids")).collect()}
    assert got["a"].n == pytest.approx(8000, abs=2) and got["a"].most == 2 and got["b"].n == pytest.approx(12_000, abs=2) and got["b"].most == 1
    assert got["a"].docs == got["a"].ids and m.selection.join(rows, ["doc_id", "source"], "left_anti").count() == 0
    with pytest.raises(ValueError):
        mixing.mix(rows, "doc_id", "text", "source", targets, mixing.MixConfig(max_patterns=1))


def test_mix(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = np.random.default_rng(7)
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, text(20), " Big ") for k in range(300)] + [(300 + k, text(20), "small") for k in range(10)]
    rows += [(400, rows[0][1], "small"), (401, rows[0][1], "small"), (402, None, "small"), (403, "", "big"), (404, text(20), None), (405, text(20), "other"), (None, text(20), "big"), (6, text(9), "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("uses", F.lit(0)).withColumn("n_tokens", F.lit(0))
    targets = spark.createDataFrame([("big", 0.5, 1), ("Small", 0.09, 3), ("absent", 0.1, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, "doc_id", "text", "source", targets)
    report = {r.source: r for r in m.report.collect()}
    assert set(report) == {"big", "small", "absent"}
    assert report["big"].share_of_corpus == pytest.approx(0.5, abs=0.01) and report["small"].share_of_corpus == pytest.approx(0.09, abs=0.01)
    assert report["absent"].mixed_tokens == 0 and report["small"].most_uses <= 3 and report["big"].most_uses == 1
    chosen = m.selection.collect()
    assert len({(r.doc_id, r.source, r.n_tokens) for r in chosen}) == len(chosen) and None not in {r.doc_id for r in chosen} and not {402, 403, 404, 405} & {r.doc_id for r in chosen}
    empty = mixing.mix(df.limit(0), "doc_id", "text", "source", targets)
    assert empty.selection.count() == 0 and empty.report.count() == 3
    again = {tuple(r) for r in mixing.mix(df, "doc_id", "text", "source", targets).selection.collect()}
    assert again == {tuple(r) for r in chosen}


def test_token_counts_add_up(spark):
    config = mixing.MixConfig()
    encoding, _ = mixing.encoder(config.tokenizer)
    texts = ["The lion's mane, 12.5%!", "این کتاب را نوشت.\n\n  و رفت", "没有人 测量", "", "a  b\t c\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.n_tokens for r in mixing.token_counts(df, ["id"], "t", config).collect()}
    assert got == {k: len(encoding.encode_ordinary(t)) for k, t in enumerate(texts)}


def test_equal_rows_meet_no_copy(spark):
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") == 7, "ａ b").otherwise("a b").alias("t"))
    began = time.time()
    pairs = canonical.look_alike_pairs(rows, "k", "t", ["t"])
    assert pairs.count() == 19_999
    assert time.time() - began < 20  # the first run loads the tables, too
    links = {(r.n_forms, r.n_links): r.n for r in canonical.look_links(rows, "k", "t", ["t"]).groupBy("n_forms", "n_links").agg(F.count("*").alias("n")).collect()}
    assert links == {(2, 1): 19_999, (2, 19_999): 1}


def test_overlap_classes(spark):
    q = spark.createDataFrame([(f"q{k}", "one two three four five six seven") for k in range(60)] + [("x", "one two three four five six eight"), ("y", None), ("z", "solo")], "query_id string, query_text string")
    q = q.withColumn("source", F.lit("s"))
    ids = lambda *k: {"query_ids": list(k)}
    s = spark.createDataFrame([("a", ids(*(f"q{k}" for k in range(30)), "z"), ids(*(f"q{k}" for k in range(30, 60)), "x", "z", "y"))], "split_id string, calibration struct<query_ids:array<string>>, validation struct<query_ids:array<string>>")
    rows = {(r.side, r.query_id): r.n_links for r in overlap.overlap_classes(q, s).collect()}
    assert rows["calibration", "q0"] == 31 and rows["validation", "q40"] == 30 and rows["validation", "x"] == 30 and rows["validation", "z"] == rows["calibration", "z"] == 1
    pairs = overlap.overlapping_pairs(q, s)
    assert pairs.count() == 30 * 31 + 1 and pairs.where("query_id_a = 'q0' AND query_id_b = 'q40'").first().cosine == 1.0
    assert pairs.where("query_id_b = 'x'").first().cosine < 1


def test_overlap_sends_no_table_to_the_driver(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(f"q{k}", f"one two three four five six w{k % 30}", "s") for k in range(60)], QUERY).write.parquet(f"{tmp_path}/q")
    ids = lambda *k: {"query_ids": [f"q{j}" for j in k]}
    spark.createDataFrame([("a", ids(*range(30)), ids(*range(30, 60)))], SPLIT).write.parquet(f"{tmp_path}/s")
    q, s = spark.read.parquet(f"{tmp_path}/q"), spark.read.parquet(f"{tmp_path}/s")
    plans, settle = [], overlap.settle

    def settled(df):
        out = settle(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(overlap, "settle", settled)
    for f, n in ((overlap.overlapping_pairs, 900), (overlap.overlap_classes, 60), (overlap.overlap_report, 1)):
        out = f(q, s)
        assert len(out.collect()) == n
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    # The one row of totals is all that is broadcast.
    assert len(plans) > 15 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_registry():
    names = queries.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 8, 10)} | {"p9_mix_report"} <= set(names)
