import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.config import FusionConfig
from folioflow.functions.lineage import shared_folder
from folioflow.operators import building, corpus, dense, evidence, lexical, parsing, policy, search, units
from folioflow.sources import catalogs, marked, metadata, stores


def unit_rows(spark, rows):
    """rows: version, profile, [(type, text)]"""
    out = []
    for version, profile, parts in rows:
        for k, (kind, text) in enumerate(parts):
            raw = f"### | {text}" if kind == "heading" else text
            out.append((version, profile, f"{version}:{k}", kind, 10 * k, raw, text, text, True))
    df = spark.createDataFrame(out, "v string, profile string, unit_id string, unit_type string, char_start long, raw_text string, display_text string, retrieval_text string, inc boolean")
    return units.heading_context(df, "v")


def words(n, c="a"):
    return " ".join([c] * n)


def built(spark, rows):
    return {r.passage_id: r for r in building.build(unit_rows(spark, rows), "v", "profile", "inc").collect()}


def test_verse_passages(spark):
    verses = lambda n: [("verse", f"line {k}") for k in range(n)]
    got = built(spark, [("w.x", "structured_poetry", verses(10)), ("w.Mathnawi.x", "structured_poetry", verses(10)), ("w.y", "structured_poetry", verses(8))])
    size = lambda p: got[p].member_count
    assert (size("w.x:passage_000001"), size("w.x:passage_000002")) == (8, 3)
    assert (size("w.Mathnawi.x:passage_000001"), size("w.Mathnawi.x:passage_000002")) == (8, 8)
    second = got["w.Mathnawi.x:passage_000002"]
    assert second.kind == "mathnawi" and second.unit_ids[0] == "w.Mathnawi.x:2" and second.display_text.split("\n")[0] == "line 2"
    assert size("w.y:passage_000001") == 8 and len(got) == 5
    assert got["w.x:passage_000001"].next_passage_id == "w.x:passage_000002" and got["w.x:passage_000001"].previous_passage_id is None


def test_prose_passages(spark):
    parts = [("heading", "One"), *[("paragraph", words(100))] * 3, ("heading", "Two"), ("paragraph", words(20)), ("paragraph", "!"), ("paragraph", words(10)), ("raw", "noise"), ("paragraph", words(5))]
    parts[6] = ("paragraph", " ")
    got = built(spark, [("p", "mixed_prose_ocr", parts), ("r", "raw_ocr_reference", [("raw", "x")])])
    rows = [got[f"p:passage_{k:06d}"] for k in range(1, len(got) + 1)]
    # The empty paragraph and the raw line break the run as headings do.
    assert [r.word_count for r in rows] == [200, 100, 20, 10, 5] and [r.ordinal for r in rows] == [1, 2, 3, 4, 5]
    assert rows[0].display_text == words(100) + "\n\n" + words(100)
    assert [r.parent_context_id for r in rows] == ["p:0", "p:0", "p:4", "p:4", "p:4"]
    assert rows[1].previous_passage_id == rows[0].passage_id and rows[1].next_passage_id is None and rows[2].previous_passage_id is None
    us = unit_rows(spark, [("p", "mixed_prose_ocr", parts)])
    skipped = building.skipped_units(us, "v", "profile")
    assert [(r.unit_id, r.issue) for r in skipped.collect()] == [("p:6", "empty_content_unit")]
    members = building.prepared(us, "v", "profile").where("role = 'member'").select(F.col("v").alias("version_id"), "unit_id")
    b = building.build(us, "v", "profile")
    assert building.build_violations(b, members, skipped).count() == 0
    assert {r.issue for r in building.build_violations(b.where("ordinal > 1"), members, skipped.union(skipped.selectExpr("'p'", "'p:9'", "issue"))).collect()} == {"unit_in_no_passage", "skipped_unit_in_passage"}
    report = {(r.part, r.name): r.n for r in building.build_report(b, skipped).collect()}
    assert report == {("kind", "mixed_prose"): 5, ("build_issue", "empty_content_unit"): 1}


def test_long_paragraph_and_mixed_members(spark):
    long_ = " ".join(words(169, c) + " end." for c in "abcd")
    got = built(spark, [("p", "mixed_prose_ocr", [("paragraph", long_), ("verse", "v1"), ("verse", "v2")])])
    rows = [got[f"p:passage_{k:06d}"] for k in range(1, len(got) + 1)]
    assert [r.word_count for r in rows] == [170, 170, 170, 172] and all("oversized_unit_sentence_split" in r.issues for r in rows)
    assert rows[3].unit_ids == ["p:0", "p:1", "p:2"] and rows[3].display_text.endswith("end.\n\nv1\nv2") and rows[0].has_split_member
    assert building.build(unit_rows(spark, [("p", "mixed_prose_ocr", [("heading", "x")])]), "v", "profile").count() == 0


def test_heading_stack(spark):
    rows = [("section", "s1", "x"), ("heading", "h1", "# a"), ("heading", "h3", "### b"), ("heading", "h2", "## c"), ("verse", "v", "t"), ("heading", "h0", "none"), ("section", "s2", "y"), ("verse", "w", "t")]
    df = spark.createDataFrame([("k", i, u, 10 * n, raw) for n, (u, i, raw) in enumerate(rows)], "k string, unit_id string, unit_type string, char_start long, raw_text string")
    got = {r.unit_id: r for r in units.heading_context(df, "k").collect()}
    assert got["h3"].heading_path == ["h1", "h3"] and got["v"].heading_path == ["h1", "h2"] and got["v"].section_path == ["s1"] and got["v"].heading_id == "h2"
    assert got["h0"].heading_path == ["h0"] and got["h0"].heading_issue == "heading_without_level" and got["w"].heading_path == [] and got["w"].section_id == "s2"


def test_order_of_units_and_markers(spark):
    u = spark.createDataFrame([("k", 0, 10), ("k", 8, 20), ("k", 30, 40)], "k string, char_start long, char_end long")
    m = spark.createDataFrame([("k", 2, 4), ("k", 38, 45), ("k", 22, 25)], "k string, char_start long, char_end long")
    assert {(r.char_start, r.issue) for r in units.order_violations(u, m, "k").collect()} == {(8, "overlapping_units"), (38, "marker_crosses_unit")}


def test_blocks_against_their_source(spark):
    text = "#META#Header#End#\n# 1 one %~% two\n~~more ms12 PageV02P003\n![a b](x/y.png)\n\n### | head\n"
    docs = spark.createDataFrame([("d", text, "mixed_prose_ocr")], "k string, text string, profile string")
    lines = marked.source_lines(marked.split_sources(docs, "k", "text"), "k")
    blocks = parsing.parse(lines.withColumn("profile", F.lit("mixed_prose_ocr")), "k", "profile")
    assert corpus.block_violations(blocks, lines, "k").count() == 0
    told = {r.block_type: r for r in corpus.described(blocks, "k").collect()}
    assert (told["page_marker"].page_volume, told["page_marker"].page_number) == (2, 3) and told["milestone"].milestone == 12 and told["milestone"].content_text == ""
    assert (told["image_reference"].image_alt, told["image_reference"].image_name) == ("a b", "y.png") and told["verse"].verse_number == 1 and told["heading"].heading_level == 3
    bad = blocks.withColumn("char_start", F.col("char_start") + F.when(F.col("block_type") == "milestone", 1).otherwise(0)).where("block_type <> 'image_reference'")
    issues = {(r.issue) for r in corpus.block_violations(bad, lines, "k").collect()}
    assert issues == {"gap", "text_differs"}
    at = {r.char: r.line_number for r in corpus.line_of_character(spark.createDataFrame([("d", 19), ("d", 40), ("d", 5000)], "k string, char long"), lines, "k").collect()}
    assert at[19] == 2 and at[40] == 3 and at[5000] is None
    expected = spark.createDataFrame([("d", "verse", 1), ("d", "heading", 2), ("d", "section", 1)], "k string, block_type string, n long")
    assert {(r.block_type, r.expected, r.found) for r in corpus.count_differences(blocks, expected, "k").collect()} == {("heading", 2, 1), ("section", 1, 0)}
    samples = spark.createDataFrame([("a", []), ("b", ["x"]), ("c", None)], "k string, blocks array<string>")
    drafts = spark.createDataFrame([("a", ["n"]), ("b", ["n"])], "k string, blocks array<string>")
    assert {r.k: (r.blocks, r.drafted) for r in corpus.with_draft(samples, drafts, "k").collect()} == {"a": (["n"], True), "b": (["x"], False), "c": (None, False)}
    assert {r.k: r.blocks for r in corpus.with_draft(samples, drafts, "k", True).collect()}["b"] == ["n"]


def test_corpus_gate(spark):
    versions = spark.createDataFrame([("a", True, True), ("a", True, True), ("b", False, True), ("c", True, None)], "k string, is_canonical boolean, include_in_index boolean")
    metrics = spark.createDataFrame([("a", True, 5, 2), ("b", False, 6, 1), ("z", True, 1, 1)], "k string, lossless boolean, body_chars long, n_blocks long")
    found = corpus.corpus_violations(versions, metrics, "k")
    assert {tuple(r) for r in found.collect()} == {("a", "repeated_version"), ("b", "not_lossless"), ("c", "no_source"), ("z", "unexpected_source")}
    with pytest.raises(ValueError):
        corpus.require_clean(found)
    corpus.require_clean(found.limit(0))
    m = corpus.corpus_measures(versions, metrics, "k").first()
    assert (m.n_versions, m.n_indexable, m.n_canonical, m.n_reference, m.body_chars, m.all_lossless) == (4, 2, 3, 1, 16, False)


def test_metadata_files(spark):
    strict = "00#VERS#URI######: v-per1\n90#VERS#ISSUES###: a, b\nlist: [1, 2]\n80#VERS#LINKS####: https://x.org/y\n"
    loose = "  early\nstray\n# comment\n---\n00#AUTH#URI######: A: b: c\n  goes on: here\n\n  and here\nattached\n10#AUTH#SHUHRA#AR: TODO\n10#AUTH#SHUHRA#EN: Name\n"
    files = spark.createDataFrame([("v-per1", "version_yml", strict), ("v-per1", "author_yml", loose), ("n", "version_yml", None)], "version_id string, source string, text string")
    rows = metadata.yaml_fields(files)
    got = {(r.source, r.field): r for r in rows.where("field IS NOT NULL").collect()}
    assert got["version_yml", "list"].status == "malformed" and got["author_yml", metadata.AUTHOR_URI].value == "A: b: c\ngoes on: here\n\nand here\nattached"
    assert got["author_yml", metadata.NAME_AR].status == "placeholder" and got["author_yml", metadata.NAME_AR].line_number == 10
    assert sorted((r.line_number, r.issue) for r in rows.where("field IS NULL").collect()) == [(1, "orphan_continuation_line"), (2, "unparsed_yaml_line"), (9, "unparsed_yaml_line_attached")]
    header = spark.createDataFrame([("v-per1", "text_header", 1, "avg transcription confidence", "high", "valid", None)], rows.schema)
    versions = spark.createDataFrame([("v-per1", "w", "A", "p", True, True), ("odd", "w2", "B", "p", False, False)], "version_id string, work_id string, author_id string, profile string, is_canonical boolean, include_in_index boolean")
    works = spark.createDataFrame([("w", "T")], "work_id string, title_fa string")
    docs = {r.version_id: r for r in metadata.document_metadata(versions, works, rows.unionByName(header)).collect()}
    d = docs["v-per1"]
    assert (d.author_name, d.title_fa, d.language, d.source_url, d.text_quality, d.ocr_confidence) == ("Name", "T", "Persian", "https://x.org/y", ["a", "b"], None)
    assert {"author_uri_mismatch", "missing_work_uri", "invalid_ocr_confidence", "placeholder_value", "non_scalar_value"} <= set(d.issues) and "version_uri_mismatch" not in d.issues
    assert docs["odd"].author_name == "B" and {"missing_version_uri", "missing_language_code"} <= set(docs["odd"].issues)
    assert metadata.get_first(rows, metadata.NAME_EN).first().value == "Name" and metadata.of_status(rows, "placeholder").count() == 1


def test_metadata_files_from_disk(spark, tmp_path):
    (tmp_path / "w.v.yml").write_text("﻿00#VERS#URI######: w.v\n", encoding="utf-8")
    rows = metadata.yaml_fields(metadata.read_metadata_files(spark, str(tmp_path), "version_yml")).collect()
    assert [(r.version_id, r.field, r.value) for r in rows] == [("w.v", metadata.VERSION_URI, "w.v")]


PASSAGE = {"author_id": "a", "author_name": "n", "work_id": "w", "work_title": "t", "profile": "p", "kind": "diwan", "previous_passage_id": None, "next_passage_id": None, "word_count": 2, "unit_count": 1, "member_count": 1}
TYPES = ", ".join(f"{c} {'int' if c in ('ordinal', 'word_count', 'unit_count', 'member_count') else 'string'}" for c in stores.STORE_COLUMNS)


def stored(spark, texts):
    rows = [PASSAGE | {"passage_id": f"v:passage_{k:06d}", "version_id": "v", "ordinal": k, "display_text": t, "retrieval_text": t, "search_alias_text": t} for k, t in enumerate(texts, 1)]
    return spark.createDataFrame([tuple(r[c] for c in stores.STORE_COLUMNS) for r in rows], TYPES)


def test_stores_open_as_they_were_written(spark, tmp_path):
    p = stored(spark, ["red rose", "blue sea", "red sea"])
    stores.write_store(p, str(tmp_path / "s"))
    assert sorted(map(tuple, stores.open_store(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, p.collect()))
    with pytest.raises(Exception):
        stores.write_store(p, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="repeated"):
        stores.write_store(p.union(p), str(tmp_path / "t"))
    index = lexical.build_index(p, "passage_id", "search_alias_text")
    stores.write_index(index, str(tmp_path / "i"))
    q = lexical.query_terms(spark.createDataFrame([("q", "red sea")], "query_id string, q string"), "query_id", "q")
    again = stores.open_index(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, lexical.search_any(again, q).collect())) == sorted(map(tuple, lexical.search_any(index, q).collect()))
    vectors = p.select("passage_id", dense.encoded(F.col("retrieval_text"), dense.HashingEncoder(8)).alias("e"))
    stores.write_vectors(vectors, "passage_id", "e", str(tmp_path / "v"), "hashing")
    rows, told = stores.open_vectors(spark, str(tmp_path / "v"))
    assert rows.count() == 3 and told["model"] == "hashing" and told["dimension"] == 8
    with pytest.raises(ValueError):
        stores.open_store(spark, str(tmp_path / "v"))
    p.limit(1).select(*stores.STORE_COLUMNS).write.mode("append").partitionBy("version_id").parquet(str(tmp_path / "s" / "rows"))
    with pytest.raises(ValueError, match="manifest"):
        stores.open_store(spark, str(tmp_path / "s"))


def test_matrix_file(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(10, 3)).astype(np.float32)
    np.save(tmp_path / "m.npy", m)
    got = {r.row_index: r.vector for r in stores.read_matrix(spark, str(tmp_path / "m.npy"), 4).collect()}
    assert len(got) == 10 and all(np.allclose(got[k], m[k]) for k in range(10))
    np.save(tmp_path / "d.npy", m.astype(float))
    with pytest.raises(ValueError):
        stores.read_matrix(spark, str(tmp_path / "d.npy"))


def corpus_of(spark):
    p = stored(spark, ["the red rose of the garden", "the blue sea", "a red sea and a red sky", "nothing here"])
    encoder = dense.HashingEncoder(32)
    vectors = p.select(F.col("passage_id").alias("key"), dense.encoded(F.col("retrieval_text"), encoder).alias("vector"))
    aliases = spark.createDataFrame([("x", "author", False, "Outsider"), ("a", "author", True, "Insider")], "entity_id string, kind string, in_corpus boolean, alias string")
    links = spark.createDataFrame([("a", "v")], "entity_id string, version_id string")
    zones = spark.createDataFrame([("v", 1, 4, "authorial", 4)], "version_id string, start_ordinal int, end_ordinal int, role string, expected_passage_count int")
    return search.Corpus(lexical.build_index(p, "passage_id", "search_alias_text"), vectors, encoder, p, aliases, links, zones)


def test_one_search_call(spark):
    c = corpus_of(spark)
    q = spark.createDataFrame([("q1", "red sea"), ("q2", "red sea by Outsider"), ("q3", None), ("q4", " ")], "query_id string, t string")
    run = search.hybrid_search(c, q, "t", limit=3)
    assert search.run_violations(run).count() == 0
    lex = {r.passage_id: r.lexical_rank for r in run.lexical.where("query_id = 'q1'").collect()}
    near = {r.passage_id: r.dense_rank for r in run.dense.where("query_id = 'q1'").collect()}
    score = lambda p: (2 / (60 + lex[p]) if p in lex else 0) + (1 / (60 + near[p]) if p in near else 0)
    want = sorted({*lex, *near}, key=lambda p: (-round(score(p), 12), lex.get(p, 99), near.get(p, 99), p))[:3]
    got = [r.passage_id for r in run.hybrid.where("query_id = 'q1'").orderBy("hybrid_rank").collect()]
    assert got == want and got[0] == "v:passage_000003"
    answers = {r.query_id: r for r in search.search(c, q, "t").collect()}
    assert set(answers) == {"q1", "q2", "q3", "q4"}
    first = answers["q1"].passages[0]
    assert answers["q1"].action == "return_results" and first.reference.ordinal == 3 and first.scores.lexical_rank == 1 and first.snippet == "a red sea and a red sky"
    assert answers["q2"].reason == "known_out_of_corpus_scope" and answers["q2"].passages == [] and answers["q2"].n_diagnostic > 0
    assert answers["q3"].reason == answers["q4"].reason == "no_hybrid_hits"
    moved = search.Run(run.lexical, run.dense, run.hybrid.withColumn("dense_rank", F.col("dense_rank") + 1))
    assert {r.issue for r in search.run_violations(moved).collect()} == {"dense_rank_of_another_hit"}
    with pytest.raises(ValueError):
        search.hybrid_search(c, q, "t", limit=101)
    with pytest.raises(ValueError, match="stored"):
        search.search(search.Corpus(**{**c.__dict__, "store": c.store.where("ordinal <> 3")}), q, "t")


def test_violations_of_left_out_ranks_and_scores(spark):
    c = corpus_of(spark)
    q = spark.createDataFrame([("q1", "red sea"), ("q2", "blue")], "query_id string, t string")
    run = search.hybrid_search(c, q, "t", limit=3, config=FusionConfig(lexical_weight=3.0))
    found = lambda run: {(r.query_id, r.passage_id, r.issue) for r in search.run_violations(run).collect()}
    hit = run.hybrid.where("query_id = 'q1' AND hybrid_rank = 1").first()
    change = lambda c, to: run.hybrid.withColumn(c, F.when((F.col("query_id") == "q1") & (F.col("hybrid_rank") == 1), F.expr(to)).otherwise(F.col(c)))
    again = lambda hybrid: found(search.Run(run.lexical, run.dense, hybrid, None, run.config))
    assert found(run) == set() and again(run.hybrid) == set()
    assert again(change("fusion_score", "fusion_score + 0.001")) == again(change("fusion_score", "NULL")) == {("q1", hit.passage_id, "score_of_other_ranks")}
    assert again(change("lexical_rank", "CAST(NULL AS INT)")) == {("q1", hit.passage_id, "lexical_rank_left_out")}
    lists = search.Lists(run.lists.passages, run.lists.found, run.lists.hybrid.withColumn("fusion_score", F.col("fusion_score") * 2).withColumn("dense_rank", F.col("dense_rank") + 1))
    by = {issue: n for issue, n in search.run_violations(search.Run(run.lexical, run.dense, run.hybrid, lists, run.config)).groupBy("issue").count().collect()}
    assert by == {"score_of_other_ranks": run.hybrid.count(), "dense_rank_of_another_hit": run.hybrid.where("dense_rank IS NOT NULL").count()}


def test_features_of_lists(spark):
    c = corpus_of(spark)
    q = spark.createDataFrame([("q1", "red sea"), ("q2", "blue"), ("q3", "absent"), ("q4", None)], "query_id string, t string")
    run = search.hybrid_search(c, q, "t", limit=3)
    want = evidence.rank_features(run.hybrid, run.lexical, run.dense)
    assert sorted(map(tuple, evidence.list_features(run.hybrid, run.lists.found).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    best = search.search(c, q, "t").where("query_id = 'q1'").first().passages[0]
    assert best.scores.dense_cosine_score == run.dense.where(f"query_id = 'q1' AND dense_rank = {best.scores.dense_rank}").first().dense_cosine_score


def test_hits_and_catalog_checks(spark):
    p = stored(spark, ["x", "y"])
    hits = spark.createDataFrame([("q", "v:passage_000001", "v", "diwan"), ("q", "v:passage_000002", "u", "diwan"), ("q", "gone", "v", "diwan")], "query_id string, passage_id string, version_id string, kind string")
    assert {(r.passage_id, r.issue) for r in policy.disagreeing_hits(hits, p).collect()} == {("v:passage_000002", "version_differs"), ("gone", "not_stored")}
    aliases = spark.createDataFrame([("a", "author", True, "Same"), ("b", "author", False, "same "), ("c", "work", True, "C"), ("c", "work", False, "C2")], "entity_id string, kind string, in_corpus boolean, alias string")
    versions = spark.createDataFrame([("a", "w")], "author_id string, work_id string")
    found = {tuple(r) for r in search.catalog_violations(aliases, versions).collect()}
    assert found == {("a", "shared_alias"), ("b", "shared_alias"), ("c", "repeated_entity"), ("c", "without_version"), ("w", "not_in_catalog")}


def test_shared_folder_is_refused_on_a_cluster():
    class Conf:
        def get(self, name):
            return None

    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    with pytest.raises(ValueError):
        shared_folder(Cluster())


def test_response_is_json(spark):
    c = corpus_of(spark)
    q = spark.createDataFrame([("q1", "red sea")], "query_id string, t string")
    row = search.search(c, q, "t").select(F.to_json(F.struct("*")).alias("j")).first()
    assert json.loads(row.j)["passages"][0]["reference"]["version_id"] == "v"


def test_markers_within_units(spark):
    u = spark.createDataFrame([("k", "a", 0, 10), ("k", "b", 20, 40)], "k string, unit_id string, char_start long, char_end long")
    m = spark.createDataFrame([("k", 2, 4, "page_marker"), ("k", 12, 14, "page_marker"), ("k", 20, 24, "milestone"), ("k", 30, 33, "image_reference"), ("k", 38, 44, "page_marker")], "k string, char_start long, char_end long, block_type string")
    got = {r.unit_id: (r.n_pages, r.n_images, r.n_milestones, r.spans_page) for r in units.spanned_markers(u, m, "k").collect()}
    assert got == {"a": (1, 0, 0, True), "b": (0, 1, 1, False)}
    g = spark.createDataFrame([("x", None), ("x", "x"), ("x", "y"), (None, "y")], "g string, n string")
    own, clash = units.own_group(F.col("g"), F.col("n"))
    assert [tuple(r) for r in g.select(own, clash).collect()] == [("x", False), ("x", False), ("x", True), ("y", False)]
    assert spark.range(1).select(units.attribute_map(F.expr("array(struct('a', 1))"))).first()[0] == {"a": 1}


def test_catalog_projections(spark):
    data = {"works": {"w": {"title_fa": "T", "profile": "p", "canonical_version": "w.a", "include_in_index": False, "reference_versions": ["w.b"]}, "x": {"title_fa": "U", "profile": "p", "canonical_version": "x.a"}}}
    v = catalogs.manifest_versions(spark, data)
    ids = lambda df: sorted(r.version_id for r in df.collect())
    assert ids(catalogs.canonical_versions(v)) == ["w.a", "x.a"] and ids(catalogs.reference_versions(v)) == ["w.b"] and ids(catalogs.indexable_versions(v)) == ["x.a"] and ids(catalogs.work_versions(v, "w")) == ["w.a", "w.b"]
    scope = {"in_corpus": {"authors": {"b": {"label_fa": "B", "aliases": ["b2"]}, "a": {"label_fa": "A", "aliases": ["a2"]}}, "works": {}}, "known_out_of_corpus": {"authors": {"c": {"label_fa": "C", "aliases": ["c2"]}}, "works": {}}}
    e = catalogs.scope_entities(spark, scope)
    assert [r.entity_id for r in catalogs.entities_of(e, "author").collect()] == ["b", "a"] and catalogs.entity(e, "c").count() == 2
    z = catalogs.paratext_zones(spark, {"versions": {"v": {"expected_passage_count": 3, "zones": [{"start_ordinal": 1, "end_ordinal": 3, "role": "authorial"}]}}})
    assert catalogs.expected_counts(z).first()[:] == ("v", 3)
