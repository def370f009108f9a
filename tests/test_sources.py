import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import corpus, inventory, parsing, store, units
from folioflow.sources import catalogs, exports, marked, tables
from folioflow.streaming import ingest

HEAD = "######OpenITI#\n\n#META# 010.Title :: دیوان\n#META# x: NA\n#META# nothing\n#META#Header#End#\n"
POETRY = "### | [ daftar 1 ]\n### باب\n# 1 دل من %~% جان من\n~~ادامه\nPageV01P002\n~~دوم\n\n~~گم\nمتن ms0001 دیگر\n# 2 سر %~% پا PageV01P003\r\n"
PROSE = "~~یتیم\n~~باز\n# بند نخست\n~~ادامه ms0002\n![a](b/c.png)\n~~هنوز\n# مجلس اول\n# شعر %~% نو\n~~پس\nخام\n"
OCR = "~~ PageV01P001\nخط ms12 دیگر ![x](y)\n\nنو"


def sources(spark):
    rows = [("p", HEAD + POETRY, parsing.POETRY), ("m", PROSE, parsing.PROSE), ("o", HEAD + OCR, parsing.RAW_OCR), ("e", "", parsing.PROSE), ("n", None, parsing.PROSE)]
    df = spark.createDataFrame(rows, "id string, text string, profile string")
    s = marked.split_sources(df, "id", "text")
    return s, marked.source_lines(s, "id").join(df.select("id", "profile"), "id")


def test_lines_tile_the_body(spark):
    s, lines = sources(spark)
    got = {r.id: r for r in s.collect()}
    assert got["p"].has_magic and got["p"].header == HEAD and got["p"].body == POETRY and got["p"].body_line_start == 7
    assert got["m"].body == PROSE and got["m"].body_char_start == 0 and "n" not in got
    first = lines.where("id = 'p'").orderBy("line_number").first()
    assert first.line_number == 7 and first.char_start == len(HEAD)


def test_parsing_is_lossless(spark):
    s, lines = sources(spark)
    blocks = parsing.parse(lines, "id", "profile")
    metrics = {r.id: r for r in parsing.parse_metrics(blocks, s, "id").collect()}
    assert all(m.lossless for m in metrics.values()) and set(metrics) == {"p", "m", "o", "e"}
    kinds = lambda k: [(b.block_type, b.group_id) for b in blocks.where(f"id = '{k}'").orderBy("block_no").collect()]
    assert kinds("p") == [
        ("section", "section_0001"), ("heading", "heading_0001"), ("verse", "verse_0001"), ("verse", "verse_0001"), ("page_marker", None), ("verse", "verse_0001"),
        ("blank", None), ("raw", None), ("raw", None), ("milestone", None), ("raw", None), ("verse", "verse_0002"), ("page_marker", None),
    ]
    assert kinds("m") == [
        ("paragraph", "paragraph_0001"), ("paragraph", "paragraph_0001"), ("paragraph", "paragraph_0002"), ("paragraph", "paragraph_0002"), ("milestone", None), ("image_reference", None),
        ("paragraph", "paragraph_0002"), ("section", "section_0001"), ("verse", "verse_0001"), ("paragraph", "paragraph_0003"), ("raw", None),
    ]
    assert [k for k, _ in kinds("o")] == ["page_marker", "raw", "milestone", "raw", "image_reference", "blank", "raw"]


def test_units_and_cleanup(spark):
    _, lines = sources(spark)
    us = units.logical_units(parsing.parse(lines, "id", "profile").where("group_id IS NOT NULL"), "id")
    got = {r.unit_id: r for r in units.cleanup(us).collect()}
    assert got["p:verse_0001"].display_text == "دل من | جان من ادامه دوم"
    assert got["p:verse_0001"].verse_number == 1 and got["p:verse_0001"].has_gaps
    assert got["m:paragraph_0002"].component_count == 3
    h = spark.createDataFrame([("u", "heading", "### | باب [key: one] نو [key: two]"), ("v", "heading", "### |")], "unit_id string, unit_type string, raw_text string")
    rows = {r.unit_id: r for r in units.cleanup(h).collect()}
    assert rows["u"].display_text == "باب نو" and rows["u"].notes == {"key": "one"} and rows["u"].cleanup_issue == "metadata_conflict"
    assert rows["v"].cleanup_issue == "structural_only_unit"
    ctx = {r.unit_id: r for r in units.heading_context(us, "id").collect()}
    assert ctx["p:verse_0002"].heading_id == "p:heading_0001" and ctx["p:verse_0002"].section_id == "p:section_0001"
    pages = parsing.parse(lines, "id", "profile").where("block_type = 'page_marker'").select("id", "char_start", "char_end", F.trim(F.regexp_replace("raw_text", "\\s", "")).alias("label"))
    p = {r.unit_id: r for r in units.page_context(us.select("id", "unit_id", "char_start", "char_end"), pages, "id").collect()}
    assert p["p:verse_0001"].embedded_markers == 1 and p["p:verse_0001"].following == "PageV01P003" and p["p:verse_0002"].preceding == "PageV01P002"


def test_header(spark):
    s, _ = sources(spark)
    rows = [(r.field, r.status, r.issue) for r in marked.header_fields(s, "id").where("id = 'p'").orderBy("line_number").collect()]
    assert rows == [("010.Title", "valid", None), ("x", "placeholder", "placeholder_header_value"), (None, None, "unparsed_header_line")]


def test_coverage_sweep(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 10, 12), ("a", 4, 4), ("b", 1, 2)], "k string, s int, e int")
    got = {r.k: (r.covered, r.covered_twice) for r in parsing.interval_coverage(rows, "k", "s", "e").collect()}
    assert got == {"a": (10, 2), "b": (1, 0)}


def test_catalogs(spark, tmp_path):
    zones = {"versions": {"v": {"expected_passage_count": 3, "zones": [{"start_ordinal": 1, "end_ordinal": 3, "role": "mixed"}]}}}
    assert catalogs.paratext_zones(spark, zones).count() == 1
    zones["versions"]["v"]["expected_passage_count"] = 4
    with pytest.raises(ValueError):
        catalogs.paratext_zones(spark, zones)
    works = {"works": {"A.B": {"profile": "x", "canonical_version": "A.B.v1", "reference_versions": ["A.B.v2"]}}}
    assert {r.version_id: r.include_in_index for r in catalogs.manifest_versions(spark, works).collect()} == {"A.B.v1": True, "A.B.v2": False}
    with pytest.raises(ValueError):
        catalogs.policy_config({"unknown": 1})
    entities = {"in_corpus": {"authors": {"e": {"label_fa": "x", "aliases": ["x", "y"]}}}}
    assert catalogs.scope_entities(spark, entities).count() == 2


def test_evaluation_round_trip(spark, tmp_path):
    q = spark.createDataFrame([("1.0.0", "q1", "متن", "semantic", [("p", 3, None)], ["v"], ["t"], True, None)], tables.EVALUATION_SCHEMA)
    tables.write_evaluation(q, str(tmp_path / "q"))
    back = tables.read_evaluation(spark, str(tmp_path / "q"))
    assert back.select(*q.columns).collect() == q.collect()
    with pytest.raises(ValueError):
        tables.fail_if_any(tables.duplicates(q.union(q), "query_id"), "queries")


def test_source_files(spark, tmp_path):
    (tmp_path / "v1").write_bytes(b"\xef\xbb\xbf" + HEAD.encode())
    assert marked.read_sources(spark, str(tmp_path / "v1")).first().text == HEAD
    (tmp_path / "v2").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception):
        marked.read_sources(spark, str(tmp_path / "v2")).collect()


def test_store_checks(spark):
    s = spark.createDataFrame([("v:1", "v", 1, None, "v:2"), ("v:2", "v", 2, "v:9", None), ("v:4", "v", 4, None, None)], "passage_id string, version_id string, ordinal int, previous_passage_id string, next_passage_id string")
    assert [(r.passage_id, r.issue) for r in store.link_issues(s).collect()] == [("v:2", "previous")]
    assert store.ordinal_report(s).first().n_left_out == 1
    w = spark.createDataFrame([("v:2", 1), ("v:2", 0), ("zz", 2), (None, 3)], "passage_id string, o int")
    assert [(r.passage_id, r.asked_at) for r in store.get_many(s, w, "passage_id", "o").collect()] == [("v:2", 0)]
    assert [r.passage_id for r in store.missing(w, s, "passage_id").collect()] == ["zz"]


def test_streams(spark, tmp_path):
    p = spark.createDataFrame([("a", "x y"), ("b", "y")], "passage_id string, t string")
    p.write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_passages(spark, str(tmp_path / "in"), p)
    ingest.ingest_postings(stream, "passage_id", "t", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.term: r.df for r in ingest.term_totals(spark, str(tmp_path / "out")).collect()} == {"x": 1, "y": 2}
    e = spark.sql("SELECT 1 AS u, timestamp'2024-01-01 00:10:00' AS ts, 'k' AS kind, 2.0D AS v UNION ALL SELECT 1, timestamp'2024-01-01 00:20:00', 'k', 3.0D UNION ALL SELECT 1, timestamp'2024-01-01 02:00:00', 'k', 1.0D")
    assert [r.n for r in ingest.event_windows(e, "ts", "kind", "v").orderBy("window_start").collect()] == [2, 1]
    assert ingest.sessions(e, "u", "ts").count() == 2


def test_parsed_versions_round_trip(spark, tmp_path):
    versions = spark.createDataFrame([("a", "w", "v", "p", True, True)], "author_id string, work_id string, version_id string, profile string, include_in_index boolean, is_canonical boolean")
    blocks = spark.createDataFrame([("v", "v:b0002", "verse", 5, 9, 2, "text", "g"), ("v", "v:b0001", "blank", 0, 5, 1, "\n", None)], "k string, block_id string, block_type string, char_start long, char_end long, line_number int, raw_text string, group_id string")
    docs = exports.parsed_documents(versions, blocks, "k")
    exports.write_parsed(docs, docs.groupBy().count(), str(tmp_path / "p"))
    read = exports.read_parsed(spark, str(tmp_path / "p" / "versions"))
    assert [b.block_id for b in read.first().document.blocks] == ["v:b0001", "v:b0002"]
    bad = docs.withColumn("file", F.lit("other")).union(docs)
    assert {r.issue for r in exports.parsed_violations(bad).collect()} == {"file_differs", "repeated_version"}
    exports.write_passages(spark.createDataFrame([("v", "v:1", "x"), ("v", "v:2", None)], "version_id string, passage_id string, t string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j" / "manifest")).first().line_count == 2 and spark.read.json(str(tmp_path / "j" / "versions")).count() == 2


def test_golden_samples(spark, tmp_path):
    sample = {
        "schema_version": "1", "sample_id": "s", "version_id": "v", "profile": "p", "line_start": 1, "line_end": 2, "char_start": 0, "char_end": 9, "raw_text": "ab\ncdefg\n",
        "lines": [{"line_number": 1, "char_start": 0, "char_end": 3, "text": "ab\n"}, {"line_number": 2, "char_start": 3, "char_end": 9, "text": "cdefg\n"}],
        "annotations": {"status": "done", "blocks": [{"block_id": "b1", "block_type": "raw", "char_start": 0, "char_end": 3, "line_start": 1, "line_end": 1, "raw_text": "ab\n", "group_id": None}, {"block_id": "b2", "block_type": "raw", "char_start": 3, "char_end": 9, "line_start": 2, "line_end": 2, "raw_text": "cdeXg\n", "group_id": None}], "notes": None},
    }
    (tmp_path / "s.json").write_text(json.dumps(sample, indent=1))
    g = exports.read_golden(spark, str(tmp_path / "s.json"))
    assert [(r.block_no, r.issue) for r in corpus.block_violations(exports.golden_blocks(g), exports.golden_lines(g), "sample_id").collect()] == [(2, "text_differs")]
    lines = spark.createDataFrame([("v", 1, 0, 3, "ab\n"), ("v", 2, 3, 8, "cdef\n")], "v string, line_number int, char_start long, char_end long, line string")
    assert [(r.line_number, r.issue) for r in exports.sample_differences(g, lines, "v").collect()] == [(2, "offsets_differ")]
    exports.write_samples(g, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_plain_values_settings_and_codes(spark, tmp_path):
    import datetime
    import enum
    import pathlib

    class Kind(enum.Enum):
        A = "a"

    assert exports.plain_value({1: {Kind.A, None}, "p": (pathlib.PurePosixPath("x/y"), datetime.date(2020, 1, 2), 1.5)}) == {"1": ["a", None], "p": ["x/y", "2020-01-02", 1.5]}
    with pytest.raises(TypeError):
        exports.plain_value(object())
    env = {"FOLIOFLOW_STORE": str(tmp_path), "FOLIOFLOW_INDEX": "/nowhere/i", "FOLIOFLOW_VECTORS": str(tmp_path), "FOLIOFLOW_SUGGESTIONS": "no"}
    settings = exports.ServiceSettings.of(env)
    assert settings.limit == 10 and not settings.suggestions and settings.missing_paths(spark) == ["/nowhere/i"]
    for wrong in ({}, env | {"FOLIOFLOW_LIMIT": "0"}, env | {"FOLIOFLOW_SUGGESTIONS": "maybe"}):
        with pytest.raises(ValueError):
            exports.ServiceSettings.of(wrong)
    df = spark.createDataFrame([(["a", "b"], '["c"]', "{"), (None, None, None)], "l array<string>, t string, u string")
    assert df.select(exports.encoded_list("l"), exports.decoded_list("t")).first()[:] == ('["a","b"]', ["c"])
    assert exports.exit_code(df) == 1 and exports.exit_code(df.limit(0)) == 0 and exports.exit_code(None) == 2
    assert json.loads(exports.report_json(n=df.groupBy().count()))["n"] == [{"count": 2}]


def test_inventory(spark):
    df = spark.createDataFrame([("v", "a1٢ 12"), ("v", "12 ۳"), (None, "é"), ("w", None)], "k string, t string")
    assert {(r.k, r.code_point): r.n for r in inventory.code_points(df, "k", "t").collect()}["v", ord("1")] == 3
    assert [(r.kind, r.found, r.n) for r in inventory.digit_examples(df, "k", "t", 1).orderBy("kind").collect()] == [("ascii", "12", 2), ("mixed", "1٢", 1), ("persian", "۳", 1)]
