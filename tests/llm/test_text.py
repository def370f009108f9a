import unicodedata

import pickle

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import arrowtext as at
from folioflow.llm import abuse, canonical, chunking, language, scans, sentences

TEXTS = st.lists(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=30), max_size=6)


def united(*texts):
    return canonical.unite_column(pa.array(texts, pa.string())).to_pylist()


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_arrow_round_trip(texts):
    cp, off = at.decode(pa.array(texts, pa.string()))
    assert at.encode(cp, off).to_pylist() == texts


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_unite_is_idempotent_and_independent_of_neighbours(texts):
    once = united(*texts)
    assert united(*once) == once
    assert [united(t)[0] for t in texts] == once


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aeiọ̧̈̂éạو ئأإآٔٓٱक़ऩािd", max_size=12), max_size=5))
def test_composition_is_nfc(texts):
    cp, off = canonical.visible_form(*at.decode(pa.array([unicodedata.normalize("NFD", t) for t in texts], pa.string())))
    assert at.encode(cp, off).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


def test_what_unites_and_what_does_not():
    same = [("ﺩﺭ", "در"), ("ｉｎ", "in"), ("k\u0435\u0443", "key"), ("ي ك ١", "ی ک 1"), ("a​b c", "ab c"), ("مدرسە", "مدرسه"), ("آ", "آ"), ("أمة", "امه"), ("⼈", "人")]
    for a, b in same:
        assert united(a) == united(b)
    for a, b in (("سُحر", "سحر"), ("a.", "a!"), ("A", "a"), ("a\nb", "a b"), ("کهن", "کنه"), ("x²", "x2")):
        assert united(a) != united(b)
    assert united(None, "", " \n ") == [None, "", ""]


def test_look_alike_pairs(spark):
    rows = [("1", "ab c", "r", "a"), ("2", "аb c", "r", "a"), ("3", "ab c", "r", "a"), ("4", "ab c", "r", None), ("5", "ab d", "r", "a"), ("6", None, "r", "a"), ("1", "ab c", "r", "a")]
    df = spark.createDataFrame(rows, "passage_id string, d string, r string, a string").withColumn("look_id", F.lit("clash"))
    got = {tuple(r) for r in canonical.look_alike_pairs(df, "passage_id", "d", ["d", "r", "a"]).collect()}
    assert got == {("1", "2"), ("2", "3"), ("1", "4"), ("2", "4"), ("3", "4")}
    assert canonical.look_alike_pairs(df.limit(0), "passage_id", "d", ["d"]).count() == 0
    assert canonical.unify_text(df, ["passage_id", "look_id"], ["d"]).columns == ["passage_id", "look_id", "d_unified"]


CHUNK = chunking.ChunkConfig(max_words=30, max_chars=200, overlap_words=4, overlap_chars=20, window=8)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n!文。字  ́", max_size=1500))
def test_pieces_keep_limits_and_tile(text):
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    pieces = chunking.pieces_of(cp, CHUNK)
    assert "".join(text[c:e] for _, c, e, _ in pieces) == text
    for s, c, e, w in pieces:
        assert e - s <= 200 and w <= 30 and s <= c <= e
        assert len([x for x in text[s:e].split()]) in (w, w - 1, w + 1)


def test_edits_stay_local():
    text = " ".join(f"w{k * 7919 % 1000}" + ("." if k % 9 == 0 else "") for k in range(3000))
    ends = lambda t: [e for _, _, e, _ in chunking.pieces_of(np.frombuffer(t.encode("utf-32-le"), np.uint32), chunking.ChunkConfig())]
    a, b = ends(text), ends(text[:2000] + "new words here " + text[2000:])
    assert len(set(a) & {e - 15 for e in b}) >= len(a) - 4


def test_oversized_follows_the_text(spark):
    rows = [("w", "a " * 301, 1), ("x", "a " * 300, 999), ("c", "文" * 2001, 1), ("d", "文" * 2000, 1), ("n", None, 5000), ("e", "", 1), ("s", "a " * 301, 1)]
    df = spark.createDataFrame(rows, "passage_id string, t string, word_count int").withColumn("piece_no", F.lit(1))
    assert {r.passage_id for r in chunking.oversized(df, "passage_id", "t").collect()} == {"w", "c", "s"}
    pieces = chunking.chunk(df, "passage_id", "t").where("passage_id = 'w'").orderBy("piece_no").collect()
    assert [p.n_words <= 300 for p in pieces] == [True, True] and pieces[1].core_start - pieces[1].char_start == 40
    assert chunking.chunk(df.limit(0), "passage_id", "t").count() == 0
    with pytest.raises(ValueError):
        chunking.ChunkConfig(overlap_words=200)


def test_language_network_learns_and_decodes():
    words = {"eng": "the river of every garden was near and there is more", "fre": "le fleuve de chaque jardin était près et il y a plus", "per": "رود هر باغ نزدیک بود و نه آن که بیشتر است", "ara": "كان نهر كل بستان قريبا إلى هذا الذي ليس من"}
    rng = np.random.default_rng(1)
    make = lambda lang: " ".join(rng.choice(words[lang].split(), 12)) + ". "
    rows = [("".join(make(lang) for _ in range(4)), lang, False) for lang in words for _ in range(40)]
    config = language.LanguageConfig(epochs=4, filters=8)
    net = language.fit(rows, config)
    texts = [make(a) * 2 + make(b) * 2 for a in words for b in words]
    wanted = [{a, b} for a in words for b in words]
    cp, off = canonical.visible_form(*at.decode(pa.array(texts + ["", "12 !", None], pa.string())))
    s = language.segments_of(cp, off, np.zeros(len(texts) + 3, bool), net, config)
    got = [{language.LANGUAGES[x] for x in s.language[s.row == k]} for k in range(len(texts) + 3)]
    assert sum(a == b for a, b in zip(got, wanted)) >= len(texts) - 3
    assert got[-3:] == [set(), set(), set()]
    assert language.fit([], config) is None


def test_units_keep_abbreviations_and_numbers_and_mark_titles():
    texts = ["It is. Prof. A. B. Bell bought it, cf. fol. 825 of it. Yes.", "وزن آن ۸٫۲۹۳ من و ۲۷۶.۵ درم بود. رفت.", "रंग था। डॉ. बेल ने पृ. 5 पढ़ा।", "در سال ۵ ه.ق. The end came. Well... so it is.", "Old Book\n\nIt is.\n\nOld Book | 12"]
    cp, off = canonical.visible_form(*at.decode(pa.array(texts)))
    u = language.units_of(cp, off, np.zeros(len(texts), bool))
    whole = at.encode(cp, off).to_pylist()
    got = [[whole[r][a:b].strip() for q, a, b in zip(u.row, u.start, u.end) if q == r and whole[r][a:b].strip()] for r in range(len(texts))]
    assert got[0] == ["It is.", "Prof. A. B. Bell bought it, cf. fol. 825 of it.", "Yes."]
    assert [len(x) for x in got[1:3]] == [2, 2]
    assert got[3] == ["در سال ۵ ه.ق.", "The end came.", "Well... so it is."]
    assert [t for t, a in zip(u.title[u.row == 4], u.words[u.row == 4]) if a] == [True, False, True]
    assert {*language.windows_of(u, language.LanguageConfig())[1]} == {k for k in range(len(u.row)) if u.words[k]}


def test_short_persian_units_that_look_arabic():
    cp, off = canonical.visible_form(*at.decode(pa.array(["باغ و ساحل به بلبل سبز رفت", "باغ الملك به"])))
    u = language.units_of(cp, off, np.zeros(2, bool))
    logp = np.full((2, len(language.LANGUAGES)), -9.0)
    logp[:, language.LANGUAGES.index("ara")] = -0.1
    language.prefer_persian(logp, u, np.arange(2), language.LanguageConfig())
    assert [language.LANGUAGES[k] for k in logp.argmax(1)] == ["per", "ara"]


def test_labels(spark):
    rows = spark.createDataFrame([("fa-IR",), ("PER",), ("per, ENG",), ("tur+zho",), ("und",), ("xxx",), ("",), (None,), ("deu",)], "lang string")
    got = [sorted(r.x) for r in rows.select(language.label_languages(F.col("lang")).alias("x")).collect()]
    assert got == [["per"], ["per"], ["eng", "per"], ["chi", "tur"], [], [], [], [], ["ger"]]


def test_languages_of_empty_tables(spark):
    p = spark.createDataFrame([], "passage_id string, version_id string, display_text string, kind string")
    labels = spark.createDataFrame([], "passage_id string, lang string, labelled_at timestamp")
    assert language.unlabelled_languages(p, labels).count() == 0


@pytest.fixture(scope="module")
def boundary():
    rng = np.random.default_rng(8)
    nouns = "book river house tree road garden".split()
    texts = []
    for k in range(80):
        a, b, c, d = rng.choice(nouns, 4)
        texts.append(f"Dr. Bell saw the {a} of King{k % 7} in vol. {k} of the {b}. Every {c} grew near the {d}. He left the {a}.\n\nThey came, cf. fol. {k}. The {b} was near the {c}. They left.\n\nHe came. Every {a} was long.")
    counts = sentences.count_tokens(texts)
    return sentences.fit([(t, *c) for t, c in counts.items()], texts, sentences.SentenceConfig(epochs=8))


def test_sentence_ends(boundary):
    cut = lambda t: [t[a:b].strip() for a, b in zip([0, *sentences.sentence_ends(t, False, boundary)], sentences.sentence_ends(t, False, boundary))]
    assert cut("Dr. Bell came in vol. 3 of the book. He left.") == ["Dr. Bell came in vol. 3 of the book.", "He left."]
    assert cut('He said: "Every tree grew. He left." They came.') == ['He said: "Every tree grew. He left."', "They came."]
    assert cut("Heading\n\nIt weighs 3.5 pounds! They\ncame… and left? Yes") == ["Heading", "It weighs 3.5 pounds!", "They\ncame… and left?", "Yes"]
    assert cut("每个春天。没有人！「他说。再说。」好") == ["每个春天。", "没有人！", "「他说。再说。」", "好"]
    assert cut("آمد؛ رفت؟ «گفت. باز» ماند. ") == ["آمد؛", "رفت؟", "«گفت. باز» ماند."]
    assert cut("") == [] and cut(" \n ") == []
    assert sentences.sentence_ends("a b\nc. d\n\ne", True, boundary) == [3, 8, 11]


def test_sentences_table(spark, boundary):
    df = spark.createDataFrame([("a", "He left. They came.", "x"), ("a", "He left. They came.", "x"), ("n", None, "x"), ("e", " ", "x")], "passage_id string, t string, end_char string")
    rows = sentences.sentences(df, "passage_id", "t", F.lit(False), boundary, with_text=True).collect()
    assert [(r.passage_id, r.sentence) for r in rows] == [("a", "He left."), ("a", "They came.")] * 2
    model = sentences.boundary_model(df.limit(0), "passage_id", "t", F.lit(True))
    assert sentences.sentence_ends("A b. C d.", False, model)[-1] == 9


def test_scan_noise(spark):
    clean = "the river was near the garden and every house stood in the morning light of the old garden wall\nthey came to the river in the morning and saw the garden of the house near the wall"
    rows = [(f"c{k}", clean, "v", "mixed_prose_ocr") for k in range(40)]
    rows += [(f"m{k}", clean.replace(a, b, 1), "v", "raw_ocr_reference") for k, (a, b) in enumerate([("river", "rivcr"), ("every", "cvery"), ("garden", "gardcn"), ("the house", "thc house"), ("morning", "m0rning")] * 2)]
    rows += [("h", "Old Book  12\n" + clean, "v", "mixed_prose_ocr"), ("h2", "Old Book\n" + clean, "v", "mixed_prose_ocr"), ("h3", clean + "\n13 Old Book", "v", "mixed_prose_ocr")]
    rows += [("p", clean.replace("\n", "\n- 7 -\n"), "v", "mixed_prose_ocr"), ("y", clean.replace("morning light", "mor-\n[9]\nning light"), "v", "mixed_prose_ocr")]
    rows += [("s", clean.replace("garden", "gar■den", 1), "v", "mixed_prose_ocr"), ("n", None, "v", "mixed_prose_ocr"), ("e", "", "v", "mixed_prose_ocr"), ("z", clean.replace("river", "rivcr"), "v", "structured_poetry")]
    df = spark.createDataFrame(rows, "passage_id string, t string, version_id string, profile string").withColumn("noise", F.lit("x"))
    config = scans.ScanConfig(least_types=2)
    got = {(r.passage_id, r.noise) for r in scans.noises(df, "passage_id", "t", "version_id", "profile", config).collect()}
    want = {(f"m{k}", "misread") for k in range(10)} | {(h, "header") for h in ("h", "h2", "h3")} | {("p", "pageno"), ("y", "hyphen"), ("y", "pageno"), ("s", "misread")}
    assert got == want
    channel = scans.fit(df.where("t IS NOT NULL AND profile <> 'structured_poetry'"), "t", "version_id", config)
    fixed = {r.passage_id: r.repaired_text for r in scans.repaired(df, "passage_id", "t", "version_id", channel).collect()}
    plain = clean.replace("\n", " ")
    assert fixed["y"] == fixed["p"] == fixed["h"] == fixed["s"] == fixed["m0"] == plain and fixed["n"] is None and fixed["e"] == ""
    assert scans.noises(df.limit(0), "passage_id", "t", "version_id", "profile").count() == 0


def test_headers_without_numbers_and_seen_once(spark):
    one = "the river was near the garden and every house\nstood in the morning light of the old garden\nwall where they came to the river again."
    two = "they saw the wall of the house in the morning\nand the garden near the river was full of the\nlight of every house that stood near by it."
    put = lambda text, k, line: "\n".join(text.split("\n")[:k] + [line] + text.split("\n")[k:])
    rows = [("a", put(one, 1, "Bell — Old Book"), "v"), ("b", put(two, 2, "Bell — Old Book"), "v"), ("c", put(one, 0, "Bell — Old Book"), "v")]
    rows += [("d", put(one, 2, "Tree Road"), "w"), ("e", put(one, 2, "Tree Road"), "w"), ("f", put(two, 1, "Green Hill | 252"), "w"), ("g", put(two, 3, "Hill 12"), "w")]
    rows += [("h", put(two, 2, "Book Five Old Book"), "v"), ("i", one, "v"), ("j", two, "w"), ("k", "Green Tree\n\n" + one, "v"), ("l", "Green Tree\n\n" + two, "v")]
    rows += [("m", put(one, 1, "113 Lost Water"), "alone")]
    df = spark.createDataFrame([(*r, "mixed_prose_ocr") for r in rows], "passage_id string, t string, version_id string, profile string")
    got = {r.passage_id for r in scans.noises(df, "passage_id", "t", "version_id", "profile").where("noise = 'header'").collect()}
    assert got == {"a", "b", "c", "f", "h", "m"}  # d and e are copies: their line doesn't recur elsewhere


def test_term_automaton_against_edit_distance():
    terms = {"imbecile": 1, "moron": 0, "schwachkopf": 1}
    auto = abuse.TermAutomaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(2)
    for term in terms:
        for _ in range(300):
            w = list(term)
            for _ in range(rng.integers(0, 3)):
                k = int(rng.integers(0, len(w)))
                w[k : k + int(rng.integers(0, 2))] = [str(rng.choice(list("abcimo")))] if rng.random() < 0.7 else []
            word = "".join(w)
            best = min((distance(word, t), t) for t in terms if distance(word, t) <= terms[t]) if any(distance(word, t) <= e for t, e in terms.items()) else None
            assert (auto.match(word)[0] if auto.match(word) else None) == (best[1] if best else None)
    assert auto.match("i******e") == ["imbecile"]


def test_a_term_spelled_out_alone_is_read():
    scorer = abuse.Scorer(abuse.AbuseConfig(), abuse.Lexicon({"abuse": {"bastard": 1.5, "scumbag": 1.5}, "sexual": {"fuck": 2.5}}, dict.fromkeys(abuse.CATEGORIES, -1.0)))
    assert scorer.document("f u c k") == {2: 1.5}
    assert scorer.document("you b.a.s.t.a.r.d, s.c.u.m.b.a.g") == {0: 2.0}
    assert scorer.document("a sc*mbag, a scumbga, a scuumbag and a b4st4rd") == {0: 2.0}
    again = pickle.loads(pickle.dumps(scorer))
    assert again.lexicon == scorer.lexicon and again.document("f u c k") == {2: 1.5}


def reviewed_documents(rng, n):
    """Documents of meaningless sentences; of a part one sentence is abusive, or only tells of abuse."""
    words = ["".join(rng.choice(list("aeioumnrstlk"), 5)) for _ in range(150)]
    insults, folks = ("morbek", "tarlun", "sovrag"), ("Ulvars", "Benkos")
    rows = []
    for k in range(n):
        parts = [" ".join(rng.choice(words, 7)) for _ in range(5)]
        kind = ("abuse", "hate", "told", *["ok"] * 9)[k % 12]
        insult, folk = str(rng.choice(insults)), str(rng.choice(folks))
        if kind == "abuse":
            parts[2] = f"you filthy {insult} go away"
        elif kind == "hate":
            parts[1] = f"all {folk} are filth and must be expelled"
        elif kind == "told":
            parts[3] = f"the book explains why {insult} is rude"
        rows.append((k, ". ".join(parts) + ".", "ok" if kind == "told" else kind))
    return rows


def test_abuse_is_learned_from_reviews(spark):
    rows = reviewed_documents(np.random.default_rng(8), 1200)
    read = [(k, label) for k, _, label in rows if k % 24 < 12] + [(0, "ok"), (1, None), (5, "ok"), (5, "ok")]
    unread = {k for k, _, _ in rows} - {k for k, _ in read}
    extra = [(9000, None), (9001, ""), (9002, "You filthy m o r b e k go away!"), (9003, "you filthy tarlumn go away"), (9004, "Spam " * 3000 + ". you filthy sovrag go away")]
    df = spark.createDataFrame([(k, t) for k, t, _ in rows] + extra + [(9002, extra[2][1])], "doc_id long, text string")
    df = df.withColumn("source", F.when(F.col("doc_id") >= 9000, " Forum ").when(F.col("doc_id") % 2 == 0, "x")).withColumn("category", F.lit("clash")).withColumn("score", F.lit(9))
    reviews = spark.createDataFrame(read, "doc_id long, label string").withColumn("rater", F.lit("r"))
    lexicon = abuse.learned_lexicon(df, "doc_id", "text", reviews)
    assert lexicon.weights["abuse"]["morbek"] > 0.8 and lexicon.weights["abuse"].get("explains", -1) < 0
    got = {tuple(r) for r in abuse.flagged(df, "doc_id", "text", lexicon).collect()}
    want = {(k, label) for k, _, label in rows if label != "ok"} | {(9002, "abuse"), (9003, "abuse"), (9004, "abuse")}
    assert {x for x in got if x[0] in unread} == {x for x in want if x[0] in unread}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 2
    rates = {(r.source, r.category): (r.n_docs, r.n_flagged) for r in abuse.source_rates(df, "doc_id", "text", "source", lexicon).collect()}
    assert rates["forum", "abuse"] == (5, 3) and rates["unknown", "sexual"][1] == 0
    assert abuse.abuse_scores(df.limit(0), "doc_id", "text", lexicon).count() == 0
    # Without reviews, or without documents, the general words decide.
    bare = abuse.learned_lexicon(df, "doc_id", "text", reviews.limit(0))
    assert bare.weights["abuse"] == abuse.seed_lexicon().weights["abuse"]
    assert abuse.learned_lexicon(df.limit(0), "doc_id", "text", reviews).weights == bare.weights


def test_abuse_quality_on_held_out_reviews():
    rows = reviewed_documents(np.random.default_rng(9), 1200)
    sample = [(t.lower(), label) for _, t, label in rows]
    rng = np.random.default_rng(1)
    sample = [sample[k] for k in rng.permutation(len(sample))]
    asked = abuse.words_asked(sample)
    everywhere = abuse.Background(len(sample), {w: sum(w in {v for c in abuse.clauses(t) for v in c} for t, _ in sample) for w in asked})
    quality = abuse.held_out_quality(sample, everywhere)
    assert quality["abuse"][0] > 0.97 and quality["abuse"][1] > 0.97 and quality["hate"][0] > 0.97 and quality["sexual"][2] == 0
