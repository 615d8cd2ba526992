import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm.language import LANGUAGES, BitmaskFilter, canonical_language, detect_languages, fit_language_filter, language_segments, ngrams, train_filter
from lodestone.llm.leakage import find_leaks, plain_words, tiles
from lodestone.llm.personal import candidates, find_personal, fit_span_model, redact
from lodestone.llm.queries import p6_found
from lodestone.llm.sentences import sentence_spans, sentences
from lodestone.llm.toxicity import BlockMaxIndex, Voter, features, fit_voter, score_documents, unmask

SENTENCES = [
    ["They opened at 5 p.m. on Monday.", "Dr. Lee paid 3.50 for no. 12!"],
    ["We waited... but it was fine 😋", "She asked \"Is it ok?\" and left."],
    ["Das kostet z. B. 3,50 Euro pro Pers. und ist viel.", "Am 3. Oktober war zu."],
    ["El Sr. Gil cobró 5 euros.", "«Vuelva mañana.» fue todo."],
    ["1. Sit, 2. order soup, 3. leave.", "Done (really. Trust me) now."],
]
JOINED = ["昨日は良かった。", "「また来て。」と言われた。", "本当ですか？"]


@pytest.mark.parametrize("parts", SENTENCES)
def test_sentences_with_spaces(parts):
    t = " ".join(parts)
    assert [t[a:b] for a, b in sentence_spans(t)] == parts


def test_sentences_without_spaces():
    t = "".join(JOINED)
    assert [t[a:b] for a, b in sentence_spans(t)] == JOINED
    t = "ok for 9 dollars.The next one!Last"
    assert [t[a:b] for a, b in sentence_spans(t)] == ["ok for 9 dollars.", "The next one!", "Last"]
    t = "ซุปอร่อยมาก ห้องน้ำสะอาด"
    assert [t[a:b] for a, b in sentence_spans(t)] == t.split(" ")
    t = "यह अच्छा है। हाँ!"
    assert [t[a:b] for a, b in sentence_spans(t)] == ["यह अच्छा है।", "हाँ!"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 .!?…\"'()«»。」「 \n\xa0😋éก", max_size=60))
def test_sentences_cover_everything_but_spaces(t):
    spans = sentence_spans(t)
    at = 0
    for a, b in spans:
        assert at <= a < b and not t[at:a].strip() and not t[a].isspace() and not t[b - 1].isspace()
        at = b
    assert not t[at:].strip()


def test_sentences_of_a_table(spark):
    df = spark.createDataFrame([("a", "One. Two."), ("b", None), ("c", " "), ("d", "x" * 200_000 + ". End."), (None, "Hi.")], "id string, t string")
    got = sorted(map(tuple, sentences(df, "id", "t").collect()), key=str)
    assert ("a", 0, 4) in got and ("a", 5, 9) in got and (None, 0, 3) in got and len([g for g in got if g[0] == "d"]) == 2
    assert sentences(df.limit(0), "id", "t").count() == 0


# --- language ---
SAMPLES = {
    "en": "The food was great and the service was very good. We will be back with our friends.",
    "es": "La comida estaba muy buena y el servicio fue excelente. Volveremos con nuestros amigos.",
    "fr": "La nourriture était très bonne et le service était parfait. Nous reviendrons avec nos amis.",
    "de": "Das Essen war sehr gut und der Service war nicht schlecht. Wir kommen gerne wieder.",
    "it": "Il cibo era molto buono e il servizio è stato ottimo. Torneremo con i nostri amici.",
    "pt": "A comida estava muito boa e o serviço foi ótimo. Voltaremos com os nossos amigos.",
    "nl": "Het eten was heel goed en de bediening was niet slecht. We komen zeker terug.",
    "ru": "Еда была очень вкусной, и нас хорошо обслужили.",
    "ja": "料理はとても美味しかったです。",
    "zh": "菜很好吃，服务也不错。",
    "th": "อาหารอร่อยมากและบริการดี",
    "hi": "खाना बहुत अच्छा था और सेवा भी।",
    "ar": "كان الطعام لذيذا جدا والخدمة ممتازة.",
}


@pytest.fixture(scope="module")
def model():
    return train_filter([(k, v) for k, v in SAMPLES.items()] * 3 + [("de", SAMPLES["en"])], counts={"en": 100, "de": 5})


def test_filter_has_no_false_negatives():
    f = BitmaskFilter.build({g: 1 << (i % 13) for i, g in enumerate(ngrams("restaurant"))}, 12)
    assert all(f.languages(g) >> (i % 13) & 1 for i, g in enumerate(ngrams("restaurant")))
    assert all(0 <= r < 1 for r in f.false_positive_rates())


@pytest.mark.parametrize("lang", LANGUAGES)
def test_each_language(model, lang):
    got = language_segments(f"<p>{SAMPLES[lang]}</p>", model, model.false_positive_rates())
    assert [g[2] for g in got] == [lang] and 0 < got[0][3] <= 1


def test_mixed_and_wordless(model):
    r = model.false_positive_rates()
    t = f"{SAMPLES['en']} {SAMPLES['fr']} {SAMPLES['en']} {SAMPLES['zh']}"
    got = language_segments(t, model, r)
    assert [g[2] for g in got] == ["en", "fr", "en", "zh"]
    assert t[got[1][0] : got[1][1]] == SAMPLES["fr"]
    for t in (None, "", "10/10 !!!", "https://a.example/b", "<br/>"):
        assert language_segments(t, model, r) == []


def test_language_tables(spark):
    labels = spark.createDataFrame([("EN",), ("en_GB",), ("fr-CA",), ("Spanish",), ("deu",), ("und",), (None,), ("",)], "l string")
    assert [r[0] for r in labels.select(canonical_language(F.col("l"))).collect()] == ["en", "en", "fr", "es", "de", None, None, None]
    df = spark.createDataFrame([(f"{k}{i}", v, k) for k, v in SAMPLES.items() for i in range(2)] + [("n", None, None), (None, "", "en")], "id string, t string, lang string")
    m = fit_language_filter(df, "t", "lang", "id")
    got = detect_languages(df.withColumnRenamed("lang", "label"), "id", "t", m, ("label",)).filter("segment_no = 0").collect()
    assert len(got) == 26 and all(r["lang"] == r["label"] for r in got)
    assert detect_languages(df.limit(0), "id", "t", m).count() == 0


# --- personal data ---
GIVEN = ["Anna", "Boris"]
PERSONAL = [
    ("Contact: anna.k+x@mail.example, please.", "email", "anna.k+x@mail.example"),
    ("My address is bo_12 (at) post.test, ok?", "email", "bo_12 (at) post.test"),
    ("Write to bo at post dot test soon", "email", "bo at post dot test"),
    ("Call me on (555) 555-0123 ext. 45 today", "phone", "(555) 555-0123 ext. 45"),
    ("Tel. +44 7700 900 974.", "phone", "+44 7700 900 974"),
    ("They copied my ID number Q970-3249-3902 twice", "identity", "Q970-3249-3902"),
    ("Apuntaron mi DNI 09015184-D ayer", "identity", "09015184-D"),
    ("We moved to 649 West Oak Street in spring", "address", "649 West Oak Street"),
    ("Ich wohne in der Ottersbyweg 88a, gleich nebenan", "address", "Ottersbyweg 88a"),
    ("Our server Anna K. Zorvath was a gem.", "name", "Anna K. Zorvath"),
    ("Thank you, Zorvath, Anna, for the candle.", "name", "Zorvath, Anna"),
    ("Ask for J. Zorvath at the counter", "name", "J. Zorvath"),
]


def test_personal(spark):
    rows = [(f"{i}-{k}", t) for k in range(4) for i, (t, _, _) in enumerate(PERSONAL)]
    rows += [(f"z{i}", t) for i, t in enumerate(["Order 4471-37-037 came on 2019-08-18 at 18:37.", "Barcode 4041771130041 would not scan.", "Copper Lantern Cafe beats the Caesar salad.", "Follow @tastybench53 for news.", None, "", "a " * 100_000])]
    df = spark.createDataFrame(rows, "id string, t string")
    spans = find_personal(df, "id", "t", GIVEN)
    got = {(r["id"], r["kind"], r["found"]) for r in spans.collect()}
    assert got == {(f"{i}-{k}", kind, x) for k in range(4) for i, (_, kind, x) in enumerate(PERSONAL)}
    red = {r["id"]: r["redacted"] for r in redact(df, "id", "t", spans).collect()}
    assert red["4-0"] == "Tel. <PHONE>." and red["10-1"] == "Thank you, <NAME>, for the candle." and red["z4"] is None and red["z3"] == "Follow @tastybench53 for news."
    assert find_personal(df.limit(0), "id", "t", GIVEN).count() == 0


def _letters(i):
    return "".join(chr(97 + int(d)) for d in f"{i:06d}")


def test_no_word_of_the_gazetteer_is_left_out(spark, tmp_path):
    # more family names than were ever kept, the rarest by rank last; "Odalys" is the name of one writer only
    many = " ".join(f"Anna Q{_letters(i)}, Anna Q{_letters(i)}." for i in range(20_100)) + " Anna Zorvath."
    texts = [many, "many thanks to zorvath for all of it", "It was Odalys who came by.", "thanks to anna zorvath", None, ""]
    r = spark.createDataFrame([(f"r{i}", t, None) for i, t in enumerate(texts)], "review_id string, text string, loaded_at timestamp")
    r.write.parquet(f"{tmp_path}/reviews.parquet")
    spark.createDataFrame([("Anna",), ("Anna",), ("Odalys",), ("",), (None,)], "name string").write.parquet(f"{tmp_path}/users.parquet")
    got = {(x["review_id"], x["found"]) for x in p6_found(spark, str(tmp_path)).filter("review_id <> 'r0'").collect()}
    assert got == {("r1", "zorvath"), ("r2", "Odalys"), ("r3", "anna zorvath")}


@pytest.mark.parametrize("most", [0, 1, 7])
def test_joined_gazetteer_equals_broadcast_one(spark, most):
    more = ["Ask for anna-lena Zorvath-Meyer, she was great", "thanks to zorvath", "Jean-Boris O'Neil helped. THANKS ANNA!", "my friend is here", "Thank you, Meyer, Anna."]
    rows = [(f"{i}-{k}", t) for k in range(4) for i, (t, _, _) in enumerate(PERSONAL)] + [(f"m{i % 7}", t) for i, t in enumerate(more * 3)] + [(None, more[0]), ("n", None), ("e", "")]
    df = spark.createDataFrame(rows, "id string, t string")
    found = lambda given, **a: sorted(str((*r[:5], round(r["probability"], 9))) for r in find_personal(df, "id", "t", given, **a).collect())
    want = found(GIVEN)
    assert found([*GIVEN, "Kalle"], most=most) == want and len(want) > 50


def test_span_model_weighs_labelers():
    m = fit_span_model([("phone", "++0", 0, 900), ("phone", "+00", 0, 50), ("phone", "0--", 0, 700), ("phone", "00-", 0, 40)])
    assert m.probability("phone", "++0", 0) > 0.9 > 0.1 > m.probability("phone", "0--", 0)
    assert all(0.5 < r < 1 for r in m.reliability["phone"])


def test_candidates_of_nothing():
    assert candidates(None, frozenset()) == [] and candidates("", frozenset()) == []


# --- leakage ---
ITEM = "the quick brown fox jumps over the lazy dog while seven old wizards quietly drink their warm tea outside".split()


def test_leaks(spark):
    said = " ".join(ITEM)
    docs = [
        (1, f"Intro. {said} End."), (2, " ".join(ITEM[3:15])), (3, " ".join(ITEM[3:14]) + " outro"), (4, "THE  Quick, brown\nfox jumps <b>over</b> thе lаzy dog while séven old wizards"),
        (5, " ".join(ITEM[10:] + ITEM[:10])), (6, None), (7, ""), (8, "x " * 50_000 + said),
    ]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, said), (11, "Rate this: " + said), (12, None), (13, "short")], "item_id long, text string")
    for block in (2_000_000, 20):
        got = {(r["doc_id"], r["item_id"]): (r["longest"], r["coverage"]) for r in find_leaks(d, "doc_id", "text", items, "item_id", "text", block_words=block).collect()}
        assert set(got) == {(i, k) for i in (1, 2, 4, 8) for k in (10, 11)}
        assert got[1, 10] == (len(ITEM), 1.0) and got[2, 10][0] == 12
    assert find_leaks(d, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    same = find_leaks(d, "doc_id", "text", items.withColumnRenamed("item_id", "doc_id"), "doc_id", "text")
    assert "doc_id_item" in same.columns and same.count() == 8


def test_tiles_do_not_overlap():
    a, b = plain_words("a b c d e x f g h"), plain_words("f g h q a b c d e")
    got = tiles(a, b, [(0, 4), (1, 5), (6, 0)], 3)
    assert got == [(0, 4, 5), (6, 0, 3)]


# --- toxic content ---


def test_unmask():
    assert unmask("D i m w i t") == "dimwit" and unmask("f1lthy r@t") == "filthy rat" and unmask("wooooorthless") == "worthless" and unmask("sеx") == "sex"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=8), min_size=1, max_size=150), st.lists(st.sampled_from("abcdefghz"), min_size=1, max_size=8))
def test_nearest_is_exact(examples, q):
    ix = BlockMaxIndex(examples)
    vs, v = [ix._vector(x) for x in examples], ix._vector(q)
    want = sorted(((-round(sum(w * x.get(t, 0) for t, w in v.items()), 5), i) for i, x in enumerate(vs)))
    got = ix.nearest(q, 5, 0.35)
    assert [s for s, _ in got] == pytest.approx([-s for s, _ in want if -s >= 0.35][:5], abs=3e-5)


def test_content_scores(spark):
    neutral = [f"The {a} was {b} again." for a in ("soup", "bread", "table", "waiter", "music") for b in ("lovely", "slow", "fine", "late")]
    bad = ["You are a worthless idiot, drop dead.", "You are a worthless moron, drop dead.", "You are a stupid idiot, drop dead."]
    docs = [(i, f"{neutral[i % 20]} {neutral[(i * 7 + 3) % 20]}" + (f" {bad[i % 3]}" if i % 5 == 0 else ""), "s") for i in range(100)] + [(100, None, None), (101, "", "s"), (102, "You are a worthless 1d1ot, drop dead!", "s")]
    labels = [(i, "abusive" if i % 5 == 0 else "none", "r") for i in range(60)] + [(3, "abusive", "q"), (200, "abusive", "r"), (4, None, "r"), (None, "none", "r")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    v = fit_voter(d, "doc_id", "text", spark.createDataFrame(labels, "doc_id long, label string, rater string"), "label")
    got = score_documents(d, "doc_id", "text", v, ("source",)).filter("kind = 'abusive'").collect()
    assert {r["doc_id"] for r in got if r["score"] >= 0.33} == {*range(0, 100, 5), 102}
    assert all("drop dead" in r["evidence"] for r in got if r["score"] >= 0.33)
    assert score_documents(d.limit(0), "doc_id", "text", v).count() == 0
    assert Voter([]).document("any text at all here")[0] == [0.0, 0.0, 0.0] and features("") == []
