import random

import pytest

from tidemark.llm import residue as M
from tidemark.llm import residue_rules as R

OPEN = [
    "I'd order the {{product_name}} again tomorrow.", "Gekauft: %s, und wir sind begeistert.", "J'ai offert ce produit, undefined, et c'est une réussite.", "Hi [INSERT FIRST NAME], great thing.",
    "The <%= item %> broke.", "$marca$ se rompió.", "__brand__ - @@city@@", "|お名前|を買いました。", "The ______ sits on the shelf.", "I bought the <no value> for my dad.", "The {0} is fine, :item: too.", "{{#if item}} ging kaputt.",
]
MENTIONED = [
    'It came engraved with "{{product_name}}" instead of my name, they replaced it.', "I print {curly} and [square] brackets all day and the keys haven't faded.", "The undefined shape of the handle suits my small hands.",
    "Auf den Musteretiketten steht [Name], das ändert man in einer Minute.", "My name template %s%s printed nicely.", "It is 100% cotton, cost $20 {yes, twenty} and holds 5% more than stated.", "<p>Fine</p> <|endoftext|> ok, [Update after 3 weeks] still good.",
    "L'étiquette porte « {{nom}} », on la change vite.", "It is 50% off and 20% lighter, $5 or $6.",
]


@pytest.mark.parametrize("text", OPEN + ["The {{ customer.preferred_product.display_name.in_short }} broke", "${customer.preferred_product.display_name.in_short} broke.", "<%= customer.preferred_product.display_name.in_short %>", "Take the {}.", "The %1$s and %(name)s.", "undefinedを買いました"])
def test_unfilled_placeholders(text):
    assert any(R.HOLE in s for s in R.split(text))


@pytest.mark.parametrize("text", MENTIONED)
def test_weak_labels_of_mentioned_placeholders(text):
    assert not any(n[0] for (kind, _), n in M.weak_labels([text]).items() if kind == "slot")


def test_kinds():
    for text, kind in {
        "HTTP 503 Service Unavailable.": "error", "Seite nicht gefunden": "error", "This page requires JavaScript to continue.": "notice", "Veuillez activer les scripts.": "notice",
        "Their shop asked me to enable JavaScript before I could pay.": "text", "your review here": "sample", "Works well.": "text", "⭐⭐⭐": "text", "404": "error",
    }.items():
        assert R.kind_of(text) == kind, text
    for text, filler in {"lorem velis dolor sit amet sed": True, "asdf qwer asdf asdf12 qwer": True, "word " * 9: True, "Works well for my dad and for me.": False, "": False}.items():
        assert R.filler(R.WORD.findall(text.lower())) is filler, text
    long = "the lamp is solid and works fine after two weeks " * 300
    assert not R.filler(R.WORD.findall(long))


def test_json_keeps_its_strings():
    for text in ('{"error": "service unavailable", "code": 503}\n\n-- \n5/5', '<p>{"message": "' + "x " * 500 + 'not found", "status": 404}</p>'):
        assert any(R.kind_of(s) == "error" for s in R.split(text)), text
    assert R.split('It said "not found" twice.') == ['It said "" twice.']


def trained(n, seed):
    return M.train(M.weak_labels([t for _, t, _ in corpus(n, seed)]))


def test_what_follows_a_line_of_dashes_is_judged():
    w = trained(1500, 1)
    error, good = "404 - Not Found. Return to the home page.", "The lamp is solid. Works fine after two weeks. Nice price."
    found = [f"{good}\n--\nI'd order the {{{{item}}}} again tomorrow.", f"{good}\n-- \nsent from my {{{{device}}}}", f"{error}\n--\n{error}", f"{error}\n--\nsent from my phone", f"{error}\n-- \nsize 42, width 1,234.56 mm", f"{error}\n--\n5/5"]
    kept = [f"{error}\n--\n" + f"{good} " * 5, f"{good}\n--\nsent from my phone", f"{good}\n--\n{good}"]
    assert [f for _, f in M.Judge(w).verdicts(found + kept)] == [True] * len(found) + [False] * len(kept)


def test_clean():
    assert R.clean("cafÃ© &amp; th​é x") == "café & thé x" or R.clean("cafÃ©") == "café"
    assert R.clean("é") == "é"


WORDS = "the lamp chair is solid works fine after two weeks delivered early colour nice price good my dad uses it daily would buy again cable short broke once".split()


def corpus(n, seed):
    rnd = random.Random(seed)
    sentence = lambda: (" ".join(rnd.sample(WORDS, rnd.randrange(3, 9))).capitalize() + ".")
    out = []
    for k in range(n):
        text, bad = " ".join(sentence() for _ in range(rnd.randrange(1, 6))), False
        pick = rnd.random()
        if pick < 0.04:
            text, bad = rnd.choice(["404 - Not Found. Return to the home page.", "HTTP 500 Internal Server Error. Something went wrong.", "Access denied"]), True
        elif pick < 0.08:
            text, bad = rnd.choice(["Please enable JavaScript to view this content.", "This page requires scripts in your browser settings."]), True
        elif pick < 0.12:
            text, bad = text + f" I'd order the {rnd.choice(['{{item}}', '%s', '[brand]'])} again tomorrow.", True
        elif pick < 0.15:
            text, bad = " ".join(rnd.choices(["lorem", "ipsum", "dolor", "amet", "sed"], k=12)), True
        elif pick < 0.2:
            text = text + ' My old browser showed "Please enable JavaScript to view this content." on their help page. Once the app gave an error 404, then all was fine. ' + sentence() + " " + sentence()
        elif pick < 0.22:
            text = rnd.choice(["", "   ", "ok", "<p></p>"])
        out.append((k, text, bad))
    return out


def test_held_out_texts_and_misspelt_ones(spark):
    w = trained(1500, 1)
    held = corpus(600, 2)
    got = M.Judge(w).verdicts([t for _, t, _ in held])
    assert [f for _, f in got] == [bad for *_, bad in held]
    typos = ["404 - Not Fuond. Retrun to the home page.", "Please enabel JavaScript to veiw this content."]
    assert all(f for _, f in M.Judge(w).verdicts(typos))


def test_operator_defined_cases(spark):
    rows = [(k, t, "x") for k, t, _ in corpus(300, 3)] + [(1000, None, None), (1001, "word " * 20_000, None), (1002, "Fine lamp. " * 3000 + "The {{item}} broke.", None), (1002, "ok", None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, score STRING")
    got = [(r.doc_id, r.found) for r in M.judge_texts(df).collect()]
    assert len(got) == len(rows)
    found = {k for k, f in got if f}
    assert {1001, 1002} <= found and 1000 not in found
    assert found >= {k for k, _, bad in corpus(300, 3) if bad}
    assert M.judge_texts(df.limit(0)).collect() == []


def test_long_segments_are_not_cut_within_a_placeholder():
    judge = M.Judge(trained(1500, 1))
    words = " ".join(WORDS) * 12
    texts = [f"{words[:n]} I'd order the {{{{item}}}} again tomorrow {words[:900]}" for n in range(360, 400)]
    assert all(found for _, found in judge.verdicts(texts))
    mention = f"{words[:340]} on my printed label template stands {{{{item}}}} of it {words[:900]}"
    assert not judge.verdicts([mention])[0][1]
    for text in (words[:3000], "x" * 3000, R.HOLE * 900):
        assert "".join(R.pieces(text, 400)) == text and all(len(p) <= 400 for p in R.pieces(text, 400))
    assert judge.verdicts(["%s" * 900, "a" * 100_000 + " {{item}}"])[1][1]


def test_features_do_not_depend_on_the_batch():
    texts = ["One text here.", "x", "日本", "404 not found 12345678", ""]
    w = M.train(M.weak_labels(["Fine lamp.", "HTTP 404 Not Found."])).segment
    assert M.score(w, texts).tolist() == pytest.approx([float(M.score(w, [t])[0]) for t in texts])
    assert M.score(w, []).tolist() == []


def test_neutral_segments_are_learnt():
    texts = [f"{a} Skip to content." for a in ("HTTP 403 Access denied.", "HTTP 404 Not Found.", "Internal server error.")] * 2 + [f"{' '.join(WORDS[k : k + 5])}. Skip to content." for k in range(12)]
    assert "skip to content." in M.train(M.weak_labels(texts)).neutral


def test_title_is_a_feature():
    (titled, plain), _ = zip(*[M.features([s]) for s in (f"{R.TITLE}Sorry", "Sorry")])
    assert set(titled) - set(plain)
    assert R.split("<html><head><title>Sorry</title></head><body>Gone</body></html>") == [f"{R.TITLE}Sorry", "Gone"]


def test_weights_are_kept(spark, tmp_path):
    rows = [(k, t) for k, t, _ in corpus(300, 4)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    model = M.fit_model(docs)
    model.save(spark, str(tmp_path / "m"))
    again = M.Model.load(spark, str(tmp_path / "m"))
    assert (again.segment == model.segment).all() and (again.slot == model.slot).all() and again.neutral == model.neutral
    assert sorted(M.judge_texts(docs, model=again).collect()) == sorted(M.judge_texts(docs).collect())


def test_unseen_sources(spark, small):
    """What a model of ten times the texts finds, against models of a thousand that never saw the source."""
    docs = spark.read.parquet(small.replace("sf0.001", "sf0.01") + "/documents.parquet")
    better = M.fit_model(spark.read.parquet(small.replace("sf0.001", "sf0.1") + "/documents.parquet"))
    known = spark.createDataFrame(M.judge_texts(docs, model=better).where("found").select("doc_id").toPandas())
    report = M.held_out(docs, "source", reference=known)
    assert sum(r[3] for r in report) >= 0.8 * sum(r[1] for r in report) and sum(r[2] - r[3] for r in report) <= 8, report
