import random
import zlib

from genospark.llm import language_id as L

WORDS = {"aa": ["kato", "kemo", "tako", "moke"], "bb": ["shura", "shili", "rushi", "lirsh"], "ru": ["мир", "дом", "кот", "лес"]}


def model():
    from collections import Counter

    return L.fitted({k: Counter(g for w in v for g in L.letter_groups(w)).most_common() for k, v in WORDS.items()})


def brute(m, text):
    """Viterbi without arrays."""
    ws = L.words(text)
    best = {k: (s, [k]) for k, s in enumerate(m.score(ws[0]))}
    for w in ws[1:]:
        s = m.score(w)
        new = {}
        for k in best:
            v, path = max(((v - (L.SWITCH if j != k else 0), p) for j, (v, p) in best.items()), key=lambda x: x[0])
            new[k] = (v + s[k], path + [k])
        best = new
    return max(best.values(), key=lambda x: x[0])[0]


def cost(m, text, path):
    ws = L.words(text)
    return sum(m.score(w)[k] for w, k in zip(ws, path)) - L.SWITCH * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_is_optimal():
    m, rng = model(), random.Random(2)
    texts = [" ".join(rng.choice(WORDS[rng.choice("aa bb ru".split())]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    for text, (path, _) in zip(texts, L.Labeller(m).paths(texts)):
        assert abs(cost(m, text, list(path)) - brute(m, text)) < 1e-6


def test_spans_and_scripts():
    m = model()
    text = "kato kemo tako moke kato! Shura, shili rushi lirsh shura. мир дом"
    spans = L.Labeller(m).spans(text)
    assert [s[2] for s in spans] == ["aa", "bb", "ru"]
    assert text[spans[1][0] : spans[1][1]] == "Shura, shili rushi lirsh shura"
    assert m.candidates("мир") == 1 << m.languages.index("ru")
    assert L.Labeller(m).label(["мир", None, "", "123 !", "kato kato"]) [0][0] == "ru"
    assert [x[0] for x in L.Labeller(m).label([None, "", "123 !", "\u0301 \u0302"])] == ["und"] * 4
    assert L.Labeller(L.fitted({})).label(["x"]) == [("und", 0.0)]


def test_scores_of_many_words_are_those_of_one():
    m = model()
    found = ["kato", "shura", "мир", "x", "ka" * 50, "日本"]
    together = m.score_many(found)
    for word, row in zip(found, together):
        pieces = [word[i : i + L.LONGEST] for i in range(0, len(word), L.LONGEST)]
        groups = [g for p in pieces for g in L.letter_groups(p)]
        for k in range(len(m.languages)):
            if not m.candidates(word) >> k & 1:
                assert row[k] == -1e3
                continue
            place = {int(key): n for n, key in enumerate(m.keys)}
            wanted = sum(m.table[place.get(L._packed(g), len(m.keys)), k] for g in groups) / len(groups) * min(len(word), L.LONGEST)
            assert abs(row[k] - wanted) < 1e-9


def test_long_words_and_texts():
    label = L.Labeller(model()).label(["kato" * 5000, "kemo " * 30000])
    assert [x[0] for x in label] == ["aa", "aa"] and all(0 <= x[1] <= 1 for x in label)


def test_frame(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS[k]) for _ in range(20)), k, "s") for i in range(200) for k in [rng.choice(sorted(WORDS))]]
    rows += [(500, None, None, None), (501, "", "aa", "s"), (501, "", "aa", "s"), (None, "kato", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    m = L.learn_from_documents(docs)
    got = L.predict(docs.withColumn("held_out", L.held_out()), m).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not r["text"]:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["lang"]:
            assert r["lang_pred"] == r["lang"]
    empty = docs.limit(0)
    assert L.predict(empty, L.learn_from_documents(empty)).count() == 0


def test_language_without_blanks(spark):
    rng = random.Random(8)
    unspaced = ["".join(rng.choice("日本語文字列漢") for _ in range(90)) for _ in range(20)]
    rows = [(i, x, "zz", "s") for i, x in enumerate(unspaced)] + [(100 + i, " ".join(rng.choice(WORDS["aa"]) for _ in range(20)), "aa", "s") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    m = L.learn_from_documents(docs)
    assert m.languages == ["aa", "zz"]
    assert all(r["lang_pred"] == r["lang"] for r in L.predict(docs, m).collect())


def test_many_languages(spark):
    """More languages than bits of a machine word, or values of a byte; one of them in a script of its own."""
    from collections import Counter

    rng = random.Random(5)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4)] for k in range(199)} | {"thai": ["กขคง", "งคขก"]}
    m = L.fitted({k: Counter(g for w in v for g in L.letter_groups(w)).most_common() for k, v in words.items()})
    assert len(m.languages) == 200 and m.candidates("กข") == 1 << 199
    texts = [" ".join(rng.choices(v, k=12)) for v in words.values()]
    assert [x[0] for x in L.Labeller(m).label(texts)] == list(words)
    mixed = " ".join([*words["l150"], *words["l003"], *words["thai"]])
    assert [s[2] for s in L.Labeller(m).spans(mixed)] == ["l150", "l003", "thai"]
    docs = spark.createDataFrame([(n, t, k, "s") for k, v in words.items() for n, t in enumerate([" ".join(v)] * 3)], "doc_id long, text string, lang string, score string")
    learnt = L.learn(docs.selectExpr("lang", "text", "concat(lang, doc_id) as key"))
    assert len(learnt.languages) == 200 and len(learnt.table) <= L.CELLS // 200 + 1
