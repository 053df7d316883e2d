"""Language ID: automata against brute force, held-out accuracy, odd inputs."""

import random

from texts import SYLLABLES, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import language
from riskframe.llm.queries import op1_language_id


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=25), st.lists(st.integers(0, 3), max_size=8))
def test_automaton_accepts_substrings_only(text, probe):
    moves, at = language.suffix_automaton(text), 0
    accepted = True
    for c in probe:
        at = moves[at].get(c)
        if at is None:
            accepted = False
            break
    inside = any(text[i : i + len(probe)] == probe for i in range(len(text) - len(probe) + 1))
    assert accepted == inside
    assert len(moves) <= max(1, 2 * len(text))


def greedy_phrases(letters, sample):
    """Longest matches from left to right; a letter that the sample lacks breaks and restarts nothing."""
    count, now = 1, ""
    for c in letters:
        if now + c in sample:
            now += c
        else:
            count += 1
            now = c if c in sample else ""
    return count


def labelled(spark, seeds=range(40)):
    """Two invented languages: the syllables as they are, and each backwards with other letters."""
    other = [s[::-1].translate(str.maketrans("aeion", "äöüij")) for s in SYLLABLES]
    swap = lambda t: " ".join(w.translate(str.maketrans("aeion", "äöüij"))[::-1] for w in t.split())
    rows = []
    for i in seeds:
        rows.append((2 * i, prose(i, 60), "aa"))
        rows.append((2 * i + 1, swap(prose(1000 + i, 60)), "bb"))
    assert other
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_phrases_match_brute_force(spark):
    model = language.train(labelled(spark, range(6)))
    parser = language.Parser(model)
    texts = [prose(77, 30), "zzz qqq", "a", prose(78, 500)]
    samples = {}
    for r in language.sample(labelled(spark, range(6))).collect():
        samples.setdefault(r["lang"], set()).add(language.normalise(r["text"]))
    count, _ = parser.phrases(texts)
    for t, row in zip(texts, count):
        letters = language.normalise(t) + " "  # a text ends like a word
        for x, n in zip(model.languages, row):
            sample = language.learnt_text(samples[x], language.SAMPLE_CHARS // 2)
            whole = "".join(c if c == " " or c in model.alphabet else "\0" for c in letters)
            expected = sum(
                greedy_phrases(whole[i : i + language.WINDOW], sample) for i in range(0, len(whole), language.WINDOW)
            )
            assert abs(int(n) - expected) <= 1


def test_held_out_accuracy_and_odd_rows(spark):
    model = language.train(labelled(spark))
    test = labelled(spark, range(500, 530)).collect()
    odd = [(9001, None, "aa"), (9002, "", None), (9003, "123 !? \n", "aa"), (9004, "þþþ", None)]
    docs = spark.createDataFrame([tuple(r) for r in test] + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs.withColumnRenamed("lang", "score"), model).collect()}
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in test) == len(test)
    assert [got[9001 + i]["lang_pred"] for i in range(3)] == ["und"] * 3
    assert got[9004]["lang_pred"] in ("aa", "bb")
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_learnt(spark):
    none = spark.createDataFrame([("text", None), (None, "xx"), ("12", "yy")], "text string, lang string")
    model = language.train(none)
    assert model.languages == ()
    assert {r["lang_pred"] for r in language.identify(none, model).collect()} == {"und"}
    assert language.identify(none.filter("1 = 0"), model).count() == 0


def test_prediction_depends_on_text_only(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, prose(i % 30, 50), r.choice(["aa", "bb"]), "s", 1) for i in range(80)]
    rows += [(None, prose(3, 50), "aa", None, None), (100, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_text = {}
    texts = {i: t for i, t, *_ in rows}
    for x in got:
        by_text.setdefault(texts[x["doc_id"]], set()).add(x["lang_pred"])
    assert all(len(v) == 1 for v in by_text.values())


SCRIPTS = {  # first letter and number of letters
    "el": (0x3B1, 24), "en": (0x61, 26), "ka": (0x10D0, 33), "ru": (0x430, 32), "zh": (0x4E00, 1500), "ko": (0xAC00, 900),
}


def in_script(lang, seed, words=60):
    """Words of an invented vocabulary in the letters of a script."""
    first, size = SCRIPTS[lang]
    r = random.Random(lang)
    known = ["".join(chr(first + r.randrange(size)) for _ in range(r.randint(2, 7))) for _ in range(600)]
    return " ".join(random.Random(f"{lang}{seed}").choices(known, k=words))


def test_every_script_is_learnt(spark):
    """Thousands of letters in all; none is crowded out by those of other languages."""
    rows = [(in_script(x, i), x) for x in SCRIPTS for i in range(20)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.alphabet) > 10 * language.DENSE
    probe = [(x, in_script(x, 1000 + i)) for x in SCRIPTS for i in range(20)]
    names, _ = language.Parser(model).predict([t for _, t in probe])
    assert names == [x for x, _ in probe]


def test_rare_letters_match_brute_force(spark):
    rows = [(in_script(x, i, 12), x) for x in SCRIPTS for i in range(4)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    texts = [in_script("zh", 0, 12)[5:40], in_script("en", 0, 12)[3:30] + in_script("ko", 1, 12), in_script("zh", 9, 12)]
    count, _ = language.Parser(model).phrases(texts)
    for t, row in zip(texts, count):
        for x, n in zip(model.languages, row):
            sample = language.learnt_text({language.normalise(a) for a, b in rows if b == x}, language.SAMPLE_CHARS // 6)
            assert abs(int(n) - greedy_phrases(language.normalise(t) + " ", sample)) <= 1


def test_a_language_of_long_texts_only(spark):
    rows = [(in_script("ru", i, 2_000), "ru") for i in range(3)] + [(in_script("en", i), "en") for i in range(20)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ("en", "ru")
    assert language.Parser(model).predict([in_script("ru", 99)])[0] == ["ru"]
    chosen = language.sample(spark.createDataFrame(rows * 3, "text string, lang string")).collect()
    assert len(chosen) == 23 and all(len(r["text"]) <= language.SAMPLE_TEXT_CHARS for r in chosen)
    # not the beginnings
    assert not any(t.startswith(r["text"]) for r in chosen if r["lang"] == "ru" for t, _ in rows)
