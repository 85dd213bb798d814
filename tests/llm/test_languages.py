import numpy as np
import pytest

from loomgraph.llm import languages as L

TEXTS = {
    "en": "The meeting was moved because nobody had checked the limits before the weekend. We should wait for the next window and write down what happened there.",
    "de": "Die Besprechung wurde verschoben, weil niemand vor dem Wochenende die Grenzen geprüft hatte. Wir sollten auf das nächste Fenster warten und aufschreiben, was dort geschah.",
    "fr": "La réunion a été déplacée parce que personne n'avait vérifié les limites avant la fin de la semaine. Nous devons attendre la prochaine fenêtre et noter ce qui s'est passé.",
    "es": "La reunión se cambió porque nadie había mirado los límites antes del fin de semana. Tenemos que esperar a la próxima ventana y anotar lo que ha pasado allí.",
    "it": "La riunione è stata spostata perché nessuno aveva controllato i limiti prima della fine della settimana. Dobbiamo aspettare la prossima finestra e scrivere che cosa è successo.",
    "nl": "De vergadering werd verplaatst omdat niemand de grenzen voor het weekend had bekeken. We moeten op het volgende venster wachten en opschrijven wat daar gebeurde.",
    "pt": "A reunião foi mudada porque ninguém tinha visto os limites antes do fim de semana. Temos de esperar pela próxima janela e escrever o que aconteceu naquele dia.",
}
KIND = "doc_id bigint, text string, lang string, code string, label string"


@pytest.fixture(scope="module")
def table(spark):
    rows, n = [], 0
    for code, text in TEXTS.items():
        for i in range(12):
            words = text.split()
            rows.append((n, " ".join(words[i:] + words[:i]) + ".", code if i else "en", "x", "x"))
            n += 1
    return L.fit(spark.createDataFrame(rows, KIND))


def run(spark, table, rows):
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], KIND)
    found = L.languages(docs, table)
    return {(r.doc_id, r.lang) for r in found.collect()}, {tuple(r) for r in L.mislabelled(found).collect()}, docs


def test_labels(spark):
    want = {"en": "en", "EN": "en", "en_GB": "en", "en-US": "en", "eng": "en", "English": "en", " deutsch ": "de", "Français": "fr", "es-MX": "es", "??": None, "": None, "und": None, "unknown": None, "n/a": None, None: None, "enx": None, "english-ish": None}
    df = spark.createDataFrame([(k,) for k in want], "x string").select("x", L.label_code(L.F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == want


def test_each_language_and_wrong_labels(spark, table):
    rows = [(i, t, c) for i, (c, t) in enumerate(TEXTS.items())]
    got, wrong, _ = run(spark, table, rows)
    assert got == {(i, c) for i, (c, _) in enumerate(TEXTS.items())} and wrong == set()
    upper = [(i, t.upper(), None) for i, t in enumerate(TEXTS.values())]
    assert run(spark, table, upper)[1] == got
    assert run(spark, table, [(1, TEXTS["nl"], "English")])[1] == {(1, "nl")}


def test_mixed_text_and_segments(spark, table):
    text = TEXTS["en"] + "\n\n" + TEXTS["fr"]
    got, wrong, docs = run(spark, table, [(1, text, "en")])
    assert got == wrong == {(1, "en"), (1, "fr")}
    seg = L.segments(docs, table).orderBy("segment").collect()
    assert [s.lang for s in seg] == ["en", "fr"] and text[seg[1].start : seg[1].stop].startswith("La réunion")
    assert all(0 < s.confidence <= 1 for s in seg)


def test_names_logs_and_quotes_do_not_count(spark, table):
    log = "```\n" + "error failed because the system could not start\n" * 30 + "```\n"
    got, _, _ = run(spark, table, [(1, log + TEXTS["de"] + ' «' + "The Quick Brown Fox Guide" + "»", "de")])
    assert got == {(1, "de")}


def test_nulls_blanks_long_and_empty(spark, table):
    got, wrong, docs = run(spark, table, [(1, None, "en"), (2, " ​", None), (3, "12:30 0xff 99", None), (4, TEXTS["it"] * 3000, None), (None, TEXTS["it"], None)])
    assert got == wrong == {(4, "it")}
    assert L.languages(docs.limit(0), table).count() == 0
    empty = L.fit(docs.limit(0))
    assert L.languages(docs, empty).count() == 0 and L.segments(docs, empty).count() == 0


def test_score_is_the_bundled_vectors_cosine():
    import pandas as pd

    rng = np.random.default_rng(0)
    s = L.Sentences(["the quick brown fox"])
    g = np.unique(np.concatenate([s.grams, rng.integers(0, L._A**3, 500)]))
    counts = pd.DataFrame([(i, x, rng.integers(1, 5)) for i in range(7) for x in g], columns=["i", "g", "n"])
    known = L.prototypes([f"l{i}" for i in range(7)], counts, 256)
    v = L.gram_vectors(g, L.letter_vectors(256)).astype(np.float32)
    p = np.log1p(counts["n"].to_numpy().reshape(7, -1)).astype(np.float32) @ v
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    p -= p.mean(0)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    bundle = v[np.searchsorted(g, s.grams)].sum(0)
    own, n = s.score(known)
    assert n[0] == len(s.grams) and np.allclose(own[0], bundle @ p.T / np.sqrt(256), atol=1e-2)


MORE = {
    "pl": "Spotkanie zostało przełożone, ponieważ nikt nie sprawdził limitów przed weekendem. Powinniśmy poczekać na następne okno i zapisać, co się tam wydarzyło.",
    "sv": "Mötet flyttades eftersom ingen hade kontrollerat gränserna före helgen. Vi bör vänta på nästa fönster och skriva ner vad som hände där.",
    "ru": "Встреча была перенесена, потому что никто не проверил ограничения перед выходными. Нам следует подождать следующего окна и записать, что там произошло.",
    "zh": "会议被推迟了，因为周末之前没有人检查限制。我们应该等待下一个窗口，并记录那里发生的事情。团队将准备一份新计划，并在今晚发送给所有参与者。请大家按时参加，不要忘记。",
}


def rotated(text, sep=" "):
    words = text.split(sep) if sep else list(text)
    return [sep.join(words[i:] + words[:i]) + "." for i in range(12)]


def fitted(spark, texts, extra=()):
    rows = [(t, c) for c, text in texts.items() for t in rotated(text, "" if c == "zh" else " ")] + list(extra)
    return L.fit(spark.createDataFrame([(n, t, c, "x", "x") for n, (t, c) in enumerate(rows)], KIND))


def test_languages_come_from_the_labels_in_any_script(spark):
    known = fitted(spark, TEXTS | MORE)
    assert known.langs == sorted([*TEXTS, *MORE])
    rows = [(i, t, c) for i, (c, t) in enumerate((TEXTS | MORE).items())]
    got, wrong, _ = run(spark, known, rows)
    assert got == {(i, c) for i, _, c in rows} and wrong == set()
    assert run(spark, known, [(1, MORE["ru"] + " " + MORE["zh"], "ru")])[1] == {(1, "ru"), (1, "zh")}


def test_texts_in_none_of_the_languages(spark, table):
    rows = [(i, 3 * (t + " "), c) for i, (c, t) in enumerate(MORE.items())]
    assert run(spark, table, rows)[1] == set()  # labels of languages without a profile are kept
    assert run(spark, table, [(i, t, None) for i, t, _ in rows])[1] == {(i, L.OTHER) for i in range(4)}
    assert run(spark, table, [(i, t, "en") for i, t, _ in rows])[1] == {(i, L.OTHER) for i in range(4)}
    docs = spark.createDataFrame([(1, TEXTS["en"] + "\n" + MORE["ru"], "en", "", "")], KIND)
    assert {r.lang for r in L.segments(docs, table).collect()} == {"en", L.OTHER}


def test_a_label_that_no_text_bears_out_has_no_profile(spark):
    said = "The people who wrote these pages were asked to read them again before anything else would be changed. Most of what they found had been known for years, though none of them could say where it came from. Others thought that the work should be shared, so that every group might learn from it and help with the next one."
    known = fitted(spark, TEXTS, [(t, "en") for t in rotated(said)] + [(t, "pl") for t in (TEXTS["en"] + " " + said, said, TEXTS["en"], "We should write down what they found before the next one.")])
    assert known.langs == sorted(TEXTS)


def test_a_quoted_passage_counts_and_a_title_does_not(spark, table):
    got, _, _ = run(spark, table, [(1, TEXTS["de"] + ' "' + TEXTS["fr"] + '"', "de"), (2, TEXTS["de"] * 2 + ' "' + "the way that nobody had checked the limits before the weekend came around, and " * 3 + '"', "de")])
    assert got == {(1, "de"), (1, "fr"), (2, "de")}
