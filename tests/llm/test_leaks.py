import random
import unicodedata

from loomgraph.llm import leaks as L

DOC, ITEM = "doc_id bigint, text string, item_id string, windows int", "item_id string, passage string, question string, text string"


def brute(docs, items, span=13):
    grams = lambda t: {tuple(w[i : i + span]) for w in [L.words(t)] for i in range(len(w) - span + 1)}
    held = {i: grams(p) | grams(q) for i, p, q in items}
    return {(d, i) for d, t in docs for i, g in held.items() if grams(t) & g}


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], DOC)
    e = spark.createDataFrame([(*x, "clash") for x in items], ITEM)
    return d, e, sorted((r.doc_id, r.item_id) for r in L.leaks(d, e).collect())


def test_random_texts_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["Straße", "naïve", "ÉTÉ"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(f"q{i}", text(60), text(15)) for i in range(20)] + [("same", None, None), ("short", "too short", "x")]
    items.append(("twin", items[0][1], "other question"))
    docs = [(i, text(50)) for i in range(60)]
    for i in range(30):
        words = (items[i % 20][1] or "").split()
        k = rnd.randrange(9, 18)
        a = rnd.randrange(0, len(words) - k)
        docs.append((100 + i, text(20) + " … " + "--".join(words[a : a + k]).upper() + " " + text(5)))
    docs += [(500, None), (501, ""), (502, " ​ ")]
    _, _, got = run(spark, docs, items)
    assert got == sorted(brute(docs, items)) and len(got) > 10
    assert (100, "q0") not in got or (100, "twin") in got


def test_normal_forms(spark):
    words = [f"tok{i}" for i in range(13)]
    item = [("q", " ".join(words) + " end", None)]
    odd = unicodedata.normalize("NFD", "; ".join(words)).replace("tok3", "to­k​3").replace("tok5", "ｔｏｋ５").upper()
    assert run(spark, [(1, odd), (2, " ".join(words[:12]))], item)[2] == [(1, "q")]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(f"q{i}", " ".join(f"a{i}b{j}" for j in range(20)), None) for i in range(12)]
    docs = [(i, "x " + items[i][1]) for i in range(12)]
    whole = run(spark, docs, items)[2]
    monkeypatch.setattr(L, "BLOCK_CHARS", 300)
    assert run(spark, docs, items)[2] == whole == [(i, f"q{i}") for i in range(12)]


def test_clean_removes_just_the_shared_words(spark):
    passage = " ".join(f"p{j}" for j in range(20))
    d, e, _ = run(spark, [(1, f"Keep this. {passage.upper()} And that."), (2, "nothing"), (3, None), (4, "é" + passage)], [("q", passage, None)])
    out = {r.doc_id: r for r in L.clean(d, e).collect()}
    assert out[1].text == "Keep this.  And that." and out[1].removed == len(passage)
    assert out[2].text == "nothing" and out[3].text is None and out[2].removed == 0
    assert out[4].text == "ép0 " and set(out) == {1, 2, 3, 4}
    assert L.leaks(L.clean(d, e), e).count() == 0


def test_very_long_text_and_empty_tables(spark):
    passage = " ".join(f"p{j}" for j in range(14))
    long_ = "filler words here " * 100_000
    assert run(spark, [(1, long_ + passage + long_)], [("q", passage, None)])[2] == [(1, "q")]
    assert run(spark, [], [("q", passage, None)])[2] == []
    assert run(spark, [(1, passage)], [])[2] == []


def test_clean_with_repeated_ids_and_blocks(spark, monkeypatch):
    one, two = " ".join(f"p{j}" for j in range(20)), " ".join(f"r{j}" for j in range(15))
    docs = [(1, f"short {one} end"), (1, f"a much longer beginning before {one} end"), (1, "no leak at all"), (None, f"x {two}"), (2, f"{one} and {two}!")]
    want = [(None, "x "), (1, "a much longer beginning before  end"), (1, "no leak at all"), (1, "short  end"), (2, " and !")]
    for chars, held in ((8_000_000, 4), (60, 1), (60, 2)):
        monkeypatch.setattr(L, "BLOCK_CHARS", chars)
        monkeypatch.setattr(L, "HELD", held)
        d, e, _ = run(spark, docs, [("q", one, None), ("r", two, one)])
        got = [(r.doc_id, r.text) for r in L.clean(d, e).collect()]
        assert sorted(got, key=lambda x: (x[0] or 0, x[1])) == want


def test_slices_cover_all_texts(spark, monkeypatch):
    passage = " ".join(f"p{j}" for j in range(14))
    docs = [(i, f"{'y ' * (i % 7)}{passage}") for i in range(40)] + [(99, "nothing"), (98, "")]
    whole = run(spark, docs, [("q", passage, None)])[2]
    monkeypatch.setattr(L, "SLICE", 50)
    assert run(spark, docs, [("q", passage, None)])[2] == whole == [(i, "q") for i in range(40)]
    assert list(L._slices(["a" * 30, None, "b" * 30, "c"])) == [(0, 3), (3, 4)] and list(L._slices([])) == []


def test_a_window_of_clean_text_is_left_out_of_every_row(spark):
    d, e, _ = run(spark, [(1, None), (2, "")], [])
    assert sorted((r.doc_id, r.text, r.removed) for r in L.clean(d, e).collect()) == [(1, None, 0), (2, "", 0)]
