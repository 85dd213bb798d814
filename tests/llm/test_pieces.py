import random
from datetime import datetime as D

import pytest

from loomgraph.llm import pieces as P


def check(text, limit, overlap):
    got = P.split(text, limit, overlap)
    assert "".join(text[o:e] for _, o, e in got) == text
    for i, (s, o, e) in enumerate(got):
        assert e - s <= limit and s <= o < e
        assert o - s <= overlap and (i == 0) == (o == 0)
        if i:
            assert s >= got[i - 1][0]
    return got


@pytest.mark.parametrize("seed", range(20))
def test_random_texts_are_covered_and_bounded(seed):
    rnd = random.Random(seed)
    bits = ["# Head\n", "## Sub\n", "\n\n", "\r\n \t\r\n", "* item one\n", "A sentence. ", "Another one! ", "word ", "x" * rnd.randrange(1, 300), "\r", "é😀 "]
    text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 400)))
    check(text, rnd.randrange(50, 400), rnd.randrange(0, 40))


def test_cuts_at_headings_then_blocks_then_sentences():
    text = "# One\n\n" + "Alpha beta. " * 20 + "\n\n# Two\n\n" + "Gamma delta. " * 20
    got = check(text, 300, 0)
    assert any(text[o:e].startswith("# Two") for _, o, e in got)
    long_ = "This is a sentence of some length. " * 50
    assert all(long_[o:e].endswith(". ") for _, o, e in check(long_, 200, 0))
    assert [e - o for _, o, e in check("z" * 1000, 300, 0)] == [300, 300, 300, 100]
    got = check(long_, 200, 60)
    assert all(long_[s:].startswith("This") for s, o, e in got)


def over(text):
    opened = []
    P.split(text, opened=opened)
    return P.oversized(opened)


def test_oversized_blocks():
    big = "a b " * 500
    assert over("x" * 1600) == []
    assert over("x" * 1601) == [0, 1]
    assert over("\n \n" + "short\n\n \t\n" + big + "\r\r" + "y" * 1700) == [0, 2, 3]
    assert over("s" + " " * 5000 + "e") == [0]
    lines = "word " * 200
    assert over(lines + "\r\n" + lines) == [0, 1]  # one line end, not two
    assert over(lines + "\r\n\r\n" + lines) == [0]
    assert over(lines + "\n\r\n" + lines) == [0]
    assert over("```\n" + big + "\n\n" + big + "\n```\n\n# x\n\n" + big) == [0, 1, 2, 4]


@pytest.mark.parametrize("seed", range(20))
def test_descended_blocks_are_those_of_a_plain_division(seed):
    import re

    rnd = random.Random(seed)
    bits = ["# Head\n", "```\n", "\n\n", "\r\n \t\r\n", "- item\n", "  - sub item\n", "A sentence. " * 9, "word " * 70, "x" * 300, "\r", "   "]
    text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 300)))
    kept = [p for p in (P.plain(x) for x in re.split(r"\n(?:[ \t]*\n)+", text.replace("\r\n", "\n").replace("\r", "\n"))) if p]
    assert over(text) == ([0, *(i for i, p in enumerate(kept, 1) if len(p) > 1600)] if len(text) > 1600 else [])
    check(text, 1600, 160)


def own(text, limit, overlap):
    return [text[o:e] for _, o, e in check(text, limit, overlap)]


def test_a_node_within_the_limit_is_never_cut():
    text = "a" * 1499 + "\n\n" + "b " * 300
    assert own(text, 1600, 160) == ["a" * 1499 + "\n\n", "b " * 300]


def test_rests_of_a_section_are_not_glued_to_the_next():
    text = "# A\n\n" + "One two three. " * 40 + "\n\n# B\n\nshort\n\n# C\n\nshorter"
    got = own(text, 400, 0)
    assert got[0].startswith("# A\n\nOne") and got[-1] == "# B\n\nshort\n\n# C\n\nshorter" and not any("# B" in x for x in got[:-1])


def test_fences_are_kept_whole_and_hold_no_headings():
    fence = "```sh\n# not a heading\n\nrun it\n\n# nor this\n```\n\n"
    text = "# A\n\n" + "Some words here. " * 20 + "\n\n" + fence + "# B\n\n" + "More words. " * 30
    assert sum(fence.strip() in x for x in own(text, 400, 40)) == 1
    assert "".join(own("```\n# open\n\n" + "word " * 200, 300, 0)).startswith("```")


def test_lists_are_cut_between_items_and_nested_items():
    text = "".join(f"- item {i}\n" + "".join(f"  - part {i}.{j} of it\n" for j in range(30 if i == 2 else 2)) for i in range(8))
    got = own(text, 300, 0)
    assert all(x.lstrip().startswith("- ") for x in got)
    assert [x for x in got if x.startswith("- item 3")] and not [x for x in got if "part 2." in x and "item 3" in x]


T = "key string, description string, ingested_at timestamp_ntz, body string, block_no int, at int"
R = "id string, body string, loaded_at timestamp_ntz"


def test_latest_state_nulls_and_repeats(spark):
    big = "word " * 400
    t = [("A", big, D(2025, 1, 1), "x", 1, 1), ("A", "now short", D(2025, 1, 2), "x", 1, 1), ("B", big, D(2025, 1, 1), "", 0, 0), ("B", big, D(2025, 1, 1), "", 0, 0), ("C", None, None, "", 0, 0), (None, big, D(2025, 1, 1), "", 0, 0), ("D", big, None, "", 0, 0)]
    out = P.pieces(P.project_texts(spark.createDataFrame(t, T), spark.createDataFrame([("r", big, D(2025, 1, 1)), ("e", "", None)], R))).collect()
    assert sorted((r.src_table, r.item_key, r.block_no) for r in out if r.block_no is not None) == [("raw_records", "r", 0), ("raw_records", "r", 1), ("tickets", "B", 0), ("tickets", "B", 1), ("tickets", "D", 0), ("tickets", "D", 1)]
    own = sorted((r.piece_no, r.content[r.own - r.start :]) for r in out if r.item_key == "B" and r.piece_no)
    assert "".join(x for _, x in own) == big


def test_empty_tables_and_bad_parameters(spark):
    empty = P.project_texts(spark.createDataFrame([], T), spark.createDataFrame([], R))
    assert P.pieces(empty).count() == 0
    with pytest.raises(ValueError):
        P.pieces(empty, 100, 100)


def test_very_long_text():
    text = ("para of words. " * 20 + "\n\n") * 5000
    assert len(check(text, 1600, 160)) > 800
