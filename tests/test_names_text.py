from pyspark.sql import functions as F

from loomgraph.functions import names, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_slug(spark):
    assert one(spark, "Auth Redesign", names.slug) == "auth-redesign"
    assert one(spark, "  Hello,  World!! ", names.slug) == "hello-world"
    assert one(spark, "___multiple---separators___", names.slug) == "multiple-separators"


def test_page_and_ticket_keys(spark):
    assert one(spark, "  doc: Cache Guide-X1.\t", names.page_key) == "cache-guide-x1"
    assert one(spark, " doc:a_b", names.page_key) == "a-b"
    assert one(spark, " \n", names.page_key) is None
    assert one(spark, None, names.page_key) is None
    assert one(spark, "ticket:PROJ-7\n", names.ticket_key) == "PROJ-7"
    assert one(spark, "proj-7", names.ticket_key) == "proj-7"


def test_named_array(spark):
    got = one(spark, [" A-1", None, "", "ticket:A-1", "B-2"], lambda c: names.named(c, names.ticket_key), "array<string>")
    assert got == ["A-1", "B-2"]
    assert one(spark, None, lambda c: names.named(c, names.ticket_key), "array<string>") == []


def test_channel_and_handle(spark):
    assert one(spark, " ##  ENG-Lobby", names.channel_key) == "eng-lobby"
    assert one(spark, "@Jane-Doe ", names.handle_key) == "jane-doe"
    assert one(spark, "person:x", names.handle_key) == "x"


def test_keywords_keep_typed_tokens_first(spark):
    assert one(spark, "Why does the cache of OPS-12 fail, cache?", text.keywords) == ["OPS-12", "cache", "ops", "fail"]
    assert one(spark, "", text.keywords) == []


def test_labels_names_choices(spark):
    assert one(spark, "3 prime-utr", text.sanitize) == "_3_prime_utr"
    assert one(spark, "owns", text.relation_type) == "OWNS"
    assert one(spark, "jane-doe", text.person_name) == "Jane Doe"
    pick = lambda c: text.choice_letter(c, F.lit(5))
    assert one(spark, "Answer: c", pick) == 2
    assert one(spark, "banana", pick) is None
    assert one(spark, "Z", pick) is None


def test_mentions_and_paragraphs(spark):
    assert one(spark, "see [[A page]] and [[A page]] by @tim", lambda c: text.mentions(c, text.WIKILINK)) == ["A page"]
    assert one(spark, None, lambda c: text.mentions(c, text.HANDLE)) == []
    assert one(spark, "a\n  b\n\n \r\n\r\nc", text.paragraphs) == ["a b", "c"]
    assert one(spark, "[doc:a] x [ticket:B-1] [no]", text.cited) == ["doc:a", "ticket:B-1"]
