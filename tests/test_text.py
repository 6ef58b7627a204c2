from pyspark.sql import functions as F

from citeloom.functions import text as t
from citeloom.functions.layout import authors_of, split_run_on_names, title_of


def one(spark, value, expr, name="x"):
    return spark.createDataFrame([(value,)], f"{name} string").select(expr(F.col(name)).alias("r")).first()["r"]


def sections(spark, text):
    return [(s["name"], s["text"]) for s in one(spark, text, t.split_sections)]


def test_sections_numbering_case_repeats_and_empties(spark):
    text = "Title\nA. Author\nAbstract\nWe study.\n1. Introduction\nHello\nIV. METHODS\n\nresults\r\nGood.\n3.2. Introduction \nMore\nMethods of x\n"
    assert sections(spark, text) == [
        ("preamble", "Title\nA. Author"), ("abstract", "We study."), ("introduction", "Hello\nMore\nMethods of x"), ("results", "Good."),
    ]


def test_sections_fall_back_to_whole_text(spark):
    assert sections(spark, "  just prose\n") == [("full_text", "  just prose\n")]
    assert sections(spark, "abstract\nonly one") == [("full_text", "abstract\nonly one")]


def test_sections_of_texts_with_control_characters_stay_whole(spark):
    text = "a\x01b\x02c\nMethods\nd\x02e\x01f\nResults\ng\n"
    got = spark.createDataFrame([(text,)], "text string").select(t.split_sections(F.col("text")).alias("s")).first().s
    assert [(x.name, x.text.strip()) for x in got] == [("preamble", "abc"), ("methods", "def"), ("results", "g")]


def test_sections_keep_blank_lines_between_repeats(spark):
    assert dict(sections(spark, "intro text\nmethod\nx\nmethod\nmethod\ny"))["method"] == "x\ny"


def test_references_numbered_and_name_year(spark):
    assert one(spark, "[1] A. One.\n[2] B. Two,\ncontinued.\n[3] C.", t.split_references) == ["[1] A. One.", "[2] B. Two, continued.", "[3] C."]
    named = "Smith, J. and Doe, K. 2019. A title.\nBrown, L. 2020. Another\ntitle."
    assert one(spark, named, t.split_references) == ["Smith, J. and Doe, K. 2019. A title.", "Brown, L. 2020. Another title."]
    assert one(spark, "", t.split_references) == []


def test_sentences_need_capital_or_digit(spark):
    assert one(spark, "One is. two no! Yes? 3 more. Élan stays", t.split_sentences) == ["One is. two no!", "Yes?", "3 more. Élan stays"]


def test_tokens_are_lossless_and_additive(spark):
    text = "A b-c, été 42!\n x"
    parts = one(spark, text, t.tokens)
    assert "".join(parts) == text and one(spark, text, t.token_count) == len(parts) == 9


def test_page_location(spark):
    rows = spark.createDataFrame([(["alpha beta\ngamma", "delta  epsilon", "zeta"],)], "pages array<string>")
    index = t.page_index(F.col("pages"))
    got = rows.select(*[t.locate_page(F.lit(x), index).alias(n) for n, x in (("a", "beta gamma"), ("b", "delta epsilon zeta"), ("c", "nowhere"), ("d", " "))]).first()
    assert (got.a, got.b, got.c, got.d) == (1, 2, None, None)


def test_preamble_scrub_removes_first_title_only(spark):
    df = spark.createDataFrame([("My Net\n{a, b}@x.org c.d@e.com\nMy Net rocks", "My Net")], "t string, title string")
    assert df.select(t.scrub_preamble(F.col("t"), F.col("title"))).first()[0] == "My Net rocks"


def test_small_scalars(spark):
    assert one(spark, "https://arxiv.org/pdf/1706.03762v5.pdf", t.arxiv_id) == "1706.03762v5"
    assert one(spark, "cs.CL/0112017", t.arxiv_id) == "cs.CL/0112017"
    assert one(spark, "nothing", t.arxiv_id) is None
    assert one(spark, "Deep Nets: A Study (DN) ", t.norm_title) == "deepnetsastudy"
    assert one(spark, "\n\nYES, same.\nno", t.says_yes) is True
    assert one(spark, "No.\nyes", t.says_yes) is False
    assert one(spark, "Main results table", t.is_trivial_claim) is True
    assert one(spark, "It improves speed", t.is_trivial_claim) is False
    assert one(spark, "x" * 12, lambda c: t.truncate_section(c, 10)) == "x" * 10 + "\n[truncated]"


def layout(spark, lines):
    return spark.createDataFrame([([{"size": float(s), "text": x} for s, x in lines],)], "l array<struct<size:double,text:string>>")


def test_title_and_authors_from_layout(spark):
    df = layout(spark, [(9, "Preprint"), (20, "A Long"), (19.8, "Title"), (11, "Ann Lee∗, Bob Ray and Cy Poe§"), (11, "University of X"),
                        (11, "{ann,bob}@x.org"), (11, "Di Fox"), (11, "1Some Research  2Other"), (12, "Abstract"), (11, "Not Author")])
    row = df.select(title_of(F.col("l")).alias("t"), authors_of(F.col("l")).alias("a")).first()
    assert row.t == "A Long Title" and row.a == ["Ann Lee", "Bob Ray", "Cy Poe", "Di Fox"]


def test_byline_without_separators(spark):
    assert one(spark, "Ann Lee Bob van Dyke Cy Poe", split_run_on_names) == ["Ann Lee", "Bob van", "Dyke Cy", "Poe"]
    assert one(spark, "Ann Lee Bob Ray Cy Poe", split_run_on_names) == ["Ann Lee", "Bob Ray", "Cy Poe"]
    df = layout(spark, [(20, "T"), (11, "Ann Lee Bob Ray Cy Poe")])
    assert df.select(authors_of(F.col("l"))).first()[0] == ["Ann Lee", "Bob Ray", "Cy Poe"]


def test_layout_without_authors(spark):
    row = layout(spark, [(20, "T"), (11, "Abstract"), (11, "x")]).select(title_of(F.col("l")).alias("t"), authors_of(F.col("l")).alias("a")).first()
    assert row.t == "T" and row.a is None
