from pyspark.sql import functions as F

from tessera.functions import annotate, rewrite, text
from tessera.operators import rerank


def one(rows, column, value):
    return rows([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_white_space_is_unicode(rows):
    assert one(rows, text.collapse, " a 　b\t\nc ") == "a b c"
    assert one(rows, text.split_words, " a 　b ") == ["a", "b"]


def test_tokens(rows):
    assert [one(rows, text.count_tokens, t) for t in ("", None, "abc", "abcdefgh")] == [0, 0, 1, 2]


def test_html(rows):
    page = "<html><script>var x = '</p>';</script><style>p{}</style><p>One &amp; two</p>\n<nav> three <b>four</b></nav></html>"
    assert one(rows, text.html_to_text, page) == "One & two\nthree\nfour"


def test_markdown(rows):
    source = "# Title\n\nSome **bold** and *soft* [link](http://x).\n\n- item\n> quote\n\n```py\ncode\n```\n"
    assert one(rows, text.markdown_to_text, source) == "Title\nSome bold and soft link.\nitem\nquote\ncode"


def test_hashes_tell_texts_apart(rows):
    assert one(rows, text.content_hash, "a") != one(rows, text.content_hash, "b")
    assert len(one(rows, text.secure_hash, "a")) == 64
    assert one(rows, text.fast_hash, "a") == one(rows, text.fast_hash, "a")


def test_types(rows):
    kinds = rows([("Team-Meeting-spec.md", ""), ("API_Spec.md", ""), ("How-To.txt", ""), ("x.txt", "```"), ("x.txt", "y"), (None, None)], "s string, t string")
    found = [r[0] for r in kinds.select(annotate.document_type(F.col("t"), F.col("s"))).collect()]
    assert found == ["meeting", "prd", "wiki", "technical", "general", "general"]
    assert one(rows, lambda c: annotate.validated_type(F.lit(" PRD "), c), "x") == "prd"
    assert one(rows, lambda c: annotate.validated_type(F.lit("odd"), c), "def f()") == "technical"


def test_languages(rows):
    assert [one(rows, annotate.document_language, t) for t in ("plain text", "会议记录", "こんにちは", "한국어", "", "abcd 会议记")] == [
        "english", "chinese", "japanese", "korean", "unknown", "mixed",
    ]


def test_meta_queries(rows):
    asked = {"files?": "list", "how many files": "count", "what is indexed": "list", "show documents summary": "stats", "total": "count", "hello": None}
    assert {q: one(rows, annotate.meta_query, q) for q in asked} == asked


def test_expansion(rows):
    made = one(rows, rewrite.expand_query, "database error")
    assert "db" in made.related_terms and "exception" in made.synonyms
    assert made.combined_query.startswith('"database error" OR ')
    assert one(rows, rewrite.expand_query, "a").related_terms == []
    assert len(one(rows, lambda c: rewrite.expand_query(c, substring_compat=True), "a").related_terms) > 5
    assert one(rows, rewrite.expand_query, "writing wrote").variations == ["write", "writer", "writes", "written", "wrote"]


def test_spelling_and_processing(rows):
    assert one(rows, rewrite.correct_spelling, "Databse serach") == "database search"
    assert one(rows, rewrite.correct_spelling, "fine") is None
    done = one(rows, rewrite.process_query, "databse error")
    assert done.processed == "database error" and "exception" in done.expansion.synonyms and done.phrases == ["database error"]


def test_multi_query_pads(rows):
    assert len(one(rows, lambda c: rewrite.multi_query(c, 3), "database error")) == 3
    assert one(rows, lambda c: rewrite.multi_query(c, 9), "find it?") == ["find it?"] * 9


def test_follow_ups(rows):
    said = F.lit("Tell me about solar panels here")
    assert one(rows, lambda c: rewrite.reformulated(c, said), "how does it work") == "how does it work (referring to Tell solar panels)"
    assert one(rows, lambda c: rewrite.reformulated(c, said), "and those") == "and those (in context of Tell solar panels)"
    assert one(rows, lambda c: rewrite.reformulated(c, said), "plain question") == "plain question"
    assert one(rows, lambda c: rewrite.reformulated(c, F.lit(None).cast("string")), "what about it") == "what about it"


def test_presets():
    assert rerank.model_name(None) == rerank.PRESETS["balanced"]
    assert rerank.model_name("own") == "own"


def test_languages_of_letters_in_and_out_of_ascii(rows):
    """What ASCII alone decides is what the scripts decide."""
    wanted = {"Abc 12": "english", "12 - ?": "unknown", "\u00e9": "english", "\u00aa": "english", "12 \u2013": "unknown", "\u03a9": "unknown", "a" * 500 + "\u4f1a" * 9: "english", "1" * 499 + "\u4f1a": "chinese"}
    assert {t: one(rows, annotate.document_language, t) for t in wanted} == wanted
