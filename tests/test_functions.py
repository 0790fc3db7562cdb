"""Known answers of the text and vector functions."""

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions import vector as vec
from quire.plans.alignments import edition_verdict, near_boundary
from quire.plans.quality import off_by, trust_state


def cases():
    return [
        (F.array_join(tx.tokenize(F.lit("  The QUICK—brown, don’t fox! 42 ")), " "), "the quick brown don't fox 42"),
        (F.array_join(tx.tokenize(F.lit("'tis the 'end' ' of it")), " "), "tis the end of it"),
        (F.array_join(tx.display_tokens(F.lit("The QUICK—brown")), " "), "The QUICK brown"),
        (tx.normalize_title(F.lit("Dr. Jekyll & Mr. Hyde")), "dr jekyll mr hyde"),
        (tx.normalize_word(F.lit("«Élan!» ")), "élan"),
        (tx.title_key(F.lit("The Long Way (Unabridged)")), "long-way"),
        (tx.title_key(F.lit("Long Way, Volume 2")), "long-way-volume-2"),
        (tx.author_key(F.lit("Austen, Jane")), "austen"),
        (tx.author_key(F.lit("Jane Austen.")), "austen"),
        (tx.author_key(F.lit("")), ""),
        (tx.filing_title(F.lit("An Apple")), "apple"),
        (tx.is_boilerplate(F.lit(" Table of Contents ")), True),
        (tx.is_boilerplate(F.lit("The Project Gutenberg License")), True),
        (tx.is_boilerplate(F.lit("Chapter 1")), False),
        (F.size(tx.sentences(F.lit("One. Two! Three?\nFour"))), 4),
        (tx.keyword(F.lit("what does the captain eat")), "captain"),
        (tx.is_pure_repetition(F.split(F.lit("a b a b a b"), " ")), True),
        (tx.is_pure_repetition(F.split(F.lit("a b a b a"), " ")), False),
        (tx.is_pure_repetition(F.split(F.lit("a a a"), " ")), False),
        (tx.is_pure_repetition(F.split(F.lit("ab a ba b ab a ba"), " ")), False),
        (tx.session_title(F.lit("  \n ")), "New chat"),
        (tx.session_title(F.lit("a\tb\n c")), "a b c"),
        (tx.roman_value(F.lit("XXXIX")), 39),
        (tx.roman_value(F.lit("IV")), 4),
        (tx.roman_value(F.lit("abc")), None),
        (tx.number_word(F.lit("twenty-one")), 21),
        (tx.number_word(F.lit("42")), 42),
        (tx.number_word(F.lit("twelve")), 12),
        (tx.number_word(F.lit("banana")), None),
        (tx.chapter_number(F.lit("Chapter XII")), 12),
        (tx.chapter_number(F.lit("Ch. 7: The End")), 7),
        (tx.chapter_number(F.lit("Epilogue")), None),
        (tx.series_of(F.lit("The Expanse, Book 3"))["name"], "The Expanse"),
        (tx.series_of(F.lit("Dune #2"))["index"], 2),
        (tx.series_of(F.lit("Book 4 of The Cycle"))["name"], "The Cycle"),
        (tx.title_from_filename(F.lit("/a/b/My_Old-Book.v2.epub")), "My Old Book.v2"),
        (tx.canonical_spelling(F.lit("colour")), "color"),
        (tx.canonical_spelling(F.lit("organisation")), "organization"),
        (tx.canonical_spelling(F.lit("hour")), "hour"),
        (tx.compare_form(F.lit("Well-known colour!")), "wellknowncolor"),
        (tx.html_to_text(F.lit("<head><title>x</title></head><p>One &amp; two</p><p></p>a<br>b<sup>3</sup>")), "One & two\na\nb"),
        (tx.sanitize_html(F.lit('<div class="x"><p id=1>a <b style="c">b</b><script>z</script></p></div>')), "<p>a <b>b</b></p>"),
        (tx.snippet(F.lit("x" * 100 + "hit" + "y" * 100), F.lit(101), F.lit(3)), "..." + "x" * 50 + "hit" + "y" * 50 + "..."),
        (tx.word_overlap(F.array(F.lit("old"), F.lit("man"), F.lit("of")), F.array(F.lit("man"), F.lit("of"), F.lit("old"))), 2),
        (vec.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))), 1.0),
        (vec.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-2.0), F.lit(0.0))), -1.0),
        (vec.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0))), 0.0),
        (vec.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), 0.0),
        (vec.model_of(F.lit(768)), "text-768"),
        (edition_verdict(F.lit(0.9), F.lit(None).cast("double")), "same_edition"),
        (edition_verdict(F.lit(0.049), F.lit(0.774)), "different_edition"),
        (tx.canonical_spelling(F.lit("travelled")), "traveled"),
        *[(tx.canonical_spelling(F.lit(a)), b) for a, b in (("rise", "rise"), ("wise", "wise"), ("vise", "vise"), ("arise", "arize"), ("recognised", "recognized"), ("grey", "gray"), ("rising", "rizing"), ("ised", "ised"))],
        (tx.canonical_spelling(F.lit("pouring")), "pouring"),
        (tx.canonical_spelling(F.lit("centre")), "center"),
        (tx.canonical_spelling(F.lit("towards")), "toward"),
        (tx.canonical_spelling(F.lit("favourite")), "favorite"),
        (near_boundary(F.lit(0.049), F.lit(0.774), F.lit(0.93)), True),
        (trust_state(F.lit(None).cast("int"), F.lit(0)), "unchecked"),
        (trust_state(F.lit(100), F.lit(3)), "significant"),
        (trust_state(F.lit(1000), F.lit(29)), "minor"),
        (off_by(F.lit(10.0), F.lit(0.0), 0.1), False),
    ]


def test_known_answers(spark):
    columns, wants = zip(*cases(), strict=True)
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    assert [(i, g) for i, g in enumerate(got)] == list(enumerate(wants))
