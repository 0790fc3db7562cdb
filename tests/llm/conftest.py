import pytest

PASSAGE = "The committee met again in spring and every member brought a different map of the river valley with notes. " * 5


def edge_texts():
    """(doc_id, text, lang): nulls, empty, blank, copies, near copies, odd characters and one long text."""
    rows = [
        (1, "Hello World, it's a test! 123", "en"), (2, "Hello World, it's a test! 123", "en"), (3, None, "en"), (4, "", None), (5, "  \n\t ", "de"),
        (6, "Éléphant ÉCOLE straße ΣΑΣ İx   12", "fr"), (7, "x<|endoftext|>y <|startoftext|>", "en"), (8, "a\x1cb \x00 c\x00\x00", None), (9, "one", "en"), (10, "one two", "en"),
        (11, PASSAGE + "tail one", "en"), (12, "head " + PASSAGE, "en"), (13, PASSAGE + "tail one", "en"), (14, "a" * 1500, None), (15, "日本語 テキスト 👍🏽", "ja"),
        (16, " ".join(f"w{i % 977}" for i in range(20000)), "en"), (None, "no identifier here at all", "en"), (17, "Hello World, it's a test! 123", "en"), (9, "one", "en"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """The edge texts with extra columns whose names the operators use inside."""
    rows = [(i, t, lang, None if i == 3 else "src", len(t or ""), "clash", 7, "clash", [1.0]) for i, t, lang in edge_texts()]
    kind = "doc_id long, text string, lang string, source string, n_chars long, id string, fp long, words string, score array<double>"
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
