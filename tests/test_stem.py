import pytest

from folioscope.functions import stem


@pytest.mark.parametrize(
    ("word", "expected"),
    [("elephants", "eleph"), ("dependent", "depend"), ("miami", "miami"), ("", ""), ("running", "run"), ("flies", "fli"), ("ties", "tie"), ("hoping", "hope"), ("hopping", "hop")]
    + [("relational", "relat"), ("conditional", "condit"), ("generously", "generous"), ("happy", "happi"), ("skies", "sky"), ("national", "nation"), ("agreed", "agre"), ("sky", "sky")],
)
def test_english(word, expected):
    assert stem.english(word) == expected


@pytest.mark.parametrize(("word", "expected"), [("häuser", "haus"), ("autobahnen", "autobahn"), ("kategorischen", "kategor"), ("mädchen", "madch"), ("aufeinander", "aufeinand"), ("freundlichkeit", "freundlich")])
def test_german(word, expected):
    assert stem.german(word) == expected


def test_languages(spark):
    from folioscope.operators import postings

    assert stem.stem("eng", "running") == "run" and stem.stem("zho", "running") == "running" and stem.stem(None, "x") == "x"
    docs = spark.createDataFrame([("en", 1, "Running runs run"), ("fr", 2, "running")], "archive string, doc_id long, text string")
    assert {tuple(r) for r in stem.stemmed(postings.postings(docs)).collect()} == {("en", "run", 1, 3), ("fr", "running", 2, 1)}
