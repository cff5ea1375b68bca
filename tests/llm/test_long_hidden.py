"""Hidden passages of any length, and borders of words in letters set apart."""

from test_llm_brute_force import reader  # noqa: F401


def test_glued_words_are_parted(reader):  # noqa: F811
    assert reader.set_apart("y o u i d i o t")[-1] == "idiot"
    assert reader.measure("y o u i d i o t")[0] == 5.0


def test_long_passages_are_read(reader):  # noqa: F811
    passage = " ".join(" ".join("pathetic") for _ in range(40))
    assert reader.set_apart(passage).count("pathetic") >= 30
    long = "x" + "stuuupid" * 40
    assert "stupid" in reader.read(long)
