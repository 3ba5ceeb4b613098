"""Only the lines that a text speaks for are spelled out."""

import pandas as pd

from crosswitness.llm import line_dedup


def test_a_text_spells_only_the_lines_it_is_named_for():
    text = "one line here\nsecond line 5\nsecond line 6\nthird line"
    names = [line_dedup._name("second line <*>"), line_dedup._name("third line")]
    out = pd.concat(line_dedup._spelled([pd.DataFrame({"text": [text], "names": [names]})]))
    assert list(zip(out["name"], out["line"])) == [(names[0], "second line <*>"), (names[1], "third line")]
