"""Places of tokens in whole texts, against the text itself."""

import re

from weftline.operators import wordforms

TEXTS = {1: "  two  spaces\tand\n\n lines ", 2: "für Ärger, naïve 日本 x", 3: "", 4: None, 5: " \n\t ", 6: "a" * 70000, 7: "x " * 40000, 8: "no break\x0bline\x1cend", 9: "a"}


def test_places(spark):
    rows = [(i, t, "kept out") for i, t in TEXTS.items()] + [(9, "a", "again"), (None, "b c", "")]
    out = wordforms.positions(spark.createDataFrame(rows, "id long, text string, start string"), ["id"]).collect()
    got = {}
    for r in out:
        got.setdefault(r["id"], []).append(tuple(r)[1:])
    assert sorted(got.pop(9)) == [(0, "a", 0, 1, 0, 1)] * 2
    assert sorted(got.pop(None)) == [(0, "b", 0, 1, 0, 1), (1, "c", 2, 3, 2, 3)]
    for i, text in TEXTS.items():
        want = [(w, m[0], *m.span(), len(text[: m.start()].encode()), len(text[: m.end()].encode())) for w, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))] if i < 7 else None
        if want is not None:
            assert sorted(got.get(i, [])) == want
    assert sorted(got[7]) == [(w, "x", 2 * w, 2 * w + 1, 2 * w, 2 * w + 1) for w in range(40000)]
    assert [t[1] for t in sorted(got[8])] == ["no break", "line\x1cend"]


def test_none(spark):
    assert wordforms.positions(spark.createDataFrame([], "a int, b string, text string"), ["a", "b"]).columns == ["a", "b", "w", "token", "start", "stop", "start_byte", "stop_byte"]
