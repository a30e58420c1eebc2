from lodestack.functions.inputs import dropped_paths, engine_of_label, limit_of, summary_lines
from lodestack.i18n import format_number, t
from lodestack.operators.budget import Decision


def test_paths_limits_and_labels():
    assert dropped_paths("{/a b/c.txt} /d.md {e f}") == ["/a b/c.txt", "e f", "/d.md"]
    assert dropped_paths(" /a  /b ") == ["/a", "/b"] and dropped_paths("") == []
    assert [limit_of(x, 7) for x in ("12", "0", "-1", "x", "")] == [12, 7, 7, 7, 7]
    assert engine_of_label("Fast", {"Fast": "openai"}) == "openai" and engine_of_label("?", {}) == "approx"


def test_summaries():
    free = Decision(3, 1, 1, 1, 0, None, None, False, False)
    lines = summary_lines({"ready": 2, "images": 1}, free, 1000)
    assert lines == [t("summary.ok", count=2, limit=format_number(1000)), t("summary.images", count=1)]
    blocked = Decision(3, 1, 1, 2000, 1, "a.txt", 1500, True, True)
    assert "a.txt" in summary_lines({"ready": 2}, blocked, 1000)[0] and len(summary_lines({"ready": 2}, blocked, 1000)) == 1
    assert "2" in summary_lines({}, Decision(3, 1, 1, 2000, 0, None, None, True, True), 1000)[0]
