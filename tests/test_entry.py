"""The entry module stands without the optional operators or what they import."""

import sys

import pytest

import __spark_entry__ as entry
from yardstream.operators import quality as Q


@pytest.mark.parametrize("hidden", ["public_tokenizers", "yardstream.llm", "corpus_pipeline"])
def test_queries_without_the_optional_part(monkeypatch, hidden):
    for name in [n for n in sys.modules if n.startswith(("yardstream.llm", "corpus_pipeline", "public_tokenizers"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, hidden, None)  # importing it fails
    with pytest.warns(UserWarning, match="left out"):
        names = set(entry.queries())
    assert len(names) > 130 and not [n for n in names if n.startswith("op") and n[2:3].isdigit()]


def test_log_with_broken_lines(spark, tmp_path):
    lines = ['{"variant": "a", "success": true, "confidence": 0.5, "time_ms": 10}', '{"variant": "a", "succ', "", "no json", '{"success": false}', '{"success": "often"}', "[1]"]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    log = Q.read_ocr_log(spark, f"file://{tmp_path}/log.jsonl")
    assert Q.ocr_log_state(log).first().asDict() == {"lines": 6, "broken_lines": 4}
    assert sorted(map(tuple, Q.ocr_log_summary(log).collect())) == [("a", 1, 1.0, 10.0, 0.5), ("main", 1, 0.0, None, None)]
    assert all(r.success is None and r.variant is None for r in log.filter("broken is not null").collect())
