"""Candidates stored as people and addresses, once and again."""

import pytest

from leadlens.operators import persist

SCHEMA = "company_id long, tenant string, name string, email string, title string, url string"


def state(spark, base):
    held = persist.snapshot(spark, base)
    return sorted(map(tuple, held["people"].collect())), sorted(map(tuple, held["emails"].collect()), key=str)


def test_second_run_changes_nothing(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    assert state(spark, base) == ([], [])
    rows = [
        (1, "t", "Ann Lee", "Ann@a.example", None, "u1"), (1, "t", "ann  lee", None, "Chief Executive Officer", "u2"), (1, "t", "Bob Ray", None, "", "u1"), (2, "t", "Ann Lee", "ann@b.example", "CTO", None),
        (1, "t", None, "info@a.example", None, "u1"), (1, "t", "Cy Fox", "sales@a.example", None, "u1"), (1, "t", "Our Team", "x@a.example", None, "u1"), (1, "t", None, None, None, None), (1, "s", "Ann Lee", "ann@a.example", None, "u1"),
    ]
    assert persist.persist(spark.createDataFrame(rows, SCHEMA), base) == 1
    people, emails = first = state(spark, base)
    named = {(p[1], p[2].lower()): p for p in people}
    assert len(people) == 4 and {(c, n.replace("  ", " ")): p[3] for (c, n), p in named.items()} == {(1, "ann lee"): "Chief Executive Officer", (1, "bob ray"): "Auto-discovered", (2, "ann lee"): "CTO", (1, "cy fox"): "Auto-discovered"}
    owner = {(e[1], e[2]): e[3] for e in emails}
    ann = next(p[0] for p in people if p[1] == 1 and p[2].lower().replace("  ", " ") == "ann lee")
    assert owner[("t", "ann@a.example")] == owner[("s", "ann@a.example")] == ann
    assert owner[("t", "info@a.example")] is None and owner[("t", "sales@a.example")] is None and owner[("t", "x@a.example")] is None
    assert persist.persist(spark.createDataFrame(rows, SCHEMA), base) == 2
    assert state(spark, base) == first
    more = [(1, "t", "Bob Ray", "bob@a.example", "VP Sales", "u3"), (1, "t", "Di Orr", "x@a.example", None, "u3")]
    assert persist.persist(spark.createDataFrame(more, SCHEMA), base) == 3
    people, emails = state(spark, base)
    assert {p[2]: p[3] for p in people}["Bob Ray"] == "VP Sales" and len(people) == 5
    assert {e[2]: e[3] for e in emails}["x@a.example"] == next(p[0] for p in people if p[2] == "Di Orr")


def test_lost_run_leaves_the_last_version(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(1, "t", "Ann Lee", "ann@a.example", None, "u")], SCHEMA)
    persist.persist(rows, base)
    before = state(spark, base)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(persist, "merged_emails", lost)
        with pytest.raises(RuntimeError):
            persist.persist(spark.createDataFrame([(1, "t", "Bob Ray", None, None, "u")], SCHEMA), base)
    assert state(spark, base) == before
    assert persist.persist(rows, base) == 2 and state(spark, base) == before
