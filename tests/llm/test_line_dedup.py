"""op10 on small cases and against DuckDB."""

from __future__ import annotations

from outletiq.llm import line_dedup
from outletiq.llm.queries import ORACLES, QUERIES
from outletiq.plans.check import canonical_rows, duck


def test_small_case(spark, make_docs):
    rows = [(i, f"top\n body {i}\n\n  top  \nfoot", "en", "a") for i in range(6)]
    rows += [(10 + i, f"top\nother {i}" if i < 2 else f"other {i}", "en", "b") for i in range(8)]
    rows += [(30, None, "en", "a"), (31, "", "en", "b"), (32, "top", "en", None), (33, "word " * 50_000, "en", "b"),
             (34, "foot\nfoot\nx", "en", "a"), (34, "foot\nfoot\nx", "en", "a")]
    docs = make_docs(rows).withColumn("lines", line_dedup.F.lit(1)).withColumn("n_lines", line_dedup.F.lit("old"))
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, 0.5, 3).collect()}
    assert got[2].text == " body 2\n" and (got[2].n_lines, got[2].n_dropped) == (5, 3)
    assert got[10].text == "top\nother 0" and got[32].text == "top"  # below the ratio; too few pages
    assert got[34].text == "x" and got[34].n_dropped == 2
    assert got[30].text is None and (got[30].n_lines, got[30].n_dropped) == (0, 0)
    assert got[31].text == "" and got[33].text == "word " * 50_000
    out = line_dedup.drop_boilerplate(docs, 0.5, 3)
    assert out.count() == len(rows) and set(out.columns) == set(docs.columns) | {"n_dropped"}
    assert line_dedup.drop_boilerplate(make_docs([]), 0.5, 3).count() == 0


def test_any_column_names_and_repeated_ids(spark, make_docs):
    rows = [(i, f"top\nbody {i}", "en", "a") for i in range(6)] + [(7, "top\nseven", "en", "b")] * 5 + [(8, "x", "en", "b")] * 9
    clash = {"__host": "h", "__all": "a", "every": "e", "of_host": "o", "lines": "l", "kept": "k", "row": "r", "a.b": "dot"}
    docs = make_docs(rows)
    for name, value in clash.items():
        docs = docs.withColumn(name, line_dedup.F.array(line_dedup.F.lit(value)))
    got = line_dedup.drop_boilerplate(docs, 0.3, 5)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = got.collect()
    assert all(r[n] == [v] for r in got for n, v in clash.items())
    # each row is a page, also where an id repeats: 5 of 14 pages of b hold the line
    assert {(r.doc_id, r.text) for r in got if r.doc_id > 6} == {(7, ""), (8, "")}
    assert {r.text for r in got if r.doc_id < 6} == {f"body {i}" for i in range(6)}


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    got, want = QUERIES["op10_line_dedup"](spark, sf), duck(sf).execute(ORACLES["op10_line_dedup"])
    names = [d[0] for d in want.description]
    assert canonical_rows([tuple(r) for r in got.collect()], got.columns) == canonical_rows(want.fetchall(), names)
