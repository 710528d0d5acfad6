import re

import pytest

from driftwell.llm import licences
from tests.llm.helpers import EDGES, documents


def pairs(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(w, w[1:]))


def test_notices_whole_and_inside(spark):
    mit = licences.TEMPLATES["mit-permission"]
    rows = [(10, licences.TEMPLATES["mit"]), (11, "Some prose.\nReleased under the MIT  license!\nMore prose here."), (12, mit.replace(". ", ".\n")), (13, "Intro text of its own.\n\n" + mit.replace(": ", ":\n") + "\n\nOutro."), (14, "A license to be cited"), (15, "All rights reserved.\nLicensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licences.scan(documents(spark, [*rows, *EDGES])).collect()}
    assert got[10].licences == "mit" and got[10].best_dice == 1.0 and got[11].licences == "mit" and got[11].n_matches == 1
    assert got[12].licences == got[13].licences == "mit-permission" and got[14].licences == "" and got[15].licences == "all-rights-reserved,cc-by-nc-4.0"
    assert all((got[i].licences, got[i].n_matches, got[i].best_dice) == ("", 0, 0.0) for i in range(1, 10))


def test_dice_by_hand(spark):
    near = "Licensed under the Apache Software License, Version 2.0."
    a, b = pairs(near), pairs(licences.TEMPLATES["apache-2.0"])
    dice = 2 * len(a & b) / (len(a) + len(b))
    row = licences.scan(documents(spark, [(1, near)]), threshold=60).collect()[0]
    assert row.best_dice == pytest.approx(dice, abs=1e-6) and "apache-2.0" in row.licences
    assert licences.scan(documents(spark, [(1, near)]), threshold=90).collect()[0].licences == ""


def test_plan_is_native(spark):
    plan = licences.scan(documents(spark, EDGES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert licences.scan(documents(spark, EDGES).limit(0)).count() == 0
    with pytest.raises(ValueError):
        licences.scan(documents(spark, EDGES), templates={"x": "one"})


def test_wrapped_headers_above_code(spark):
    t = licences.TEMPLATES
    comment = lambda *parts: "\n#\n".join("\n".join("# " + " ".join(p.split()[i : i + 9]) for i in range(0, len(p.split()), 9)) for p in parts)
    code = "\n".join(f"def f{i}(x):\n    return x * {i}" for i in range(40))
    rows = [
        (1, comment("tool, a program", t["gpl-2.0-grant"], t["gpl-warranty"], "You should have it.") + "\n\n" + code),
        (2, comment(t["lgpl-2.1-grant"]) + "\n\n" + code), (3, comment(t["agpl-3.0-grant"], t["gpl-warranty"]) + "\n\n" + code),
        (4, comment(t["bsd-grant"], "1. " + t["bsd-source-clause"], "2. " + t["bsd-binary-clause"]) + "\n\n" + code), (5, code),
    ]
    got = {r.doc_id: r.licences for r in licences.scan(documents(spark, rows)).collect()}
    assert got == {1: "gpl-2.0-grant,gpl-warranty", 2: "lgpl-2.1-grant", 3: "agpl-3.0-grant,gpl-warranty", 4: "bsd-binary-clause,bsd-grant,bsd-source-clause", 5: ""}


def test_rows_equal_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [*EDGES[:8], *((20 + i, f"Some words of number {i}.\n\n{v}\nmore " * (1 + i % 3)) for i, v in enumerate(licences.TEMPLATES.values())), (90, "x y " * 500)]
    docs = documents(spark, rows, clashing=False)
    docs.write.parquet(f"{tmp_path}/d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, n_matches, licences, best_dice FROM ({licences.SQL})").fetchall())
    assert sorted(tuple(r) for r in licences.scan(docs).collect()) == want and any(w[1] for w in want)
