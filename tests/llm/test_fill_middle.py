"""Fill-in-middle: SQL twin (test_native), plain Python, odd inputs."""

import hashlib
import re

from pyspark.sql import functions as F

from geostrata.llm import fill_middle


def plain(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(fill_middle.UNIT, text)
    n = len(units)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", " ", "\n\t \n", "word", " two words ", "a\x01b \x02c\x01\x02 \x02d \x02e", "\x01", "\x02 \x01 \x02", "<P> in it", "x <S>", "<M>", "<", "a < b <P <S", "<< >> <P<P>",
    "$0 $1 \\ \\0 back", "é中文 \U0001f600  x y \u0085z", "one\r\ntwo\x0b\x0cthree", "w " * 30000, "x" * 50000, " " * 20000, "a\x00b c",
]


def test_against_plain_python(spark):
    rows = [(i, t, "clash", "clash", "clash") for i in range(-3, 40) for t in [TEXTS[(i + 3 * k) % len(TEXTS)] for k in range(3)]] + [(None, "a b c d", "", "", "")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, output string, `MARKED` string")
    got = fill_middle.transform(df)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(r[0], *plain(r[0], r[1])) for r in rows], key=key)
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "spm", "psm"}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(r.restored_sha256 for r in fill_middle.digests(got).collect()) == sorted(sha(r[1]) for r in rows)
    assert sorted(r.output_sha256 for r in fill_middle.digests(got).collect()) == sorted(sha(plain(r[0], r[1])[-1]) for r in rows)


def test_empty_table_and_parameters(spark):
    df = spark.createDataFrame([(k, f"a {k} b") for k in range(200)], "doc_id long, text string")
    assert fill_middle.digests(fill_middle.transform(df.limit(0))).count() == 0
    assert {r.form for r in fill_middle.transform(df, percent=0).collect()} == {"plain"}
    assert {r.form for r in fill_middle.transform(df, percent=100, percent_spm=0).collect()} == {"psm"}
    assert fill_middle.transform(df, seed=7).exceptAll(fill_middle.transform(df)).count() > 50


def test_no_shuffle_and_one_scan(spark):
    out = fill_middle.digests(fill_middle.transform(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 1 and "lang" not in plan
    assert out.where(F.col("n") > 0).count() > 0
