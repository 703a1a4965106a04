"""Snippets against SQLite's own choice of window."""

import random
import sqlite3

from pyspark.sql import functions as F

from codeloom.operators import snippets
from codeloom.schema import node_meta

WORDS = "alpha beta gamma delta x yy zzz one two three".split()


def test_windows_against_sqlite():
    rng, db = random.Random(1), sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, body, tokenize=\"unicode61 tokenchars '_'\")")
    texts = []
    for i in range(400):
        n = rng.choice([3, 15, 18, 19, 40, 90])
        texts.append("".join(rng.choice(WORDS[:4] if rng.random() < 0.15 else WORDS[4:]) + rng.choice([" ", " ", " ", ", ", ". ", ": ", ".\n", ".", " - "]) for _ in range(n)).strip() + rng.choice(["", ".", " !"]))
        db.execute("insert into t values (?, ?)", (i, texts[-1]))
    for terms in (["alpha"], ["alpha", "beta", "gamma"], ["delta", "x"]):
        want = dict(db.execute("select id, snippet(t, 1, '', '', ' ... ', 18) from t where t match ?", (" OR ".join(terms),)).fetchall())
        assert len(want) > 100
        for i, snippet in want.items():
            assert snippets.snippet_of(texts[int(i)], frozenset(terms)) == snippet, (texts[int(i)], terms)


def test_first_field_that_is_not_blank(spark):
    rows = [(1, "  ", None, "body with alpha " * 20), (2, "The doc.", "def f()", "alpha"), (3, None, None, None), (4, "", "sig(Älpha)", "x")]
    d = spark.createDataFrame(rows, "id int, d string, s string, b string").select("id", node_meta(docstring=F.col("d"), signature=F.col("s"), body_preview=F.col("b")).alias("meta"))
    got = {r.id: r.s for r in d.select("id", snippets.hit_snippet(["alpha"]).alias("s")).collect()}
    assert got[2] == "The doc." and got[3] is None and got[4] == "sig(Älpha)" and got[1].count("alpha") == 6 and got[1].endswith(" ...")


def test_long_texts_take_linear_time():
    assert snippets.window_of("alpha " * 200_000, frozenset(["alpha"]))[:2] == (0, 1137)
