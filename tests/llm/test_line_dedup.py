import random

from codeloom.llm import line_dedup

SCHEMA = "doc_id long, text string, source string, pos int, line string"


def plain(rows, sites=3, words=3):
    spread, first = {}, {}
    for i, t, s in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(line.split()) >= words and i is not None:
                spread.setdefault(line, set()).update([s] if s else [])
                first[line] = min(first.get(line, (i, p)), (i, p))
    bad = {x for x, s in spread.items() if len(s) >= sites}
    out = []
    for i, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for p, x in enumerate(lines) if i is None or x not in bad or first[x] == (i, p)]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_plain_counts(spark):
    rng = random.Random(4)
    lines = [f"line number {i} of the pool" for i in range(30)] + ["short one", "", "x", "all rights are reserved here"]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.5 else f"own line {i} {k}" for k in range(rng.randrange(0, 9))), f"s{rng.randrange(6)}") for i in range(120)]
    rows += [(500, None, "s1"), (501, "", "s1"), (502, lines[0], None), (None, "\n".join(lines[:4]), "s1")]
    docs = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    out = line_dedup.remove_boilerplate(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()], key=str) == plain(rows)


def test_many_sites_near_the_threshold(spark):
    rows = [(i * 100 + k, f"line on {n} sites exactly", f"site{k}") for i, n in enumerate((2, 9, 10, 11, 12, 14, 60)) for k in range(n)]
    docs = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)
    out = line_dedup.remove_boilerplate(docs, min_sites=11)
    assert sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()], key=str) == plain(rows, 11)


def test_empty_table(spark):
    assert line_dedup.remove_boilerplate(spark.createDataFrame([], SCHEMA)).collect() == []


def test_passages_on_one_site(spark):
    long, short = " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49))
    rows = [(3, f"a\n{long}\n{short}\n{long}", "s"), (5, f"{long}\nb\n{short}", "s"), (7, f"{long} x\n{long} x", "s"), (8, None, "s"), (None, long, None)]
    out = line_dedup.remove_passages(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA))
    want = {3: (f"a\n{long}\n{short}", 4, 1), 5: (f"b\n{short}", 3, 1), 7: (f"{long} x\n{long} x", 2, 0), 8: (None, 0, 0), None: (long, 1, 0)}
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out.collect()} == want


def test_clashing_names_and_long_texts(spark):
    names = "doc_id long, text string, source string, n_lines string, n_removed string, _doc string, _gone string, salt int, h1 int"
    pool = [f"this line stands on many sites {i}" for i in range(20_000)]
    rows = [(i, "\n".join(pool if i < 3 else [*pool[:3], f"an own line {i}"]), f"s{i}", "a", "b", "c", "d", 1, 2) for i in range(4)]
    docs = spark.createDataFrame(rows, names)
    out = line_dedup.remove_boilerplate(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert (got[0].text, got[0]._n_removed) == (rows[0][1], 0)
    assert (got[1].text, got[1]._n_lines, got[1]._n_removed) == ("", 20_000, 20_000)
    assert (got[3].text, got[3].n_lines, got[3]._gone) == ("an own line 3", "a", "d")
