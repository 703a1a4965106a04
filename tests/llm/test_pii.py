import hashlib
import random
import re
import time

from codeloom.llm import pii

SCHEMA = "doc_id long, text string, spans int, row string"


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    """The contract's patterns as they stand."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def rows_of(spark, texts, **how):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return {r.doc_id: r for r in pii.digest(pii.find(docs, **how)).collect()}


def added(row, text):
    return [(k, text[int(s) : int(e)]) for k, s, e in (x.split(":") for x in row.spans.split(",") if x) if k.startswith("context_")]


BITS = ["a@b.c", "@", "me.x%y+z-1@host-1.example.com", ".", "-", " ", "(", ")", "+", "1", "22", "255", "256", "007.", "10.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500000000000004", "+1 (555) 010-9999",
        "+44 20 7946 0958", "é", "😀", "\n", ":", "=", "word", "1.2.3.4.5.6.7.8", "a@@b.c", "x@y.z@w.v", "0000000000000000"]


def test_base_spans_against_the_patterns_as_they_stand(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(0, 25))) for _ in range(2_000)]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t
    some = [*texts[:200], "", None]
    got = rows_of(spark, some)
    assert len(got) == len(some)
    for i, text in enumerate(some):
        want = plain(text or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x[1] == k for x in want) for k in range(4))
        assert [x for x in got[i].spans.split(",") if x and not x.startswith("context")] == ([x for x in joined.split(",") if x])


def test_words_and_their_hashes_agree():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice([*BITS, "a", "b:", " = ", " "]) for _ in range(rng.randrange(0, 30)))
        words = [m[0] for m in pii._TOKEN.finditer(text)]
        assert len(words) == len(pii.word_hashes(pii._raw(text))) == len(pii._plain(pii._raw(text)))
        assert pii._plain(pii._raw(text)).tolist() == [not re.search("[0-9@]", w) for w in words]


def filler(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6))) for _ in range(12))


def number(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def test_contexts_discover_identifiers_without_a_base_shape(spark):
    rng, texts, planted, clean = random.Random(1), [], {}, []
    for i in range(40):  # seeds
        texts.append(f"{filler(rng)} reach me at +49 {number(rng, 3)} {number(rng, 6)} {filler(rng)}")
        texts.append(f"{filler(rng)} mailto: u{i}x@mail{i % 7}.example.com {filler(rng)}")
    for i in range(10):
        planted[len(texts)] = ("context_phone", f"{number(rng, 3)}-{number(rng, 4)}")
        texts.append(f"{filler(rng)} reach me at {planted[len(texts)][1]}, {filler(rng)}")
        planted[len(texts)] = ("context_email", f"v{i}[at]mail.example.com")
        texts.append(f"{filler(rng)} <mailto:{planted[len(texts)][1]}> {filler(rng)}".replace("<", ""))
    for _ in range(200):  # numbers and words of the same looks in other contexts, and the contexts' words apart
        clean.append(len(texts))
        texts.append(f"{filler(rng)} meet at {number(rng, 7)} {filler(rng)} page {number(rng, 3)}-{number(rng, 4)} {filler(rng)} reach {filler(rng)}")
    got = rows_of(spark, texts)
    found = sum(planted[i] in added(got[i], texts[i]) for i in planted)
    assert found == len(planted), [(planted[i], added(got[i], texts[i])) for i in planted]
    assert all(added(got[i], texts[i]) == [] for i in clean)


def test_discoveries_make_further_patterns(spark):
    """``call desk`` has no seed: its instances are known from the trusted context first, then it discovers others."""
    rng = random.Random(2)
    local = [f"{number(rng, 3)}-{number(rng, 5)}" for _ in range(44)]
    texts = [f"{filler(rng)} ring phone +31 {number(rng, 9)} {filler(rng)}" for _ in range(300)]
    texts += [f"{filler(rng)} ring phone {x} {filler(rng)}" for x in local[:40]]
    texts += [f"{filler(rng)} call desk {x} {filler(rng)}" for x in local]
    texts += [f"{filler(rng)} call {filler(rng)} desk {filler(rng)}" for _ in range(60)]
    last = range(len(texts) - 60 - 4, len(texts) - 60)
    one, three = rows_of(spark, texts, rounds=1), rows_of(spark, texts, rounds=3)
    assert [added(one[i], texts[i]) for i in last] == [[]] * 4
    assert [added(three[i], texts[i]) for i in last] == [[("context_phone", x)] for x in local[40:]]


def test_copies_of_one_seed_make_no_pattern_and_a_seeds_value_is_known_elsewhere(spark):
    rng = random.Random(6)
    texts = [f"{filler(rng)} fax +49 30 1234567 {filler(rng)}" for _ in range(50)] + [f"{filler(rng)} fax 7654321 {filler(rng)}", f"{filler(rng)} 49301234567 {filler(rng)}"]
    got = rows_of(spark, texts)
    assert added(got[50], texts[50]) == [] and added(got[51], texts[51]) == [("context_phone", "49301234567")]


def test_null_ids_repeated_rows_empty_table_and_long_texts(spark):
    text = "write a@b.cc or +1 555 010 9999"
    docs = spark.createDataFrame([(None, text, None, None), (1, text, 0, ""), (1, text, 0, ""), (1, "10.0.0.1", 0, ""), (2, None, 0, "")], SCHEMA)
    got = sorted((str(r.doc_id), r.spans) for r in pii.digest(pii.find(docs)).collect())
    spans = "email:6:12,phone:16:31"
    assert got == sorted([("1", "ip:0:8"), ("1", spans), ("1", spans), ("2", ""), ("None", spans)])
    assert pii.digest(pii.find(docs.limit(0))).collect() == []
    began = time.time()
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "a" * 200_000 + "@" + "b" * 200_000, "1 " * 150_000):
        pii.identifiers(long)
    assert time.time() - began < 20
