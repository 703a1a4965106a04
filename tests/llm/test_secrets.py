import base64
import hashlib
import random
import re

import numpy as np

from codeloom.llm import secrets

SCHEMA = "doc_id long, text string, spans int"
#: The contract's pattern, with the words' letters in either case.
ASSIGN = "((?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]))" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def rows_of(spark, texts):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in secrets.digest(secrets.find(docs)).collect()}


def test_base_spans_against_a_plain_scan(spark):
    rng = random.Random(5)
    bits = ["password", "TOKEN", "api_key", "ApiKey", "token=token: abcdefgh", "=", ": ", " = '", '"', "abc", "s3cr3tvalue.x-y", "secret", "AKIA" + "B7" * 8, "AKIAAKIA", "é😀 ",
            "0123456789abcdef01234567", "deadbeef", " ", "\n", "passwd:hunter22"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(300)] + ["", None]
    got = rows_of(spark, texts)
    for i, text in enumerate(texts):
        want = base(text or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (text, got[i].spans, joined)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[2] == k for x in want) for k in ("assign", "access", "hex"))


def test_random_tokens_are_found_and_words_are_not(spark):
    rng, gen = random.Random(1), np.random.default_rng(1)
    syllables = "the ing tion er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic".split()
    texts, planted = [], {}
    for i in range(400):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
        if i % 8 == 0:
            token = base64.b64encode(gen.bytes(rng.choice([24, 30, 48]))).decode().rstrip("=")
            words[30] = token
            planted[i] = token
        texts.append(" ".join(words))
    got = rows_of(spark, texts)
    hits = 0
    for i, text in enumerate(texts):
        found = [x.split(":") for x in got[i].spans.split(",") if x.startswith("random")]
        tokens = [text[int(s) : int(e)] for _, s, e in found]
        if i in planted:
            hits += planted[i] in tokens
            tokens = [t for t in tokens if t != planted[i]]
        assert tokens == []
    assert hits >= 0.95 * len(planted)


HEX, LETTERS = "0123456789abcdef", "ghijklmnopqrstuvwxyz"
ENCODINGS = {
    "upper hexadecimal": HEX.upper(), "base 36": HEX + LETTERS, "upper base 36": (HEX + LETTERS).upper(),
    "base 62": HEX + LETTERS + (HEX[10:] + LETTERS).upper(), "base 64": HEX + LETTERS + (HEX[10:] + LETTERS).upper() + "+/",
}
PLAIN = [
    "abcdefghijklmnopqrstuvwxyz", "01234567890123456789", "2024-01-01-2024-12-31-backup", "this_is_a_long_identifier_name_here", "getTheFullNameOfUserFromDatabase",
    "CamelCaseIdentifierWithManyWords2024", "a" * 28, "-" * 32, "node_modules/react-dom/server/index", "com/example/project/service/Impl", "A" * 16 + "B" * 16, "1111111111222222222233333333",
    "Donaudampfschifffahrtsgesellschaft", "supercalifragilisticexpialidocious", "README_2023_final_version_v2_copy", "user-profile-settings-page-2", "ISBN-978-3-16-148410-0-2020",
]


def test_unnamed_secrets_of_every_encoding_and_length(spark):
    rng = random.Random(3)
    texts, planted = [], []
    for kind, alphabet in ENCODINGS.items():
        for n in (20, 24, 28, 32, 40, 64, 100):
            for _ in range(6):
                token = "".join(rng.choice(alphabet) for _ in range(n))
                planted.append((len(texts), kind, n, token))
                texts.append(f"some words before {token} and some after it")
    texts += [f"some words before {x} and some after it" for x in PLAIN]
    got = rows_of(spark, texts)
    found = [[texts[i][int(s) : int(e)] for k, s, e in (x.split(":") for x in got[i].spans.split(",") if x) if k == "random"] for i in range(len(texts))]
    assert [x for x in found[len(planted) :] if x] == []
    for kind in ENCODINGS:
        hits = [t in found[i] for i, k, _, t in planted if k == kind]
        assert sum(hits) >= 0.9 * len(hits), kind
    for n in (32, 40, 64, 100):
        assert all(t in found[i] for i, _, m, t in planted if m == n)


def test_time_grows_with_the_text(spark):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice(HEX) for _ in range(32)) + " secret=abcdef" for _ in range(15_000))
    got = rows_of(spark, [text])[0]
    assert (got.n_hex, got.n_assign) == (15_000, 15_000)  # took minutes when each match walked the text


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert secrets.digest(secrets.find(docs)).collect() == []
