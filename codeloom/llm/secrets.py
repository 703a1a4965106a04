"""Secrets in texts: named patterns, and a randomness battery for unnamed ones, in DataFrame operations.

Base spans come from three patterns. The method adds spans of other tokens that look random. A token
is a run of 20 or more letters, digits and ``+/=_-``; its encoding (hexadecimal, base 36 or base 64) is
inferred from its characters. Three tests compare it with what text of its length gives:

* chi-squared against a uniform alphabet: text uses few letters often, so its statistic is large;
* runs: how often neighbours differ in class (digit, capital, other), rare in text;
* serial correlation at lag one: of the vowels, which text alternates with consonants and random
  tokens don't; and of the symbols' places in the encoding's alphabet, where a correlation that is
  too far from nought for random symbols (counters, alphabets, joined names and dates) counts against.

Each gives a normal score, positive for random tokens; their sum over the root of three gives a p-value
under the hypothesis "text". Benjamini and Hochberg's step-up then runs in each class of encoding and
length, with p-values counted in bins of their logarithm: counts over all documents, of fixed size.

Every match is visited once: places are sums over the matches before, walked in chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import chunked_walk, let, stage

#: The base patterns, and the characters that a token consists of.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/=_-]{20,}"
ASSIGN_CHARS = 6

#: Share of false discoveries in each class of tokens.
ALPHA = 0.001
#: Text's chance that two of its letters are equal, and the correlation of neighbours as vowels; random
#: tokens have 1/k, and nought.
TEXT_EQUAL, TEXT_VOWELS = 0.066, -0.36
#: Text's chance that neighbours differ in class, by encoding: words with capitals, digits and marks
#: between them pass for base 64. Random tokens have 0.47, 0.40 and 0.64.
TEXT_TURN = {16: 0.1, 36: 0.1, 64: 0.3}
#: A correlation of symbols so many deviations from nought is no longer one of random symbols.
STRUCTURED = 3.0
#: The alphabets of the encodings.
ALPHABETS = {16: "0123456789abcdef", 36: "0123456789abcdefghijklmnopqrstuvwxyz", 64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="}
#: Lengths that part the classes, longest tokens last.
LENGTHS = (24, 32, 48, 64, 128)
#: p-values are counted in bins of a tenth of a power of ten, down to 10**-30.
BINS = 300


def _spans(text: Column, pattern: str, extra: tuple[str, Callable[[Column], Column]] | None = None) -> Column:
    """Spans (s, e) in code points of all matches of ``pattern``, with ``v``, ``extra`` of the match."""
    kind, of = extra or ("boolean", lambda m: F.lit(True))
    kind = f"struct<s:int,e:int,v:{kind}>"

    def placed(found: Column) -> Column:
        pairs = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), of(m).alias("v")))

        def step(at: Column, x: Column) -> Column:
            return F.struct((at + x.g + x.n).alias("state"), F.struct((at + x.g).alias("s"), (at + x.g + x.n).alias("e"), x.v.alias("v")).alias("out"))

        walked = chunked_walk(F.filter(pairs, lambda x: x.n.isNotNull()), F.lit(0), step, kind).out
        return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(f"array<{kind}>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with arrays ``assign``, ``access``, ``hex`` and ``token`` of spans (s, e, v);
    a token's v is its string."""
    text = F.col("text")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.array().cast("array<struct<s:int,e:int,v:boolean>>")
    long_enough = ("boolean", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_CHARS)
    return out.select(
        "doc_id",
        F.when(text.rlike("(?i)passw|secret|token|api_?key"), F.filter(_spans(text, ASSIGN, long_enough), lambda x: x.v)).otherwise(none).alias("assign"),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS)).otherwise(none).alias("access"),
        _spans(text, HEX).alias("hex"),
        _spans(text, TOKEN, ("string", lambda m: m)).alias("token"),
    )


def open_tokens() -> Column:
    """Of the column ``token``, those that lie in no span of ``assign``, ``access`` or ``hex``."""
    kind = "struct<s:int,base:boolean,e:int,v:string>"

    def part(c: str, base: bool) -> Column:
        return F.transform(c, lambda x: F.struct(x.s.alias("s"), F.lit(not base).alias("late"), x.e.alias("e"), (F.lit("") if base else x.v).alias("v")))

    def step(most: Column, x: Column) -> Column:
        """``most`` is the furthest end of the base spans so far: a token that ends by then lies within one."""
        drop = ~x.late | (x.e <= most)
        out = F.struct(x.s.alias("s"), drop.alias("base"), x.e.alias("e"), x.v.alias("v"))
        return F.struct(F.when(x.late, most).otherwise(F.greatest(most, x.e)).alias("state"), out.alias("out"))

    parts = F.array_sort(F.concat(part("assign", True), part("access", True), part("hex", True), part("token", False)))
    walked = F.filter(chunked_walk(parts, F.lit(0), step, kind).out, lambda x: ~x.base)
    return F.when(F.size("token") > 0, walked).otherwise(F.array().cast(f"array<{kind}>"))


def battery(word: Column) -> Column:
    """(class, p) of a token: its class of encoding and length, and the logarithm to base 10 of its p."""
    hexa, base36 = word.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), word.rlike("^(?:[0-9a-z]+|[0-9A-Z]+)$")
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return let(F.when(hexa, 16).when(base36, 36).otherwise(64), lambda k: let(letters, lambda chars: _tested(word, k, chars)))


def _correlation(values: Column) -> Column:
    """Serial correlation at lag one of an array of doubles, in a circle; null if all are equal."""

    def of(v: Column) -> Column:
        n = F.size(v).cast("double")
        after = F.concat(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, 1))
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
        lagged, squares = total(F.zip_with(v, after, lambda a, b: a * b)), total(F.transform(v, lambda a: a * a))
        return let(total(v), lambda s: (n * lagged - s * s) / F.nullif(n * squares - s * s, F.lit(0.0)))

    return let(values, of)


def _tested(word: Column, k: Column, chars: Column) -> Column:
    n, size = F.size(chars).cast("double"), k.cast("double")
    # n squared times the chance that two places have equal letters
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow((F.length(word) - F.length(F.replace(word, c, F.lit("")))).cast("double"), F.lit(2.0)))
    chi = squares * size / n - n
    text_equal = F.greatest(F.lit(TEXT_EQUAL), 1.3 / size)
    expected = (n + n * (n - 1) * text_equal) * size / n - n
    spread = F.sqrt(2 * n * (n - 1) * text_equal * (1 - text_equal)) * size / n
    uniform = (expected - chi) / spread
    kinds = F.translate(word, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 5)
    turns = (F.length(F.regexp_replace(kinds, "a+|A+|0+|-+", "x")) - 1).cast("double")
    turn = F.when(k == 16, TEXT_TURN[16]).when(k == 36, TEXT_TURN[36]).otherwise(TEXT_TURN[64])
    runs = (turns - (n - 1) * turn) / F.sqrt((n - 1) * turn * (1 - turn))
    vowels = F.transform(chars, lambda c: c.isin(*"aeiouAEIOU").cast("double"))
    alphabet = F.when(k == 16, ALPHABETS[16]).when(k == 36, ALPHABETS[36]).otherwise(ALPHABETS[64])
    places = F.transform(chars, lambda c: F.call_function("locate", F.when(k == 64, c).otherwise(F.lower(c)), alphabet).cast("double"))
    structure = F.abs(F.coalesce(_correlation(places), F.lit(1.0)) + 1 / (n - 1)) * F.sqrt(n)
    serial = (F.coalesce(_correlation(vowels), F.lit(0.0)) - TEXT_VOWELS) * F.sqrt(n) - F.greatest(structure - STRUCTURED, F.lit(0.0)) * 3
    z = (F.least(uniform, F.lit(6.0)) + F.least(runs, F.lit(12.0)) + F.least(serial, F.lit(6.0))) / 3**0.5
    length_class = reduce(lambda c, x: c + (F.size(chars) > x).cast("int"), LENGTHS, F.lit(0))
    kind = length_class * 3 + F.when(k == 16, 0).when(k == 36, 1).otherwise(2)
    return let(z, lambda z: F.struct(kind.alias("c"), _upper_tail(z).alias("p")))


def _upper_tail(z: Column) -> Column:
    """Logarithm to base 10 of the normal distribution's upper tail: a logistic curve near 0, its asymptote beyond."""
    near = -F.log10(1 + F.exp(1.5976 * z + 0.07056 * z * z * z))
    far = -(z * z / 2) / 2.302585092994046 - F.log10(F.greatest(z, F.lit(1.0)) * 2.5066282746310002)
    return F.when(z < 5, near).otherwise(far)


def cutoffs(tested: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Step-up cutoff of each class as a bin: tokens of that bin or a smaller p are discoveries.

    ``tested`` has (c, bin), a row per token; the result has a row per class at most.
    """
    counts = tested.groupBy("c", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("c").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select("c", "bin", F.sum("n").over(upto).alias("rank"), F.sum("n").over(Window.partitionBy("c")).alias("m"))
    # a bin's largest p is its upper edge
    return ranked.where((F.col("bin") + 1 - BINS) / 10.0 <= F.log10(alpha * F.col("rank") / F.col("m"))).groupBy("c").agg(F.max("bin").alias("cut"))


def find(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and ``spans``, array of (kind, s, e), sorted by start,
    then kind in the order assign, access, hex, random. Ends are exclusive, in code points.

    Null and empty texts have no spans. A token that lies within or equals a base span is not tested. Repeated rows are each scanned; extra columns are ignored; an empty table gives no rows.
    """
    tested = F.transform(open_tokens(), lambda x: let(battery(x.v), lambda t: F.struct(x.s.alias("s"), x.e.alias("e"), t.c.alias("c"),
                         F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(t.p * 10).cast("int") + BINS)).alias("bin"))))
    plain = [F.transform(k, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"))).alias(k) for k in ("assign", "access", "hex")]
    scanned = stage(base_spans(docs).select("doc_id", *plain, tested.alias("tokens")), "secrets")
    cuts = cutoffs(scanned.select(F.explode("tokens").alias("t")).select("t.c", "t.bin"), alpha)
    # an entry per class of encoding and length at most: 18 numbers, which become literals
    known = [(r.c, r.cut) for r in cuts.collect()]

    def cut_of(c: Column) -> Column:
        return reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), known, F.when(F.lit(False), F.lit(-1))).otherwise(-1)

    def tagged(c: Column | str, i: int, kind: str) -> Column:
        return F.transform(c, lambda x: F.struct(x.s.alias("s"), F.lit(i).alias("i"), F.lit(kind).alias("kind"), x.e.alias("e")))

    chosen = F.filter("tokens", lambda x: x.bin <= cut_of(x.c))
    spans = F.array_sort(F.concat(tagged("assign", 0, "assign"), tagged("access", 1, "access"), tagged("hex", 2, "hex"), tagged(chosen, 3, "random")))
    return scanned.select("doc_id", F.transform(spans, lambda x: F.struct(x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as strings."""

    def text(x: Column) -> Column:
        return F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x.kind != "random")
    return found.select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )
