"""Secret scans: fixed patterns and a randomness test battery, in built-in functions only.

The patterns give the base spans. The battery adds spans: maximal runs of code characters of
:data:`MIN_TOKEN` or more are tokens; the smallest alphabet that holds all characters of a token
is its inferred encoding. Three tests ask whether the token can be a uniform draw from that
alphabet: chi-squared uniformity (as a normal deviate), runs above and below the mean, and
serial correlation; their p-values are combined by Fisher's rule, and a token that fails is
ordinary text. Short words pass such tests easily, so the opposite hypothesis is tested too:
that the token is drawn from the characters of this corpus, counted over all texts. The
likelihood ratio of the two gives a p-value that holds for any length (its mean under ordinary
text is one), and false discoveries are controlled by the step-up rule within each length
class. Character counts and p-value histograms cover all documents; only those histograms,
whose size is fixed, reach the driver.

Positions are code points. Overlaps with base spans are not reported twice.

Defined results: a null or empty text has no spans; repeated rows are scanned alike; an empty
table gives an empty result; other columns are ignored or, in :func:`redact`, carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, staged

ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
#: Inferred encodings from narrow to wide: (characters as a regex class, alphabet size).
ENCODINGS = (("0-9", 10), ("0-9a-f", 16), ("0-9A-F", 16), ("a-z", 26), ("A-Z", 26), ("A-Z2-7", 32), ("a-z0-9", 36),
             ("A-Z0-9", 36), ("A-Za-z", 52), ("A-Za-z0-9", 62), ("A-Za-z0-9+/", 64), ("A-Za-z0-9_-", 64),
             ("A-Za-z0-9+/_-", 66))
ORDER = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_"
#: A token is ordinary text if the battery's combined p-value is below this.
REJECT = 0.001
#: Rate of false discoveries.
RATE = 0.01
_SPAN = "array<struct<s:int,e:int,k:int,t:string>>"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as (start, end, kind, match)."""
    def place(found):
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(
            F.length(g).alias("g"), F.length(m).alias("n"), m.alias("t")))
        start = F.struct(F.lit(0).alias("p"), F.array().cast(_SPAN).alias("o"))
        out = F.aggregate(steps, start, lambda a, x: F.struct(
            (a.p + x.g + x.n).alias("p"),
            F.concat(a.o, F.array(F.struct((a.p + x.g).alias("s"), (a.p + x.g + x.n).alias("e"),
                                           F.lit(kind).alias("k"), x.t.alias("t")))).alias("o")))
        return F.when(F.size(found) > 0, out["o"]).otherwise(F.array().cast(_SPAN))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    assign = F.filter(_spans(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x.t, ASSIGN, 2)) >= 6)
    return F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) by the logistic approximation."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070565 * z * z * z))


def battery(token: Column) -> Column:
    """(combined p-value under uniform randomness, alphabet size) of a token."""
    size = F.lit(ENCODINGS[-1][1])
    for cls, n in reversed(ENCODINGS):
        size = F.when(token.rlike(f"^[{cls}]+$"), n).otherwise(size)

    def test(c, v, a):
        n = F.size(c).cast("double")
        counts = F.transform(F.array_distinct(c), lambda x: F.size(F.filter(c, lambda y: y == x)).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x)
        df = a - 1
        chi = a / n * squares - n
        z1 = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
        mean = total(v) / n

        def with_mean(m):
            above = F.transform(v, lambda x: (x > m).cast("int"))
            diff = F.transform(v, lambda x: x - m)
            n1 = total(F.transform(above, lambda x: x.cast("double")))
            n2 = n - n1
            m1 = F.size(v) - 1
            runs = 1 + total(F.zip_with(F.slice(above, 1, m1), F.slice(above, 2, m1),
                                        lambda x, y: (x != y).cast("double")))
            mu = 2 * n1 * n2 / n + 1
            var = (mu - 1) * (mu - 2) / (n - 1)
            z2 = F.when(var > 0, (runs - mu) / F.sqrt(var)).otherwise(F.lit(9.0))
            cov = total(F.zip_with(F.slice(diff, 1, m1), F.slice(diff, 2, m1), lambda x, y: x * y))
            ss = total(F.transform(diff, lambda x: x * x))
            z3 = F.when(ss > 0, (cov / ss + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
            ps = [_normal_tail(z1), 2 * _normal_tail(F.abs(z2)), 2 * _normal_tail(F.abs(z3))]
            x = F.lit(0.0)
            for p in ps:
                x = x - F.log(F.greatest(p, F.lit(1e-300)))
            return let(x, lambda x: F.exp(-x) * (1 + x + x * x / 2))  # chi-squared tail, 6 degrees
        return let(mean, with_mean)

    codes = lambda c: F.transform(c, lambda x: F.instr(F.lit(ORDER), x).cast("double"))
    chars = F.array_remove(F.split(token, "", -1), "")
    return let(size.cast("double"), lambda a: let(chars, lambda c: let(codes(c), lambda v: F.struct(
        test(c, v, a).alias("p"), a.alias("a")))))


def candidates(text: Column, base: Column) -> Column:
    """Tokens outside base spans that the battery does not reject, with their alphabet size."""
    free = F.filter(_spans(text, TOKEN, 3), lambda x: ~F.exists(base, lambda b: (b.s < x.e) & (x.s < b.e)))
    rated = F.transform(free, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.k.alias("k"), x.t.alias("t"),
                                                 battery(x.t).alias("b")))
    return rated


def _length_class(n: Column) -> Column:
    """Classes of token lengths, by doubling."""
    return F.floor(F.log2(n / MIN_TOKEN)).cast("int")


def character_counts(documents: DataFrame) -> dict[str, int]:
    """How often each character of :data:`ORDER` occurs in all texts (one grouped count)."""
    size = F.octet_length("text").cast("long")
    row = documents.agg(*[F.sum(size - F.octet_length(F.replace("text", F.lit(ch), F.lit("")))).alias(f"c{i}")
                          for i, ch in enumerate(ORDER)]).first()
    return {ch: row[i] or 0 for i, ch in enumerate(ORDER)}


def discoveries(rows: DataFrame, c: str, seen: dict[str, int], rate: float = RATE):
    """A function (token struct) -> boolean Column: is this candidate random text?

    ``rows`` holds candidate arrays in column ``c``; ``seen`` has the corpus's characters."""
    tokens = rows.select(F.explode(c).alias("x")).select("x.t", "x.b")
    counted = tokens.groupBy("t", "b").agg(F.count(F.lit(1)).alias("n"))
    total = sum(seen.values())
    cost = {ch: -math.log((seen.get(ch, 0) + 0.5) / (total + 0.5 * len(ORDER))) for ch in ORDER}
    costs = F.array(*[F.lit(cost[ch]) for ch in ORDER])

    def evidence(x):  # -log10 of the p-value for ordinary text, at least 0, in tenths
        chars = F.array_remove(F.split(x["t"], "", -1), "")
        plain = F.aggregate(chars, F.lit(0.0), lambda s, ch: s + F.element_at(costs, F.instr(F.lit(ORDER), ch)))
        gain = (plain - F.length(x["t"]) * F.log(x["b"]["a"])) / math.log(10)
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(300.0), gain)) * 10).cast("int")

    passed = counted.select(F.struct("t", "b").alias("x"), "n")
    grid = (passed.select(_length_class(F.length("x.t")).alias("len"),
                          F.when(F.col("x.b.p") >= REJECT, evidence(F.col("x"))).otherwise(0).alias("e"), "n")
            .groupBy("len", "e").agg(F.sum("n").alias("n")).collect())  # classes x 3001 rows at most
    least = {}
    for cls in {r["len"] for r in grid}:
        bins = sorted(((r["e"], r["n"]) for r in grid if r["len"] == cls), reverse=True)
        m, k = sum(n for _, n in bins), 0
        for e, n in bins:  # step-up rule: the weakest p-value with p <= k / m * rate
            k += n
            if 10 ** (-e / 10) <= k / m * rate:
                least[cls] = e

    def found(x):
        out = F.lit(False)
        for cls, e in sorted(least.items()):
            out = out | ((_length_class(F.length(x["t"])) == cls) & (evidence(x) >= e))
        return (x["b"]["p"] >= REJECT) & out
    return found


def _scanned(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with a struct column ``name``: base spans and rated candidates."""
    t = F.coalesce(text, F.lit(""))
    return df.withColumn(name, let(t, lambda x: let(base_spans(x), lambda b: F.struct(
        b.alias("base"), candidates(x, b).alias("more")))))


def _all_spans(s: str, found) -> Column:
    more = F.transform(F.filter(F.col(f"{s}.more"), found),
                       lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.k.alias("k"), x.t.alias("t")))
    return F.array_sort(F.transform(F.concat(F.col(f"{s}.base"), more),
                                    lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"))))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x.k + 1), x.s.cast("string"), x.e.cast("string"))), ",")


def secret_table(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row, and the number of
    spans that the battery added."""
    rows = staged(_scanned(documents.select("doc_id", "text"), F.col("text"), "s").select("doc_id", "s"), "secrets")
    found = discoveries(rows, "s.more", character_counts(documents))
    n = lambda k: F.size(F.filter("s.base", lambda x: x.k == k)).cast("long")
    base = F.array_sort(F.transform("s.base", lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"))))
    spans = _all_spans("s", found)
    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                       F.sha2(_written(base), 256).alias("base_sha256"), _written(spans).alias("spans"),
                       F.size(F.filter(spans, lambda x: x.k == 3)).cast("long").alias("n_random"))


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every span of its texts replaced by ``mark`` (touching and
    overlapping spans by one); ``n_chars``, where there is one, follows the new text."""
    s, m = fresh(documents, "secrets", "merged")
    rows = staged(_scanned(documents, F.col("text"), s), "secrets-documents")
    spans = _all_spans(s, discoveries(rows, f"{s}.more", character_counts(documents)))
    merged = F.aggregate(spans, F.array().cast("array<struct<s:int,e:int>>"), lambda a, x: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1).e >= x.s),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
            F.element_at(a, -1).s.alias("s"), F.greatest(F.element_at(a, -1).e, x.e).alias("e")))))
        .otherwise(F.concat(a, F.array(F.struct(x.s.alias("s"), x.e.alias("e"))))))
    rows = rows.withColumn(m, merged)
    text = F.col("text")
    built = F.aggregate(F.col(m), F.struct(F.lit(0).alias("p"), F.lit("").alias("o")), lambda a, x: F.struct(
        x.e.alias("p"), F.concat(a.o, F.substring(text, a.p + 1, x.s - a.p), F.lit(mark)).alias("o")),
        lambda a: F.concat(a.o, F.substring(text, a.p + 1, F.length(text))))
    new = F.when(F.size(m) > 0, built).otherwise(text)
    out = rows.withColumn("text", new)
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(m) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in documents.columns])
