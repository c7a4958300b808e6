"""Secret scan: fixed patterns, and tokens that a battery of randomness tests takes for keys.

A token is given an encoding by its characters. Under the hypothesis that it is random in the alphabet of that
encoding, three tests are made: chi-squared uniformity of the characters, the number of runs above and below the
middle of the alphabet, and the correlation of neighbours; without a digit, also the shares of capitals and small letters.
A run of key characters is tested whole and by its parts, as a key may be glued to a name or a path. The combined p-value is uniform for random tokens and
near zero for text. Per encoding and length band, the share of random tokens is estimated from the upper half of
the p-values of the whole corpus, and the lowest limit is taken at which the expected share of other tokens among
those above it stays within the false-discovery rate. Everything runs on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import joined_spans, let, match_spans

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What may stand together in one run: keys, and names or paths that they are glued to. "=" ends a run.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}=*"
#: The tokens of a run: the longest parts of letters and digits; of base64; of base64url; and of base64 between slashes.
PARTS = (
    r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}=*",
    r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9]*[+/])[A-Za-z0-9+/]{16,}=*",
    r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9]*[_-])[A-Za-z0-9_-]{16,}=*",
    r"(?<![A-Za-z0-9+])(?=[A-Za-z0-9]*[+])(?:(?<=/)[A-Za-z0-9+]{16,}+=*|[A-Za-z0-9+]{16,}+(?=/))",
)

#: Alphabets by encoding: fixed values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
BINS = 20
#: Lower ends of the length bands.
BANDS = (16, 24, 32, 48, 64)


def _spans(spans: Column, place: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end")),
    )


def encoding_of(token: Column) -> Column:
    """hex, base32, base62, base64 or base64url; null for characters of two alphabets."""
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+$"), "base32")
        .when(token.rlike("^[A-Za-z0-9]+$"), "base62")
        .when(token.rlike("^[A-Za-z0-9+/]+$"), "base64")
        .when(token.rlike("^[A-Za-z0-9_-]+$"), "base64url")
    )


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), logistic approximation."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def randomness(token: Column, encoding: Column) -> Column:
    """Combined p-value of the tests; 1 for perfectly ordinary random tokens, near 0 for text."""
    alphabet = F.lit("")
    for name, letters in ALPHABETS.items():
        alphabet = F.when(encoding == name, F.lit(letters)).otherwise(alphabet)
    folded = F.when(encoding == "hex", F.lower(token)).otherwise(token)

    def tests(x: Column) -> Column:
        # x: value, letters, places in the alphabet, size of the alphabet, n
        n, k = x["n"], x["k"]
        squares = F.aggregate(
            F.array_distinct(x["letters"]), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(x["value"], c, F.lit(""))), F.lit(2.0))
        )
        df = k - 1.0
        chi = (k / n) * squares - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        high = F.transform(x["places"], lambda p: (p * 2 > k - 1).cast("double"))
        ones = F.aggregate(high, F.lit(0.0), lambda a, b: a + b)
        runs = 1.0 + let(high, lambda h: F.aggregate(F.zip_with(F.slice(h, F.lit(2), F.size(h)), F.slice(h, F.lit(1), F.size(h) - 1), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b))
        expected = 2 * ones * (n - ones) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        p_runs = F.when(spread > 0, 2 * _upper_tail(F.abs(runs - expected) / F.sqrt(spread))).otherwise(0.0)
        mean = F.aggregate(x["places"], F.lit(0.0), lambda a, b: a + b) / n
        off = let(mean, lambda m: F.transform(x["places"], lambda p: p - m))  # once a token, not once a character

        def serial(o: Column) -> Column:
            square = F.aggregate(o, F.lit(0.0), lambda a, b: a + b * b)
            lagged = F.aggregate(F.zip_with(F.slice(o, F.lit(2), F.size(o)), F.slice(o, F.lit(1), F.size(o) - 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            return F.when(square > 0, 2 * _upper_tail(F.abs(lagged / square + 1 / n) * F.sqrt(n))).otherwise(0.0)

        # a token of both cases without a digit is judged by its shares of capitals, small letters and others too
        upper, lower = (F.length(F.regexp_replace(x["value"], f"[^{letters}]", "")) for letters in ("A-Z", "a-z"))
        shares = k / n * (F.pow(upper, F.lit(2.0)) / 26 + F.pow(lower, F.lit(2.0)) / 26 + F.pow(n - upper - lower, F.lit(2.0)) / (k - 52)) - n
        p_shares = F.when((k > 52) & ~x["value"].rlike("[0-9]"), F.exp(-shares / 2)).otherwise(1.0)

        return F.least(F.lit(1.0), 3 * F.least(_upper_tail(z_chi), p_runs, let(off, serial), p_shares))

    def prepared(value: Column) -> Column:
        letters = F.split(value, "")
        return F.struct(
            value.alias("value"), letters.alias("letters"),
            F.transform(letters, lambda c: (F.call_function("instr", alphabet, c) - 1).cast("double")).alias("places"),
            F.length(alphabet).cast("double").alias("k"), F.length(value).cast("double").alias("n"),
        )

    return let(folded, lambda value: let(prepared(value), tests))


def candidates(text: Column) -> Column:
    """Per run its tokens with a letter and one alphabet: (start, end, encoding, band, p). Padding is not tested."""

    def tokens(r: Column) -> Column:
        parts = F.transform(
            F.concat(*[match_spans(r["value"], part) for part in PARTS]),
            lambda s: F.struct((s["start"] + r["start"]).alias("start"), (s["end"] + r["start"]).alias("end"), s["value"].alias("value")),
        )
        return F.when(r["value"].rlike("[+/_-]"), parts).otherwise(F.array(r))

    def tested(s: Column) -> Column:
        value = F.rtrim(s["value"], F.lit("="))
        return let(
            F.struct(value.alias("value"), encoding_of(value).alias("encoding")),
            lambda v: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), v["encoding"].alias("encoding"),
                sum((F.length(v["value"]) >= low).cast("int") for low in BANDS).alias("band"),
                F.when(v["encoding"].isNotNull() & v["value"].rlike("[A-Za-z]"), randomness(v["value"], v["encoding"])).alias("p"),
            ),
        )

    return F.transform(match_spans(text, RUN), lambda r: F.filter(F.transform(tokens(r), tested), lambda c: c["p"].isNotNull()))


def limits(counts: dict[tuple[str, int], list[int]], rate: float) -> dict[tuple[str, int], float]:
    """Per encoding and band the lowest limit on p whose estimated false-discovery rate is within ``rate``."""
    found = {}
    for key, bins in counts.items():
        random = 2 * sum(bins[BINS // 2 :])
        for low in range(BINS):
            above = sum(bins[low:])
            if above and 1 - random * (1 - low / BINS) / above <= rate:
                found[key] = low / BINS
                break
    return found


def scan(docs: DataFrame, text: str = "text", rate: float = 0.1) -> DataFrame:
    """Add ``base`` and ``found``: arrays of (start, place, kind, end), for the patterns and for random tokens.

    Null and empty texts have no spans. Rows are judged one by one against the corpus-wide limits, so repeated rows
    get equal results. The limits are one number per encoding and length band (25 at most), whatever the corpus size.
    Input columns named base or found are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    counted = (
        docs.select(F.explode(F.flatten(candidates(body))).alias("c"))
        .groupBy(F.col("c.encoding").alias("encoding"), F.col("c.band").alias("band"), F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).alias("bin"))
        .count()
    )
    counts: dict[tuple[str, int], list[int]] = {}
    for row in counted.collect():  # at most encodings x bands x bins rows
        counts.setdefault((row["encoding"], row["band"]), [0] * BINS)[row["bin"]] += row["count"]
    lowest = limits(counts, rate)

    def passes(c: Column) -> Column:
        test = F.lit(False)
        for (encoding, band), low in lowest.items():
            test = test | ((c["encoding"] == encoding) & (c["band"] == band) & (c["p"] >= low))
        return test

    assign = F.filter(match_spans(body, ASSIGN, 2), lambda s: F.length(s["value"]) >= 8)
    base = F.concat(_spans(assign, 0, "assign"), _spans(match_spans(body, ACCESS), 1, "access"), _spans(match_spans(body, HEX), 2, "hex"))

    def longest(run: Column) -> Column:
        """Of the tokens of a run that pass, those that are no part of another."""
        within = lambda c, d: (d["start"] <= c["start"]) & (c["end"] <= d["end"]) & (d["end"] - d["start"] > c["end"] - c["start"])
        return let(F.filter(run, passes), lambda kept: F.filter(kept, lambda c: ~F.exists(kept, lambda d: within(c, d))))

    found = _spans(F.flatten(F.transform(candidates(body), longest)), 3, "random")
    return docs.select(*[c for c in docs.columns if c not in ("base", "found")], base.alias("base"), found.alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per pattern, the hash of the pattern spans, and all spans as text."""
    def many(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id", many("assign"), many("access"), many("hex"),
        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
        joined_spans(F.concat("base", "found")).alias("spans"),
    )
