"""Secret scan: fixed patterns, and a battery of randomness tests over long tokens.

A token of 16 or more characters is read in the smallest encoding that its characters fit (digits, hex, one case of
letters, base 32, base 36, both cases, base 64) as a sequence of codes. Three tests ask whether the codes could be uniform
draws: chi-squared over equal code ranges, runs above and below the middle, and lag-1 serial correlation. A token that
any of them turns down (Bonferroni) is no secret. For one that passes, a p-value tells how likely language looks as even:
the root of the chi-squared statistic over groups of codes - from those that text favours to those that it hardly has, so
that language fills them most unevenly - against its mean and deviation under a fixed language model, draws by the shares
of letters and digits in text at the token's own length and encoding. Benjamini-Hochberg control over all
tokens of a length class sets the threshold, so that of what is reported at most ``rate`` is expected to be language,
whether a corpus holds few long tokens or many. Only the histogram (classes x bins) reaches the driver.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import stored

KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CLASSES = (16, 20, 24, 32, 48, 64, 128)  # least lengths
BINS = 400  # of the language p-value, ten to a power of ten
UNIFORM = 0.01  # the least p-value of the battery
GROUPS = 6  # of equal size, for the language p-value
SPREAD = 1.25  # language varies more than independent draws by the same shares
KINDS = ("assign", "access", "hex", "random")

# The encodings, from the smallest alphabet up, their codes in order.
ENCODINGS = [
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]


# Shares of letters in English text and of leading digits, in percent.
LETTERS = {
    "a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.15, "k": 0.77, "l": 4.0, "m": 2.4,
    "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.095, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 0.98, "w": 2.4, "x": 0.15, "y": 2.0, "z": 0.074,
}
DIGITS = {"0": 12.0, "1": 26.5, "2": 15.5, "3": 11.0, "4": 8.5, "5": 7.0, "6": 5.9, "7": 5.1, "8": 4.5, "9": 4.0}
#: Of a token of language: small letters, capitals, digits, the two marks.
MAKEUP = 0.76, 0.1, 0.08, 0.06


def _language(char: str, alphabet: str) -> float:
    """The weight of a character in language that is written in the alphabet; one of capitals alone is written in capitals."""
    small, capitals, digits, marks = MAKEUP
    if char.lower() in LETTERS:
        mixed = alphabet.lower() != alphabet != alphabet.upper()
        return LETTERS[char.lower()] * (small + capitals if not mixed else small if char.islower() else capitals)
    return DIGITS[char] * digits if char in DIGITS else 50 * marks


class Table(NamedTuple):
    """An encoding: alphabet size, its characters, their codes, the group of each code, and the groups' shares in the
    alphabet and in language."""

    name: str
    size: int
    allowed: frozenset
    codes: np.ndarray
    group: np.ndarray
    even: np.ndarray
    language: np.ndarray


def _tables() -> list[Table]:
    out = []
    for name, alphabet in ENCODINGS:
        codes = np.full(128, -1, np.int64)
        for i, c in enumerate(alphabet):
            codes[ord(c)] = i
        if name == "base64":
            codes[ord("-")], codes[ord("_")] = 62, 63
        shares = np.array([_language(c, alphabet) for c in alphabet])
        parts = np.array_split(np.argsort(-shares, kind="stable"), min(GROUPS, len(alphabet)))
        group = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[np.argsort(np.concatenate(parts))]
        size = np.array([len(p) for p in parts]) / len(alphabet)
        told = np.bincount(group, weights=shares / shares.sum())
        out.append(Table(name, len(alphabet), frozenset(np.flatnonzero(codes >= 0).tolist()), codes, group, size, told))
    return out


TABLES = _tables()


def infer(token: str) -> tuple[int, np.ndarray]:
    """The place of the smallest encoding that holds the token (padding aside) in TABLES, and the codes."""
    raw = token.replace("=", "").encode()
    used = set(raw)
    for place, t in enumerate(TABLES):
        if used <= t.allowed:
            return place, t.codes[np.frombuffer(raw, np.uint8)]
    raise ValueError(token)


def evenness(counts: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """The root of the chi-squared statistic of counts (in the last axis)."""
    return np.sqrt(((counts - expected) ** 2 / expected).sum(axis=-1))


@functools.lru_cache(maxsize=8192)
def language_null(place: int, n: int) -> tuple[float, float]:
    """Mean and deviation of ``evenness`` over draws of n codes of an encoding from the language model."""
    t = TABLES[place]
    even = evenness(np.random.default_rng([place, n]).multinomial(n, t.language, 400), n * t.even)
    return float(even.mean()), float(even.std())


def language_p(place: int, codes: np.ndarray) -> float:
    """How likely language of this length and encoding is as even as the codes."""
    t, n = TABLES[place], len(codes)
    mean, deviation = language_null(place, n)
    z = (float(evenness(np.bincount(t.group[codes], minlength=len(t.even)), n * t.even)) - mean) / (SPREAD * deviation)
    return math.erfc(-z / math.sqrt(2)) / 2


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(codes: np.ndarray, size: int) -> float:
    """p-value of the codes' counts in equal ranges, about five codes to a range (Wilson-Hilferty)."""
    n = len(codes)
    ranges = max(2, min(size, n // 5))
    edges = np.arange(ranges + 1) * size // ranges
    share = np.diff(edges) / size
    counts = np.bincount(np.searchsorted(edges, codes, "right") - 1, minlength=ranges)
    stat = float(((counts - n * share) ** 2 / (n * share)).sum())
    k = 2 / (9 * (ranges - 1))
    z = ((stat / (ranges - 1)) ** (1 / 3) - (1 - k)) / math.sqrt(k)
    return math.erfc(z / math.sqrt(2)) / 2


def runs(codes: np.ndarray, size: int) -> float:
    """p-value of the number of runs above and below the middle of the alphabet (Wald-Wolfowitz)."""
    high = codes * 2 >= size
    n, ones = len(codes), int(high.sum())
    zeros = n - ones
    if not ones or not zeros:
        return 0.0
    expected = 2 * ones * zeros / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    if variance <= 0:
        return 1.0
    return _two_sided((1 + int((high[1:] != high[:-1]).sum()) - expected) / math.sqrt(variance))


def serial(codes: np.ndarray) -> float:
    """p-value of the lag-1 serial correlation."""
    x = codes - codes.mean()
    power = float((x * x).sum())
    return 0.0 if power == 0 else _two_sided(float((x[1:] * x[:-1]).sum()) / power * math.sqrt(len(codes)))


def randomness(token: str) -> tuple[str, float, float]:
    """Encoding, the battery's Bonferroni p-value of uniform codes, and the p-value of language (1 where they aren't)."""
    place, codes = infer(token)
    name, size = TABLES[place][:2]
    if len(codes) < 8:
        return name, 0.0, 1.0
    uniform = min(1.0, 3 * min(chi_squared(codes, size), runs(codes, size), serial(codes)))
    return name, uniform, language_p(place, codes) if uniform >= UNIFORM else 1.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns; characters are code points, ends exclusive."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found


def scan(text: str) -> tuple[list, list]:
    """Base spans, and the long tokens (start, end, class, bin of the language p-value: tenths of its power of ten)."""
    base, tokens = base_spans(text), []
    for m in TOKEN.finditer(text):
        a, token = m.start(), m[0]
        if len(token) >= 24:  # a hex run of 24 or more lies within such a token
            base += [("hex", a + h.start(), a + h.end()) for h in HEX.finditer(token) if h.end() - h.start() >= 24]
        likely = randomness(token)[2]
        length = sum(len(token) >= c for c in CLASSES) - 1
        tokens.append((a, m.end(), length, min(int(-10 * math.log10(max(likely, 1e-300))), BINS - 1)))
    return base, tokens


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
LONG = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length", pa.int32()), ("bin", pa.int32())])
SCANNED = (
    "doc_id long, base array<struct<kind:string,start:long,end:long>>, "
    "tokens array<struct<start:long,end:long,length:int,bin:int>>"
)


def thresholds(histogram: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """The least bin reported in each length class, BINS where none is; histogram: (class, bin) -> tokens.

    Benjamini-Hochberg: the largest p-value of which ``rate`` times the tokens at or below it cover what as many tokens
    of language as there are would bring. A bin counts with the largest p-value in it.
    """
    out = {}
    for length in range(len(CLASSES)):
        seen = np.zeros(BINS)
        for (c, b), n in histogram.items():
            seen[b] += n * (c == length)
        below = np.cumsum(seen[::-1])[::-1]
        good = (below > 0) & (10.0 ** (-np.arange(BINS) / 10) * seen.sum() <= rate * below)
        out[length] = int(np.argmax(good)) if good.any() else BINS
    return out


def find_secrets(docs: DataFrame, *, rate: float = 0.05) -> DataFrame:
    """Secrets of each row of ``docs(doc_id, text)``: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    spans joins ``kind:start:end`` of all spans by start, then kind, by commas; base_sha256 is the SHA-256 of the same
    of the fixed patterns alone. Tokens that meet a base span aren't reported again. Null and empty texts have no
    spans; repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py() or "") for t in batch.column(1)]
            base = [[dict(zip(("kind", "start", "end"), s)) for s in r[0]] for r in rows]
            tokens = [[dict(zip(("start", "end", "length", "bin"), s)) for s in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(SPAN)), pa.array(tokens, pa.list_(LONG))], names=["doc_id", "base", "tokens"]
            )

    scanned = stored(docs.select("doc_id", "text").mapInArrow(run, SCANNED), "scanned")
    counted = scanned.select(F.explode("tokens").alias("t")).groupBy("t.length", "t.bin").count()
    least = thresholds({(r[0], r[1]): r[2] for r in counted.collect()}, rate)
    limit = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))
    free = F.filter(
        "tokens",
        lambda t: (t["bin"] >= F.element_at(limit, t["length"]))
        & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    added = F.transform(free, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))

    def joined(spans):
        order = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.withColumn("added", added).select(
        "doc_id", n("assign"), n("access"), n("hex"), F.size("added").cast("long").alias("n_random"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"),
    )
