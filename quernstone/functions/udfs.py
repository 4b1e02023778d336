"""Functions without a built-in form, as Arrow-batched Pandas UDFs: folds over lines, string distance, parsing."""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as ty


def _json_texts(value) -> list[str]:
    if isinstance(value, bool):
        return [str(value).lower()]
    if isinstance(value, (int, float)):
        return [json.dumps(value)]
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if isinstance(value, list):
        return [t for v in value for t in _json_texts(v)]
    return [t for k in sorted(value) for t in _json_texts(value[k])] if isinstance(value, dict) else []


@F.pandas_udf(ty.StringType())
def flatten_json(texts: pd.Series) -> pd.Series:
    """The scalars of a JSON value in key order, joined by spaces; other text stays, null gives null."""

    def one(t):
        if t is None:
            return None
        try:
            return " ".join(_json_texts(json.loads(t)))
        except ValueError:
            return t

    return texts.map(one)


def jaro_value(a: str, b: str) -> float:
    """Jaro similarity; equal strings 1, an empty one 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 1)
    free = [True] * len(b)
    matched_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                matched_a.append(ch)
                break
    matched_b = [ch for ch, f in zip(b, free) if not f]
    m = len(matched_a)
    if m == 0:
        return 0.0
    swapped = sum(x != y for x, y in zip(matched_a, matched_b)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_value(a: str, b: str) -> float:
    """Jaro raised by a tenth of what it lacks for each of up to four equal first characters, without threshold."""
    base = jaro_value(a, b)
    common = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        common += 1
    return base + common * 0.1 * (1 - base)


def _pairwise(fn):
    @F.pandas_udf(ty.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


jaro = _pairwise(jaro_value)
jaro_winkler = _pairwise(jaro_winkler_value)

# Layout noise of scanned books, and the marker of the backup copy.
NOISE_LINES = {"倪海厦注", "倪海厦注《金匮》", "倪海厦注金匮", "倪注金匮", "校排", "呚"}
NOISE_PARTS = ("勤求古訓博采眾方", "勤求古训博采众方")
BACKUP_MARK = "【原PDF对应页完整文本校对备份】"
_PAGE_LINE = re.compile(r"【PDF页码.*】|[0-9.。．校排]*校排", re.S)
_WHITE = re.compile(r"\s+")


def is_noise(line: str) -> bool:
    key = _WHITE.sub("", line)
    return bool(key) and (
        key in NOISE_LINES or any(p in key for p in NOISE_PARTS) or ("群龙无首" in key and "校排" in key) or _PAGE_LINE.fullmatch(key) is not None
    )


def clean_lines_text(content: str, name: str) -> str:
    """Imported text without layout noise, repeated lines, repeated titles near the top and split-off line starts."""
    lines = [line.strip() for line in content.split(BACKUP_MARK)[0].splitlines()]
    keys = [_WHITE.sub("", line) for line in lines]
    following = [""] * len(lines)
    ahead = ""
    for i in range(len(lines) - 1, -1, -1):
        following[i] = ahead
        ahead = keys[i] or ahead
    title = _WHITE.sub("", name)
    out: list[str] = []
    out_keys: list[str] = []
    short_seen: set[str] = set()
    for i, (line, key) in enumerate(zip(lines, keys)):
        if not key:
            if out_keys and out_keys[-1]:
                out.append("")
                out_keys.append("")
            continue
        short = len(key) <= 6
        repeats = bool(out_keys) and key == out_keys[-1]
        title_again = title and i < 12 and key == title and any(k.startswith(title) for k in out_keys)
        split_off = short and following[i] != key and following[i].startswith(key)
        seen_before = short and key in short_seen and following[i] != key
        if is_noise(line) or repeats or title_again or split_off or seen_before:
            continue
        out.append(" ".join(line.split()))
        out_keys.append(key)
        if short:
            short_seen.add(key)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


@F.pandas_udf(ty.StringType())
def clean_lines(content: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else clean_lines_text(c, n or "") for c, n in zip(content, name)])


_DIGITS = {c: i for i, c in enumerate("一二三四五六七八九", 1)}
_NUMBER = re.compile(r"(?:(?P<t>[一二三四五六七八九])?(?P<x>十)(?P<o>[一二三四五六七八九])?|(?P<d>[一二三四五六七八九]))?(?P<h>半)?")
_ENTRY = re.compile(r"(?P<name>.*?)(?P<number>[一二三四五六七八九十半]+)(?P<unit>[两枚升合钱分])", re.S)
ASCII_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + " \t\n\r"


def numeral(text: str) -> float | None:
    """Chinese numeral below a hundred, with 半 for a half."""
    m = _NUMBER.fullmatch(text)
    if not m or not text:
        return None
    if m["x"]:
        whole = 10 * _DIGITS.get(m["t"], 1) + _DIGITS.get(m["o"], 0)
    else:
        whole = _DIGITS.get(m["d"], 0)
    return whole + (0.5 if m["h"] else 0.0)


def composition_entries(text: str) -> list[tuple[str, float, str, str]]:
    """(name, amount, unit, original) of each ``name number unit`` run of a composition."""
    flat = re.sub("[：:，,、;；\n\r\t]", " ", text)
    out = []
    for m in _ENTRY.finditer(flat):
        name = m["name"].strip().strip(ASCII_EDGE).rpartition(" ")[2].strip()
        value = numeral(m["number"])
        if name and value is not None:
            out.append((name, value, m["unit"], m[0].strip()))
    return out


def amount_text(value: float) -> str:
    return str(int(value)) if value == int(value) else f"{value:.1f}"


def ratio_text(text: str) -> str | None:
    """``a : b = 3 : 2`` over the unit that most entries share, the others named behind; null below two entries alike."""
    entries = composition_entries(text)
    by_unit: dict[str, list] = {}
    for e in entries:
        by_unit.setdefault(e[2], []).append(e)
    alike = [by_unit[u] for u in sorted(by_unit) if len(by_unit[u]) >= 2]
    if not alike:
        return None
    main = max(alike, key=len)  # the first of equals
    names = {e[0] for e in main}
    ratio = f"{' : '.join(e[0] for e in main)} = {' : '.join(amount_text(e[1]) for e in main)}"
    rest = [f"{e[3]}另计" for u in sorted(by_unit) for e in by_unit[u] if e[0] not in names]
    return f"{ratio}；{'，'.join(rest)}。" if rest else ratio


ENTRY = ty.ArrayType(ty.StructType([ty.StructField("name", ty.StringType()), ty.StructField("amount", ty.DoubleType()), ty.StructField("unit", ty.StringType()), ty.StructField("original", ty.StringType())]))


@F.pandas_udf(ENTRY)
def composition(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [dict(zip(("name", "amount", "unit", "original"), e)) for e in composition_entries(t)])


@F.pandas_udf(ty.StringType())
def ratio(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else ratio_text(t))


# Characters that end a formula's name, and those that part it from what stands before.
FORMULA_ENDS = "汤丸散方饮剂"
FORMULA_BREAKS = " \t\n\r\f\v\u3000\u00a0，。、；;:：“”\"'？?！!"


def formula_names_in(text: str) -> list[str]:
    """Names that end in a formula's character: up to nine characters back to the last separator; each once, in order."""
    out: dict[str, None] = {}
    for i, ch in enumerate(text):
        if ch in FORMULA_ENDS:
            head = text[max(0, i - 8) : i]
            cut = max((head.rfind(b) for b in FORMULA_BREAKS), default=-1)
            name = head[cut + 1 :] + ch
            if len(name) >= 2:
                out.setdefault(name)
    return list(out)


@F.arrow_udf(ty.ArrayType(ty.StringType()))
def formula_names(texts: pa.Array) -> pa.Array:
    """``formula_names_in`` of each text; one text of a batch is a Python string at a time."""
    return pa.array((None if (text := t.as_py()) is None else formula_names_in(text) for t in texts), pa.list_(pa.string()))


def fnv_hex(text: str) -> str:
    """64-bit FNV-1a over UTF-8 with this engine's offset, 16 hex digits."""
    h = 1469598103934665603
    for b in text.encode():
        h = (h ^ b) * 1099511628211 & (1 << 64) - 1
    return f"{h:016x}"


@F.arrow_udf(ty.StringType())
def fnv(texts: pa.Array) -> pa.Array:
    return pa.array((None if (text := t.as_py()) is None else fnv_hex(text) for t in texts), pa.string())


_ANCHOR = re.compile(r"<a\b[^>]*\bhref=[\"'](?P<url>[^\"']*)[\"'][^>]*>(?P<body>.*?)</a>", re.S | re.I)
LINK = ty.ArrayType(ty.StructType([ty.StructField("title", ty.StringType()), ty.StructField("url", ty.StringType())]))


def page_links(html: str, limit: int = 8) -> list[dict]:
    """(title up to 120 characters, url) of a page's links with text, each url once."""
    from html import unescape

    out: dict[str, str] = {}
    for m in _ANCHOR.finditer(html):
        title = unescape(re.sub(r"<[^>]*>?", "", m["body"])).strip()[:120]
        if title and m["url"] not in out:
            out[m["url"]] = title
    return [{"title": t, "url": u} for u, t in list(out.items())[:limit]]


@F.pandas_udf(LINK)
def links(html: pd.Series) -> pd.Series:
    return html.map(lambda t: None if t is None else page_links(t))


_CARD = re.compile(r"b_algo(?P<body>.*?)(?:</li>|\Z)", re.S)
_CARD_LINK = re.compile(r'href="(?P<url>[^"]*)"[^>]*>(?P<title>.*?)</a>', re.S)
_CARD_TEXT = re.compile(r"<p[^>]*>(?P<text>.*?)</p>", re.S)
CARD = ty.ArrayType(ty.StructType([ty.StructField(f, ty.StringType()) for f in ("title", "url", "snippet")]))


def result_cards(html: str, limit: int = 8) -> list[dict]:
    """Cards of a page of search results: title (120 characters) and url of the first link, the first paragraph (500). Cards
    without a title or an http address, and addresses met before, are left out; a page shows ``limit``."""
    from html import unescape

    def plain(markup: str, most: int) -> str:
        text = unescape(re.sub(r"<[^>]*>?", "", markup)).strip()
        return text if len(text) <= most else text[:most] + "..."

    out: dict[str, dict] = {}
    for card in _CARD.finditer(html):
        link, text = _CARD_LINK.search(card["body"]), _CARD_TEXT.search(card["body"])
        url = unescape(link["url"]) if link else ""
        title = plain(link["title"], 120) if link else ""
        if title and url.startswith("http"):
            out.setdefault(url, {"title": title, "url": url, "snippet": plain(text["text"], 500) if text else ""})
    return list(out.values())[:limit]


@F.pandas_udf(CARD)
def cards(html: pd.Series) -> pd.Series:
    return html.map(lambda t: None if t is None else result_cards(t))
