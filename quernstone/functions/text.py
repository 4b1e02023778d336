"""Text functions as Column expressions: normalization, keys, lists, headers, similarity. Nulls give null unless said."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = "　" + "".join(chr(c + 0xFEE0) for r in ("AZ", "az", "09") for c in range(ord(r[0]), ord(r[1]) + 1))
HALF = " " + "".join(chr(c) for r in ("AZ", "az", "09") for c in range(ord(r[0]), ord(r[1]) + 1))
#: The whole full-width block, punctuation too.
WIDE = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = " " + "".join(chr(c) for c in range(0x21, 0x7F))

_EDGE = r"(?U)^\s+|\s+$"
_BLANKS = r"(?U)\s+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Unicode white space off both ends (``trim`` knows only U+0020)."""
    return F.regexp_replace(col(c), _EDGE, "")


def blank_to_null(c) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def when_told(c) -> Column:
    """The text as it is, null where it is blank."""
    return F.when(strip(c) != "", col(c))


def normalize(c) -> Column:
    """Search form: full-width letters and digits made ASCII, lower case, no white space."""
    return F.regexp_replace(F.lower(F.translate(col(c), FULL, HALF)), _BLANKS, "")


def half_width(c) -> Column:
    return F.translate(col(c), WIDE, NARROW)


def compact(c) -> Column:
    return F.regexp_replace(col(c), _BLANKS, "")


def code_key(c) -> Column:
    """Upper-case ASCII letters and digits of the search form."""
    return F.upper(F.regexp_replace(normalize(c), "[^0-9a-z]", ""))


def pinyin_key(c) -> Column:
    return F.regexp_replace(normalize(c), "[^0-9a-z]", "")


def valid_code(c) -> Column:
    """A capital first, then capitals, digits, underscores and hyphens."""
    return col(c).rlike("^[A-Z][A-Z0-9_-]*$")


def valid_acupoint_code(c) -> Column:
    return col(c).rlike("^[A-Z]{2}[0-9]+$")


def _parts(c, separators: str) -> Column:
    return F.filter(F.transform(F.split(col(c), f"[{separators}]"), strip), lambda x: x != "")


def split_list(c) -> Column:
    """Parts between list separators, without blanks."""
    return _parts(c, ",，;；、|")


def split_terms(c) -> Column:
    """Parts between list separators and slashes."""
    return _parts(c, ",，;；|/、")


def split_join(c) -> Column:
    return F.array_join(split_list(c), ",")


def alias_key(c) -> Column:
    """``|a|b|``: the normalized aliases, distinct and sorted; ``||`` where there is none."""
    parts = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(col(c), "[,，;；|/、 ]"), normalize), lambda x: x != "")))
    return F.concat(F.lit("|"), F.array_join(parts, "|"), F.lit("|"))


def alias_contains(aliases, name) -> Column:
    n = normalize(name)
    return (n != "") & F.contains(alias_key(aliases), F.concat(F.lit("|"), n, F.lit("|")))


def merge_tags(a, b) -> Column:
    """Both tag lists, the first spelling of each normalized tag, joined by ``，``; null reads as empty."""
    both = F.concat(split_terms(F.coalesce(col(a), F.lit(""))), split_terms(F.coalesce(col(b), F.lit(""))))
    first = F.aggregate(
        both,
        F.array().cast("array<string>"),
        lambda seen, x: F.when(F.exists(seen, lambda s: normalize(s) == normalize(x)), seen).otherwise(F.array_append(seen, x)),
    )
    return F.array_join(first, "，")


def header_key(c) -> Column:
    """Header for matching: lower case without spaces, hyphens, underscores, dots and slashes."""
    return F.regexp_replace(F.lower(strip(c)), r"[ \-_./]", "")


def mapping_header_key(c) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"[ \-_]", "")


def header_key_text(text: str) -> str:
    """``header_key`` of a literal."""
    return "".join(ch for ch in text.strip().lower() if ch not in " -_./")


# Category and type names and what they fold to.
CATEGORIES = {"腧穴": "穴位", "草药": "中药"}
ITEM_TYPES = {
    **{t: t for t in ("herb", "formula", "acupuncture", "syndrome", "theory", "note")},
    "classic": "theory", "acupoint": "acupuncture", "meridian": "acupuncture",
    "unknown": "note", "mixed": "note", "auto": "note", "disease": "note",
    "中药": "herb", "方剂": "formula", "经络": "acupuncture", "穴位": "acupuncture", "证型": "syndrome", "理论": "theory",
    "笔记": "note", "病症": "note",
}


def lookup(c, pairs: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), col(c))


def category(c) -> Column:
    return F.coalesce(lookup(c, CATEGORIES), col(c))


def item_type(c) -> Column:
    """The canonical type; unknown and missing ones are notes."""
    return F.coalesce(lookup(F.coalesce(col(c), F.lit("note")), ITEM_TYPES), F.lit("note"))


def truncate(c, n: int) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def summary_of(c, n: int = 80) -> Column:
    return F.substring(col(c), 1, n)


def camel_case(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def overlap_similarity(a, b) -> Column:
    """2 x (characters of a that occur in b) / (both lengths); not symmetric. Two empty strings give 0."""
    a, b = col(a), col(b)
    hits = F.size(F.filter(F.split(a, ""), lambda ch: (ch != "") & F.contains(b, ch)))
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2.0 * hits / total).otherwise(0.0)


def content_similar(a, b) -> Column:
    """Normalized texts equal, or one holds the other; blank ones are never similar."""
    both = F.transform(F.array(col(a), col(b)), lambda c: normalize(F.coalesce(c, F.lit(""))))

    def similar(x: Column, y: Column) -> Column:
        return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))

    return F.get(F.transform(F.array(both), lambda t: similar(t[0], t[1])), F.lit(0))


def dimension_similarity(name_a, name_b, pinyin_a, pinyin_b, code_a, code_b, measure) -> Column:
    """Weighted mean of name (.5), pinyin (.3) and code (.2, equal or not) over the dimensions that both have."""
    dims = [
        (0.5, col(name_a), col(name_b), measure(name_a, name_b)),
        (0.3, col(pinyin_a), col(pinyin_b), measure(pinyin_a, pinyin_b)),
        (0.2, col(code_a), col(code_b), (col(code_a) == col(code_b)).cast("double")),
    ]
    there = [(w, x.isNotNull() & y.isNotNull() & (x != "") & (y != ""), s) for w, x, y, s in dims]
    weight = reduce(lambda p, q: p + q, (F.when(ok, w).otherwise(0.0) for w, ok, _ in there))
    total = reduce(lambda p, q: p + q, (F.when(ok, s * w).otherwise(0.0) for w, ok, s in there))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def percent_encode(c) -> Column:
    """RFC 3986: unreserved characters stay, a space is %20."""
    out = F.url_encode(col(c))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def percent_decode(c) -> Column:
    """Decoded text; null where the escapes aren't valid. A plus is a plus."""
    return F.try_url_decode(F.replace(col(c), F.lit("+"), F.lit("%2B")))


def strip_tags(c) -> Column:
    """Text outside ``<...>``; an unclosed tag takes the tail with it, a stray ``>`` goes too."""
    return F.replace(F.regexp_replace(col(c), "<[^>]*>?", ""), F.lit(">"), F.lit(""))


# Entities in the order in which they are replaced.
ENTITIES = [("&amp;", "&"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")]


def unescape(c) -> Column:
    out = col(c)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def labelled_text(c, labels: list[str]) -> Column:
    """What follows the first label that the text holds, up to a newline or full stop; labels are tried in order."""
    found = []
    for label in labels:
        after = F.regexp_replace(F.substring_index(F.split_part(col(c), F.lit(label), F.lit(2)), "\n", 1), r"^[：:\s]+", "")
        found.append(F.when(F.contains(col(c), F.lit(label)), blank_to_null(F.substring_index(after, "。", 1))))
    return F.coalesce(*found)


def labelled_section(c, label: str, labels: list[str]) -> Column:
    """The section under 【label】, up to the next of the known labels."""
    ahead = "|".join(labels)
    return blank_to_null(F.regexp_extract(col(c), rf"(?s)【{label}】(.*?)(?=【(?:{ahead})】|$)", 1))


def terms_in_order(c, terms: list[str]) -> Column:
    """The known terms in order of appearance, longest match first, each once."""
    import re

    pattern = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(f"({pattern})"), 1))


def unique_join(*lists, sep: str = "，") -> Column:
    return F.array_join(F.array_distinct(F.concat(*(split_terms(F.coalesce(col(x), F.lit(""))) for x in lists))), sep)


def source_note(existing, *extra) -> Column:
    """The note and the further parts, without blanks and repeats, joined by `` / ``."""
    parts = F.filter(F.array(*(strip(F.coalesce(col(c), F.lit(""))) for c in (existing, *extra))), lambda x: x != "")
    return F.array_join(F.array_distinct(parts), " / ")


def highlight(c, query: str) -> Column:
    """The query wrapped in <mark> wherever it stands."""
    return F.replace(col(c), F.lit(query), F.lit(f"<mark>{query}</mark>")) if query else col(c)


def canonical_key(c) -> tuple[Column, Column]:
    """(type, name) of a key ``kind:...:name``; a passage's name is its second part; a bare word is a note."""
    key = col(c)
    parts = F.split(key, ":")
    kind = F.element_at(parts, 1)
    # The kinds of keys.
    kinds = {"herb": "herb", "formula": "formula", "acupoint": "acupuncture", "meridian": "acupuncture", "classic_chapter": "theory", "classic_passage": "syndrome"}
    simple = F.size(parts) < 2
    kind_of = F.when(simple, F.lit("note")).otherwise(F.coalesce(lookup(kind, kinds), F.lit("note")))
    passage = (kind == "classic_passage") & (F.size(parts) >= 3)
    name = F.when(simple, strip(key)).when(passage, strip(F.get(parts, F.lit(2)))).otherwise(strip(F.element_at(parts, -1)))
    return kind_of, name


#: Keywords that tell an acupuncture question, and those that tell one about medicines.
NEEDLE_WORDS = ["针", "灸", "穴", "经络"]
MEDICINE_WORDS = ["药", "方", "咳嗽", "治疗", "怎么治"]


def intent(c) -> Column:
    def has(words):
        return reduce(lambda a, b: a | b, (F.contains(col(c), F.lit(w)) for w in words))

    return F.when(has(NEEDLE_WORDS), "Acupuncture").when(has(MEDICINE_WORDS), "MedicineOrFormula").otherwise("General")
