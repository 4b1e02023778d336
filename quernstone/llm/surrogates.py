"""Surrogates for personal data: keyed replacements of the same type, format, script and gender.

Every entity is read into a canonical value (case and separators aside) and mapped by a keyed permutation of all values
of its kind: a Feistel network over the integers below the number of such values, walked on until it lands on a valid
one. A permutation keeps distinct entities distinct and equal ones equal, in every task, without a table that must be
joined; the replacement is then written in the entity's own format. Names of the lists go around a keyed cycle of the
names of their gender and script; others, met after an honorific or a given name, are permuted among the unlisted ones. A
check over the corpus's distinct entities counts collisions all the same, and the key is changed until there are none.
Entities are detected and replaced in one pass, whose rows are written once with digests of each entity and surrogate.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import stored

# Names by script, gender and place, with the honorifics that lead to them.
NAMES = {
    ("latin", "f", "given"): "Anna Maria Laura Julia Sophie Emma Claire Camille Lucia Elena Carmen Isabel Sarah Emily Alice Helen".split(),
    ("latin", "m", "given"): "Thomas Peter Paul Martin Lukas Felix Pierre Louis Antoine Carlos Miguel Javier James William George Henry".split(),
    ("latin", "", "family"): "Schmidt Fischer Weber Wagner Becker Dubois Laurent Moreau Lefebvre Garcia Fernandez Lopez Ramirez Smith Johnson Taylor Miller Clarke Walker Bennett".split(),
    ("cyrillic", "f", "given"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m", "given"): "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Павел".split(),
    ("cyrillic", "f", "family"): "Иванова Петрова Смирнова Кузнецова Соколова Попова Лебедева Морозова".split(),
    ("cyrillic", "m", "family"): "Иванов Петров Смирнов Кузнецов Соколов Попов Лебедев Морозов".split(),
}
HONORIFICS = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Don Doña Г-н Г-жа".split()

# Further given names that lead to a person's family name, whatever it is, by script and gender. Left out are those that
# are common words.
GIVEN_MORE = {
    ("latin", "m", "given"): (
        "Robert John David Richard Charles Joseph Daniel Matthew Anthony Donald Steven Andrew Kenneth Kevin Brian Edward Ronald Timothy "
        "Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick "
        "Raymond Dennis Jerry Michael Christopher Hans Klaus Jürgen Wolfgang Stefan Andreas Matthias Uwe Günter Heinrich Karl Friedrich "
        "Jean Jacques François Philippe Michel Nicolas Olivier Mathieu José Juan Luis Antonio Francisco Manuel Pedro Jorge Alejandro Diego "
        "Fernando Rafael Giovanni Giuseppe Marco Jan Piotr Krzysztof Tomasz Mohammed Muhammad Ahmed Ali"
    ).split(),
    ("latin", "f", "given"): (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Donna Michelle "
        "Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Samantha Katherine "
        "Christine Rachel Sabine Monika Petra Ursula Brigitte Renate Ingrid Heike Katharina Johanna Marie Nathalie Isabelle Sylvie "
        "Catherine Françoise Monique Céline Josefa Pilar Dolores Teresa Cristina Beatriz Francesca Agnieszka Katarzyna Fatima"
    ).split(),
    ("cyrillic", "m", "given"): "Владимир Виктор Юрий Борис Олег Игорь Максим Артём".split(),
    ("cyrillic", "f", "given"): "Екатерина Людмила Галина Юлия Ксения Дарья Виктория".split(),
}
NAMES = {k: names + GIVEN_MORE.get(k, []) for k, names in NAMES.items()}
PARTICLES = "de del la las los le da dos di du van von der den zu zum zur ter ten el al bin ibn y e".split()
ENDINGS = ("ова", "ева", "ёва", "ина", "ская", "ов", "ев", "ёв", "ин", "ский")  # of Cyrillic family names, kept for their gender

_BASIC = "aeiou", "bcdfghjklmnpqrstvwxyz"


def _classes() -> dict[str, str]:
    """The class that each digit and small letter of a name is replaced in: vowels and consonants, letters with marks, digits."""
    plain = lambda c: len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c
    marked, greek = ("".join(filter(plain, map(chr, range(a, b)))) for a, b in ((0xC0, 0x180), (0x386, 0x3CF)))
    vowels = "аеёиоуыэюя"
    rest = "".join(c for c in filter(plain, map(chr, range(0x430, 0x460))) if c not in vowels)
    return {c: k for k in (*_BASIC, marked, greek, vowels, rest) for c in k}


NAME_CLASS = _classes()
CLASS = {c: k for k in ("abcdefghijklmnopqrstuvwxyz", "0123456789") for c in k}

# names and honorifics are met as written and in capitals; Don in capitals is too often the word
_LEADS = {n for k, names in NAMES.items() if k[2] == "given" for n in names}
_LEADS |= {n.upper() for n in _LEADS if len(n) > 2}


def _either(names: Iterable[str]) -> str:
    names = set(names)
    return "|".join(sorted({*names, *(n.upper() for n in names if len(n) > 2)}, key=lambda n: (-len(n), n)))


_GIVEN = _either(n for k, names in NAMES.items() if k[2] == "given" for n in names)
_FAMILY = _either(n for k, names in NAMES.items() if k[2] == "family" for n in names)
_TITLES = "|".join([*HONORIFICS, *(h.upper() for h in HONORIFICS if h != "Don")])
_LEADS |= {h.split("-")[0] for h in _TITLES.split("|")}
_SMALL = "".join(NAME_CLASS) + "ß"
_BIG = "".join(c.upper() for c in NAME_CLASS)
_L = f"[{_SMALL}{_BIG}]"
#: Bounds of the formats: letters of a name, honorifics, initials and particles in a row, blanks between words, the parts of an address.
NAME_LETTERS, ROW, LOCAL, HOST = 64, 4, 64, 253
_SP = rf"[ ]{{1,{ROW}}}"
_END = rf"(?!\w|['’-](?:[{_BIG}]|{_L}{{2}}))"
_TOKEN = rf"[{_BIG}]{_L}{{0,{NAME_LETTERS - 1}}}(?:['’-](?=[{_BIG}]|{_L}{{2}}){_L}{{1,{NAME_LETTERS}}}){{0,{ROW}}}"  # a possessive 's isn't part of it
_REST = rf"(?:[{_BIG}]\.[ ]?){{0,{ROW}}}(?:(?:{'|'.join(PARTICLES)}){_SP}){{0,{ROW}}}{_TOKEN}"

#: The two sides of an address, about its ``@``: the last ``LOCAL`` characters before it at most, and ``HOST`` after it.
MAILBOX = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
IPV4 = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)", re.ASCII)
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII)
CARD = re.compile(r"(?<![\w.+-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\w-])", re.ASCII)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d[\d ().-]{7,18}\d|\(\d{2,4}\)[ .-]?\d[\d .-]{4,12}\d|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{4,9})(?![\w-])", re.ASCII)
PHONE_DIGITS = 7  # the fewest of a number
PERSON = re.compile(
    rf"(?<!\w)(?=[{_BIG}])(?:(?:(?:{_TITLES})\.?{_SP}){{1,{ROW}}}(?:(?:{_GIVEN})(?:{_SP}{_REST})?{_END}|(?:{_FAMILY})(?:{_SP}(?:{_FAMILY}))?{_END}|{_REST}(?:{_SP}{_REST}){{0,2}}{_END})"
    rf"|(?:{_GIVEN})(?:-{_TOKEN})?{_SP}{_REST}{_END})"
)
TITLED = re.compile(rf"(?:(?:{_TITLES})\.?{_SP}){{0,{ROW}}}")
NAME = re.compile(f"{_L}+")
WORD = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d", re.ASCII)
NUMBERED = re.compile(r"\d[\d ().:/-]*\d[\d ().:/-]*\d", re.ASCII)


def stream(key: bytes, message: bytes, size: int) -> bytes:
    """``size`` keyed bytes, digest by digest."""
    return b"".join(hashlib.blake2b(b"%d|" % at + message, key=key, digest_size=min(64, size - at)).digest() for at in range(0, size, 64))


def permute(key: bytes, tweak: str, value: int, size: int, valid: Callable[[int], bool] | None = None) -> int:
    """A keyed permutation of the numbers below ``size`` that are ``valid``: Feistel rounds, walked along their cycle
    until they land on such a number. ``value`` must be one of them."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def turn(x: int) -> int:
        left, right = x >> half, x & mask
        for r in range(8):
            left, right = right, left ^ (int.from_bytes(stream(key, f"{tweak}|{r}|{size:x}|{right:x}".encode(), width), "big") & mask)
        return left << half | right

    x = turn(value)
    while x >= size or (valid is not None and not valid(x)):
        x = turn(x)
    return x


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def refill(form: str, digits: str) -> str:
    """The form with its digits replaced in order."""
    it = iter(digits)
    return DIGITS.sub(lambda _: next(it), form)


def check_digits(country: str, body: str) -> str:
    """The check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


class Surrogates:
    """Replacements under one key."""

    def __init__(self, key: bytes):
        self.key = hmac.digest(key, b"surrogates", "sha256")
        self.cycle = {}
        for (script, gender, place), names in NAMES.items():
            order = sorted(set(names), key=lambda n: hmac.digest(self.key, f"{script}{gender}{place}{n}".encode(), "sha256"))
            for a, b in zip(order, order[1:] + order[:1]):
                self.cycle[a] = b
        # a Cyrillic family name and its other gender's form are one family: both follow the male cycle
        male, female = (NAMES["cyrillic", g, "family"] for g in "mf")
        for m, f in zip(male, female):
            self.cycle[f] = female[male.index(self.cycle[m])]
        self.known = functools.lru_cache(maxsize=100_000)(self._digits)
        self.unknown = functools.lru_cache(maxsize=100_000)(self._unknown)

    def _digits(self, kind: str, digits: str, keep: int) -> str:
        """Other digits of the same number, the first ``keep`` kept."""
        rest = digits[keep:]
        return digits[:keep] + str(permute(self.key, f"{kind}{digits[:keep]}", int(rest), 10 ** len(rest))).zfill(len(rest))

    def number(self, kind: str, form: str, keep: int) -> str:
        return refill(form, self.known(kind, "".join(DIGITS.findall(form)), keep))

    def card(self, form: str) -> str:
        digits = "".join(DIGITS.findall(form))
        good, rest = luhn(digits), len(digits) - 1
        out = permute(self.key, f"card{digits[0]}", int(digits[1:]), 10**rest, lambda x: luhn(digits[0] + str(x).zfill(rest)) == good)
        return refill(form, digits[0] + str(out).zfill(rest))

    def ssn(self, form: str) -> str:
        def fine(x: int) -> bool:
            return x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 != 0 and x % 10**4 != 0

        value = int(form.replace("-", ""))
        return refill(form, str(permute(self.key, "ssn", value, 10**9, lambda x: fine(x) == fine(value))).zfill(9))

    def ip(self, form: str) -> str:
        parts = list(map(int, form.split(".")))
        x = permute(self.key, "ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def iban(self, form: str) -> str:
        """Valid ones go to valid ones, by their bodies; others to others with all their digits."""
        flat = form.replace(" ", "")
        country, body = flat[:2], flat[4:]
        if check_digits(country, body) == flat[2:4]:
            body = self._classes("iban" + country, body)
            new = country + check_digits(country, body) + body
        else:
            new = country + self._classes("iban" + country, flat[2:], lambda x: check_digits(country, x[2:]) != x[:2])
        it = iter(new)
        return "".join(c if c == " " else next(it) for c in form)

    def _classes(self, tweak: str, text: str, valid: Callable[[str], bool] | None = None, classes: dict[str, str] = CLASS) -> str:
        """Letters to letters of their class, digits to digits, in their case and places; the rest stays. Texts that are
        ``valid`` go to such texts."""
        kinds = [classes.get(c.lower()) for c in text]
        value, size = 0, 1
        for c, k in zip(text, kinds):
            if k:
                value, size = value * len(k) + k.index(c.lower()), size * len(k)
        if size == 1:
            return text

        def spell(value: int) -> str:
            out = []
            for c, k in zip(reversed(text), reversed(kinds)):
                if k:
                    value, d = divmod(value, len(k))
                    c = k[d].upper() if c.isupper() else k[d]
                out.append(c)
            return "".join(reversed(out))

        pattern = "".join(k[0] if k else c for c, k in zip(text, kinds))
        return spell(permute(self.key, f"{tweak}|{pattern}", value, size, valid and (lambda x: valid(spell(x)))))

    def email(self, form: str) -> str:
        """Local part and host together, without the top-level domain."""
        head, dot, top = form.rpartition(".")
        return self._classes("email." + top.lower(), head) + dot + top

    def person(self, form: str) -> str:
        """Each name by its cycle, and unknown ones by a permutation of those of their form; honorifics and particles are
        kept, so that full and shorter mentions of a person still agree."""
        at = TITLED.match(form).end()
        return form[:at] + NAME.sub(lambda m: m[0] if m[0] in PARTICLES else self.listed(m[0]) or self.unknown(m[0]), form[at:])

    def listed(self, name: str) -> str | None:
        """The next of a listed name's cycle, in capitals where the name is."""
        if name in self.cycle or len(name) < 3 or not name.isupper():
            return self.cycle.get(name)
        return self.cycle[name.title()].upper() if name.title() in self.cycle else None

    def _unknown(self, name: str) -> str:
        """A name that no list holds; vowels, consonants and the ending of a Cyrillic family name stay what they are."""
        end = ending(name)
        stem = name[: len(name) - len(end)]
        return self._classes("name", stem, lambda x: self.listed(x + end) is None and ending(x + end) == end and x + end not in PARTICLES, NAME_CLASS) + end


def ending(name: str) -> str:
    return next((e for e in ENDINGS if name.endswith(e) and len(name) > len(e) + 1), "")


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the e-mail addresses, about each ``@``."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = max(end, at - LOCAL)
        if (left := MAILBOX.search(text[start:at])) and (right := DOMAIN.match(text, at + 1, at + 1 + HOST)):
            end = right.end()
            yield start + left.start(), end
        at = text.find("@", max(at + 1, end))


#: Kinds in order of precedence: pattern, or what gives the places, and replacement.
KINDS: list[tuple[str, re.Pattern | Callable, Callable[[Surrogates, str], str]]] = [
    ("email", addresses, Surrogates.email),
    ("ip", IPV4, Surrogates.ip),
    ("iban", IBAN, Surrogates.iban),
    ("card", CARD, Surrogates.card),
    ("ssn", SSN, Surrogates.ssn),
    ("phone", PHONE, lambda s, f: s.number("phone", f, 2 if f.startswith("+") else 0)),
    ("person", PERSON, Surrogates.person),
]


def canonical(kind: str, form: str) -> str:
    """What two mentions of one entity share."""
    if kind in ("card", "ssn"):
        return "".join(DIGITS.findall(form))
    if kind == "phone":
        return ("+" if form.startswith("+") else "") + "".join(DIGITS.findall(form))
    if kind == "ip":
        return ".".join(str(int(p)) for p in form.split("."))
    if kind == "iban":
        return form.replace(" ", "")
    return form.lower() if kind == "email" else form


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities, in order; of overlapping ones the earlier kind stays. Ends are exclusive."""
    found: list[tuple[int, int, str]] = []  # in order of their places
    numbered = NUMBERED.search(text) is not None
    for kind, pattern, _ in KINDS:
        if kind == "email" and "@" not in text or kind in ("ip", "iban", "card", "ssn", "phone") and not numbered:
            continue
        if kind == "person" and _LEADS.isdisjoint(WORD.findall(text)):
            continue
        places = pattern(text) if callable(pattern) else (m.span() for m in pattern.finditer(text))
        fresh = []
        for a, b in places:
            if kind == "phone" and len(DIGITS.findall(text[a:b])) < PHONE_DIGITS:
                continue  # dots and blanks between a few digits, as in a table of contents
            i = bisect.bisect_left(found, (a, b))  # found ones don't overlap each other
            if (i == 0 or found[i - 1][1] <= a) and (i == len(found) or b <= found[i][0]):
                fresh.append((a, b, kind))
        found = sorted(found + fresh)
    return [(k, a, b) for a, b, k in found]


_MAKE = {kind: make for kind, _, make in KINDS}


def replace(text: str, made: Surrogates) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and (kind, start, end in the old text, surrogate) of each."""
    out, at, spans = [], 0, []
    for kind, a, b in detect(text):
        new = _MAKE[kind](made, text[a:b])
        out += [text[at:a], new]
        spans.append((kind, a, b, new))
        at = b
    return "".join([*out, text[at:]]), spans


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())]))
PAIRS = pa.list_(pa.struct([("kind", pa.string()), ("old", pa.binary()), ("new", pa.binary())]))
SCHEMA = (
    "doc_id long, n_entities long, spans array<struct<kind:string,start:long,end:long,surrogate:string>>, text string, "
    "pairs array<struct<kind:string,old:binary,new:binary>>"
)


def _digest(value: str) -> bytes:
    return hashlib.blake2b(value.encode(), digest_size=16).digest()


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """Rows with surrogates under the key, and digests of the distinct entities of each row and of what replaces them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for batch in batches:
            texts, spans, pairs = [], [], []
            for t in batch.column(1):
                old = t.as_py() or ""
                new, found = replace(old, made)
                texts.append(None if t.as_py() is None else new)
                spans.append([dict(zip(("kind", "start", "end", "surrogate"), s)) for s in found])
                both = {(k, canonical(k, old[a:b]), canonical(k, s)) for k, a, b, s in found}
                pairs.append([{"kind": k, "old": _digest(x), "new": _digest(y)} for k, x, y in sorted(both)])
            columns = [batch.column(0), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, SPANS), pa.array(texts, pa.string()), pa.array(pairs, PAIRS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_entities", "spans", "text", "pairs"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def clashes(rows: DataFrame) -> int:
    """Surrogates of ``replaced`` rows that two or more distinct entities of a kind share, and entities with two surrogates."""
    pairs = rows.select(F.inline("pairs")).distinct()
    return sum(pairs.groupBy("kind", side).count().where("count > 1").count() for side in ("new", "old"))


def collisions(docs: DataFrame, key: bytes) -> int:
    """What ``clashes`` counts over the whole of ``docs`` under the key."""
    return clashes(replaced(docs, key))


def pseudonymize(docs: DataFrame, key: bytes, *, attempts: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` with surrogates: doc_id, n_entities, spans (in the old text) and the new text.

    The key is secret and decides all replacements; if the corpus-wide check finds a collision, a key derived from it
    is tried. An address's local part has at most 64 characters and its host 253; of a longer run before the ``@`` the
    last 64 are taken. A name has at most 64 letters, longer runs are none. Texts of any length take time in proportion. Null texts stay null and empty ones empty; repeated rows and entities get the same surrogates; an empty
    table gives no rows; other columns are ignored.
    """
    for n in range(attempts):
        used = key if n == 0 else hmac.digest(key, str(n).encode(), "sha256")
        rows = stored(replaced(docs, used), "surrogates")
        if clashes(rows) == 0:
            return rows.drop("pairs")
    raise RuntimeError("surrogates collide under every key tried")
