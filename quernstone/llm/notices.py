"""License scan: fuzzy search for short notices.

A notice of several words may be found with up to k edits (single characters). Cut into k + 1 pieces, one of them must
stand unedited in any such match, so the pieces are exact seeds: only where one occurs does the regex library's
bounded-error matching run, on each stretch of whole words that a match through that seed could be. Text and notices are
compared as lower-cased words joined by single spaces. Each document is scanned where it lies; nothing is shuffled.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import alnum_words

# The exact phrases and labels of the contract.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Short notices in common use, their labels and the edits allowed.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 6),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("mozilla public license version", "mpl", 3),
    ("licensed under a creative commons attribution", "cc-by", 4),
    ("licensed under cc by", "cc-by", 2),
    ("cc by nc", "cc-by-nc", 0),
    ("cc by sa", "cc-by-sa", 0),
    ("creative commons attribution noncommercial", "cc-by-nc", 4),
    ("creative commons attribution sharealike", "cc-by-sa", 4),
    ("all rights reserved", "reserved", 2),
    ("released into the public domain", "public-domain", 3),
    ("spdx license identifier", "spdx", 2),
]


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """The phrase cut into ``edits + 1`` parts of near equal length, each with its place."""
    n = edits + 1
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class NoticeScanner:
    """Finds the base phrases exactly and the notices within their edits, in one text at a time."""

    def __init__(self, notices=None, base=None):
        self.base = [(f" {p} ", p, label) for p, label in (BASE if base is None else base)]
        self.notices = []
        for phrase, label, edits in NOTICES if notices is None else notices:
            if edits >= len(phrase):
                raise ValueError(f"{edits} edits are too many for {phrase!r}")
            fuzzy = regex.compile(f"(?b)(?:{regex.escape(phrase)}){{e<={edits}}}")
            self.notices.append((phrase, label, edits, pieces(phrase, edits), fuzzy))

    def base_hits(self, joined: str) -> list[tuple[int, int, str]]:
        """(character start, end, label) of each place of each base phrase; joined has a space at either end."""
        found = []
        for bounded, phrase, label in self.base:
            at = joined.find(bounded)
            while at >= 0:
                found.append((at + 1, at + 1 + len(phrase), label))
                at = joined.find(bounded, at + 1)
        return found

    def fuzzy_hits(self, joined: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, edits, share of unedited characters) of each notice's matches of whole words; of
        overlapping ones of a notice that with the fewest edits, then the first and the shortest."""
        found = []
        for phrase, label, edits, parts, fuzzy in self.notices:
            begins = set()
            for offset, part in parts:
                at = joined.find(part)
                while at >= 0:
                    # a match with this part unedited begins after a space, at most `edits` from the part's place
                    space = joined.find(" ", max(0, at - offset - edits - 1), max(0, at - offset + edits))
                    while space >= 0:
                        begins.add(space + 1)
                        space = joined.find(" ", space + 1, max(0, at - offset + edits))
                    at = joined.find(part, at + 1)
            matches = []
            for a in begins:
                b = joined.find(" ", max(a + 1, a + len(phrase) - edits), a + len(phrase) + edits + 1)
                while b >= 0:
                    if m := fuzzy.fullmatch(joined, a, b):
                        matches.append((sum(m.fuzzy_counts), a, b))
                    b = joined.find(" ", b + 1, a + len(phrase) + edits + 1)
            taken: list[tuple[int, int, str, int, float]] = []  # by start; none of them meets another
            for e, a, b in sorted(matches):
                at = bisect.bisect_left(taken, (a,))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                    taken.insert(at, (a, b, label, e, 1 - e / len(phrase)))
            found += taken
        return found

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans (first word, last word, label, edits)."""
        words = alnum_words(text)
        joined = f" {b' '.join(words).decode()} "
        base = self.base_hits(joined)
        fuzzy = self.fuzzy_hits(joined)
        begins = list(itertools.accumulate((len(w.decode()) + 1 for w in words), initial=1)) if base or fuzzy else []
        word_at = (lambda at: bisect.bisect_right(begins, at) - 1)  # the word that begins there
        starts = [word_at(a) for a, _, _ in base]
        spans = sorted({(word_at(a), word_at(b), label, e) for a, b, label, e, _ in fuzzy})
        score = max([1.0 if base else 0.0, *(unedited for *_, unedited in fuzzy)])
        exact = {label for _, _, label in base}
        return (
            len(words),
            len(base),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(exact)),
            ",".join(sorted(exact | {s[2] for s in spans})),
            score,
            [f"{label}:{a}:{b}:{e}" for a, b, label, e in spans],
        )


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<string>"
)


def scan_notices(docs: DataFrame, notices=None) -> DataFrame:
    """License notices of each row of ``docs(doc_id, text)``: SCHEMA's columns.

    n_base counts all places of the base phrases, first_word and last_word are their smallest and largest start (null
    if none), labels adds those of the fuzzy notices, score is 1 less the least share of edited characters (0: nothing
    found), spans lists ``label:first word:last word:edits`` of the fuzzy matches. Null and empty texts have no words
    and find nothing; repeated rows are scanned each; an empty table gives no rows; other columns are ignored.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = NoticeScanner(notices)
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=[c.split()[0] for c in SCHEMA.split(", ")]
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
