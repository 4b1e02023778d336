"""Relation graph: mentions of items in texts, suggestions, degrees and neighbourhoods."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T

#: Bytes of needles that are sent to every task; more are met by their grams.
NEEDLE_BYTES = 8 << 20


def needles(targets: DataFrame) -> DataFrame:
    """(target_id, needle): normalized name, code and alias parts of ``targets(id, name, code, alias)``, blanks out."""
    parts = F.concat(F.array(T.normalize("name"), T.normalize("code")), F.transform(F.split(F.coalesce("alias", F.lit("")), "[,，;；|/、 ]"), T.normalize))
    each = targets.select(F.col("id").alias("target_id"), F.explode(F.array_distinct(parts)).alias("needle"))
    return each.where("needle is not null and needle != ''")


def mentions(texts: DataFrame, wanted: DataFrame, *, needle_bytes: int = NEEDLE_BYTES) -> DataFrame:
    """(source_id, target_id): which normalized ``texts(id, text)`` hold a needle of ``wanted(target_id, needle)``, once each.

    Needles of at most ``needle_bytes`` together go to every task as one automaton. More are met whole, or by their rarest grams
    where they are longer than ``WHOLE`` characters, in one pass over the texts whatever their number, and never leave the
    executors. Null ids are left out.
    """
    return held(texts.where("id is not null").select(F.col("id").alias("source_id"), T.normalize("text").alias("text")), wanted, needle_bytes=needle_bytes)


def held(normal: DataFrame, wanted: DataFrame, *, needle_bytes: int = NEEDLE_BYTES) -> DataFrame:
    """``mentions`` of texts ``(source_id, text)`` and needles that are in the form in which they are to be compared.

    Texts are searched for the needles of classes of targets; what a class is found in is dealt to its targets by a join.
    """
    members, named = needle_classes(wanted)
    size, n_named, n_classes = named.agg(F.coalesce(F.sum(F.octet_length("needle")), F.lit(0)), F.count("*"), F.countDistinct("class_id")).first()
    of_class = named.withColumnRenamed("class_id", "target_id")
    if size <= needle_bytes:
        found = by_automaton(normal, of_class)
    elif n_named == n_classes and normal.groupBy("source_id").count().where("count > 1").isEmpty():
        # a needle a class and a text a source: what is found is found once, and goes to its targets where it is met
        return by_length(normal, named.hint("merge").join(members, "class_id").select("target_id", "needle"))
    else:
        found = by_length(normal, of_class).distinct()
    # a given number of partitions isn't merged at run time: few bytes here can make many rows
    n = int(normal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.select("source_id", F.col("target_id").alias("class_id")).repartition(n, "class_id").hint("merge")
    return found.join(members.repartition(n, "class_id"), "class_id").select("source_id", "target_id")


def needle_classes(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, target_id) and (class_id, needle): targets of equal needles are one class, told by its least target."""
    from quernstone.operators.store import materialized

    # a target's needles are few: its name, code and aliases
    sets = materialized(wanted.groupBy("target_id").agg(F.sort_array(F.collect_set("needle")).alias("needles")), "needle-sets")
    classes = materialized(sets.groupBy("needles").agg(F.min("target_id").alias("class_id")), "needle-classes")
    return sets.hint("merge").join(classes, "needles").select("class_id", "target_id"), classes.select("class_id", F.explode("needles").alias("needle"))


def by_automaton(normal: DataFrame, wanted: DataFrame) -> DataFrame:
    """``mentions`` by one automaton of all needles, whose size the caller has checked."""
    sent = normal.sparkSession.sparkContext.broadcast([tuple(r) for r in wanted.select("target_id", "needle").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        owners: dict[str, set[int]] = {}
        for target, needle in sent.value:
            owners.setdefault(needle, set()).add(target)
        automaton = ahocorasick.Automaton()
        for needle in owners:
            automaton.add_word(needle, needle)
        automaton.make_automaton()
        for batch in batches:
            pairs = []
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {n for _, n in automaton.iter(text)} if text and owners else ()
                pairs += [(source, t) for t in set().union(*(owners[n] for n in found))]
            columns = list(zip(*pairs)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["source_id", "target_id"])

    return normal.mapInArrow(run, "source_id long, target_id long")


#: Lengths of grams: a needle is known by grams of the largest that it reaches.
GRAM_LENGTHS = (1, 2, 3, 6, 12)
#: Bits of the filter of signature grams that every task holds, and texts whose grams tell which are rare.
FILTER_BITS, COUNTED_TEXTS = 1 << 24, 10_000


#: Needles of up to so many characters are met whole. Characters that a task looks through at a time.
WHOLE, LOOKED_AT = 48, 1 << 20


def gram_hashes(text: str, length: int) -> np.ndarray:
    """A hash of each run of ``length`` characters, in order."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(points) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = h * np.uint64(0x100000001B3) + points[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(32)).view(np.int64)


def filter_bits(places: DataFrame) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits, those at column ``place`` set."""
    words = places.select(F.floor(F.col("place") / 32).cast("long").alias("word"), F.pmod("place", F.lit(32)).cast("int").alias("bit")).distinct()
    told = words.groupBy("word").agg(F.sum(F.pow(F.lit(2.0), "bit")).cast("long").alias("v")).toArrow()  # at most FILTER_BITS / 32 rows
    bits = np.zeros(FILTER_BITS // 32, "<u4")
    bits[told["word"].to_numpy()] = told["v"].to_numpy()
    return bits.view(np.uint8)


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hashes' base and of its inverse, modulo 2 ** 64."""
    base = 0x100000001B3
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))


class Windows:
    """Runs of the characters of some texts, told by hashes of any length."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        self.points = np.frombuffer(self.text.encode("utf-32-le"), "<u4")
        n, sizes = len(self.points), [len(t) for t in texts]
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        self.room = np.repeat(np.cumsum(sizes, dtype=np.int64), sizes) - np.arange(n)  # characters up to the text's end
        powers, self.inverses = _powers(max(LOOKED_AT, 1 << n.bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.points + np.uint64(1)) * powers[:n])])

    def hashes(self, at: np.ndarray | None, length: int) -> np.ndarray:
        """The hashes of the runs of ``length`` that begin at ``at``, or at each place."""
        if at is None:
            return (self.sums[length:] - self.sums[:-length]) * self.inverses[: max(0, len(self.sums) - length)]
        return (self.sums[at + length] - self.sums[at]) * self.inverses[at]

    @staticmethod
    def places(h: np.ndarray, length: int, *, whole: bool) -> np.ndarray:
        """The places of hashes in the filter, as those of whole needles or of their beginnings."""
        mixed = (h + np.uint64(2 * length + whole)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).view(np.int64)

    def passing(self, at: np.ndarray | None, length: int, kept: np.ndarray, *, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Those of the begins (or of all) that have room and pass the filter, and their hashes."""
        if at is None:
            room = self.room[: max(0, len(self.sums) - length)]
        else:
            at = at[self.room[at] >= length]
            room = self.room[at]
        h = self.hashes(at, length)
        place = self.places(h, length, whole=whole)
        passed = np.flatnonzero((kept[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1) & (room >= length))
        return passed if at is None else at[passed], h[passed]

    def pieces(self, at: np.ndarray, h: np.ndarray, length: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct runs, and (run, text) by number of each text that has one, ordered and once."""
        told = np.unique(h)
        run, first = np.searchsorted(told, h), np.zeros(len(told), np.int64)
        first[run] = at  # any of its begins
        if any((self.points[at + k] != self.points[first[run] + k]).any() for k in range(length)):  # two runs of one hash
            _, one, run = np.unique(self.points[at[:, None] + np.arange(length)], axis=0, return_index=True, return_inverse=True)
            run, first = run.reshape(-1), at[one]
        texts = int(self.owner[-1]) + 1
        key = run * texts + self.owner[at]
        if len(first) * texts <= 1 << 24:
            seen = np.zeros(len(first) * texts, bool)
            seen[key] = True
            key = np.flatnonzero(seen)
        else:
            key = np.unique(key)
        return [self.text[i : i + length] for i in first.tolist()], key // texts, key % texts


def gram_length(length: int) -> int:
    """The longest gram that a needle of a length reaches."""
    return max(n for n in GRAM_LENGTHS if n <= length)


def by_length(normal: DataFrame, wanted: DataFrame) -> DataFrame:
    """``mentions`` of needles of any length, which never leave the executors; a pair may come as often as it has needles."""
    longer = wanted.where(F.length("needle") > WHOLE)
    if longer.isEmpty():
        return by_pieces(normal, wanted)
    return by_pieces(normal, wanted.where(F.length("needle") <= WHOLE)).unionByName(by_grams(normal, longer))


def by_pieces(normal: DataFrame, wanted: DataFrame) -> DataFrame:
    """``mentions`` of needles of at most ``WHOLE`` characters by a join of texts' pieces with needles: a task gives those pieces of
    a needle's length that pass a filter of fixed size, each with the texts that hold it, so that neither text nor candidates
    have to be verified. Only where a needle's beginning passes are its lengths tried."""
    from quernstone.operators.index import spread
    from quernstone.operators.store import materialized

    def of_needles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Windows(batch.column(0).to_pylist())
            begins = np.flatnonzero(np.diff(own.owner, prepend=-1))  # no needle is empty
            for n in np.unique(own.room[begins]).tolist():
                at = begins[own.room[begins] == n]
                both = np.concatenate([own.places(own.hashes(at, k), k, whole=whole) for k, whole in ((gram_length(n), False), (n, True))])
                yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(np.full(len(both), n, np.int32))], names=["place", "length"])

    owners = wanted.where("needle != ''").select("needle", "target_id").distinct()
    places = materialized(owners.select("needle").distinct().mapInArrow(of_needles, "place long, length int"), "needle-places")
    lengths = sorted(r[0] for r in places.select("length").distinct().collect())  # at most WHOLE
    kept = normal.sparkSession.sparkContext.broadcast(filter_bits(places))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pc.is_valid(batch.column(1)))
            sizes = pc.utf8_length(rows.column(1)).to_numpy().astype(np.int64)
            part = np.cumsum(sizes) // LOOKED_AT
            for some in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1):
                if sizes[some].sum() == 0:
                    continue
                chunk = rows.slice(some[0], len(some))
                ids, own = chunk.column(0).to_numpy(), Windows(chunk.column(1).to_pylist())
                for gram in GRAM_LENGTHS:
                    tried = [n for n in lengths if gram_length(n) == gram]
                    begins = None
                    if tried and tried != [gram]:
                        begins, _ = own.passing(begins, gram, kept.value, whole=False)
                    for n in tried:
                        at, h = own.passing(begins, n, kept.value, whole=True)
                        if len(at):
                            names, run, text = own.pieces(at, h, n)
                            ends = np.concatenate([[0], np.cumsum(np.bincount(run, minlength=len(names)))])
                            held_by = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[text]))
                            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), held_by], names=["needle", "sources"])

    # a given number of partitions isn't merged at run time: few bytes here can make many rows
    n = int(normal.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = spread(normal).mapInArrow(of_texts, "needle string, sources array<long>").repartition(n, "needle").hint("merge")
    return met.join(owners.repartition(n, "needle"), "needle").select(F.explode("sources").alias("source_id"), "target_id")


def by_grams(normal: DataFrame, wanted: DataFrame) -> DataFrame:
    """``mentions`` by a join of signatures: every needle is known by its rarest gram; texts give those of their grams alone
    that pass a filter of ``FILTER_BITS`` bits; texts and needles that share one are verified. Which gram is rarest is told by the
    grams of about ``COUNTED_TEXTS`` texts, and decides no row."""
    from quernstone.operators.index import spread
    from quernstone.operators.store import materialized

    normal = materialized(spread(normal), "texts")  # normalized once, and read three times

    def of_needles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for needle in batch.column(0).to_pylist():
                length = gram_length(len(needle))
                own = np.unique(gram_hashes(needle, length))
                yield pa.RecordBatch.from_arrays([pa.array([needle] * len(own), pa.string()), pa.array(own), pa.array(np.full(len(own), length, np.int32))], names=["needle", "h", "length"])

    def bits_of(hashes: DataFrame) -> np.ndarray:
        """A filter that lets the hashes of column ``h`` pass."""
        return filter_bits(hashes.select(F.pmod("h", F.lit(FILTER_BITS)).alias("place")))

    def of_texts(kept: np.ndarray, lengths: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sources, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = np.concatenate([np.zeros(0, np.int64), *(gram_hashes(text or "", n) for n in lengths)])
                    at = own & FILTER_BITS - 1
                    own = np.unique(own[kept[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1])
                    sources.append(np.full(len(own), source, np.int64))
                    hashes.append(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sources)), pa.array(np.concatenate(hashes))], names=["source_id", "h"])

        return run

    names = wanted.select("needle").where("needle != ''").distinct()
    grams = materialized(names.mapInArrow(of_needles, "needle string, h long, length int"), "needle-grams")
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # at most five
    share = min(1.0, COUNTED_TEXTS / max(1, normal.count()))
    some = normal.where(F.pmod(F.xxhash64("source_id"), F.lit(1 << 31)) < share * (1 << 31))
    counts = some.mapInArrow(of_texts(bits_of(grams), lengths), "source_id long, h long").groupBy("h").agg(F.count("*").alias("n"))
    rare = grams.join(counts, "h", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("least"))
    signed = materialized(rare.select("needle", F.col("least.h").alias("h")), "signatures")
    met = normal.mapInArrow(of_texts(bits_of(signed), lengths), "source_id long, h long")
    # candidates compress to a byte or two each, so by their bytes they would be taken for few and sent through the driver
    pairs = met.join(signed, "h").select("source_id", "needle").hint("merge")
    held = normal.join(pairs, "source_id").where(F.contains("text", F.col("needle"))).select("source_id", "needle")
    return held.join(wanted.select("target_id", "needle"), "needle").select("source_id", "target_id").distinct()


#: Which type's text is searched for which, the relation and its confidence.
MENTION_RULES = [
    ("formula", "herb", "contains_herb", 0.86),
    ("disease", "acupoint", "mentions_acupoint", 0.72),
    ("disease", "formula", "mentions_formula", 0.72),
    ("disease", "syndrome", "mentions_syndrome", 0.72),
]


def suggest(items: DataFrame) -> DataFrame:
    """Suggested edges among ``items(id, type, code, name, alias, category, text, meridian_id)``.

    Mentions by MENTION_RULES; an acupoint goes to its bound meridian (.96), or, without one, to the meridians that its
    category or text mentions or whose code begins its own (.84). Columns: source_id, target_id, relation_type, confidence.
    """
    out = None
    for source, target, relation, confidence in MENTION_RULES:
        wanted = needles(items.where(F.col("type") == target))
        found = mentions(items.where(F.col("type") == source).select("id", "text"), wanted).where("source_id != target_id")
        rows = found.select("source_id", "target_id", F.lit(relation).alias("relation_type"), F.lit(confidence).alias("confidence"))
        out = rows if out is None else out.unionByName(rows)
    points, lines = items.where("type = 'acupoint'"), items.where("type = 'meridian'")
    bound = points.join(lines.select(F.col("id").alias("target_id")), F.col("meridian_id") == F.col("target_id")).select(F.col("id").alias("source_id"), "target_id")
    free = points.join(bound.select(F.col("source_id").alias("id")), "id", "left_anti")
    told = mentions(free.select("id", F.concat_ws(" ", "category", "text").alias("text")), needles(lines))
    # a code prefix is an equi join over the prefixes of the point's code
    prefixes = free.where("code is not null").select(F.col("id").alias("source_id"), F.explode(F.expr("transform(sequence(1, greatest(length(code), 1)), n -> upper(substring(code, 1, n)))")).alias("prefix"))
    coded = prefixes.join(lines.where("code != ''").select(F.col("id").alias("target_id"), F.upper("code").alias("prefix")), "prefix").select("source_id", "target_id")
    for rows, confidence in ((bound, 0.96), (told.unionByName(coded).distinct(), 0.84)):
        out = out.unionByName(rows.select("source_id", "target_id", F.lit("belongs_to_meridian").alias("relation_type"), F.lit(confidence).alias("confidence")))
    return out


EDGE = ["source_id", "target_id", "relation_type"]


def new_suggestions(found: DataFrame, pending: DataFrame, accepted: DataFrame) -> DataFrame:
    """Suggestions that are neither pending nor accepted already, once each."""
    return found.dropDuplicates(EDGE).join(pending.select(EDGE), EDGE, "left_anti").join(accepted.select(EDGE), EDGE, "left_anti")


def decide(suggestions: DataFrame, relations: DataFrame, accepted_ids: DataFrame, rejected_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suggestions with their new status, and relations with the accepted edges that were missing. Only pending rows move."""
    a, r = accepted_ids.select("id", F.lit("accepted").alias("to")), rejected_ids.select("id", F.lit("rejected").alias("to"))
    told = suggestions.join(a.unionByName(r).groupBy("id").agg(F.min("to").alias("to")), "id", "left")
    moved = told.withColumn("status", F.when((F.col("status") == "pending") & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("status")))
    fresh = told.where("status = 'pending' and to = 'accepted'").select(EDGE).distinct().join(relations.select(EDGE), EDGE, "left_anti")
    return moved.drop("to"), relations.unionByName(fresh, allowMissingColumns=True)


def suggestion_list(suggestions: DataFrame, items: DataFrame) -> DataFrame:
    """Suggestions with name and type of both ends, null where an item is gone; the surest first, ties by id."""
    def end(side):
        return items.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("type").alias(f"{side}_type"))

    return suggestions.join(end("source"), "source_id", "left").join(end("target"), "target_id", "left").orderBy(F.desc("confidence"), "id")


#: The detail columns whose texts speak for an item, by the detail table that holds them.
DETAIL_TEXTS = {"formula": ["composition", "indications"], "acupoint": ["indications", "functions"], "disease": ["symptoms", "common_syndromes", "care_advice", "notes"]}


def with_detail_text(items: DataFrame, details: dict[str, DataFrame]) -> DataFrame:
    """Items with ``text``: content, summary and the texts of their detail rows (``details[kind](item_id, ...)``), by spaces."""
    out, parts = items, ["content", "summary"]
    for kind, columns in DETAIL_TEXTS.items():
        if kind in details:
            names = [f"_{kind}_{c}" for c in columns]
            out = out.join(details[kind].select(F.col("item_id").alias("id"), *(F.col(c).alias(n) for c, n in zip(columns, names))), "id", "left")
            parts += names
    text = F.trim(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in parts)))
    return out.withColumn("text", text).drop(*(p for p in parts if p.startswith("_")))


def degrees(edges: DataFrame) -> DataFrame:
    """(item_id, relation_type, n) over both ends of every edge; a loop counts twice."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("item_id"), "relation_type")
    return ends.groupBy("item_id", "relation_type").agg(F.count("*").alias("n"))


def neighbours(edges: DataFrame, items: DataFrame, item_id) -> DataFrame:
    """One hop from an item, either way: direction, relation_type and the other item's columns."""
    out = edges.where(F.col("source_id") == item_id).select(F.col("target_id").alias("id"), "relation_type", F.lit("outgoing").alias("direction"))
    back = edges.where((F.col("target_id") == item_id) & (F.col("source_id") != item_id)).select(F.col("source_id").alias("id"), "relation_type", F.lit("incoming").alias("direction"))
    return out.unionByName(back).join(items, "id")


def in_list_order(rows: DataFrame) -> DataFrame:
    """Neighbours by relation type, type and name, in either case, ties by id."""
    return rows.orderBy(F.lower("relation_type"), F.lower("type"), F.lower("name"), "id")
