"""Spelling variants by PartEnum signatures: words one inserted, deleted or replaced letter apart, and their likely forms.

A word is the multiset of its letters, told as a binary vector: one dimension for each letter and each of its occurrences
(the second ``e`` is a dimension of its own). One edit changes at most two dimensions, so near words have vectors at a Hamming
distance of at most two. The dimensions are partitioned by hash into ``PARTS`` parts; two vectors at most two apart agree on
all but at most two parts, so for every choice of two parts left out a signature of the others is enumerated, and near words
share at least one. As one edit changes two dimensions of words of equal length and one otherwise, signatures are told with
the length, and across lengths leave one part out. Signatures are met by an equi-join, and the join's condition verifies the words themselves, so that no
pair leaves it but the near ones. Nothing is lost: the signatures are exact and no bucket is capped.

All steps are DataFrame expressions. A word's near words are bounded by its length and the alphabet, so no word is a hot key of
the forms; counting is by partial sums. No join here is by a broadcast: Spark takes exploded signatures to be as few bytes as the
words' compressed file, and words for no more than that file, and would send them through the driver.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import stored, text_column

#: Parts of the dimensions; signatures leave out two of them.
PARTS = 6
DISTANCE = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, *, every: int = 97, least_length: int = 5) -> DataFrame:
    """(word) of each letter run of the texts that has ``least_length`` code points once it is spelled: in a run whose crc32
    with the document's id ``every`` divides, the code point at that number modulo the run's length is left out."""
    runs = F.regexp_extract_all(F.translate(text_column(), UPPER, LOWER), F.lit("([a-zÀ-ÿ]+)"), 1)
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    each = each.where(F.length("run") >= least_length)  # a shorter run gives no longer word
    h = F.crc32(F.concat("doc", F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return each.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= least_length)


def vocabulary(docs: DataFrame, *, least: int = 3, least_length: int = 5, every: int = 97) -> DataFrame:
    """(word, n) of the words met at least ``least`` times."""
    return occurrences(docs, every=every, least_length=least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def dimensions(word: str) -> Column:
    """A hash for each dimension of the word's vector: a letter and which of its occurrences it is."""
    letters = F.array_sort(F.split(word, ""))
    # in sorted order the occurrences of a letter stand together, from its first place on
    return F.transform(letters, lambda c, i: F.xxhash64(c, i - F.array_position(letters, c).cast("int")))


def part_hash(hashes: str, j: int) -> Column:
    """The XOR of the dimensions in part j."""
    return F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(PARTS)) == j), F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(h))


def signatures(words: DataFrame) -> DataFrame:
    """(signature, word): near words of equal length are two dimensions apart and share a signature that leaves two parts out;
    those whose lengths differ by one are one dimension apart and share one that leaves one part out, told with the lesser of
    the two lengths by either word."""
    told = words.withColumn("hashes", dimensions("word")).withColumn("parts", F.array(*(part_hash("hashes", j) for j in range(PARTS))))

    def without(n: int, tag: Column) -> list[Column]:
        kept = [[j for j in range(PARTS) if j not in out] for out in combinations(range(PARTS), n)]
        return [F.xxhash64(F.lit(n), F.lit(k), tag, *(F.get("parts", F.lit(j)) for j in keep)) for k, keep in enumerate(kept)]

    size = F.length("word")
    every = F.array(*without(DISTANCE, size), *without(1, size), *without(1, size - 1))
    return told.select(F.explode(every).alias("signature"), "word")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of the words that are exactly one edit apart, each pair once, a before b."""
    signed = signatures(words)  # one exchange serves both sides of the join
    met = (F.col("l.word") < F.col("r.word")) & (F.levenshtein("l.word", "r.word", 1) == 1)
    pairs = signed.alias("l").hint("merge").join(signed.alias("r"), (F.col("l.signature") == F.col("r.signature")) & met)
    return pairs.select(F.col("l.word").alias("a"), F.col("r.word").alias("b")).distinct()


def forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): the number of near words, and the commonest of them where it is twice as common as the
    word (ties: the first in code-point order)."""
    pairs = stored(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    both = both.hint("merge").join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    told = words.hint("merge").join(best, "word", "left")
    is_form = -F.col("best.m") >= 2 * F.col("n")
    return told.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"),
    )


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the last of the chain of forms. Each form is at least twice as common as
    its word, so chains end; every round doubles the way known."""
    now = stored(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = now.hint("merge").join(on, "root", "left")
        if further.where("next is not null").isEmpty():
            return now
        now = stored(further.select("word", F.coalesce("next", "root").alias("root")), "roots")


def group_variants(docs: DataFrame, *, least: int = 3, least_length: int = 5, every: int = 97) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of ``docs(doc_id, text)``.

    Null and empty texts have no words; a null doc_id reads as empty; repeated rows count each; texts are read whole; an empty
    table gives no rows; other columns are ignored. Ties between forms go to the first in code-point order.
    """
    words = stored(vocabulary(docs, least=least, least_length=least_length, every=every), "words")
    formed = stored(forms(words), "forms")
    return formed.hint("merge").join(roots(formed), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
