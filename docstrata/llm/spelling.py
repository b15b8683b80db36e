"""Spelling variants: words that differ by one letter, found with PartEnum signatures.

A word's letters with their counts are a set of (letter, copy), that is a binary vector. Words that differ by one
inserted, deleted or replaced letter have vectors at a Hamming distance of two at most. PartEnum: the dimensions
are hashed into PARTS; a distance of two touches two parts at most, so such vectors agree on all others of
some PARTS - 2 parts. A signature is a choice of PARTS - 2 parts with the letters that a word has in them: near words share
one exactly, so candidates come from an equi-join of signatures, and a join on edit distance verifies them.

A signature that many words have is split by half words: the one letter that differs lies behind the first or before
the second half, so near words also agree on one of these, taken at the length of the shorter word.
Signatures carry the length of words, and a word looks among its own length and the next.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, cut, discard

#: Letters of a run.
RUN = r"[A-Za-zÀ-ÿ]+"
#: Parts of the dimensions; two of them are left out in each signature. More parts: longer, rarer signatures, and more of them.
PARTS = 7
CHOICES = list(combinations(range(PARTS), PARTS - 2))
#: Words with one signature that meet as they are; beyond, the signature is split by half words.
CROWD = 64


def corrupted(run: Column, doc_id: Column, every: int = 97) -> Column:
    """run without one letter where the CRC-32 of doc_id:run is a multiple of every; without a doc_id, run."""
    h = F.crc32(F.concat_ws(":", doc_id.cast("string"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(doc_id.isNotNull() & (F.pmod(h, F.lit(every)) == 0), less).otherwise(run)


def count_words(docs: DataFrame, min_letters: int = 5, min_count: int = 3, every: int = 97) -> DataFrame:
    """word, n of the words of docs (doc_id, text) with at least so many letters and occurrences."""
    low = ascii_lower(F.coalesce("text", F.lit("")))
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    # a run that is two letters short or more gives no word
    words = runs.where(F.length("run") >= min_letters).select(corrupted(F.col("run"), F.col("doc_id"), every).alias("word"))
    return words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signatures(word: Column) -> Column:
    """array<bigint>: a hash for each choice of parts, of the letters (with their copies) in these parts."""

    def hashed(letters: Column) -> Column:
        copy = lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c)).cast("string"))
        return F.transform(F.transform(letters, copy), lambda e: F.struct(F.pmod(F.xxhash64(F.lit("part"), e), F.lit(PARTS)).alias("part"), F.xxhash64(e).alias("h")))

    def held(elements: Column) -> Column:  # of each part, a hash of the letters in it, in any order
        return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.aggregate(elements, F.lit(0).cast("long"), lambda s, e: s.bitwiseXOR(F.when(e["part"] == p, e["h"]).otherwise(0))))

    def choices(parts: Column) -> Column:
        return F.array(*[F.xxhash64(F.lit(k), *[F.get(parts, F.lit(p)) for p in own]) for k, own in enumerate(CHOICES)])

    return _let(F.split(word, ""), lambda letters: _let(hashed(letters), lambda elements: _let(held(elements), choices)))


def halves(word: Column) -> Column:
    """array<string>: the first and the last half of word, at its own length and at that of a word shorter by one."""
    n = F.length(word)
    sizes = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")))
    return F.flatten(F.transform(sizes, lambda k: F.array(F.concat(F.lit("^"), F.substring(word, F.lit(1), k)), F.concat(F.substring(word, n - k + 1, k), F.lit("$")))))


def near_words(words: DataFrame) -> DataFrame:
    """a, b: every pair of words (word) that differ by one letter, each in both orders."""
    signed = words.select("word", F.length("word").alias("size"), F.explode(signatures(F.col("word"))).alias("sig"))
    # pairs of one length meet under it, of two lengths under the longer one
    under = cut(signed.select("word", "sig", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("under")))
    crowds = under.groupBy("sig", "under").agg(F.count("*").alias("n")).where("n > 1")
    held = under.join(crowds.hint("merge"), ["sig", "under"])
    keyed = cut(held.select("word", "sig", "under", F.explode(F.when(F.col("n") > CROWD, halves(F.col("word"))).otherwise(F.array(F.lit("")))).alias("half")))
    other = keyed.withColumnRenamed("word", "b")
    both = keyed.withColumnRenamed("word", "a").join(other.hint("merge"), ["sig", "under", "half"])
    longer = F.greatest(F.length("a"), F.length("b")) == F.col("under")
    pairs = both.where((F.col("a") < F.col("b")) & longer & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()
    once = cut(pairs)
    discard(under, keyed)
    return once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): forms are followed to the last, which has none. Each round doubles the steps."""
    state = cut(forms.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNotNull().alias("moved")))
    while not state.where("moved").isEmpty():
        of = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(state.join(of.hint("merge"), "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        discard(state)
        state = after
    return state.drop("moved")


def spelling_forms(docs: DataFrame, min_letters: int = 5, min_count: int = 3, factor: int = 2, every: int = 97) -> DataFrame:
    """One row per word of docs (doc_id, text): word, n, n_near, form, form_n, root.

    Words are runs of letters, A-Z in lower case, of which some lose a letter (see corrupted); those of at least
    min_letters letters and min_count occurrences in all texts count. n_near is the number of words that differ by
    one inserted, deleted or replaced letter; form the one of them with the largest n (of equals the first in
    code-point order) if that is at least factor times the word's own, else null; root is where forms end, the word itself
    if it has none. Null and empty texts have no words; repeated rows count again; an empty table gives an empty result;
    other columns are ignored."""
    words = cut(count_words(docs, min_letters, min_count, every))
    pairs = near_words(words)
    weighed = pairs.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")).hint("merge"), "b")
    best = weighed.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("b").alias("form"))).alias("best"))
    joined = words.join(best.withColumnRenamed("a", "word").hint("merge"), "word", "left")
    well = -F.col("best.less") >= factor * F.col("n")
    forms = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(well, F.col("best.form")).alias("form"), F.when(well, -F.col("best.less")).alias("form_n")))
    return forms.join(roots(forms).hint("merge"), "word").select("word", "form", "root", "n", "n_near", "form_n")
