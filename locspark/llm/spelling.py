"""Grouping of spelling variants by anagram hashing.

A word's anagram value is the sum of the fifth powers of its letters' code points, so words that differ by one letter
differ in value by that letter's power (one added or removed) or by the difference of two (one exchanged). These
differences needn't be tried one by one: a word has a row under its own value, and one under its value less each of its
letters. Words that differ by one addition or removal meet under the value of the shorter one, words that differ by one
exchange under what they have in common.

1. Words are counted over the corpus and numbered by falling frequency and code-point order in one sort over partitions, so
   that the smallest number is the best form, and all that follows works on integers.
2. Rows of equal value are joined, and the order of their letters is verified: by a hash of the letters that stay, and for an
   exchange by its place. A group holds no more words than one edit of one word makes, and its members learn their
   number and their best by sums and smallest values, never by pairs.
3. A word's form is the best of its near words if it is frequent enough. Forms are followed to the last by pointer
   doubling; as each is at least `ratio` times as frequent, chains are short.

Null and empty texts have no words. For a null id the text before the colon, of which a run's checksum is taken, is empty.
Repeated rows count each, ties go by code-point order. Texts of any length are read whole; a word of any length has as many
rows as letters. Other columns, of whatever name, are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from locspark.llm import common

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 97


def slipped(doc_id: Column, run: Column, one_in: int = SLIP) -> Column:
    """The run, of which one in so many (by the checksum of id and run) loses a letter, as a typist would."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = SLIP, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n) of the distinct words of all texts."""
    low = F.translate(F.col(text).cast("string"), UPPER, LOWER)
    runs = docs.select(F.col(key).cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(low, F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    found = runs.select(slipped(F.col("doc_id"), F.col("run"), one_in).alias("word")).filter(F.length("word") >= min_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def numbered(counts: DataFrame) -> DataFrame:
    """`counts` as a table with a column number, which rises with falling n, then rising words."""
    order = [F.desc("n"), F.asc("word")]
    return common.written(counts.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("number"), "word", "n"))


VALUES = "value long, rest long, place int, lead boolean, number long"
_VALUES = pa.schema([("value", pa.int64()), ("rest", pa.int64()), ("place", pa.int32()), ("lead", pa.bool_()), ("number", pa.int64())])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word the row of its own value (place -1), and one for each letter that can go.

    rest: a hash of the letters that stay, in order. lead: no equal letter stands before it, so that each shorter word has one.
    """
    for batch in batches:
        numbers, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        size = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.cumsum(size) - size
        which, place = np.repeat(np.arange(len(words)), size), np.arange(len(letters)) - np.repeat(first, size)
        power = letters**5
        total = np.add.reduceat(power, first) if len(words) else power
        up = common.powers(int(size.max(initial=0)) + 1)
        term = common.mix(letters) * up[place]
        sums = np.concatenate(([common.U64(0)], np.cumsum(term, dtype=np.uint64)))
        start, end = sums[first][which], sums[first + size][which]
        back = common.powers(2, True)[1]
        rest = sums[:-1] - start + (end - sums[1:]) * back
        whole = sums[first + size] - sums[first]
        lead = (place == 0) | (letters != np.concatenate((letters[:1], letters[:-1])))
        both = lambda a, b: pa.array(np.concatenate((a, b)).view(np.int64))
        yield pa.record_batch([
            both(total, total[which] - power), both(common.mix(whole + size.astype(np.uint64)), common.mix(rest + (size[which] - 1).astype(np.uint64))),
            pa.array(np.concatenate((np.full(len(words), -1), place)).astype(np.int32)), pa.array(np.concatenate((np.zeros(len(words), bool), lead))), both(numbers, numbers[which]),
        ], schema=_VALUES)


def near_words(words: DataFrame) -> DataFrame:
    """(number, n_near, best) of each word (number, word) with near ones: how many, and the smallest number among them."""
    rows = words.select("number", "word").mapInArrow(_values, VALUES)
    same, place = W.partitionBy("value", "rest"), W.partitionBy("value", "rest", "place").orderBy("number")
    whole, shorter = F.col("place") < 0, F.col("lead")
    met = rows.withColumns({
        "whole": F.max(F.when(whole, F.col("number"))).over(same), "n_longer": F.count_if(shorter).over(same), "longer": F.min(F.when(shorter, F.col("number"))).over(same),
        "n_alike": F.count("*").over(place.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "least": F.first("number").over(place.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "next": F.lead("number").over(place),
    })
    removed = shorter & F.col("whole").isNotNull()
    n = F.when(whole, F.col("n_longer")).otherwise(F.col("n_alike") - 1 + removed.cast("long"))
    alike = F.when(F.col("least") == F.col("number"), F.col("next")).otherwise(F.col("least"))
    best = F.when(whole, F.col("longer")).otherwise(F.least(alike, F.when(removed, F.col("whole"))))
    return met.select("number", n.alias("n"), best.alias("best")).filter("n > 0").groupBy("number").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(number, root) for (number, form): where the chain of forms ends, in as many rounds as the logarithm of its length."""
    state = common.written(forms.select("number", F.col("form").alias("root")))
    while True:
        on = state.select(F.col("number").alias("root"), F.col("root").alias("further"))
        new = common.written(state.join(on, "root", "left").select("number", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        state = new.select("number", "root")
        if new.filter("moved").isEmpty():
            return state


def group_spellings(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = SLIP, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of at least `min_length` letters that occurs `min_count` times or more.

    form: its most frequent near word, if that is at least `ratio` times as frequent; root: the last word along forms.
    """
    words = numbered(word_counts(docs, key, text, one_in, min_length, min_count))
    near = common.written(near_words(words))
    target = words.select(F.col("number").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    forms = common.written(near.join(words.select("number", "n"), "number").join(target, "best").filter(F.col("form_n") >= ratio * F.col("n")).select("number", F.col("best"), "form", "form_n"))
    roots = last_forms(forms.select("number", F.col("best").alias("form")))
    named = roots.join(words.select(F.col("number").alias("root"), F.col("word").alias("root_word")), "root").select("number", "root_word")
    out = words.join(near.select("number", "n_near"), "number", "left").join(forms.drop("best"), "number", "left").join(named, "number", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
