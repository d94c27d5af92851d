"""Spelling variants of words through pairs of trie nodes.

Words are counted over all texts. Every prefix of a word is a node of the
forward trie, every suffix a node of the reversed one; the nodes are numbered.
A word then has one integer pair (prefix node, suffix node) for each position
that is skipped, and one for each gap where a letter may go in. Two words
differ by a replaced letter when they share a skipped pair, and by an inserted
one when the skipped pair of the longer is a gap pair of the shorter: equal
pairs are exact neighbours, nothing is left to verify.

Words that share a pair differ in one letter, so a pair holds at most as many
words as the alphabet has letters (90 here) and one more: no group grows with
the data, and each is met in one small array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, pattern: str = RUN) -> DataFrame:
    """(doc_id, run): every maximal run of letters of the whole texts, A-Z lower-cased."""
    text = F.translate("text", UPPER, LOWER)
    return pick(docs, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("run"))


def with_slips(words: DataFrame, one_in: int) -> DataFrame:
    """(word) of (doc_id, run): where ``one_in`` divides h, the crc32 of ``<doc_id>:<run>``, the letter at h % length is gone.

    A null doc_id counts as an empty one.
    """
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    gone = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return words.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, gone).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    long = words.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _numbered(strings: DataFrame, name: str) -> DataFrame:
    """(``name``, id): a number for each distinct string; stored, so that it stays the same."""
    return cut(strings.select(name).distinct().withColumn(f"{name}_id", F.monotonically_increasing_id()))


def pairs(vocab: DataFrame) -> DataFrame:
    """(p, s, gap, once, word, n): the integer pairs of every word of ``vocab`` (word, n).

    ``gap``: the letter between prefix and suffix is one to go in, not one that is skipped.
    ``once``: of a run of equal letters, whose skipping gives one and the same word, the first.
    """
    length = F.length("word")
    cuts = vocab.select("word", "n", F.explode(F.sequence(F.lit(0), length)).alias("i"))
    head, tail = F.substr("word", F.lit(1), F.col("i")), F.substr("word", F.col("i") + 1)
    cuts = cuts.select("word", "n", "i", head.alias("head"), tail.alias("tail"))
    heads, tails = _numbered(cuts, "head"), _numbered(cuts, "tail")
    # the word's own nodes, by position: prefix before i, suffix from i on
    nodes = cut(cuts.join(heads, "head").join(tails, "tail").select("word", "n", "i", F.col("head_id").alias("p"), F.col("tail_id").alias("s")))
    gaps = nodes.select("p", "s", F.lit(True).alias("gap"), F.lit(False).alias("once"), "word", "n")
    # the suffix after a skipped letter is the one from the next position on
    after = nodes.select("word", (F.col("i") - 1).alias("i"), F.col("s").alias("next"))
    at = F.col("i") + 1
    once = (F.col("i") == 0) | (F.substr("word", at, F.lit(1)) != F.substr("word", F.col("i"), F.lit(1)))
    skips = nodes.drop("s").join(after, ["word", "i"]).select("p", F.col("next").alias("s"), F.lit(False).alias("gap"), once.alias("once"), "word", "n")
    return gaps.union(skips)


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): how many near words a word of ``vocab`` has, and the most frequent of them
    (ties: the smallest in code-point order). Words without near words are left out."""
    met = pairs(vocab).groupBy("p", "s").agg(F.collect_list(F.struct((-F.col("n")).alias("m"), "word", "gap", "once")).alias("all"))
    met = met.where(F.size("all") > 1)             # at most 91 words each

    def near(x, y):
        # both skip: another letter; one skips what the other lacks: counted once for a run of equal letters
        return ((~x["gap"] & ~y["gap"]) | (x["gap"] & y["once"]) | (y["gap"] & x["once"])) & (x["word"] != y["word"])

    each = met.select("all", F.explode("all").alias("x")).select(
        F.col("x.word").alias("word"), F.filter("all", lambda y: near(F.col("x"), y)).alias("others")).where(F.size("others") > 0)
    best = F.array_min(F.transform("others", lambda y: F.struct(y["m"].alias("m"), y["word"].alias("word"))))
    found = each.select("word", F.size("others").alias("k"), best.alias("best"))
    found = found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.m")).alias("near_n"))


def roots(forms: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(word, root) of (word, form): follows the forms to the last.

    Pointer doubling: a round doubles the way, and a way has at most as many steps as the count of a word can double.
    """
    at = cut(forms.select("word", F.coalesce("form", "word").alias("root")))
    for _ in range(most_rounds):
        on = at.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not on.limit(1).count():
            return at
        new = cut(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.drop("moved")
        at = new.drop("moved")
    raise RuntimeError(f"forms did not end within {most_rounds} doublings")


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, one_in: int | None = None) -> DataFrame:
    """One row per word of the texts: word, form, root, n, n_near, form_n.

    A word's ``form`` is its most frequent near word (one letter inserted, deleted or replaced), where that
    is at least ``ratio`` times as frequent; ``root`` the end of the chain of forms. ``one_in`` makes slips
    (see ``with_slips``). Null and empty texts and texts without letters add nothing; repeated rows count as
    often as they occur; very long texts and words are taken whole; an empty table gives an empty result.
    """
    found = runs(docs)
    words = with_slips(found, one_in) if one_in else found.select(F.col("run").alias("word"))
    vocab = cut(vocabulary(words, least_length, least_count))
    near = near_words(vocab)
    is_form = F.col("near_n") >= ratio * F.col("n")
    own = cut(vocab.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near_n")).alias("form_n")))
    return own.join(roots(own), "word").select("word", "form", "root", "n", "n_near", "form_n")
