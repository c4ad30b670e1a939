"""Spelling variants of a corpus's words, from sorted dictionaries read forwards and backwards.

One edit leaves one half of a word as it was: two near words share their first half, and lie in one block
of the dictionary sorted forwards, or their last half, and lie in one block of the dictionary sorted
backwards. Blocks are joined by sort and merge, and each pair of a block is verified in the join itself, so
only near pairs come out. A block with too many words is subdivided: what is left between the shared
beginning and the shared end is halved again, until at most one character is left.

Every pair has one block: of two words whose shorter has m characters the key says m, how many characters
they share at the beginning and the end, and where they must differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut, drop, small_text, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One in so many words of a document loses a character.
SLIP = 199
#: Words of a block that are compared with each other; larger blocks are subdivided.
BLOCK = 64


def slipped(doc_id: Column, word: Column) -> Column:
    """word, or where SLIP divides crc32("doc_id:word") word without its character number crc32 % length (from 0)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % SLIP == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: bool = True, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters, only A-Z lower-cased, with their number over all texts. Counts are combined before they shuffle."""
    lower = F.translate(text_or_empty(text_col), UPPER, LOWER)
    runs = docs.select(F.col(id_col).alias("id_"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("word")).where(F.length("word") >= least_length)
    word = slipped(F.col("id_"), F.col("word")) if slips else F.col("word")
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _halves(words: DataFrame) -> DataFrame:
    """(word, n, m, i, j, differ, key): the blocks of the two dictionaries.

    i, j: characters shared at the beginning and the end; differ: so many first characters aren't all shared (0: no
    matter). A word is in blocks of its own length and of the length one less, where it is the longer one.
    """
    length = F.length("word")
    sided = words.withColumn("m", F.explode(F.array(length, length - 1))).withColumn("half", F.floor(F.col("m") / 2).cast("int"))
    forwards = sided.select("word", "n", "m", F.col("half").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("differ"))
    backwards = sided.select("word", "n", "m", F.lit(0).alias("i"), (F.col("m") - F.col("half")).alias("j"), F.col("half").alias("differ"))
    return keyed(forwards.unionAll(backwards))


def keyed(blocks: DataFrame) -> DataFrame:
    """With key: the shared beginning and end, as the sort order of the dictionary read forwards and backwards."""
    key = F.concat(F.left("word", F.col("i")), F.lit("|"), F.left(F.reverse("word"), F.col("j")))
    return blocks.select("word", "n", "m", "i", "j", "differ", key.alias("key"))


def subdivided(blocks: DataFrame) -> DataFrame:
    """Each block in two: what lies between beginning and end keeps its first half, or loses it and keeps the last."""
    between = F.col("m") - F.col("i") - F.col("j")
    half = F.ceil(between / 2).cast("int")
    first = F.struct((F.col("i") + half).alias("i"), F.col("j").alias("j"), F.col("differ").alias("differ"))
    last = F.struct(F.col("i").alias("i"), (F.col("j") + between - half).alias("j"), (F.col("i") + half).alias("differ"))
    return keyed(blocks.withColumn("part", F.explode(F.array(first, last))).select("word", "n", "m", "part.i", "part.j", "part.differ"))


PLACE = ("m", "i", "j", "differ", "key")


def _verified(blocks: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): near pairs inside blocks, each once: a is the shorter or the earlier word."""
    a = blocks.where(F.length("word") == F.col("m")).select(*PLACE, F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = blocks.select(*PLACE, F.col("word").alias("b"), F.col("n").alias("b_n"))
    differ = (F.col("differ") == 0) | (F.left("a", F.col("differ")) != F.left("b", F.col("differ")))
    longer = F.length("b") > F.length("a")
    near = F.levenshtein("a", "b", 1) == 1
    return a.join(b, list(PLACE)).where((longer | (F.col("a") < F.col("b"))) & differ & near).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, a_n, b, b_n) of words (word, n): every pair that differs by one inserted, deleted or replaced character, once.

    Work: each word meets at most `block` others in a block, and a word has two blocks for each halving; only a
    block that can't be subdivided (one character left) may have more, at most one for each word that fits it.
    """
    out, todo, old = None, _halves(words), None
    while todo is not None:
        todo = cut(todo)
        if old is not None:
            drop(old)
        full = todo.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("rows_")).where((F.col("rows_") > block) & (F.col("m") - F.col("i") - F.col("j") > 1)).drop("rows_")
        full = cut(full)
        if full.isEmpty():
            drop(full)
            found, old, todo = _verified(todo), None, None
        else:
            full = small_text(full, "key")
            old = todo
            found, todo = cut(_verified(old.join(full, list(PLACE), "left_anti"))), subdivided(old.join(full, list(PLACE), "left_semi"))
        out = found if out is None else out.unionAll(found)
    return out


def variants(words: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """(word, n, form, form_n, n_near) of words (word, n).

    form: of its near words the one of largest n (ties: smallest in code-point order), if that is at least `times` the word's n.
    """
    pairs = near_pairs(words, block)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), (-F.col("b_n")).alias("least"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), (-F.col("a_n")).alias("least"), F.col("a").alias("near")))).alias("p"))
    best = both.select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("least", "near")).alias("best"))
    taken = -F.col("best.least") >= F.col("n") * times
    return words.join(best, "word", "left").select("word", "n", F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.least")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def roots(found: DataFrame) -> DataFrame:
    """found with root: the last word that is reached from form to form, the word itself without one.

    Pointers are doubled: a chain of k forms takes log2(k) joins; each form is `times` as frequent, so there are no circles.
    """
    at = cut(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        to = small_text(at.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "further")
        new = cut(at.join(to, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = not new.where("moved").isEmpty()
        drop(at)
        at = new
        if not moved:
            break
        at = new.drop("moved")
        at.cut_path = new.cut_path
    return found.join(small_text(at.select("word", "root"), "word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: bool = True, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """Per word of at least `least_count` occurrences and `least_length` characters: word, form, root, n, n_near, form_n.

    slips: one in 199 (document, word) loses a character first. A null or empty text has no words, a null id counts as
    empty, rows that repeat an id count each, a text of any length is read whole; an empty table gives an
    empty one; other columns, whatever their names, are ignored.
    """
    words = cut(dictionary(docs, id_col, text_col, slips, least_length, least_count))
    found = cut(variants(words, times, block))
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")
