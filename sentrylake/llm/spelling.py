"""Spelling variants: words one edit apart, by a rare-first prefix filter over positional bigrams.

One inserted, deleted or replaced letter destroys at most two of a word's bigrams, and those that are left keep their
order and move by one place at most. Bigrams are ordered by how many words hold them, over all words; whichever is the
first in that order of those that two near words share is then among the three rarest of both. So each word is posted
under its three rarest bigrams with their places, and near words meet in a list.

Places say more than that they differ by one at most: the edit lies on one side of the shared bigram, so the words agree
on all of the other side, and on one half of the edited side. Both are part of a list's key, with the length of the
shorter word. No pair is lost by it, and a list holds words that differ in a few letters only, at any size of the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import dropped, small_batches, stored

#: What a word is made of, and the least length of those that are compared.
LETTERS = "A-Za-zÀ-ÿ"
LEAST = 7
#: Words that a task counts before it hands them on.
HELD = 1 << 17
#: Letters of the longest words that are compared by Spark's function, whose time grows with the square of the length;
#: candidates of longer words are compared by halving.
LONG = 255
#: A word of count n takes a near word of at least so many times n as its form.
TIMES = 10


def _misspelt(word: str, h: int, every: int) -> str:
    """The word without one letter, where the hash says so."""
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counter(least: int, every: int | None):
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def out(held: Counter):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            texts = pc.ascii_lower(b.column(1).cast(pa.large_string()))
            for doc, text in zip(b.column(0).to_pylist(), texts):
                found = Counter(runs.findall(text.as_py() or ""))
                if every is None:
                    held.update(found)
                else:
                    seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in found.items():
                        word = _misspelt(word, zlib.crc32(word.encode(), seed), every)
                        if len(word) >= least:
                            held[word] += n
                if len(held) > HELD:
                    yield out(held)
                    held = Counter()
        if held:
            yield out(held)

    return run


def word_counts(docs: DataFrame, least: int = LEAST, every: int | None = None, most_rare: int = 2) -> DataFrame:
    """(word, n): words of at least `least` letters that occur `most_rare` times or more in the texts of docs(doc_id,
    text), whole, with A-Z in lower case. With `every`, occurrences whose hash of document and word it divides lose a
    letter first, as a planted misspelling."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    counted = texts.mapInArrow(_counter(least, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= most_rare)


def _halves(rest: str, wider: int) -> tuple[str, str]:
    """What an edit of this side leaves of it: the first half, or the second. A longer word (`wider` 1) has one letter
    more, which is left out between the two."""
    at = (len(rest) - wider) // 2
    return rest[:at], rest[at + wider :]


def posts_of(word: str, rank: dict[str, int]) -> list[tuple[str, int]]:
    """(key, role) of a word's three rarest bigrams: role 0 as the shorter or equally long one of a pair, 1 as the longer."""
    grams = sorted((rank[word[i : i + 2]], i) for i in range(len(word) - 1))[:3]
    out = []
    for _, i in grams:
        left, right = word[: i + 2], word[i:]
        before, after = word[:i], word[i + 2 :]
        for role in (0, 1):
            n = len(word) - role
            if len(after) >= role:
                out += [(f"L{h} {i} {n} {left} {part}", role) for h, part in enumerate(_halves(after, role))]
            if len(before) >= role:
                out += [(f"R{h} {i - role} {n} {right} {part}", role) for h, part in enumerate(_halves(before, role))]
    return out


def _poster(rank: dict[str, int]):
    def out(rows):
        keys, roles, words = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(roles, pa.int8()), pa.array(words, pa.string())], ["key", "role", "word"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for word in b.column(0).to_pylist():
                posts = posts_of(word, rank)
                held += [(xxhash.xxh64_intdigest(key) - (1 << 63), role, word) for key, role in posts]
                size += len(posts) * len(word)
                if size > 1 << 21:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return run


def _grams(batches):
    held: Counter = Counter()
    for b in batches:
        for word in b.column(0).to_pylist():
            held.update({word[i : i + 2] for i in range(len(word) - 1)})
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Places of bigrams in the order of how many words hold them, then of the bigram. There are at most as many as pairs
    of the 90 lower-case and accented letters."""
    found = words.mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r.gram: i for i, r in enumerate(sorted(found, key=lambda r: (r.n, r.gram)))}


def _one_edit(a: str, b: str) -> bool:
    """Whether b, of a's length or one letter longer, is one edit from a."""
    low, high = 0, len(a)  # how long a prefix they share
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a != b and a[low + (len(a) == len(b)) :] == b[low + 1 :]


def _checked(batches):
    """Pairs without those of long words that are not near."""
    for b in batches:
        keep = [len(x) <= LONG and len(y) <= LONG or _one_edit(*sorted((x, y), key=len)) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield b.filter(pa.array(keep, pa.bool_()))


def near_words(words: DataFrame) -> DataFrame:
    """(word, other): pairs of words(word) that differ by exactly one inserted, deleted or replaced letter, each once,
    the smaller word first. Words of fewer than four letters, which may hold fewer than three bigrams, are not compared."""
    words = words.select("word").where(F.length("word") > 3)
    posts = words.mapInArrow(_poster(gram_ranks(words)), "key long, role byte, word string")
    a, b = posts.alias("a"), posts.alias("b")
    # conditions on both sides only, so that one exchange serves both
    meet = (F.col("a.key") == F.col("b.key")) & ((F.col("a.role") < F.col("b.role")) | ((F.col("a.role") + F.col("b.role") == 0) & (F.col("a.word") < F.col("b.word"))))
    short = F.greatest(F.length("a.word"), F.length("b.word")) <= LONG
    found = a.join(b.hint("merge"), meet).where(F.when(short, F.levenshtein("a.word", "b.word", 1)).otherwise(1) == 1)
    pairs = found.select(F.least("a.word", "b.word").alias("word"), F.greatest("a.word", "b.word").alias("other")).distinct()
    return pairs.mapInArrow(_checked, "word string, other string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms(word, form) followed to the last, by doubling. Counts grow tenfold a step, so that a chain is
    short, and the rounds few."""
    spark = forms.sparkSession
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = spark.read.parquet(new._stored_at).where("moved").limit(1).count()
        dropped(now)
        now = new
        if not moved:
            return now.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST, every: int | None = None, times: int = TIMES) -> DataFrame:
    """One row per word of at least `least` letters and two occurrences: word, n, n_near (number of words one edit away),
    form (the near word of largest n, ties to the smallest in code-point order, if that n is at least `times` the word's),
    form_n, root (forms followed to the last; the word itself without one).

    Null texts have no words; a null doc_id is named by nothing in the hash; repeated rows count each for itself; other
    columns are ignored; an empty table gives no rows.
    """
    words = stored(word_counts(docs, least, every), "words")
    pairs = stored(near_words(words), "near")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    near = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    strong = F.col("best.less") <= -times * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    found = stored(found, "forms")
    dropped(pairs)
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
