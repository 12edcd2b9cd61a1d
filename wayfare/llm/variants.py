"""Spelling variants: words that one inserted, deleted or replaced character turns into another.

No pair of words is made. Each word, with one character taken out at a position,
gives a prefix and a suffix. Words of one (position, prefix, suffix) group differ
in that character alone: the group's size and its two best words tell each member
how many it is near by a replacement, and which of them is best, itself left out.
What is left without the character is also looked up in the vocabulary: that
word and the ones it comes from are near by an insertion or a deletion. The
groups of one shortened string, whatever the position, lie in one partition, with
the vocabulary's own word of that spelling, so one exchange serves both.

Groups are small by nature: one character of the alphabet tells two members
apart, and there are 90 of them; a shortened string has at most that many words
for each place in which the character may stand. Nothing is capped.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import blocks, stored

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form is so many times as frequent as its variant, at least.
RATIO = 10
#: Of a document's distinct words, one in so many loses a character.
DAMAGE = 31
#: A run can lose a character, so one shorter than the least word never counts.
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
#: ASCII capitals to small letters; all others stay.
SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _read(doc_id: str, run: str) -> str:
    """What is read of a document's run: one in ``DAMAGE``, by CRC-32, loses a character."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, damaged: bool = False) -> DataFrame:
    """word and n of all words of ``docs`` with ``LEAST_LENGTH`` characters or more and ``LEAST_COUNT`` occurrences. Counted per block of texts before the exchange."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches):
            total: Counter[str] = Counter()
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                runs = Counter(RUN.findall(text.decode("utf-8", "replace").translate(SMALL)))
                if damaged:
                    for run, n in runs.items():
                        total[_read("" if doc_id is None else doc_id, run)] += n
                else:
                    total.update(runs)
            words = [w for w in total if len(w) >= LEAST_LENGTH]
            yield pa.record_batch([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])

    counted = docs.selectExpr("cast(doc_id as string) doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _better(n: str | Column, word: str | Column) -> Column:
    """Least for the most frequent word, of equally frequent ones for the first in the order of code points."""
    return F.struct((-F.col(n) if isinstance(n, str) else -n).alias("less"), (F.col(word) if isinstance(word, str) else word).alias("word"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near (how many words of ``vocabulary`` are near) and best (struct less, word: the most frequent of them, null if there is none)."""
    at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    cut = vocabulary.select("word", "n", at).withColumn("key", F.expr("concat(substring(word, 1, at - 1), substring(word, at + 1))"))
    # Of equal neighbours each leaves the same string; only the first of them counts as a deletion.
    first = (F.col("at") == 1) | (F.expr("substring(word, at, 1)") != F.expr("substring(word, at - 1, 1)"))
    # A shortened string that isn't the vocabulary's can still join replacements, so all are kept; position 0 is the vocabulary's own word.
    rows = cut.withColumn("deletes", first).unionByName(vocabulary.selectExpr("word", "n", "0 at", "word key", "false deletes")).repartition("key")
    group, order = Window.partitionBy("key", "at"), Window.partitionBy("key", "at").orderBy(F.desc("n"), "word")
    spelled = Window.partitionBy("key")
    me = _better("n", "word")
    rows = rows.withColumns({"size": F.count("*").over(group), "top": F.first(me).over(order), "next": F.lead(me).over(order)})
    rows = rows.withColumns({
        "base": F.min(F.when(F.col("at") == 0, me)).over(spelled),
        "longer": F.count(F.when(F.col("deletes"), 1)).over(spelled),
        "longest": F.min(F.when(F.col("deletes"), me)).over(spelled),
    })
    own, none = F.col("at") == 0, F.lit(None)
    replaced = F.when(own, none).when(F.col("top.word") == F.col("word"), F.col("next")).otherwise(F.col("top"))
    shorter = F.when(F.col("deletes"), F.col("base"))
    found = rows.select(
        "word", "n",
        F.when(own, F.col("longer")).otherwise(F.col("size") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).alias("near"),
        F.least(replaced, shorter, F.when(own, F.col("longest"))).alias("best"), own.alias("own"),
    )
    found = found.filter("own or near > 0")
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))


def spelling_variants(vocabulary: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of ``vocabulary`` (word and n, without repeats).

    form is the near word of the largest n, of equal ones the first in the order of
    code points, if that n is ``RATIO`` times the word's or more; else null, as is
    form_n. root is where forms lead to from the word, itself if it has no form. An
    empty vocabulary gives an empty result; other columns are not read.
    """
    near = stored(near_words(vocabulary.select("word", "n")))
    is_form = -F.col("best.less") >= RATIO * F.col("n")
    found = near.select("word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    # Each form is RATIO times as frequent, so paths are short; pointers double their reach at each step.
    jumps = stored(found.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = jumps.select(F.col("word").alias("at"), F.col("root").alias("next"))
        stepped = jumps.join(further, jumps["root"] == further["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = stored(stepped)
        moved = not stepped.filter("moved").isEmpty()
        jumps = stepped.select("word", "root")
        if not moved:
            break
    return found.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped_words(docs: DataFrame, damaged: bool = False) -> DataFrame:
    """``spelling_variants`` of the words of ``docs``: runs of Latin letters, ASCII capitals made small.

    A null or empty text has no words; repeated rows count each time; a null doc_id
    reads as an empty one; a very long text is read as a whole, in a block of its
    own; columns other than doc_id and text are not read. damaged: one in
    ``DAMAGE`` of a document's distinct runs loses a character, at all its
    occurrences there.
    """
    return spelling_variants(stored(word_counts(docs, damaged)))
