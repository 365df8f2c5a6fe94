"""Counts of words over a whole corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import map_arrow

#: Distinct words, and bytes of text read, after which a task passes its counts on.
HELD_WORDS, HELD_BYTES = 400_000, 256 << 20


def word_counts(read: DataFrame, words_of: Callable[[pa.RecordBatch], Iterator[tuple[str, int, list[bytes] | Mapping[bytes, int]]]], skip: tuple[bytes, ...] = ()) -> DataFrame:
    """``grp``, ``word``, ``n``: sums over all rows of ``read`` of what ``words_of`` yields per text: a group, bytes read, and words or counts of words.

    Tasks add up before the shuffle, so a frequent word is one row per task. Words are UTF-8; those in ``skip`` don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for group, own in held.items():
                for word in skip:
                    own.pop(word, None)
                words = pa.array(own.keys(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(own), pa.string()), words, pa.array(own.values(), pa.int64())], names=["grp", "word", "n"])
            held.clear()

        for b in batches:
            for group, read_bytes, words in words_of(b):
                held.setdefault(group, Counter()).update(words)
                size += read_bytes
                if size > HELD_BYTES or sum(map(len, held.values())) > HELD_WORDS:
                    yield from out()
                    size = 0
        yield from out()

    return map_arrow(read, run, "grp string, word string, n long").groupBy("grp", "word").agg(F.sum("n").alias("n"))
