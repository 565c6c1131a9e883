"""Problem 8: evaluation texts leaking into training text, by Wu-Manber multi-pattern search over words.

The patterns are all runs of ``RUN`` words of the items. As in the method, a table of blocks (here ``BLOCK``
words) says how far the search may jump when a block ends no pattern, a second table finds the patterns that
end with a block, and those are compared directly. The items of one pass are broadcast, up to a number of
words, and each worker process builds their tables once; more items are searched in further passes, each over
all documents.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a case.
RUN = 12
#: Words of a block of the shift table.
BLOCK = 3
#: Item words whose tables one pass holds (about 200 bytes each in a task).
PASS_WORDS = 1_000_000

_WORD = re.compile(r"[A-Za-z0-9]+")


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class WuManber:
    """Patterns of ``run`` words; ``search`` gives the ids of the items that own a pattern in the text."""

    def __init__(self, items: Iterable[tuple[int, str]], run: int = RUN, block: int = BLOCK) -> None:
        self.run, self.block = run, min(block, run)
        owners: dict[tuple, set[int]] = defaultdict(set)
        for ident, text in items:
            w = words(text)
            for i in range(len(w) - run + 1):
                owners[tuple(w[i : i + run])].add(ident)
        #: block of words -> how many words the end of the window may move
        self.shift: dict[tuple, int] = {}
        self.longest = run - self.block + 1
        #: block that ends patterns -> those patterns and their owners
        self.suffixes: dict[tuple, list[tuple[tuple, frozenset[int]]]] = defaultdict(list)
        for pattern, who in owners.items():
            for end in range(self.block, run + 1):
                b = pattern[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.longest), run - end)
            self.suffixes[pattern[-self.block :]].append((pattern, frozenset(who)))

    def search(self, text: str) -> set[int]:
        w = words(text)
        found: set[int] = set()
        shift, run, block, longest = self.shift, self.run, self.block, self.longest
        end, n = run, len(w)
        while end <= n:
            b = tuple(w[end - block : end])
            jump = shift.get(b, longest)
            if jump:
                end += jump
                continue
            window = tuple(w[end - run : end])
            for pattern, who in self.suffixes[b]:
                if pattern == window:
                    found |= who
            end += 1
        return found


def leaks(documents: DataFrame, eval_items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id) of each document that holds at least ``run`` consecutive words of the item.

    Words are maximal runs of ASCII letters and digits, compared without case. Null and empty texts and items
    with fewer words give no rows; a document listed twice is reported once.
    """
    context, out = documents.sparkSession.sparkContext, None
    for part in _passes(eval_items):
        sent = context.broadcast(part)
        found = documents.select("doc_id", "text").mapInArrow(_task(sent, uuid.uuid4().hex, run), "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = documents.select("doc_id", F.lit(None).cast("long").alias("item_id")).filter(F.lit(False))
    return out.distinct()


def _passes(eval_items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``PASS_WORDS`` words (one long item may be a block of its own); the driver holds one at a time."""
    block, n = [], 0
    for ident, text in eval_items.filter("text is not null").select("item_id", "text").toLocalIterator():
        k = len(_WORD.findall(text))
        if block and n + k > PASS_WORDS:
            yield block
            block, n = [], 0
        block.append((ident, text))
        n += k
    if block:
        yield block


#: The tables that this worker process built last, under the name of their pass.
_built: dict[str, WuManber] = {}


def _tables(sent, name: str, run: int) -> WuManber:
    if name not in _built:
        _built.clear()
        _built[name] = WuManber(sent.value, run)
    return _built[name]


def _task(sent, name: str, run: int):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(sent, name, run)
        for batch in batches:
            docs, found = [], []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):  # one text at a time
                if s := text.as_py():
                    for item in tables.search(s):
                        docs.append(doc.as_py())
                        found.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "item_id"])

    return search


def leaked_items(documents: DataFrame, eval_items: DataFrame, run: int = RUN) -> DataFrame:
    """(item_id, suite, documents): how many documents hold each item, 0 for those that did not leak."""
    counts = leaks(documents, eval_items, run).groupBy("item_id").agg(F.count("*").alias("documents"))
    return eval_items.select("item_id", "suite").join(counts, "item_id", "left").fillna(0, ["documents"])
