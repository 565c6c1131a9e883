"""Problem 10: long exact spans shared between records, over a compacted de Bruijn graph.

Tokens are code points. Of all k-mers only those are nodes whose smallest inner s-mer lies at either end
(closed syncmers): whether a k-mer is one depends on itself alone, and every run of ``k - s`` k-mers holds
one. So two texts with a common span have the same nodes at the same distances inside it, and a span of
``length`` holds two that follow each other. Edges are consecutive nodes of a text with their distance.

One aggregation gives for every node how many documents have it and whether more than one edge enters or
leaves it. Nodes of one document are joined away. Between nodes that fork, the path of a text branches nowhere:
every text that has one step of it has all. So only windows of ``length`` characters around forking nodes are
hashed, and they tell exactly where spans begin and end: at windows with different characters before or after
them, or next to such. A span is a compacted path of the full graph of ``length``-mers that branches nowhere,
in source coordinates. Its class is named by the digest of its text, taken from the texts themselves, so what
is listed as equal is equal.

A passage that m documents share costs m rows. Pairs of documents are a view on the classes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, settle

SPAN = 250
#: Longest s-mers.
S = 16
#: Characters hashed together in a task.
PIECE = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hasher:
    """Hashes of all substrings of one length of an array of code points (polynomials modulo 2**64)."""

    powers = inverse = np.ones(1, "u8")

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        if len(Hasher.powers) < n:
            with np.errstate(over="ignore"):
                base, size = np.full(max(n, PIECE), _BASE, "u8"), max(n, PIECE)
                back = np.full(size, pow(int(_BASE), -1, 1 << 64), "u8")
                base[0] = back[0] = 1
                Hasher.powers, Hasher.inverse = np.multiply.accumulate(base), np.multiply.accumulate(back)
        values = _mix(codes.astype("u8") + _U(0x632BE59BD9B4E019))
        self.sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(values * self.powers[:n], dtype="u8")])

    def of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, "u8")
        return _mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def sizes(length: int) -> tuple[int, int]:
    """(k, s) for spans of ``length``: the longest k-mers of which every such span is sure to hold two consecutive nodes."""
    if length < 1:
        raise ValueError("a span has at least one character")
    s = min(S, max(1, length // 4))
    return (length + s) // 2, s


def syncmers(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-mers whose smallest s-mer is their first or last."""
    if len(codes) < k:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    h = Hasher(codes)
    small = h.of(s)
    least = _sliding_min(small, k - s + 1)
    at = np.flatnonzero((small[: len(least)] == least) | (small[k - s :] == least))
    return at, h.of(k)[at]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _pieces(texts: list[str | None], overlap: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Joined code points and, for each text in them, (index, start in the joined array, length, offset in the text).

    Texts longer than ``PIECE`` come in several pieces that overlap.
    """
    held: list[np.ndarray] = []
    where: list[tuple[int, int, int, int]] = []
    n = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        codes = code_points(t)
        at = 0
        while at == 0 or at + overlap < len(codes):
            part = codes[at : at + PIECE]
            if n and n + len(part) > PIECE:
                yield np.concatenate(held), where
                held, where, n = [], [], 0
            held.append(part)
            where.append((i, n, len(part), at))
            n += len(part)
            if at + len(part) >= len(codes):
                break
            at += len(part) - overlap
    if n:
        yield np.concatenate(held), where


_NODES_DDL = "doc_id long, part long, at long, node long, came long, goes long, last_at long, next_at long"
_NODES = pa.schema([(n.split()[0], pa.int64()) for n in _NODES_DDL.split(", ")])
_ENDS = _U(0xD6E8FEB86659FD93)


def _step(node: np.ndarray, distance: np.ndarray) -> np.ndarray:
    return _mix(node ^ _mix(distance.astype("u8") * _ENDS + _U(1)))


def _nodes(length: int):
    k, s = sizes(length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, texts = (batch.column(i) for i in range(3))
            ids, parts = ids.to_numpy(), parts.to_numpy()
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for codes, where in _pieces(texts.to_pylist(), k - 1):
                pos, node = syncmers(codes, k, s)
                starts = np.array([w[1] for w in where])
                own = np.searchsorted(starts, pos, "right") - 1
                ends = np.array([w[1] + w[2] for w in where])
                keep = pos + k <= ends[own]
                pos, node, own = pos[keep], node[keep], own[keep]
                cuts = np.searchsorted(own, np.arange(len(where) + 1))
                for j, (i, start, _, offset) in enumerate(where):
                    a, b = cuts[j], cuts[j + 1]
                    if b > a:
                        held.setdefault(i, []).append((pos[a:b] - start + offset, node[a:b]))
            if not held:
                continue
            cols: list[list[np.ndarray]] = [[] for _ in _NODES]
            for i, found in held.items():
                p, h = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                # Where a text begins or ends it goes another way than all other documents.
                end = _mix(np.full(1, ids[i]).view("u8") ^ _ENDS)
                far = _step(h[1:], p[1:] - p[:-1]), _step(h[:-1], p[1:] - p[:-1])
                for c, x in zip(cols, (np.full(len(p), ids[i]), np.full(len(p), parts[i]), p, h.view("i8"), np.append(end, far[1]).view("i8"), np.append(far[0], end).view("i8"), np.append(-1, p[:-1]), np.append(p[1:], -1)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype("i8")) for c in cols], schema=_NODES)

    return run


def _texts(documents: DataFrame) -> DataFrame:
    """(doc_id, part, text): a document may be several rows, told apart by the mark of their text; repeated rows are one."""
    texts = documents.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("part"), "text")
    if documents.groupBy("doc_id").count().filter("doc_id is not null and count > 1").limit(1).count():
        return settle(texts.dropDuplicates(["doc_id", "part"]), "texts")
    return texts


def graph(texts: DataFrame, length: int = SPAN) -> DataFrame:
    """The occurrences of nodes that more than one document has: (doc_id, part, at, node, last_at, next_at, forks_in, forks_out)."""
    every = settle(texts.mapInArrow(_nodes(length), _NODES_DDL), "nodes")
    differ = lambda c: F.min(c) < F.max(c)
    # Most nodes are of one document; they are dropped before the edges of the others are compared.
    shared = every.groupBy("node").agg(differ("doc_id").alias("shared")).filter("shared").select("node")
    common = settle(every.join(shared, "node", "left_semi"), "common-nodes")
    discard(every)
    forks = common.groupBy("node").agg(differ("came").alias("forks_in"), differ("goes").alias("forks_out"))
    nodes = settle(common.drop("came", "goes").join(forks, "node"), "shared-nodes")
    discard(common)
    return nodes


def places(g: DataFrame, length: int = SPAN) -> DataFrame:
    """(doc_id, part, ranges) of a ``graph``: the first places of the windows that tell where spans begin and end in a text.

    At a node that forks in, spans begin between the node before it and itself; at one that forks out, they end
    between its end and that of the node after it. No window reaches over a node that others don't have.
    """
    k = sizes(length)[0]
    w = Window.partitionBy("doc_id", "part").orderBy("at")
    before, after = F.lag("at").over(w) == F.col("last_at"), F.lead("at").over(w) == F.col("next_at")
    g = g.select("*", F.coalesce(before, F.lit(False)).alias("linked"), F.coalesce(after, F.lit(False)).alias("links"))
    # What bounds the path of shared nodes that a node lies on; -1 is the end of the text.
    g = g.withColumn("low", F.last(F.when(~F.col("linked"), F.col("last_at") + 1), True).over(w))
    back = Window.partitionBy("doc_id", "part").orderBy(F.desc("at"))
    high = F.when(F.col("next_at") >= 0, F.col("next_at") + (k - 1)).otherwise(F.lit(2**40))
    g = g.withColumn("high", F.last(F.when(~F.col("links"), high), True).over(back)).filter("forks_in or forks_out")
    first = F.struct((F.when(F.col("linked"), F.col("last_at")).otherwise(F.col("low"))).alias("a"), F.least(F.col("at"), F.col("high") - length).alias("b"))
    last = F.struct(F.greatest(F.col("low"), F.col("at") + (k - length)).alias("a"), F.when(F.col("links"), F.col("next_at") + (k - length)).otherwise(F.col("high") - length).alias("b"))
    ranges = F.array_compact(F.array(F.when(F.col("forks_in"), first), F.when(F.col("forks_out"), last)))
    return g.select("doc_id", "part", F.explode(ranges).alias("r")).filter("r.a <= r.b").groupBy("doc_id", "part").agg(F.collect_list("r").alias("ranges"))


_WINDOWS_DDL = "doc_id long, part long, at long, span long, before long, after long"
_WINDOWS = pa.schema([(n.split()[0], pa.int64()) for n in _WINDOWS_DDL.split(", ")])


def _windows(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            for doc, part, text, ranges in zip(*batch.columns, strict=True):  # one text at a time
                codes, doc, part, at = code_points(text.as_py()), doc.as_py(), part.as_py(), 0
                for r in sorted((x["a"], x["b"]) for x in ranges.as_py()):
                    low, high = max(at, r[0]), min(r[1], len(codes) - length) + 1
                    at = max(at, high)
                    for a in range(low, high, PIECE):
                        held.append(_of_piece(codes, doc, part, a, min(high, a + PIECE), length))
                        n += len(held[-1][0])
                        if n >= PIECE:
                            yield _joined(held)
                            held, n = [], 0
        if n:
            yield _joined(held)

    return run


def _of_piece(codes: np.ndarray, doc: int, part: int, a: int, b: int, length: int) -> list[np.ndarray]:
    """The windows that begin at ``a`` up to ``b``: document, text, place, hash, and the characters before and after."""
    h = Hasher(codes[a : b + length - 1]).of(length).view("i8")
    none = -1 - (doc & 0x7FFFFFFFFFFFFFF)  # where a text begins or ends; a mark of the document keeps such places apart
    before, after = np.full(b - a, none, "i8"), np.full(b - a, none, "i8")
    skip = 0 if a else 1
    before[skip:] = codes[a - 1 + skip : b - 1]
    ahead = codes[a + length : b + length]
    after[: len(ahead)] = ahead
    return [np.full(b - a, doc), np.full(b - a, part), np.arange(a, b), h, before, after]


def _joined(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype("i8")) for c in zip(*held, strict=True)], schema=_WINDOWS)


def _bounds(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, part, low, high): where spans begin and end in each text, by hashes."""
    nodes = graph(texts, length)
    asked = texts.join(places(nodes, length), ["doc_id", "part"]).select("doc_id", "part", "text", "ranges")
    every = settle(asked.mapInArrow(_windows(length), _WINDOWS_DDL), "windows")
    discard(nodes)
    differ = lambda c: F.min(c) < F.max(c)
    shared = every.groupBy("span").agg(differ("doc_id").alias("shared"), differ("before").alias("left"), differ("after").alias("right")).filter("shared").drop("shared")
    seen = every.select("doc_id", "part", "at", "span").join(shared, "span").select("doc_id", "part", "at", "left", "right")
    w = Window.partitionBy("doc_id", "part").orderBy("at")
    next_to = lambda f, c, d: F.coalesce(f(c).over(w) & (f("at").over(w) == F.col("at") + d), F.lit(False))
    seen = seen.select("doc_id", "part", "at", (F.col("left") | next_to(F.lag, "right", -1)).alias("begins"), (F.col("right") | next_to(F.lead, "left", 1)).alias("ends")).filter("begins or ends")
    end = F.last(F.when(F.col("ends"), F.col("at")), True).over(Window.partitionBy("doc_id", "part").orderBy(F.desc("at")))
    out = settle(seen.withColumn("end", end).filter("begins").select("doc_id", "part", F.col("at").alias("low"), (F.col("end") + length).alias("high")), "pieces")
    discard(every)
    return out


def shared_spans(documents: DataFrame, length: int = SPAN) -> DataFrame:
    """(doc_id, part, start_at, n_chars, class_id, documents): every span of at least ``length`` characters that more than one document has.

    ``start_at`` counts from 1. Spans of one class have the same text, whose digest is ``class_id``, and lie in
    ``documents`` documents (the links of each member are one less). A span ends where its occurrences part, so
    those of one text may overlap by ``length - 1`` characters, and two texts that share more share several.
    Characters are code points, compared exactly. Null and shorter texts have none, nor has a passage that only
    one document has, however often; rows with the same doc_id are one document (``part`` tells their texts).
    """
    texts = _texts(documents)
    pieces = _bounds(texts, length)
    held = pieces.groupBy("doc_id", "part").agg(F.collect_list(F.struct("low", "high")).alias("pieces"))
    # Source coordinates verify: the digest is of the text itself.
    cut = lambda x: F.substring(F.col("text"), (x["low"] + 1).cast("int"), (x["high"] - x["low"]).cast("int"))
    named = texts.join(held, ["doc_id", "part"]).select("doc_id", "part", F.explode(F.transform("pieces", lambda x: F.struct((x["low"] + 1).alias("start_at"), (x["high"] - x["low"]).alias("n_chars"), F.md5(cut(x)).alias("class_id")))).alias("x")).select("doc_id", "part", "x.*")
    named = settle(named, "named")
    discard(pieces)
    classes = named.select("class_id", "doc_id").distinct().groupBy("class_id").agg(F.count("*").alias("documents")).filter("documents > 1")
    return named.join(classes, "class_id").select("doc_id", "part", "start_at", "n_chars", "class_id", "documents")


#: Members of a class that meet all others of it in one task.
BLOCK_MEMBERS = 1000


def shared_pairs(documents: DataFrame, length: int = SPAN, spans: DataFrame | None = None) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: all pairs with at least ``length`` consecutive characters in common.

    A view on ``shared_spans``. Two documents are listed at the first span of each stretch that they share, that
    is where the spans just before differ; classes whose members all come from one span list nothing. A class
    of many members is met in blocks.
    """
    spans = settle(shared_spans(documents, length), "spans") if spans is None else spans
    w = Window.partitionBy("doc_id", "part").orderBy("start_at")
    joins = F.lag(F.col("start_at") + F.col("n_chars")).over(w) == F.col("start_at") + (length - 1)
    members = spans.select("class_id", "doc_id", "documents", F.when(joins, F.lag("class_id").over(w)).otherwise(F.concat(F.lit("doc "), F.col("doc_id"))).alias("before")).distinct()
    members = settle(members, "members")
    blocks = F.ceil(F.col("documents") / BLOCK_MEMBERS).cast("int")
    begins = members.groupBy("class_id").agg((F.min("before") < F.max("before")).alias("begins")).filter("begins").select("class_id")
    members = members.join(begins, "class_id", "left_semi")
    left = members.select("class_id", F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"), F.col("doc_id").alias("doc_id_a"), F.col("before").alias("before_a"))
    right = members.select("class_id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("doc_id").alias("doc_id_b"), F.col("before").alias("before_b"))
    met = left.join(right, ["class_id", "block"]).filter("doc_id_a < doc_id_b and before_a <> before_b")
    return met.select("doc_id_a", "doc_id_b").distinct()


def shared_share(documents: DataFrame, length: int = SPAN) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): how much of each document lies in spans that another one has too.

    One row per doc_id, also for null and empty texts (0 of 0 characters); the texts of a doc_id listed with
    several are added up, each once.
    """
    w = Window.partitionBy("doc_id", "part").orderBy("start_at")
    end = F.col("start_at") + F.col("n_chars")
    own = end - F.greatest(F.col("start_at"), F.coalesce(F.lag(end).over(w), F.lit(0)))
    covered = shared_spans(documents, length).withColumn("own", own).groupBy("doc_id").agg(F.sum("own").alias("shared_chars"))
    texts = documents.select("doc_id", F.xxhash64("text").alias("part"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n")).distinct()
    out = texts.groupBy("doc_id").agg(F.sum("n").alias("n_chars")).join(covered, "doc_id", "left").fillna(0, ["shared_chars"])
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
