"""Problem 9: mixing sources to target weights, by subset-sum budget fitting.

Documents are counted by exact token length. A source's budget is its share of the whole; whole passes over
the source are taken first, the rest is fitted on the counts by length: an even share of every length, and
bounded-knapsack dynamic programming over what may differ from it. Seeded documents are then chosen by length
and count.
Only counts by length reach the fitting task, one source each; documents never leave their partitions but
for the choice within one length, which is split by a hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.deliveries import bare
from ..runtime import discard, settle

#: Public tokenizer and its file (a parameter; never part of this repository).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens that the dynamic programming begins with; it goes on with more until nothing can be better.
FIT_TOKENS = 1 << 15
#: Hash buckets that split the documents of one source and length.
BUCKETS = 256


def token_lengths(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens): source names without case and blanks, whole texts counted; null texts are 0 tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [0 if not t else len(encode(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    source = F.coalesce(F.lower(bare("source")), F.lit(""))
    return documents.select("doc_id", source.alias("source"), "text").mapInArrow(run, "doc_id long, source string, n_tokens long")


_encoders: dict = {}


def _encoder(path: str):
    if path not in _encoders:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _encoders[path] = lambda s: t.encode(s, add_special_tokens=False).ids
        elif path.endswith(".model"):
            import sentencepiece

            _encoders[path] = sentencepiece.SentencePieceProcessor(model_file=path).encode
        else:
            import base64

            import tiktoken

            import public_tokenizers

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _encoders[path]


def fit(counts: dict[int, int], budget: int, most: int = FIT_TOKENS) -> dict[int, int]:
    """How many documents of each token length to take so that the total comes as close to ``budget`` as can be from below.

    ``counts``: documents by length. First the same fraction of every length, rounded down, so that about
    ``most`` tokens are left, or single documents of the longest while it is far more; then bounded knapsack by
    bit sets over what is left. Where that misses the budget, the more of the even share is given back the
    longer it does, up to what can still matter: any two choices of about one total can be led into each other
    by adding and taking off single documents without a sum coming twice, so the best is at most twice the
    longest and what was left away from the first, counted in documents.
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    unit = math.gcd(*counts)
    if budget >= sum(n * c for n, c in counts.items()):
        return counts
    if unit > 1:  # nothing but multiples can be reached
        return {n * unit: k for n, k in fit({n // unit: c for n, c in counts.items()}, budget // unit, most).items()}
    total, budget = sum(n * c for n, c in counts.items()), max(0, budget)
    even = max(0, budget - most // 2)
    first = {n: c * even // total for n, c in counts.items()}
    left = budget - sum(n * k for n, k in first.items())
    for n in sorted(counts, reverse=True):
        if left <= most:
            break
        k = min(counts[n] - first[n], (left - most) // n + 1, left // n)
        first[n] += k
        left -= n * k
    back, enough = 0, left + 2 * max(counts) + 1
    while True:
        kept = {n: max(0, k - back) for n, k in first.items()}
        take, missed = _fill(counts, kept, budget)
        if not missed or back >= enough or not any(kept.values()):
            return {n: k for n, k in take.items() if k}
        back = max(1, back * 4)


def _fill(counts: dict[int, int], kept: dict[int, int], budget: int) -> tuple[dict[int, int], int]:
    """The best that can be added to ``kept`` within ``budget``, and by how much it misses it."""
    take, left = dict(kept), budget - sum(n * k for n, k in kept.items())
    mask = (1 << (left + 1)) - 1
    reach, steps = 1, []
    for n in sorted(counts, reverse=True):
        if reach >> left & 1:
            break
        spare, power = min(counts[n] - take[n], left // n), 1
        while spare > 0:  # any number of a length is a sum of powers of two
            k = min(power, spare)
            steps.append((n, k, reach))
            reach |= (reach << n * k) & mask
            spare -= k
            power *= 2
    best = reach.bit_length() - 1
    missed = left - best
    for n, k, before in reversed(steps):
        if not before >> best & 1:
            best -= n * k
            take[n] += k
    return take, missed


def mix(documents: DataFrame, mix_targets: DataFrame, seed: int = 0, total: int | None = None, path: str = TOKENIZER, keep_shares: bool = False) -> DataFrame:
    """(doc_id, source, n_tokens, copies): which documents to use, and how often (1 to ``max_repeats``).

    ``total`` is the size of the mix in tokens; by default all tokens of the sources that have a target.
    A source gives its share of it, or all it has ``max_repeats`` times where that is less; then the mix is
    smaller and the other sources have more than their share of it, as the report says. With ``keep_shares``
    the mix is instead made so small that every source which has documents can give its share, and the shares
    of those that have none are the others' in proportion. Sources without a
    target, documents without tokens and absent sources give no rows. Which documents of a length are chosen
    depends on ``seed`` and ``doc_id`` alone; a doc_id listed twice is two documents.
    """
    return _mix(documents, mix_targets, seed, total, path, keep_shares)[0]


def _mix(documents: DataFrame, mix_targets: DataFrame, seed: int, total: int | None, path: str, keep_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    lengths = settle(token_lengths(documents, path), "lengths")
    targets = (
        mix_targets.select(F.lower(bare("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
        .filter("source is not null and target_share is not null")
        .groupBy("source").agg(F.max("target_share").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    )
    counts = lengths.filter("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count("*").alias("n")).join(targets, "source")
    counts = settle(counts, "counts")
    if total is None:
        total = counts.agg(F.sum(F.col("n_tokens") * F.col("n"))).first()[0] or 0
    scale = 1.0
    if keep_shares:
        per = counts.groupBy("source").agg((F.sum(F.col("n_tokens") * F.col("n")) * F.greatest(F.max("max_repeats"), F.lit(0))).alias("most"), F.max("target_share").alias("share")).filter("share > 0")
        scale, limit = per.agg(F.sum("share"), F.min(F.col("most") / F.col("share"))).first()
        scale = scale or 1.0
        total = min(total, math.floor((limit or 0) * scale))

    def plan(key: tuple, t: pa.Table) -> pa.Table:
        by = dict(zip(t.column("n_tokens").to_pylist(), t.column("n").to_pylist(), strict=True))
        share, repeats = t.column("target_share")[0].as_py(), max(0, t.column("max_repeats")[0].as_py())
        tokens = sum(n * c for n, c in by.items())
        budget = min(round(share / scale * total), tokens * repeats)
        passes = budget // tokens
        extra = fit(by, budget - passes * tokens) if passes < repeats else {}
        rows = [(key[0], n, passes, extra.get(n, 0)) for n in by]
        return pa.table({c: pa.array(v, k) for (c, k), v in zip([("source", pa.string()), ("n_tokens", pa.int64()), ("passes", pa.int64()), ("extra", pa.int64())], zip(*rows, strict=True), strict=True)})

    plans = settle(counts.groupBy("source").applyInArrow(plan, "source string, n_tokens long, passes long, extra long"), "plan")
    chosen = settle(_choose(lengths, plans, seed), "chosen")
    for done in (lengths, counts, plans):
        discard(done)
    report = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    report = targets.join(report, "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
    mixed = report.agg(F.sum("tokens")).first()[0] or 0
    report = report.select("source", "target_share", "max_repeats", F.lit(total).cast("long").alias("total"), "tokens", (F.col("tokens") / F.lit(max(1, mixed))).alias("actual_share"), "documents", "most_copies")
    return chosen, report


def _choose(lengths: DataFrame, plans: DataFrame, seed: int) -> DataFrame:
    """Of each source and length the ``extra`` first documents in seeded order get one copy more.

    The order is (hash bucket, hash, doc_id). Buckets that lie wholly inside or outside need no sorting; only
    the bucket in which the count runs out is ranked, so a length that holds a third of all rows is no one
    task's work.
    """
    key = ["source", "n_tokens"]
    h = F.xxhash64(F.lit(seed), "doc_id")
    docs = lengths.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sizes = docs.groupBy(*key, "bucket").agg(F.count("*").alias("n")).join(plans, key)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sizes.withColumn("before", before).select(*key, "bucket", "passes", F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("before"))).alias("take"), "n")
    docs = docs.join(cut, [*key, "bucket"])
    whole = docs.filter("take = n or take = 0").withColumn("copies", F.col("passes") + (F.col("take") > 0).cast("long"))
    rank = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("h", "doc_id"))
    part = docs.filter("take < n and take > 0").withColumn("copies", F.col("passes") + (rank <= F.col("take")).cast("long"))
    columns = ["doc_id", "source", "n_tokens", "copies"]
    return whole.select(columns).unionByName(part.select(columns)).filter("copies > 0")


def shares(documents: DataFrame, mix_targets: DataFrame, seed: int = 0, total: int | None = None, path: str = TOKENIZER, keep_shares: bool = False) -> DataFrame:
    """(source, target_share, max_repeats, total, tokens, actual_share, documents, most_copies) of ``mix``; one row per target."""
    return _mix(documents, mix_targets, seed, total, path, keep_shares)[1]
