"""Mix sources to target shares of tokens by weighted sampling without replacement (Efraimidis and Spirakis).

Every document draws an exponential key -ln(u) / weight, u a hash of the seed and its id and weight its quality.
Within a source documents are taken in the order of their keys.  A source's budget is its share of the total; as
many complete epochs as fit come first (each document once an epoch, at most ``max_repeats`` in all), and the
rest of the budget is filled with the first documents in key order whose running token sum stays within it.

The running sum over a source of any size is found from histograms: keys fall into ``BUCKETS`` ordered buckets,
token sums by bucket give the bucket in which the budget ends, buckets before it are taken whole, and that one
bucket is divided in the same way once more.  Only the documents of one part in ``BUCKETS`` squared (17 million) of a
source are sorted and summed one by one.

Defined results: sources are compared trimmed, in lower case, with ``-`` read as ``_``; documents of a null or
unlisted source are not used; null and empty texts have 0 tokens and are not used; a listed source without
documents falls short and is reported with an actual share of 0; sources listed twice add their weights and keep
the larger repeat cap; null, zero or negative weights count as 0; equal keys are taken by id; an empty table
gives shares of 0; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

BUCKETS = 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # must be readable at this path on every executor
#: Fixed value: the public pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def canonical_source(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.translate(F.lower(F.trim(c)), "-", "_"), F.lit(""))


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``df`` without ``text``, with the number of its tokens; null counts as 0.  Equal words are counted once a task."""
    kept = [c for c in df.columns if c != text]
    src = df.select(*kept, F.col(text).cast("string").alias("__text"))
    schema = src.drop("__text").withColumn(out, F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer, "rb"))}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        pieces = regex.compile(pattern).findall
        known: dict[str, int] = {}

        class Count(dict):
            def __missing__(self, piece: str) -> int:
                n = len(encode(piece))
                if len(piece) <= 24 and len(self) < 200_000:
                    self[piece] = n
                return n

        known = Count()
        look = known.__getitem__
        for batch in batches:
            counts = [0 if t is None else sum(map(look, pieces(t))) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def exponential_key(doc_id: str, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from 53 bits of a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def _edges(sums: DataFrame, rests: DataFrame) -> DataFrame:
    """Per source the last bucket that fits whole into ``rest``, what is left after it, and the bucket in which the rest ends."""
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    at = sums.withColumn("upto", F.sum("tokens").over(upto)).join(rests, "source")
    fits = F.col("upto") <= F.col("rest")
    last = at.groupBy("source").agg(F.first("rest").alias("rest"), F.max(F.when(fits, F.col("bucket"))).alias("whole"), F.max(F.when(fits, F.col("upto"))).alias("taken"), F.min(F.when(~fits, F.col("bucket"))).alias("edge"))
    return last.select("source", F.coalesce("whole", F.lit(-1)).alias("whole"), (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("left"), "edge")


def mix(
    docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", tokens: str = "n_tokens", quality: Column | None = None, total: int | None = None, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """(chosen, report).  ``chosen``: doc_id, source, tokens and copies; ``report``: a row a listed source.

    ``targets``: source, target_weight, max_repeats.  ``total``: tokens of the mix, by default those of all usable documents."""
    plan = targets.groupBy(canonical_source("source").alias("source")).agg(F.sum(F.greatest(F.col("target_weight"), F.lit(0.0))).alias("w"), F.max(F.greatest(F.col("max_repeats"), F.lit(1))).cast("bigint").alias("max_repeats")).where("source is not null")
    share = F.coalesce(F.col("w") / F.nullif(F.sum("w").over(Window.partitionBy(F.lit(1))), F.lit(0.0)), F.lit(0.0))
    plan = cut(plan.select("source", share.alias("target_share"), "max_repeats"))  # as many rows as sources are listed

    weight = F.greatest(quality if quality is not None else F.lit(1.0), F.lit(1e-6))
    used = docs.select(F.col(doc_id).alias("doc_id"), canonical_source(source).alias("source"), F.col(tokens).cast("bigint").alias("tokens"), weight.alias("__w")).where("tokens > 0")
    used = used.join(plan.select("source"), "source", "left_semi").withColumn("key", exponential_key("doc_id", F.col("__w"), seed)).drop("__w")
    place = (1 - F.exp(-F.col("key"))) * BUCKETS
    used = cut(used.withColumn("bucket", F.least(F.floor(place), F.lit(BUCKETS - 1)).cast("int")))
    sums = cut(used.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")))
    have = sums.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum("n_docs").alias("n_docs"))
    if total is None:
        total = sums.agg(F.sum("tokens")).first()[0] or 0
    plan = plan.join(have, "source", "left").fillna(0, ["available", "n_docs"]).withColumn("budget", F.floor(F.col("target_share") * F.lit(total)))
    plan = plan.withColumn("epochs", F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats"))).otherwise(F.lit(0)))
    plan = cut(plan.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(F.lit(0))))

    rules = _edges(sums, plan.select("source", "rest")).join(plan.select("source", "epochs"), "source")
    ruled = used.join(F.broadcast(cut(rules)), "source")  # as many rows as sources are listed
    clear = ruled.where("edge is null or bucket <> edge").withColumn("copies", F.col("epochs") + (F.col("bucket") <= F.col("whole")).cast("long"))
    inner = F.least(F.floor((place - F.col("bucket")) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    edge = cut(ruled.where("bucket = edge").select("doc_id", "source", "tokens", "key", "epochs", "left", inner.alias("bucket")))
    finer = _edges(edge.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens")), edge.select("source", F.col("left").alias("rest")).distinct())
    edge = edge.drop("left").join(F.broadcast(cut(finer)), "source")
    running = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = edge.where("bucket = edge").withColumn("copies", F.col("epochs") + (F.sum("tokens").over(running) <= F.col("left")).cast("long"))
    edge = edge.where("edge is null or bucket <> edge").withColumn("copies", F.col("epochs") + (F.col("bucket") <= F.col("whole")).cast("long")).unionByName(last)
    cols = ["doc_id", "source", "tokens", F.col("copies").cast("bigint").alias("copies")]
    chosen = cut(clear.select(*cols).unionByName(edge.select(*cols)).where("copies > 0"))

    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("chosen_tokens"), F.sum("copies").alias("chosen_docs"))
    report = plan.join(got, "source", "left").fillna(0, ["chosen_tokens", "chosen_docs"])
    all_ = F.nullif(F.sum("chosen_tokens").over(Window.partitionBy(F.lit(1))), F.lit(0))
    report = report.select(
        "source", "target_share", "budget", "available", "n_docs", "max_repeats", "epochs", "chosen_tokens", "chosen_docs", F.coalesce(F.col("chosen_tokens") / all_, F.lit(0.0)).alias("actual_share"), (F.col("available") * F.col("max_repeats") < F.col("budget")).alias("falls_short")
    )
    return chosen, report
