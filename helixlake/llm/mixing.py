"""Problem 9: records of several sources mixed to target shares of all tokens.

Hash-threshold histograms.  Every document has a hash of 30 bits.  Per source, tokens are summed by the hash's leading bits; the
bucket in which the source's budget runs out is the only one that the next level splits.  After ``LEVELS`` levels the budget is a
threshold on the hash: a document is used once more if its hash is below it.  Nothing is sorted, and thresholds are nested: a larger
budget keeps every document of a smaller one.

The mix is as large as the scarcest source allows (or ``budget`` tokens, if that is less); a source with quota q and t tokens uses
each document floor(q / t) times and those below the threshold once more, so never more than ``max_repeats`` times.

Null texts have no tokens.  Documents of a null source or of one without a target get 0 copies; targets of a share or repeat count
that is null or not positive are left out; a target whose source has no tokens is reported with share 0 and doesn't bound the mix.  Ties of
the hash are used alike.  If ids repeat, their rows are documents of their own.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixlake.runtime import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bits that each level of the histogram splits, and levels.
BITS, LEVELS = 10, 3
#: Bound on the number of targets: quotas are worked out on the driver.
MAX_TARGETS = 10_000
# Fixed value: the pre-tokenisation pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict = {}


def encoding(path: str):
    """The byte-level BPE of a rank file, once per process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of every document.  The driver's vocabulary file is sent to the executors."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long"), "source", "text").mapInArrow(count, "doc_id long, source string, n_tokens long")


def _quotas(targets: DataFrame, totals: dict[str, int], budget: float | None) -> dict[str, tuple[float, int, int, float]]:
    """Per source: share, repeats, whole uses of every document and tokens that one more use of some has to add."""
    rows = targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").distinct().limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    able = [r for r in rows if totals.get(r["source"])]
    size = min([r["max_repeats"] * totals[r["source"]] / r["target_share"] for r in able] + ([budget] if budget is not None else []), default=0.0)
    out = {}
    for r in rows:
        total, quota = totals.get(r["source"]) or 0, r["target_share"] * size
        whole = min(r["max_repeats"], math.floor(quota / total + 1e-9)) if total else 0
        out[r["source"]] = (r["target_share"], r["max_repeats"], whole, max(0.0, quota - whole * total))
    return out


def mix(documents: DataFrame, targets: DataFrame, budget: float | None = None, tokenizer: str = TOKENIZER, seed: int = 0) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)``: how often the mix uses each document, 0 for those it leaves out."""
    return _mixed(documents, targets, budget, tokenizer, seed)[0]


def _mixed(documents: DataFrame, targets: DataFrame, budget: float | None, tokenizer: str, seed: int) -> tuple[DataFrame, dict, dict]:
    spark: SparkSession = documents.sparkSession
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source")), 64 - BITS * LEVELS)
    counts = stored(token_counts(documents, tokenizer).withColumn("h", hashed))
    wanted = F.broadcast(targets.select("source").where("source IS NOT NULL").distinct().limit(MAX_TARGETS + 1))
    totals = {r["source"]: r["t"] for r in counts.join(wanted, "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    quotas = _quotas(targets, totals, budget)
    #: Per source the hash prefix of the boundary bucket and the tokens still to be placed.
    edge = {s: (0, q[3]) for s, q in quotas.items() if q[3] > 0}
    for level in range(1, LEVELS + 1):
        if not edge:
            break
        bounds = F.broadcast(spark.createDataFrame([(s, p, float(left)) for s, (p, left) in edge.items()], "source string, prefix long, left double"))
        bucket = F.shiftright("h", BITS * (LEVELS - level))
        inside = counts.join(bounds, "source").where(F.shiftright(bucket, BITS) == F.col("prefix"))
        sums = inside.groupBy("source", "left", bucket.alias("b")).agg(F.sum("n_tokens").alias("t"))  # at most 2**BITS a source
        upto = F.sum("t").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        over = F.min(F.when(F.col("upto") > F.col("left"), F.struct("b", (F.col("left") - F.col("upto") + F.col("t")).alias("rest"))))
        found = sums.withColumn("upto", upto).groupBy("source", "left").agg(over.alias("over"), F.max("upto").alias("all")).collect()  # a row a source
        rest = {r["source"]: (r["over"]["b"], r["over"]["rest"]) if r["over"] else (None, r["left"] - r["all"]) for r in found}
        for s, (prefix, left) in edge.items():
            at, left = rest.get(s, (None, left))
            edge[s] = (((prefix + 1) << BITS) - 1 if at is None else at, left)
    plan = [(s, q[2], edge[s][0] if s in edge else 0) for s, q in quotas.items()]
    uses = F.broadcast(spark.createDataFrame(plan, "source string, whole int, below long"))
    used = counts.join(uses, "source", "left").withColumn("copies", F.coalesce(F.col("whole") + (F.col("h") < F.col("below")).cast("int"), F.lit(0)))
    return used.select("doc_id", "source", "n_tokens", "copies"), quotas, totals


def shares(documents: DataFrame, targets: DataFrame, budget: float | None = None, tokenizer: str = TOKENIZER, seed: int = 0) -> DataFrame:
    """``(source, target_share, max_repeats, tokens_available, tokens_used, share, n_documents, most_copies)`` per target."""
    used, quotas, totals = _mixed(documents, targets, budget, tokenizer, seed)
    spark = documents.sparkSession
    rows = [(s, q[0], q[1], int(totals.get(s) or 0)) for s, q in quotas.items()]
    base = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens_available long")
    got = used.where("copies > 0").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_used"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies"))
    got = stored(got)
    total = got.agg(F.sum("tokens_used")).first()[0] or 0
    return base.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "tokens_available",
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        (F.coalesce("tokens_used", F.lit(0)) / F.lit(float(total or 1))).alias("share"),
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
