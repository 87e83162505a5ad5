"""Token counts from an exact length histogram.

Documents are aggregated by encoded length (pre-summed in each Arrow batch, then
by Spark); suffix sums over the histogram answer totals, quantiles and truncated
totals for every context limit without touching the documents again.

Defined cases: null and empty texts have length 0; repeated rows count each;
an empty table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.byte_bpe import default_vocabulary, encoder
from vigil.llm.common import Stored, running_sum

BLOCK = 64  # lengths whose histogram rows are summed in one task


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(length, n_docs): one row per distinct encoded length."""
    path = vocabulary or default_vocabulary()

    def count(batches):
        enc = encoder(path)
        for b in batches:
            seen = Counter(enc.count(t) for t in b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.int64()),
                                              pa.array(list(seen.values()), pa.int64())], ["length", "n_docs"])

    return docs.select(docs["text"].alias("text")).mapInArrow(count, "length long, n_docs long") \
        .groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per distinct length L: documents and tokens of exactly L, of at least L (suffix sums), the corpus
    total when every document is cut at L tokens, and the share of documents no longer than L.

    Between two neighbouring lengths the truncated total is linear: see ``truncated_totals``."""
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"))
    total = h.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    docs_ge, tokens_ge = F.lit(total["d"]) - F.col("before_n_docs"), F.lit(total["t"]) - F.col("before_n_tokens")
    return running_sum(h, "length", ["n_docs", "n_tokens"], BLOCK).select(
        "length", "n_docs", "n_tokens", docs_ge.alias("docs_at_least"), tokens_ge.alias("tokens_at_least"),
        (F.col("before_n_tokens") + F.col("length") * docs_ge).alias("truncated_total"),
        ((F.col("before_n_docs") + F.col("n_docs")) / F.lit(float(total["d"] or 1))).alias("share_up_to"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, total_tokens): the corpus total with documents cut at each limit, from the suffix
    sums of the next length at or above it."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # row of the first length at or above each limit; above the longest, no document is cut
    cut = [F.min_by(F.struct("truncated_total", "length", "docs_at_least"), F.when(F.col("length") >= F.lit(int(x)), F.col("length"))).alias(str(i))
           for i, x in enumerate(limits)]
    row = sums.agg(F.max(F.struct("length", "truncated_total")).alias("last"), *cut)
    total = [F.coalesce(F.col(f"{i}.truncated_total") - (F.col(f"{i}.length") - F.lit(int(x))) * F.col(f"{i}.docs_at_least"),
                        F.col("last.truncated_total"), F.lit(0)).cast("long") for i, x in enumerate(limits)]
    both = F.explode(F.map_from_arrays(F.array(*[F.lit(int(x)).cast("long") for x in limits]), F.array(*total)))
    return wanted.join(row.select(both.alias("context_limit", "total_tokens")), "context_limit")


def quantile_lengths(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of the documents does not exceed."""
    row = sums.agg(*[F.min(F.when(F.col("share_up_to") >= F.lit(float(q)), F.col("length"))).alias(str(i))
                     for i, q in enumerate(shares)])
    return row.select(F.explode(F.map_from_arrays(F.array(*[F.lit(float(q)) for q in shares]),
                                                  F.array(*[F.col(str(i)) for i in range(len(shares))]))).alias("share", "length"))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The whole report over ``docs``; the histogram is stored, as it is read twice."""
    return suffix_sums(Stored(length_histogram(docs, vocabulary), "length-histogram").df)
