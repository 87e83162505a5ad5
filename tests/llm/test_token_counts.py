from collections import Counter

from tests.llm.helpers import awkward, awkward_rows, empty
from tests.llm.test_packing import library_ids
from vigil.llm import token_counts as C


def test_awkward_rows(spark):
    lengths = [len(x) for x in library_ids([r[1] for r in awkward_rows()])]
    sums = C.token_counts(awkward(spark)).cache()
    got = {r.length: r for r in sums.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(lengths)
    for k, r in got.items():
        assert r.n_tokens == k * r.n_docs
        assert r.docs_at_least == sum(x >= k for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= k)
        assert r.truncated_total == sum(min(x, k) for x in lengths)
        assert abs(r.share_up_to - sum(x <= k for x in lengths) / len(lengths)) < 1e-12
    limits = [0, 1, 7, 100, 1024, 10 ** 6]
    assert {r.context_limit: r.total_tokens for r in C.truncated_totals(sums, limits).collect()} == {m: sum(min(x, m) for x in lengths) for m in limits}
    ranked = sorted(lengths)
    for r in C.quantile_lengths(sums, [0.1, 0.5, 0.99, 1.0]).collect():
        assert r.length == next(x for x in ranked if sum(y <= x for y in ranked) >= r.share * len(ranked))


def test_empty_table(spark):
    assert C.token_counts(empty(spark)).collect() == []


def test_truncated_totals_read_the_suffix_sums(spark):
    lengths = [2, 2, 5, 9]
    rows = [(n, sum(x >= n for x in lengths), sum(min(x, n) for x in lengths)) for n in (2, 5, 9)]
    sums = spark.createDataFrame(rows, "length long, docs_at_least long, truncated_total long")  # no histogram columns
    limits = [0, 1, 2, 3, 5, 8, 9, 10]
    assert {r.context_limit: r.total_tokens for r in C.truncated_totals(sums, limits).collect()} == {m: sum(min(x, m) for x in lengths) for m in limits}
    assert [r.total_tokens for r in C.truncated_totals(sums.limit(0), [7]).collect()] == [0]
