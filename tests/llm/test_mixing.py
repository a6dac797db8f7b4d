from collections import Counter

import pytest

from kestrelgrid.llm import mixing

from .cases import documents


def fill(sizes, weights, total, most=3):
    """Targets by resharing again and again."""
    open_, out = set(sizes), {}
    while True:
        left = total - sum(out.values())
        level = left / sum(weights[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weights[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weights[s] for s in open_}
        out |= {s: most * sizes[s] for s in over}
        open_ -= over


def seats(votes, n):
    """Sainte-Lague, one seat after the other."""
    got = [0] * len(votes)
    for _ in range(n):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


@pytest.mark.parametrize("votes", [[100, 1, 1, 1, 1, 1, 1, 1], [53, 24, 23], [7, 7, 7, 7], [1000, 3], [5], [0, 9, 0]])
@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_apportionment_equals_seat_by_seat(spark, votes, n):
    df = spark.createDataFrame([(i, float(v), n, 10**6) for i, v in enumerate(votes)], "i int, v double, n long, top long")
    got = {r.i: r.got for r in mixing.apportion(df, [], "v", "n", "top", "i", "got").collect()}
    assert [got[i] for i in range(len(votes))] == seats(votes, n)


def test_targets_stop_and_the_excess_is_reshared(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, "d": 400, "e": 30}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    weights = dict(zip("abcde", (5, 2, 1, 5, 2), strict=True))
    want = fill(sizes, weights, sum(sizes.values()))
    assert {r.source: r.weight for r in got} == weights
    assert {r.source: r.target for r in got} == pytest.approx(want)


def test_a_hot_source_among_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    rows = [(i, "w " * (i % 7 + 1), "hot" if i % 3 else f"s{i % 5}") for i in range(300)]
    got = mixing.mix(documents(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    for s in set(source.values()):
        mine = [r for r in got if source[r.doc_id] == s]
        assert sum(r["size"] for r in mine) == mine[0].source_size
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.03, abs=3)
        assert all(0 <= r.taken <= 3 * r["size"] for r in mine)
    again = mixing.mix(documents(spark, rows).repartition(7)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}


def test_small_sources_beside_full_shards_get_their_targets(spark):
    """A document of five words and a few short ones, beside shards of 2,000 rows whose blocks would be longer."""
    rows = [(i, "w " * 40, f"big{i % 2}") for i in range(8_000)] + [(9_000, "a b c d e", "one")] + [(9_001 + i, "w " * 30, "short") for i in range(3)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in rows}
    for s in ("big0", "big1", "one", "short"):
        mine = [r for r in got if source[r.doc_id] == s]
        assert sum(r.taken for r in mine) == pytest.approx(mine[0].target, rel=0.001)
    assert [r.taken for r in got if r.doc_id == 9_000] == [15]


def test_hard_rows(spark):
    df = documents(spark)
    got = mixing.mix(df).collect()
    assert len(got) == df.count()
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.mix(df.limit(0)).count() == 0
    blank = mixing.mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert {(r["size"], r.target, r.taken) for r in blank} == {(0, 0.0, 0)}


def test_the_mixed_corpus_holds_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i % 9 + 1)) + "\n", f"s{i % 4}") for i in range(80)]
    df = documents(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want = {r.doc_id: r.taken for r in mixing.mix(df).collect() if r.taken}
    got = {}
    text = {i: t for i, t, _ in rows}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert text[r.doc_id].startswith(r.text)
    assert got == want


def test_the_mixed_corpus_with_null_and_repeated_keys(spark):
    keys = [None] * 6 + [1] * 5 + list(range(2, 12))
    rows = [(k, " ".join(f"w{i}_{j}" for j in range(i % 5 + 1)), f"s{i % 3}") for i, k in enumerate(keys)]
    df = documents(spark, rows)
    want = Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.taken
    key = {t.split()[0]: (k, len(t.split())) for k, t, _ in rows}
    got, words = Counter(), Counter()
    for r in mixing.mixed_documents(df).collect():
        first, n = r.text.split()[0], len(r.text.split())
        assert r.doc_id == key[first][0]
        got[r.doc_id] += n
        words[first] += n
    assert got == +want
    assert want[None] and want[1]
    assert all(n <= 3 * key[t][1] for t, n in words.items())


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(documents(spark))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
