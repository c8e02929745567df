import random
from collections import Counter, defaultdict

import pytest

from factloom.llm.containers import fill, fill_report, pack_histogram


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for n in range(len(bins)):
            if bins[n] + items[k] <= capacity and bins[n] not in tried:
                tried.add(bins[n])
                bins[n] += items[k]
                go(k + 1, bins)
                bins[n] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def test_packing_is_whole_and_the_reduction_keeps_the_optimum():
    rng, beyond = random.Random(1), 0
    for _ in range(600):
        capacity = rng.randrange(3, 30)
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))]
        patterns = pack_histogram(dict(Counter(items)), capacity)
        got, fixed = Counter(), []
        for sizes, n, how in patterns:
            assert sum(sizes) <= capacity and n > 0
            got.update({s: sizes.count(s) * n for s in set(sizes)})
            fixed += [sizes] * n if how == "reduced" else []
        assert got == Counter(items)
        rest = Counter(items) - Counter(x for s in fixed for x in s)
        best = optimum(items, capacity)
        assert len(fixed) + optimum(list(rest.elements()), capacity) == best
        beyond += sum(n for _, n, _ in patterns) - best
    assert beyond <= 10


@pytest.mark.parametrize("group", [3, 200_000])
def test_fill_places_every_item_once(spark, group):
    rng = random.Random(7)
    rows = [(k, rng.choice([0, None, -1, 5, 5, 5, 7, 40, 64, 65, 129, 128, rng.randrange(1, 300)]), "x", 0) for k in range(900)] + [(3, 9, "x", 0), (3, 9, "x", 0), (None, 6, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, container_id string, size int")
    placed = fill(df, "doc_id", "n_tokens", 64, rows_a_group=group)
    got = placed.collect()
    used, pieces = defaultdict(list), Counter()
    for r in got:
        used[r.container_id].append((r.offset, r.offset + r["size"]))
        pieces[(r.doc_id, r.start, r["size"])] += 1
    want = Counter()
    for k, n, *_ in rows:
        for start in range(0, n or 0, 64):
            want[(k, start, min(64, n - start))] += 1
    assert pieces == want
    for spans in used.values():
        spans.sort()
        assert spans[-1][1] <= 64 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    report = fill_report(placed, 64).collect()[0]
    assert report.n_containers == len(used) == max(used) + 1 and report.fill > 0.97


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert fill(df, "doc_id", "n_tokens", 64).collect() == [] and fill_report(fill(df, "doc_id", "n_tokens", 64), 64).collect() == []
    with pytest.raises(ValueError):
        fill(df, "doc_id", "n_tokens", 0)
