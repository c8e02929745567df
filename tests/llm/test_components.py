import math
import random

import pytest

from factloom.llm.components import connected_groups, contract

SCHEMA = "a long, b long, id string, group_id string"


def brute(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        root.setdefault(a, a), root.setdefault(b, b)
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in root}


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_groups_equal_brute_force_with_nulls_loops_repeats_and_clashing_names(spark, block):
    rng = random.Random(block)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(520)]
    edges += [(x, x + 1) for x in range(2000, 2150)] + [(3000, x) for x in range(3001, 3100)]
    edges += [(5, 5), (None, 3), (7, None), (None, None), (9999, 9999)] + edges[:40] + [(b, a) for a, b in edges[:40]]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in edges], SCHEMA).repartition(6)
    got = [tuple(r) for r in connected_groups(df, "a", "b", block=block, fan_in=2).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(edges)


def test_levels_on_a_rising_chain(spark):
    block, links = 500, 50_000
    chain = spark.range(links, numPartitions=4).selectExpr("id a", "id + 1 b").repartition(7)
    _, levels = contract(chain, block, 8)
    assert len(levels) <= 2 * math.log2(links / block)
    groups = connected_groups(chain, "a", "b", block=block)
    assert groups.count() == links + 1 and groups.where("group_id <> 0").count() == 0


def test_empty(spark):
    assert connected_groups(spark.createDataFrame([], SCHEMA), "a", "b").collect() == []
