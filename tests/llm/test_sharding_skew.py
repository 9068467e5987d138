"""Large groups are cut only where no shard can hold them, and into as few parts as it takes."""

from collections import Counter

from gridloom.llm import sharding


def test_hot_group_fills_whole_shards(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else f"single {i}") for i in range(4800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(docs).collect()
    counts = Counter(r.shard for r in got)
    assert set(counts.values()) == {600}
    text = dict(rows)
    where: dict[str, Counter] = {}
    for r in got:
        where.setdefault(text[r.doc_id], Counter())[r.shard] += 1
    assert sum(n for _, n in where["hot"].most_common(3)) >= 0.95 * where["hot"].total()  # three parts; few rows even out the shards
    pairs = [c for t, c in where.items() if t.startswith("pair")]
    assert sum(len(c) == 1 for c in pairs) >= 0.9 * len(pairs)


def spread(spark, sizes, rows):
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
    texts += [f"single {i}" for i in range(rows - len(texts))]
    got = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == rows
    where = [Counter() for _ in sizes]
    for r in got:
        if texts[r.doc_id].startswith("group"):
            where[int(texts[r.doc_id].split()[1])][r.shard] += 1
    return where


def test_groups_that_fit_are_not_cut(spark):
    assert [len(c) for c in spread(spark, [560] * 4, 6400)] == [1] * 4
    assert [len(c) for c in spread(spark, [790, 700, 300, 90, 90, 40, 13, 2, 2], 6400)] == [1] * 9


def test_more_groups_than_shards_can_hold_whole(spark):
    where = spread(spark, [480] * 10, 6400)
    assert sum(len(c) == 1 for c in where) >= 8
    assert all(sum(n for _, n in c.most_common(2)) >= 0.95 * 480 for c in where)


def test_placement_against_every_assignment():
    # With room for all, no group is cut wherever some assignment cuts none.
    import itertools
    import random

    r = random.Random(4)
    for _ in range(200):
        sizes = [r.randint(1, 10) for _ in range(r.randint(1, 6))]
        shards, quota = 3, max(10, -(-sum(sizes) * 5 // 12))
        fits = any(all(sum(n for n, s in zip(sizes, to, strict=True) if s == x) <= quota for x in range(shards)) for to in itertools.product(range(shards), repeat=len(sizes)))
        plan, load = sharding.place_large([(bytes([i]), n) for i, n in enumerate(sizes)], quota, shards)
        assert sum(load.values()) == sum(sizes) and max(load.values()) <= quota
        assert all(abs(e[-1] - 1) < 1e-9 for _, e, _ in plan)
        if fits:
            assert all(len(to) == 1 for _, _, to in plan)
