"""Queries on tables that the samples do not hold: more keys, more copies, larger groups; each equals its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans.registry import QUERIES, SQL
from tests.test_queries import SF, TABLES, plain

entry._reference()


@pytest.fixture
def same(spark, tmp_path):
    """Runs a query over the small tables, of which some are given as SQL over them, and compares it with its SQL; the query's rows."""

    def run(name: str, **tables: str):
        db = duckdb.connect()
        for t in TABLES.split():
            db.execute(f"create view old_{t} as select * from '{SF}/{t}.parquet'")
            db.execute(f"copy ({tables.get(t, f'select * from old_{t}')}) to '{tmp_path}/{t}.parquet' (format parquet)")
            db.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        got = QUERIES[name](spark, str(tmp_path)).toPandas()
        assert plain(got) == plain(db.sql(SQL[name]).df())
        return got

    return run


def test_labels_of_more_than_16_bits(same):
    lines = "select * replace ((l_partkey + 70000)::bigint as l_partkey, (l_suppkey + 65530)::bigint as l_suppkey) from old_lineitem where l_orderkey < 50"
    assert same("X4_S3_labels", lineitem=lines)["instance"].min() > 65535


def test_topk_code_makes_each_power_once(spark, capsys):
    QUERIES["T1_topk_code"](spark, SF).explain(True)
    plan = capsys.readouterr().out.split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert plan.lower().count("exp(") == 1


@pytest.mark.parametrize("blocks", [(4096, 1 << 18), (3, 40)])
def test_masks_meet_in_blocks(same, monkeypatch, blocks):
    from gridloom.operators import mask

    monkeypatch.setattr(mask, "BLOCK_MASKS", blocks[0])
    monkeypatch.setattr(mask, "BLOCK_WORDS", blocks[1])
    lines = "select l.* replace ((l_suppkey + 100 * r)::bigint as l_suppkey, l_quantity + r % 2 as l_quantity) from old_lineitem l, range(3) t(r) where l_orderkey < 300"
    assert len(same("A23_pair_iou", lineitem=lines))
    assert len(same("C1_mask_suppression", lineitem=lines))


def test_equal_boxes_stand_for_each_other(same, spark):
    from gridloom.operators import crops

    lines = "select * replace ((l_suppkey + 100 * r)::bigint as l_suppkey) from old_lineitem, range(4) t(r)"
    same("C2_greedy_boxes", lineitem=lines)
    same("C4_crop_assembly", lineitem=lines)
    boxes = spark.createDataFrame([(0, n, 0, 0, 9, 9, 1.0) for n in range(500)] + [(0, 900, 3, 3, 3, 9, 1.0), (0, 901, 3, 3, 3, 9, 1.0)], "group int, box_id int, x0 int, y0 int, x1 int, y1 int, score double")
    assert sorted(r.box_id for r in crops.unequal(boxes, 0.7).collect()) == [0, 900, 901]


def test_alike_boxes_go_without_pairs(spark, monkeypatch):
    """Boxes around a few places: what rounds of buckets keep is what the pairs keep, and no pairs are made of the many that go."""
    import random

    from gridloom.operators import crops

    rng, rows = random.Random(3), []
    for n in range(120):
        x, y = rng.choice([(0, 0), (40, 7), (-90, 60)])
        x0, y0 = x + rng.uniform(-2, 2), y + rng.uniform(-2, 2)
        rows.append((n % 2, n, x0, y0, x0 + rng.uniform(0, 25), y0 + rng.uniform(8, 12), float(rng.randint(0, 9))))
    boxes = spark.createDataFrame(rows, "group int, box_id int, x0 double, y0 double, x1 double, y1 double, score double")
    want = {tuple(r) for r in crops.settled(boxes, crops.overlapping(boxes, 0.6)).collect()}
    assert len(want) < 90
    seen = []
    monkeypatch.setattr(crops, "FEW", 0)
    monkeypatch.setattr(crops, "overlapping", lambda rows, *_: seen.append(rows.count()) or rows.select("group", rows["box_id"].alias("better"), rows["box_id"].alias("worse")))
    assert {tuple(r) for r in crops.greedy(boxes, 0.6).collect()} == want
    assert seen == [0]


def test_words_of_pixels_reach_over_their_ends(same, spark):
    from gridloom.operators import mask

    same("X17_erosion", lineitem="select * replace ((l_suppkey % 3)::bigint as l_suppkey, l_extendedprice * 7 as l_extendedprice) from old_lineitem")
    square = [(1, 1, r, c) for r in range(-2, 2) for c in range(-34, 35)]
    got = mask.erode(spark.createDataFrame(square * 2, "image_id int, mask_id int, row int, col int"))
    assert sorted((r.row, r.col) for r in got.collect()) == sorted((r, c) for r in range(-2, 2) for c in range(-34, 35) if (c not in (-34, 34)) or r in (-1, 0))


def test_products_do_not_move(spark):
    plan = QUERIES["X11_relevancy"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Cross") < plan.index("Join Inner")


def test_copies_of_points(same):
    people = "select c.* replace ((c_custkey + r * 400)::bigint as c_custkey) from old_customer c, range(7) t(r)"
    assert (same("C7_core_distances", customer=people)["core"] == 0).all()
    sellers = "select s.* replace ((s_suppkey + r * 100)::bigint as s_suppkey) from old_supplier s, range(4) t(r)"
    assert len(same("C7_spanning_tree", supplier=sellers)) == 39


def pairs_met(monkeypatch, *modules):
    """Counts of the pairs that radius joins make from now on."""
    from gridloom.operators import spatial

    made, join = [], spatial.radius_join

    def counted(*args, **kwargs):
        out = join(*args, **kwargs)
        made.append(out.count())
        return out

    for m in modules:
        monkeypatch.setattr(m, "radius_join", counted)
    return made


def test_places_meet_places(spark, monkeypatch):
    """Copies of points cost no pairs, neither those that ask nor those that are met."""
    from gridloom.operators import density, spatial

    schema = "pid long, x double, y double, z double"
    rows = [(100 * i + c, float(i * i % 17), float(i), -0.0 if c % 2 else 0.0) for i in range(20) for c in range(3)]
    points, others = spark.createDataFrame(rows, schema), spark.createDataFrame([(i, x + 0.25, y, z) for i, x, y, z in rows], schema)
    made = pairs_met(monkeypatch, density, spatial)
    places = {r[1:]: 3 for r in rows if r[0] % 100 == 0}
    far = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5
    cores = {r.id: r.core for r in density.core_distances(points, 5, 32.0).collect()}
    assert cores == {i: pytest.approx(sorted(far(p, q) for q in places for _ in range(3))[4]) for i, *p in rows}
    assert sum(made) <= 20 * 20 * len(made)
    assert {r.core for r in density.core_distances(points, 3, 32.0).collect()} == {0.0}
    made.clear()
    got = sorted((r.a_id, r.rank, r.b_id) for r in spatial.nearest(points, others, 32.0, k=2).collect())
    want = [(i, n, b) for i, *p in rows for n, (_, b) in enumerate(sorted((far(p, q), b) for b, *q in others.collect())[:2])]
    assert got == sorted(want) and sum(made) <= 20 * 40 * len(made)


def test_labels_of_noise_are_made_once(spark):
    from pyspark.sql import functions as F

    from gridloom.operators import cluster

    made = spark.sparkContext.accumulator(0)

    def label(n):
        made.add(1)
        return n if n % 3 == 0 else -1

    points = spark.range(30).select(F.col("id").alias("pid"), *[(F.col("id") * F.col("id") + n).cast("double").alias(a) for n, a in enumerate("xyz")])
    labels = spark.range(30).select("id", F.udf(label, "int")("id").alias("label"))
    got = {r.id: r.label for r in cluster.fill_noise(points, labels, 4.0).collect()}
    assert got == {n: min((abs(m * m - n * n), m) for m in range(0, 30, 3))[1] for n in range(30)}
    assert made.value == 30


def test_trees_come_to_the_driver_as_columns(spark, monkeypatch):
    from gridloom.operators import density

    points = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(9)], "pid long, x double, y double, z double")
    monkeypatch.setattr(type(points), "toPandas", lambda *_: 1 / 0)
    assert {r.label for r in density.cluster(points, 3, 3, 4.0).collect()} == {-1}


def blocks_made(monkeypatch, module):
    """The staged blocks of masks that are made from now on."""
    made, stage = [], module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: made.append((name, out := stage(df, name))) or out)
    return lambda: [df for name, df in made if name == "mask-blocks" and "trow" in df.columns]


def test_a_task_makes_few_blocks(same, monkeypatch):
    """However many blocks there are, a task makes some and not all that fit into a shuffle partition."""
    from pyspark.sql import functions as F

    from gridloom.operators import mask

    monkeypatch.setattr(mask, "BLOCK_MASKS", 2)
    made = blocks_made(monkeypatch, mask)
    same("C1_mask_suppression", lineitem="select * from old_lineitem where l_orderkey < 300")
    (blocks,) = made()
    files = [r["count"] for r in blocks.groupBy(F.input_file_name()).count().collect()]
    assert sum(files) > 20 and max(files) <= 8


def test_pairs_come_in_runs_of_equal_areas(spark):
    """Rows of a mask's pairs are in order of the other's area, which then takes next to no room."""
    from gridloom.operators import mask

    rows = [(0, m, 0, c) for m in range(60) for c in range(1 + m * 37 % 60)]
    got = mask.pair_overlaps(spark.createDataFrame(rows, "image_id long, mask_id long, row int, col int")).collect()
    runs = {}
    for r in got:
        runs.setdefault((r.a, r.a < r.b), []).append(r.area_b)
    assert len(got) == 60 * 59 // 2 and all(areas == sorted(areas) for areas in runs.values())
