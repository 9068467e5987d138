"""Queries over masks, vectors, metrics, clusters, strings and sets (rows A, C, F, J, K, T, U, X, M)."""

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import quantile, vec
from gridloom.operators import cluster, mask, metrics, order, relational, sample, vector, voxel
from gridloom.plans.inputs import DENSE, DOT, LINES, PIX, PTS, cells, dense, pixels, points, vectors
from gridloom.plans.registry import query
from gridloom.sources import sinks
from gridloom.streaming import fusion
from gridloom.session import table

# ---- masks


PAIRS = f"{PIX}, ar AS (SELECT image_id, mask_id, count(*) AS area FROM pix GROUP BY 1,2), sh AS (SELECT image_id, a.mask_id AS a, b.mask_id AS b, count(*) AS shared FROM pix a JOIN pix b USING (image_id, row, col) WHERE a.mask_id < b.mask_id GROUP BY 1,2,3), pr AS (SELECT sh.*, x.area AS area_a, y.area AS area_b, shared/(x.area+y.area-shared)::DOUBLE AS iou FROM sh JOIN ar x ON x.image_id=sh.image_id AND x.mask_id=a JOIN ar y ON y.image_id=sh.image_id AND y.mask_id=b)"


@query("A23_pair_iou", f"WITH {PAIRS} SELECT image_id, a, b, shared, area_a, area_b, iou FROM pr")
def a23(spark, d):
    return mask.pair_overlaps(pixels(spark, d))


@query("C1_mask_suppression", f"WITH {PAIRS}, rk AS (SELECT image_id, mask_id, area/64::DOUBLE AS score, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, mask_id) AS rank FROM ar), p1 AS (SELECT pr.*, r1.rank AS ra, r2.rank AS rb FROM pr JOIN rk r1 ON r1.image_id=pr.image_id AND r1.mask_id=a JOIN rk r2 ON r2.image_id=pr.image_id AND r2.mask_id=b), p2 AS (SELECT image_id, iou, CASE WHEN ra<rb THEN a ELSE b END AS better, CASE WHEN ra<rb THEN b ELSE a END AS worse, abs(ra-rb)=1 AS nxt, shared/(CASE WHEN ra<rb THEN area_a ELSE area_b END)::DOUBLE AS fb, shared/(CASE WHEN ra<rb THEN area_b ELSE area_a END)::DOUBLE AS fw FROM p1), ov AS (SELECT image_id, worse AS mask_id, iou, CASE WHEN fb<0.5 AND fw>=0.85 THEN 1-fb*fw ELSE 0 END AS u, CASE WHEN nxt AND fb<0.5 AND fw>=0.85 THEN 1-fb*fw ELSE 0 END AS l FROM p2 UNION ALL SELECT image_id, better, 0, 0, CASE WHEN fw<0.5 AND fb>=0.85 THEN 1-fb*fw ELSE 0 END FROM p2), ws AS (SELECT image_id, mask_id, max(iou) AS iou_better, max(u) AS u, max(l) AS l FROM ov GROUP BY 1,2), rows AS (SELECT rk.*, coalesce(iou_better,0) AS iou_better, coalesce(u,0) AS in_better, coalesce(l,0) AS in_worse FROM rk LEFT JOIN ws USING (image_id, mask_id)), ok AS (SELECT *, bool_or(score>0.1) OVER i AS anys, bool_or(in_better<=0.4::DOUBLE) OVER i AS anyu, bool_or(in_worse<=0.4::DOUBLE) OVER i AS anyl FROM rows WINDOW i AS (PARTITION BY image_id)) SELECT image_id, mask_id, score, rank::INT AS rank, iou_better, in_better, in_worse, (iou_better<=0.05 AND (CASE WHEN anys THEN score>0.1 ELSE rank<=3 END) AND (CASE WHEN anyu THEN in_better<=0.4::DOUBLE ELSE rank<=3 END) AND (CASE WHEN anyl THEN in_worse<=0.4::DOUBLE ELSE rank<=3 END)) AS kept FROM ok")
def c1(spark, d):
    px = pixels(spark, d)
    scores = px.groupBy("image_id", "mask_id").agg((F.count("*") / 64.0).alias("score"))
    return mask.suppress(px, scores, iou_most=0.05, inner=0.6)


@query("C2_greedy_boxes", f"""WITH RECURSIVE {PIX}, bx AS (SELECT image_id, mask_id AS box_id, min(col) AS x0, min(row) AS y0, max(col) AS x1, max(row) AS y1, count(*)::DOUBLE AS score FROM pix GROUP BY 1,2),
    rk AS (SELECT *, (x1-x0)*(y1-y0) AS area, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS n FROM bx),
    step(image_id, n, kept) AS (SELECT image_id, n, [{{'id': box_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'area': area, 'score': score}}] FROM rk WHERE n=1
        UNION ALL SELECT rk.image_id, rk.n, CASE WHEN len(list_filter(list_transform(kept, lambda b: [greatest(least(b.x1,rk.x1)-greatest(b.x0,rk.x0),0)*greatest(least(b.y1,rk.y1)-greatest(b.y0,rk.y0),0), b.area+rk.area]), lambda s: s[2]>s[1] AND s[1]/(s[2]-s[1])::DOUBLE > 0.7::DOUBLE))=0
            THEN list_append(kept, {{'id': rk.box_id, 'x0': rk.x0, 'y0': rk.y0, 'x1': rk.x1, 'y1': rk.y1, 'area': rk.area, 'score': rk.score}}) ELSE kept END FROM step JOIN rk ON rk.image_id=step.image_id AND rk.n=step.n+1),
    ends AS (SELECT image_id, unnest(arg_max(kept, n)) AS b FROM step GROUP BY 1) SELECT image_id, b.id AS box_id, b.score AS score FROM ends""")
def c2(spark, d):
    b = pixels(spark, d).groupBy("image_id", F.col("mask_id").alias("box_id")).agg(F.min("col").alias("x0"), F.min("row").alias("y0"), F.max("col").alias("x1"), F.max("row").alias("y1"), F.count("*").cast("double").alias("score"))
    return mask.greedy_boxes(b)


@query("C5_segmentation_map", f"WITH {PIX}, p AS (SELECT image_id, mask_id % 4 AS scale, mask_id//4 AS o, row, col FROM pix), off AS (SELECT image_id, scale, coalesce(sum(t+1) OVER (PARTITION BY image_id ORDER BY scale ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS off FROM (SELECT image_id, scale, max(o) AS t FROM p GROUP BY 1,2)) SELECT p.image_id, p.scale, row, col, (max(o)+any_value(off))::BIGINT AS id FROM p JOIN off ON p.image_id=off.image_id AND p.scale=off.scale GROUP BY 1,2,3,4")
def c5(spark, d):
    px = pixels(spark, d).select("image_id", (F.col("mask_id") % 4).alias("scale"), F.floor(F.col("mask_id") / 4).cast("long").alias("mask_order"), "row", "col")
    return mask.segmentation_map(px)


@query("A43_pixel_stacks", f"WITH {PIX}, s AS (SELECT image_id, row, col, list(mask_id ORDER BY mask_id) AS m FROM pix GROUP BY 1,2,3), dd AS (SELECT image_id, max(len(m)) AS deepest FROM s GROUP BY 1) SELECT image_id, row, col, len(m)::INT AS depth, deepest::INT AS padded, m[1] AS first_mask FROM s JOIN dd USING (image_id)")
def a43(spark, d):
    out = mask.pad_stacks(mask.pixel_stacks(pixels(spark, d)))
    return out.select("image_id", "row", "col", "depth", F.size("mask_ids").alias("padded"), F.col("mask_ids")[0].alias("first_mask"))


@query("A21_probability_cdf", f"WITH {PIX}, c AS (SELECT image_id, mask_id, count(*) AS n FROM pix GROUP BY 1,2), s AS (SELECT *, ln(n::DOUBLE/sum(n) OVER (PARTITION BY image_id)::DOUBLE) AS lp FROM c) SELECT image_id, row, col, mask_id, round(coalesce((sum(lp) OVER (PARTITION BY image_id,row,col ORDER BY mask_id))/nullif(sum(lp) OVER (PARTITION BY image_id,row,col),0),1.0::DOUBLE),6) AS cdf FROM pix JOIN s USING (image_id, mask_id)")
def a21(spark, d):
    return mask.probability_cdf(pixels(spark, d)).withColumn("cdf", F.round("cdf", 6))


@query("W15_pick_by_cdf", f"WITH {PIX}, s AS (SELECT image_id, row, col, list(mask_id ORDER BY mask_id) AS m FROM pix GROUP BY 1,2,3), u AS (SELECT *, ((image_id*7+row*3+col) % 16)/16::DOUBLE AS u FROM s) SELECT image_id, row, col, m[least(len(list_filter(range(1,len(m)+1), lambda x: u > x/len(m)::DOUBLE))+1, len(m))] AS picked FROM u")
def w15(spark, d):
    s = mask.pixel_stacks(pixels(spark, d))
    cdf = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda n: n / F.col("depth"))
    u = ((F.col("image_id") * 7 + F.col("row") * 3 + F.col("col")) % 16) / 16.0
    return s.select("image_id", "row", "col", mask.pick_by_cdf(cdf, F.col("mask_ids"), u).alias("picked"))


@query("X17_erosion", f"WITH {PIX}, o AS (SELECT unnest([-1,0,1]) AS s) SELECT image_id, mask_id, row+a.s AS row, col+b.s AS col FROM pix, o a, o b GROUP BY ALL HAVING count(*)>=5")
def x17(spark, d):
    return mask.erode(pixels(spark, d))


@query("F15_components", f"""WITH RECURSIVE {PIX}, p AS (SELECT DISTINCT image_id, row, col FROM pix),
    lab(image_id, row, col, label) USING KEY (image_id, row, col) AS (SELECT image_id, row, col, row*100000+col FROM p
        UNION SELECT own.image_id, own.row, own.col, min(new.label) FROM lab new JOIN recurring.lab own ON own.image_id=new.image_id AND abs(own.row-new.row)<=1 AND abs(own.col-new.col)<=1 WHERE new.label<own.label GROUP BY 1,2,3)
    SELECT image_id, 0 AS mask_id, row, col FROM (SELECT *, count(*) OVER (PARTITION BY image_id, label) AS n FROM lab) WHERE n>=20""")
def f15(spark, d):
    return mask.drop_islands(pixels(spark, d).select("image_id", F.lit(0).alias("mask_id"), "row", "col").distinct(), 20)


@query("F7_F8_mask_filters", f"WITH {PIX} SELECT image_id, mask_id, count(*) AS area FROM pix GROUP BY 1,2 HAVING count(*) <= 0.95::DOUBLE*100")
def f78(spark, d):
    return mask.area_filter(pixels(spark, d).groupBy("image_id", "mask_id").agg(F.count("*").alias("area")), 100)


@query("X16_box_mean", f"WITH {DENSE} SELECT a.image_id, a.row, a.col, sum(b.value)/count(*)::DOUBLE AS box FROM dense a JOIN dense b ON a.image_id=b.image_id AND b.row BETWEEN a.row-3 AND a.row+3 AND b.col BETWEEN a.col-3 AND a.col+3 GROUP BY 1,2,3")
def x16(spark, d):
    return mask.box_mean(dense(spark, d), "value", 3, ["image_id"]).select("image_id", "row", "col", "box")


@query("X16_relevancy_mask", f"""WITH {DENSE}, bm AS (SELECT a.image_id, a.row, a.col, 0.5::DOUBLE*(sum(b.value)/count(*)::DOUBLE + any_value(a.value)) AS blend FROM dense a JOIN dense b ON a.image_id=b.image_id AND abs(b.row-a.row)<=3 AND abs(b.col-a.col)<=3 GROUP BY 1,2,3),
    un AS (SELECT *, (blend-min(blend) OVER i)/(max(blend) OVER i-min(blend) OVER i+1e-9) AS unit FROM bm WINDOW i AS (PARTITION BY image_id)),
    m AS (SELECT image_id, row, col, least(greatest(unit*2-1,0),1)>0.4::DOUBLE AS mask FROM un)
    SELECT a.image_id, a.row, a.col, avg(b.mask::INT)>0.5 AS mask FROM m a JOIN m b ON a.image_id=b.image_id AND abs(b.row-a.row)<=1 AND abs(b.col-a.col)<=1 GROUP BY 1,2,3""")
def x16b(spark, d):
    px = dense(spark, d).withColumn("value", F.col("value").cast("double"))
    return mask.majority(mask.relevancy_mask(px, "value", ["image_id"], half=3), "mask", 1, ["image_id"]).select("image_id", "row", "col", "mask")


@query("X20_resize_nearest", f"WITH {DENSE} SELECT image_id, r::INT AS row, c::INT AS col, value FROM dense JOIN range(26) t(r) ON floor(r*52/26)=row JOIN range(11) s(c) ON floor(c*22/11)=col")
def x20(spark, d):
    return mask.resize_nearest(dense(spark, d), "value", (52, 22), (26, 11))


@query("A44_masks_by_id", f"WITH {PIX} SELECT image_id, mask_id, count(*) AS area, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, mask_id)::INT AS place FROM pix GROUP BY 1,2")
def a44(spark, d):
    areas = pixels(spark, d).groupBy("image_id", "mask_id").agg(F.count("*").alias("area"))
    return areas.withColumn("place", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("area"), "mask_id")))


@query("U1_mask_union", f"WITH {PIX} SELECT DISTINCT image_id, row, col FROM pix")
def u1(spark, d):
    return pixels(spark, d).select("image_id", "row", "col").distinct()


# ---- vectors


PAIR_DOT = f"round({DOT},6)"


@query("X5_X12_affinity", f"SELECT a.vec_id, b.vec_id AS click, {PAIR_DOT} AS affinity FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) b WHERE {DOT} >= 0.3")
def x12(spark, d):
    e = vectors(spark, d)
    return vector.affinities(e, e.where("vec_id % 50 = 0"), 0.3).withColumn("affinity", F.round("affinity", 6))


REL = "WITH n AS (SELECT vec_id, max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS neg FROM (SELECT vec_id, embedding FROM embeddings) a, (SELECT embedding FROM embeddings WHERE vec_id % 50 = 25) b GROUP BY vec_id)".replace("SELECT vec_id, max", "SELECT a.vec_id, max").replace("GROUP BY vec_id", "GROUP BY a.vec_id")


@query("X11_relevancy", f"{REL} SELECT a.vec_id, b.vec_id AS phrase_id, round(1/(1+exp(-10*({DOT}-neg))),6) AS relevancy FROM embeddings a JOIN n USING (vec_id), (SELECT * FROM embeddings WHERE vec_id % 50 = 0) b")
def x11(spark, d):
    e = vectors(spark, d)
    phrases = e.where("vec_id % 50 in (0, 25)").select(F.col("vec_id").alias("phrase_id"), (F.col("vec_id") % 50 == 0).alias("positive"), F.col("embedding").alias("vec"))
    return vector.score_phrases(e, phrases).select("vec_id", F.col("phrase_id").cast("long").alias("phrase_id"), F.round("relevancy", 6).alias("relevancy"))


@query("X13_negative_evidence", f"WITH m AS (SELECT a.vec_id, max(CASE WHEN b.vec_id % 50 = 0 THEN {DOT} END) AS p, max(CASE WHEN b.vec_id % 50 = 25 THEN {DOT} END) AS n FROM embeddings a, embeddings b WHERE b.vec_id % 50 IN (0,25) GROUP BY 1) SELECT vec_id, (p>=0.3 AND p>n*0.5::DOUBLE) AS dominate, p-n*0.5::DOUBLE>=0.3::DOUBLE AS subtract, (p>=0.3 AND n<0.5) AS veto FROM m")
def x13(spark, d):
    e = vectors(spark, d)
    out = vector.strongest(e, e.where("vec_id % 50 = 0"), "p").join(vector.strongest(e, e.where("vec_id % 50 = 25"), "n"), "vec_id")
    return out.select("vec_id", *[vector.negative_evidence(F.col("p"), F.col("n"), m, 0.3, 0.5).alias(m) for m in ("dominate", "subtract", "veto")])


@query("J21_codebook_assign", "WITH m AS (SELECT a.vec_id, b.vec_id AS code, sqrt(list_sum(list_transform(list_zip(a.embedding,b.embedding), lambda z: (z[1]::DOUBLE-z[2]::DOUBLE)*(z[1]::DOUBLE-z[2]::DOUBLE)))) AS dist FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) b) SELECT vec_id, arg_min(code, dist) AS code, round(min(dist),6) AS code_distance FROM m GROUP BY 1")
def j21(spark, d):
    e = vectors(spark, d)
    found = vector.nearest_codes(e, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "code"))
    return found.select("vec_id", "code", F.round("code_distance", 6).alias("code_distance"))


@query("T1_topk_code", "WITH e AS (SELECT vec_id, unnest(range(64)) AS n, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT *, exp(v)/sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, n) AS rk FROM s) SELECT vec_id, n::INT AS code, round(p/(sum(p) OVER (PARTITION BY vec_id)+1e-10),6) AS w FROM r WHERE rk <= 4")
def t1(spark, d):
    rows = vectors(spark, d).select("vec_id", F.explode(vector.topk_code(F.col("embedding"), 4)).alias("code", "w"))
    return rows.withColumn("w", F.round("w", 6))


@query("C10_decode", "WITH e AS (SELECT vec_id, unnest(range(64)) AS n, unnest(embedding)::DOUBLE AS v FROM embeddings), b AS (SELECT n AS code, label AS pos, sum(v) AS value FROM e JOIN embeddings USING (vec_id) GROUP BY 1,2) SELECT vec_id, pos, round(sum(v*value),4) AS value FROM e JOIN b ON n=code GROUP BY 1,2")
def c10(spark, d):
    e = vectors(spark, d).select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("code", "w"))
    book = e.groupBy("code", F.col("label").alias("pos")).agg(F.sum("w").alias("value"))
    return vector.decode(e.select("vec_id", "code", "w"), book, ["vec_id"]).withColumn("value", F.round("value", 4))


@query("P29_unit_norm", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[],embedding::DOUBLE[]))/(sqrt(list_dot_product(embedding::DOUBLE[],embedding::DOUBLE[]))+0.00001),6) AS n FROM embeddings")
def p29(spark, d):
    return vectors(spark, d).select("vec_id", F.round(vec.norm(vec.unit(F.col("embedding"), 1e-5)), 6).alias("n"))


@query("X14_X15_distances", f"SELECT a.vec_id, round(sqrt(greatest(0,list_dot_product(a.embedding::DOUBLE[],a.embedding::DOUBLE[])+list_dot_product(b.embedding::DOUBLE[],b.embedding::DOUBLE[])-2*{DOT})),4) AS l2, round(greatest(0,least(1,1-{DOT}/(sqrt(list_dot_product(a.embedding::DOUBLE[],a.embedding::DOUBLE[]))*sqrt(list_dot_product(b.embedding::DOUBLE[],b.embedding::DOUBLE[]))))),6) AS err FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x14(spark, d):
    a = vectors(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(vec.l2(F.col("embedding"), F.col("other")), 4).alias("l2"), F.round(vec.cosine_error(F.col("embedding"), F.col("other")), 6).alias("err"))


@query("A26_vector_losses", f"SELECT round(sum(1-{DOT}/(sqrt(list_dot_product(a.embedding::DOUBLE[],a.embedding::DOUBLE[]))*sqrt(list_dot_product(b.embedding::DOUBLE[],b.embedding::DOUBLE[]))))/count(*),6) AS cosine_loss, round(sum(list_sum(list_transform(list_zip(a.embedding,b.embedding), lambda z: abs(z[1]::DOUBLE-z[2]::DOUBLE)))/64)/count(*),6) AS l1_loss FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def a26(spark, d):
    a = vectors(spark, d).select("vec_id", vec.dbl(F.col("embedding")).alias("p"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("t"))
    out = metrics.vector_losses(a.join(b, "vec_id"), "p", "t")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("A36_vector_accumulate", "WITH e AS (SELECT label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, pos::INT AS pos, round(sum(v),5) AS total FROM e GROUP BY 1,2")
def a36(spark, d):
    e = vectors(spark, d).select("label", F.posexplode(vec.dbl(F.col("embedding"))).alias("pos", "v"))
    return e.groupBy("label", "pos").agg(F.round(F.sum("v"), 5).alias("total"))


@query("A41_ray_features", "WITH r AS (SELECT l_orderkey, l_suppkey AS gid, sum(l_quantity) AS weight FROM lineitem GROUP BY 1,2), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY weight DESC, gid) AS rk FROM r), f AS (SELECT s_suppkey AS gid, unnest([0,1]) AS pos, unnest([s_nationkey, s_suppkey % 7])::DOUBLE AS value FROM supplier) SELECT l_orderkey, pos, sum(weight*value) AS value FROM k JOIN f USING (gid) WHERE rk <= 3 GROUP BY 1,2")
def a41(spark, d):
    rays = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_suppkey").alias("gid")).agg(F.sum("l_quantity").alias("weight"))
    feats = table(spark, d, "supplier").select(F.col("s_suppkey").alias("gid"), F.posexplode(F.array(F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 7).cast("double"))).alias("pos", "value"))
    return vector.ray_features(rays, feats, ["l_orderkey"], 3)


@query("A30_cross_entropy", "WITH e AS (SELECT label, list_transform(embedding[1:10], lambda x: x::DOUBLE*4) AS x FROM embeddings WHERE label <> 9) SELECT round(avg(ln(list_sum(list_transform(x, lambda v: exp(v))))-x[label+1]),6) AS cross_entropy, count(*) AS n FROM e")
def a30(spark, d):
    e = vectors(spark, d).select("label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 4).alias("x"))
    return metrics.cross_entropy(e, "x", "label", 9).withColumn("cross_entropy", F.round("cross_entropy", 6))


@query("A31_lovasz", f"WITH {PTS}, e AS (SELECT pid, mask_id-1 AS truth, unnest([0,1,2,3,4]) AS class, unnest([(pid % 16)/64::DOUBLE, (pid % 8)/32::DOUBLE, (pid % 4)/16::DOUBLE, (pid % 2)/8::DOUBLE, 0.125::DOUBLE]) AS p FROM pts), g AS (SELECT pid, class, (truth=class)::INT AS fg, abs((truth=class)::INT-p) AS error FROM e), j AS (SELECT *, sum(fg) OVER (PARTITION BY class) AS t, sum(fg) OVER w AS cf, sum(1-fg) OVER w AS cb FROM g WINDOW w AS (PARTITION BY class ORDER BY error DESC, pid ROWS UNBOUNDED PRECEDING)), s AS (SELECT *, 1-(t-cf)/(t+cb)::DOUBLE AS jac FROM j WHERE t>0) SELECT class::INT AS class, round(sum(error*step),6) AS loss FROM (SELECT *, jac-coalesce(lag(jac) OVER (PARTITION BY class ORDER BY error DESC, pid),0) AS step FROM s) GROUP BY 1")
def a31(spark, d):
    p = F.array(*[(F.col("pid") % m) / float(m * 4) for m in (16, 8, 4, 2)], F.lit(0.125))
    rows = points(spark, d).select("pid", (F.col("mask_id") - 1).alias("truth"), p.alias("p"))
    return metrics.lovasz(rows, "p", "truth", "pid").withColumn("loss", F.round("loss", 6))


CON = "WITH p AS (SELECT o_custkey AS image_id, o_orderkey AS pid, substr(o_orderpriority,1,1)::INT - 2 AS mask_id, (o_orderkey % 9)/8::DOUBLE AS v FROM orders), q AS (SELECT a.image_id, abs(a.v-b.v) AS dd, a.mask_id=b.mask_id AND a.pid<b.pid AS pos, a.mask_id<>b.mask_id AS neg FROM p a JOIN p b ON a.image_id=b.image_id AND a.pid<=b.pid WHERE a.mask_id>=0 AND b.mask_id>=0)"


@query("J12_A27_contrastive", f"{CON} SELECT image_id, count(*) AS pairs, sum(CASE WHEN pos THEN dd ELSE 0 END) AS pull, sum(CASE WHEN neg THEN greatest(1-dd,0) ELSE 0 END) AS push FROM q GROUP BY 1")
def a27(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("pid"), (F.substring("o_orderpriority", 1, 1).cast("int") - 2).alias("mask_id"), F.array((F.col("o_orderkey") % 9) / 8.0).alias("v"))
    return metrics.contrastive(o, "v")


# ---- metrics and aggregates


@query("A23_A25_confusion", "WITH o AS (SELECT o_orderstatus AS g, o_totalprice>150000 AS p, substr(o_orderpriority,1,1)::INT<=2 AS t FROM orders) SELECT g, count(*) FILTER (p AND t) AS inter, count(*) FILTER (p OR t) AS \"union\", coalesce((count(*) FILTER (p AND t))/nullif(count(*) FILTER (p OR t),0)::DOUBLE,0) AS iou, (count(*) FILTER (p=t))/count(*)::DOUBLE AS accuracy FROM o GROUP BY g")
def a25(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("g"), (F.col("o_totalprice") > 150000).alias("p"), (F.substring("o_orderpriority", 1, 1).cast("int") <= 2).alias("t"))
    return metrics.confusion(o, "p", "t", ["g"])


@query("A22_coherence", "SELECT l_suppkey AS label, count(*) AS n, sum(l_quantity/64)/count(*) AS coherence FROM lineitem GROUP BY 1")
def a22(spark, d):
    return cluster.coherence(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("label"), (F.col("l_quantity") / 64).alias("prob")))


@query("F11_F12_cluster_filters", f"WITH {PTS}, s AS (SELECT floor(x/100)::BIGINT AS label, count(*) AS n, var_samp(x) AS vx, var_samp(y) AS vy, var_samp(z) AS vz, greatest(max(x)-min(x),max(y)-min(y),max(z)-min(z)) AS e FROM pts GROUP BY floor(x/100)) SELECT label, n, round(CASE WHEN e>1e-6 THEN (vx+vy+vz)/3/(e*e) ELSE 0 END,6) AS spread FROM s WHERE n>=5 AND (CASE WHEN e>1e-6 THEN (vx+vy+vz)/3/(e*e) ELSE 0 END) <= 0.5")
def f12(spark, d):
    rows = points(spark, d).withColumn("label", F.floor(F.col("x") / 100).cast("long"))
    return cluster.select_clusters(rows, 5, 0.5).withColumn("spread", F.round("spread", 6))


@query("F13_F14_percentile_trim", f"WITH {PTS} SELECT count(*) AS n, min(z) AS lo, max(z) AS hi FROM pts WHERE z BETWEEN (SELECT quantile_cont(z,0.02) FROM pts) AND (SELECT quantile_cont(z,0.98) FROM pts)")
def f13(spark, d):
    return cluster.trim_percentile(points(spark, d), "z", 0.02, 0.98).agg(F.count("*").alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"))


@query("F11_groups_of_at_least", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS groups FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*)>=8)")
def f11(spark, d):
    return relational.at_least(table(spark, d, "orders"), "o_custkey", 8).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("groups"))


@query("F1_F2_K4_finite_and_pose", f"WITH {PTS} SELECT pid, x*y-z*1 AS det FROM pts WHERE abs(x*y-z)>=1e-6")
def f1(spark, d):
    one, zero = F.lit(1.0), F.lit(0.0)
    det = vec.determinant([[F.col("x"), F.col("z"), zero], [one, F.col("y"), zero], [zero, zero, one]])
    rows = sinks.finite_rows(points(spark, d), ["x", "y", "z"]).withColumn("det", det)
    return rows.where(F.abs("det") >= 1e-6).select("pid", "det")


@query("F3_visible_union", f"WITH {PTS}, v AS (SELECT pid FROM pts WHERE x<300 UNION SELECT pid FROM pts WHERE y<300) SELECT pid, row_number() OVER (ORDER BY pid)-1 AS new FROM v")
def f3(spark, d):
    p = points(spark, d)
    return relational.visible_union(p.where("x < 300"), p.where("y < 300"))


@query("F9_F10_F19_id_filters", "SELECT d.doc_id, quality FROM documents d JOIN labels l ON d.doc_id=l.doc_id WHERE toxic<>1")
def f9(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("toxic <> 1"), "doc_id").select("doc_id", "quality")


@query("A34_deviations", "WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey)-1 AS place, o_custkey::DOUBLE AS v FROM orders), b AS (SELECT row_number() OVER (ORDER BY c_custkey)-1 AS place, c_nationkey::DOUBLE AS v FROM customer) SELECT count(*) AS n, sum(abs(a.v-b.v))/count(*) AS v_absolute, round(avg(CASE WHEN a.v<>0 AND b.v<>0 THEN abs(a.v-b.v)/greatest(abs(a.v),abs(b.v)) ELSE 0 END),6) AS v_relative FROM a JOIN b USING (place)")
def a34(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").cast("double").alias("v"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("o"), F.col("c_nationkey").cast("double").alias("v"))
    return metrics.deviations(a, b, "o", ["v"]).withColumn("v_relative", F.round("v_relative", 6))


@query("A35_sample_stats", "SELECT user_id, count(*) AS n, sum(round(value*100)::BIGINT)::BIGINT AS cents, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def a35(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.max_by("event_type", "event_id").alias("last_type"))


@query("A38_largest_scale", f"WITH {PTS} SELECT max(z) AS top, count(*) AS n FROM pts")
def a38(spark, d):
    return points(spark, d).agg(F.max("z").alias("top"), F.count("*").alias("n"))


@query("A39_localization", f"WITH {DENSE}, s AS (SELECT image_id AS frame, 0 AS prompt, row, col, value AS score FROM dense), t AS (SELECT frame, prompt, max(score) AS m FROM s GROUP BY 1,2) SELECT t.frame, t.prompt, max(CASE WHEN s.score=t.m AND col BETWEEN 0 AND 8 AND row BETWEEN 0 AND 20 THEN 1 ELSE 0 END) AS hit FROM t JOIN s USING (frame, prompt) GROUP BY 1,2")
def a39(spark, d):
    s = dense(spark, d).select(F.col("image_id").alias("frame"), F.lit(0).alias("prompt"), "row", "col", F.col("value").alias("score"))
    boxes = s.select("frame", "prompt").distinct().select("*", *[F.lit(v).alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 8), ("y1", 20))])
    return metrics.localization(s, boxes)


@query("A40_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
def a40(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("K11_scene_summary", "WITH m AS (SELECT l_returnflag AS scene, sum(l_quantity)/count(*) AS v FROM lineitem GROUP BY 1) SELECT * FROM m UNION ALL SELECT NULL, sum(v)/count(*) FROM (SELECT * FROM m ORDER BY scene)".replace("sum(v)/count(*)", "round(sum(v)/count(*),9)").replace("SELECT * FROM m UNION", "SELECT scene, round(v,9) AS v FROM m UNION"))
def k11(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("scene"), F.col("l_quantity").alias("v"))
    return metrics.summary(rows, "scene", "v").select("scene", F.round("v", 9).alias("v"))


@query("K6_sample_export", "WITH p AS (SELECT user_id AS sample, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT sample, pos FROM p WHERE n BETWEEN 5 AND 400 AND rn <= n//4*4")
def k6(spark, d):
    return sinks.export_samples(table(spark, d, "events").select(F.col("user_id").alias("sample"), F.col("event_id").alias("pos")), None, 5, 400, 4)


# ---- order, sets, strings


@query("T2_T5_topk_per_group", "SELECT l_orderkey, l_partkey, m AS qty, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY m DESC, l_partkey) AS rank FROM (SELECT l_orderkey, l_partkey, max(l_quantity) AS m FROM lineitem GROUP BY 1,2)) WHERE rank<=3")
def t2(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("qty"))
    return vector.topk(rows, ["l_orderkey"], "qty", 3, "l_partkey")


@query("T4_top_clusters", "SELECT l_suppkey AS label, sum(l_quantity/64)/count(*) AS coherence FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def t4(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("label"), (F.col("l_quantity") / 64).alias("prob"))
    return cluster.coherence(rows).orderBy(F.desc("coherence"), "label").limit(20).select("label", "coherence")


@query("T8_argmax_level", "SELECT o_custkey AS prompt, arg_min(level, (-m, level)) AS level FROM (SELECT o_custkey, substr(o_orderpriority,1,1)::INT AS level, max(o_totalprice) AS m FROM orders GROUP BY 1,2) GROUP BY 1".replace("arg_min(level, (-m, level))", "first(level ORDER BY m DESC, level)"))
def t8(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("prompt"), F.substring("o_orderpriority", 1, 1).cast("int").alias("level")).agg(F.max("o_totalprice").alias("m"))
    return rows.groupBy("prompt").agg(order.best_first("level", "m", "level").alias("level"))


@query("T9_median_pixel", f"WITH {PIX}, r AS (SELECT image_id, mask_id, row, col, row_number() OVER (PARTITION BY image_id, mask_id ORDER BY row, col) AS rn, count(*) OVER (PARTITION BY image_id, mask_id) AS n FROM pix) SELECT image_id, mask_id, col*4 AS x, row*4 AS y FROM r WHERE rn = n//2+1")
def t9(spark, d):
    w = W.partitionBy("image_id", "mask_id")
    rows = pixels(spark, d).withColumn("rn", F.row_number().over(w.orderBy("row", "col"))).withColumn("n", F.count("*").over(w))
    return rows.where(F.col("rn") == F.floor(F.col("n") / 2) + 1).select("image_id", "mask_id", (F.col("col") * 4).alias("x"), (F.col("row") * 4).alias("y"))


@query("T7_nth_image", "SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey)-1 AS place FROM part")
def t7(spark, d):
    return order.global_rank(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"], "place").select("p_partkey", "place")


@query("U2_U5_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def u2(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    out = None
    for name, df in (("union", o.union(c).distinct()), ("intersect", o.intersect(c)), ("except", c.subtract(o))):
        part = df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("X1_J17_strings", r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS stem, lpad(page_id::VARCHAR, 8, '0') AS padded, lower(url) AS low FROM pages")
def x1(spark, d):
    return table(spark, d, "pages").select("page_id", relational.stem(F.col("url")).alias("stem"), F.lpad(F.col("page_id").cast("string"), 8, "0").alias("padded"), F.lower("url").alias("low"))


@query("X2_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def x2(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("X6_S21_map_lookup", "SELECT n_nationkey, coalesce(CASE n_regionkey WHEN 0 THEN 'zero' WHEN 2 THEN 'two' END, 'other') AS name FROM nation")
def x6(spark, d):
    book = F.create_map(F.lit(0), F.lit("zero"), F.lit(2), F.lit("two"), F.lit(-1), F.lit("other"))
    return table(spark, d, "nation").select("n_nationkey", relational.first_known(book, F.col("n_regionkey"), F.lit(-1)).alias("name"))


@query("X7_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def x7(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("X8_dates", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def x8(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("X9_quantile_knots", f"WITH {PTS} SELECT n, round(knot,6) AS knot FROM (SELECT unnest(range(101))::INT AS n, unnest(quantile_cont(z, list_transform(range(101), lambda i: i/100::DOUBLE))) AS knot FROM pts WHERE z > 0)")
def x9(spark, d):
    knots = quantile.knots(points(spark, d), "z", 101)
    return spark.createDataFrame(list(enumerate(knots)), "n int, knot double").withColumn("knot", F.round("knot", 6))


@query("X9_to_normal", f"""WITH {PTS}, q AS (SELECT quantile_cont(z, {[i / 100 for i in range(101)]}) AS xs, {[NormalDist().inv_cdf(min(1 - 1e-7, max(1e-7, i / 100))) for i in range(101)]}::DOUBLE[] AS ys FROM pts WHERE z>0),
    b AS (SELECT pid, z, xs, ys, least(greatest(len(list_filter(xs, lambda x: x<=z)),1),100) AS n FROM pts, q)
    SELECT pid, round(ys[n]+least(greatest(coalesce((z-xs[n])/nullif(xs[n+1]-xs[n],0),0),0),1)*(ys[n+1]-ys[n]),6) AS v FROM b""")
def x9b(spark, d):
    p = points(spark, d)
    return p.select("pid", F.round(quantile.to_normal(F.col("z"), quantile.knots(p, "z", 101)), 6).alias("v"))


@query("X10_lower_median", f"WITH {PTS} SELECT mask_id, quantile_disc(z, 0.5) AS m FROM pts GROUP BY 1")
def x10(spark, d):
    return points(spark, d).groupBy("mask_id").agg(quantile.lower_median("z").alias("m"))


@query("S10_label_fallback", "SELECT d.doc_id, coalesce(quality, toxic, -1) AS label FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id")
def s10(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", "toxic", F.lit(-1)).alias("label"))


@query("S17_level_lengths", f"WITH {PTS}, t AS (SELECT mask_id AS level, max(pid+1) AS top FROM pts GROUP BY 1), r AS (SELECT level, max(top) OVER (ORDER BY level) AS run FROM t) SELECT level, run-coalesce(lag(run) OVER (ORDER BY level),0) AS length FROM r")
def s17(spark, d):
    return relational.level_lengths(points(spark, d).select(F.col("mask_id").alias("level"), F.col("pid").alias("id")))


@query("J23_J24_item_assembly", "SELECT o_orderkey, c_mktsegment, count(*) AS n, sum(l_quantity) AS qty FROM orders JOIN customer ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1,2")
def j23(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select("o_orderkey", "c_mktsegment")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    return o.join(li, "o_orderkey")


@query("J22_anti_exclusion", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j22(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("A33_A32_normalise", f"WITH {PTS} SELECT pid, x-(SELECT sum(x)/count(*) FROM pts) AS cx, (y-(SELECT min(y) FROM pts))/((SELECT max(y) FROM pts)-(SELECT min(y) FROM pts)+1e-8) AS uy FROM pts")
def a33(spark, d):
    p = points(spark, d)
    both = vector.min_max(vector.centered(p, ["x"]), ["y"])
    return both.select("pid", F.col("x").alias("cx"), F.col("y").alias("uy"))


@query("M9_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(round(value*100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1,2")
def m9(spark, d):
    e = table(spark, d, "events").withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return fusion.tumbling(e, "1 day").select("start", "event_type", "n", F.col("total").alias("cents"))


@query("M9_sessions", "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def m9b(spark, d):
    return fusion.sessions(table(spark, d, "events"), "30 minutes").select("user_id", "start", "n")


# ---- clusters and fits (no SQL form)


@query("C6_pca")
def c6(spark, d):
    return vector.pca(vectors(spark, d), 4).select("vec_id", "projection")


@query("C9_residual_codes")
def c9(spark, d):
    return vector.residual_codes(vectors(spark, d), 2, 8).select("vec_id", "codes")


#: Density clusters from the definition: cores, components of cores, and border points with their least core neighbour.
CLUSTERS = f"""{PTS}, near AS (SELECT a.pid AS a, b.pid AS b FROM pts a JOIN pts b ON b.x>a.x-60 AND b.x<a.x+60 WHERE (a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2<3600),
    core AS (SELECT a AS id FROM near GROUP BY 1 HAVING count(*)>=5),
    lab(id, label) USING KEY (id) AS (SELECT id, id FROM core
        UNION SELECT own.id, min(new.label) FROM lab new JOIN near ON near.b=new.id JOIN recurring.lab own ON own.id=near.a WHERE new.label<own.label GROUP BY 1),
    reach AS (SELECT a, arg_min(label, CASE WHEN a=b THEN -1 ELSE b END) AS label FROM near JOIN lab ON b=id GROUP BY 1),
    found AS (SELECT pid AS id, coalesce(label, -1) AS label FROM pts LEFT JOIN reach ON a=pid)"""


@query("C8_dbscan", f"WITH RECURSIVE {CLUSTERS} SELECT id, label FROM found")
def c8(spark, d):
    return cluster.dbscan(points(spark, d), 60.0, 5)


@query("J10_noise_fill", f"""WITH RECURSIVE {CLUSTERS}, known AS (SELECT * FROM found JOIN pts ON pid=id), far AS (SELECT n.id, k.label, row_number() OVER (PARTITION BY n.id ORDER BY (n.x-k.x)**2+(n.y-k.y)**2+(n.z-k.z)**2, k.id) AS r FROM known n JOIN known k ON n.label<0 AND k.label>=0)
    SELECT id, label FROM known WHERE label>=0 UNION ALL SELECT id, label FROM far WHERE r=1""")
def j10(spark, d):
    p = points(spark, d)
    return cluster.fill_noise(p, cluster.dbscan(p, 60.0, 5), 60.0)


@query("N5_A12_mlp")
def n5(spark, d):
    import numpy as np

    rng = np.random.default_rng(0)
    layers = [(rng.normal(size=(64, 32)), np.zeros(32)), (rng.normal(size=(32, 8)), np.zeros(8))]
    return vectors(spark, d).select("vec_id", vector.mlp(vec.dbl(F.col("embedding")), layers, True).alias("out"))


@query("J13_J14_gather", "SELECT l_orderkey, l_partkey, l_suppkey, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def j13(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return relational.gather(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), s, ["l_suppkey"]).groupBy("l_orderkey", "l_partkey", "l_suppkey", "s_nationkey").agg(F.count("*").alias("n"))


@query("J18_instance_cosine", f"SELECT a.vec_id, round(1-{DOT}/(sqrt(list_dot_product(a.embedding::DOUBLE[],a.embedding::DOUBLE[]))*sqrt(list_dot_product(b.embedding::DOUBLE[],b.embedding::DOUBLE[]))),6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 2")
def j18(spark, d):
    a = vectors(spark, d).select("vec_id", F.col("embedding").alias("vec"))
    b = a.withColumn("vec_id", F.col("vec_id") - 2)
    return metrics.instance_cosine(a, b, ["vec_id"]).select("vec_id", F.round("distance", 6).alias("distance"))


@query("A29_loss_image", f"WITH {DENSE}, t AS (SELECT image_id, max(value) AS m FROM dense GROUP BY 1) SELECT image_id, row, col, value::DOUBLE/m AS loss FROM dense JOIN t USING (image_id)")
def a29(spark, d):
    return metrics.loss_image(dense(spark, d), "value")


@query("F14_crop_box", f"WITH {PTS} SELECT pid FROM pts WHERE x BETWEEN 100 AND 900 AND y BETWEEN 200 AND 1800 AND z BETWEEN 0 AND 3000")
def f14(spark, d):
    return relational.crop_box(points(spark, d), (100.0, 200.0, 0.0), (900.0, 1800.0, 3000.0)).select("pid")


@query("X20_resize_bilinear", f"""WITH {DENSE}, y AS (SELECT r, greatest((r+0.5::DOUBLE)*52/26-0.5,0) AS y FROM range(26) t(r)), x AS (SELECT c, greatest((c+0.5::DOUBLE)*22/11-0.5,0) AS x FROM range(11) t(c))
    SELECT image_id, r::INT AS row, c::INT AS col, sum(value*(1-abs(y-row))*(1-abs(x-col))) AS value FROM dense JOIN y ON abs(y-row)<1 JOIN x ON abs(x-col)<1 GROUP BY ALL""")
def x20b(spark, d):
    return mask.resize_bilinear(dense(spark, d), "value", (52, 22), (26, 11))


@query("S4_embedding_keys", "SELECT vec_id, 10 + ((label << 16) & 4294901760) AS key, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))),4) AS n FROM embeddings")
def s4(spark, d):
    from gridloom.sources.readers import semantic_embeddings

    e = semantic_embeddings(vectors(spark, d), "label")
    return e.select("vec_id", "key", F.round(vec.norm(F.col("embedding")), 4).alias("n"))


@query("C7_fit_sample_label_all")
def c7(spark, d):
    return cluster.coherence(cluster.fit_sample_label_all(vectors(spark, d).drop("label"), 8, dims=16)).select("label", "n", "coherence")


@query(
    "W17_ranking",
    """SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rank, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dense, ntile(4) OVER w AS quarter, coalesce(lead(o_orderkey) OVER w, -1) AS next,
        coalesce(nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), -1) AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""",
)
def w17(spark, d):
    own = W.partitionBy("o_custkey")
    w, p = own.orderBy(F.desc("o_totalprice"), "o_orderkey"), own.orderBy("o_orderpriority")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(p).alias("rank"), F.dense_rank().over(p).alias("dense"), F.ntile(4).over(w).alias("quarter"), F.coalesce(F.lead("o_orderkey").over(w), F.lit(-1)).alias("next"), F.coalesce(F.nth_value("o_orderkey", 2).over(whole), F.lit(-1)).alias("second"))


@query("P20_colours", f"WITH {PTS}, c AS (SELECT pid, x%256 AS r, y%300 AS g, z%256 AS b FROM pts), t AS (SELECT greatest(max(r),max(g),max(b)) AS top FROM c) SELECT pid, {', '.join(f'least(greatest({a}/CASE WHEN top>1 THEN 255 ELSE 1 END,0),1) AS {a}' for a in 'rgb')} FROM c, t")
def p20(spark, d):
    rows = points(spark, d).select("pid", (F.col("x") % 256).alias("r"), (F.col("y") % 300).alias("g"), (F.col("z") % 256).alias("b"))
    return relational.normalized_colors(rows, ["r", "g", "b"], False)


@query("P21_intrinsics", "SELECT s_suppkey, s_suppkey/4 AS fx, (s_suppkey+1)/4 AS fy, 80.0::DOUBLE AS cx, 60.0::DOUBLE AS cy FROM supplier")
def p21(spark, d):
    cameras = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("fx"), (F.col("s_suppkey") + 1).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"))
    return relational.scaled_intrinsics(cameras, 0.25)


@query("P18_poses", "SELECT s_suppkey, -s_nationkey::DOUBLE AS m01, (5-s_nationkey)::DOUBLE AS m03, s_suppkey::DOUBLE AS m10, (s_suppkey+6)::DOUBLE AS m13, 8.0::DOUBLE AS m23 FROM supplier")
def p18(spark, d):
    row = lambda *v: F.array(*[(x if isinstance(x, Column) else F.lit(x)).cast("double") for x in v])
    n, r = F.col("s_suppkey"), F.col("s_nationkey")
    pose = F.array(row(n, 1, 0, n), row(2, r, 0, r), row(0, 0, 1, 1), row(0, 0, 0, 1))
    turn = F.array(row(0, -1, 0, 5), row(1, 0, 0, 6), row(0, 0, 1, 7), row(0, 0, 0, 1))
    m = table(spark, d, "supplier").select("s_suppkey", vec.matmul(turn, pose).alias("m"))
    return m.select("s_suppkey", *[F.col("m")[i][j].alias(f"m{i}{j}") for i, j in ((0, 1), (0, 3), (1, 0), (1, 3), (2, 3))])


@query("P27_concat", f"WITH {LINES}, a AS (SELECT batch_id, i, j, k, count(*) AS n FROM lines GROUP BY ALL), b AS (SELECT batch_id, i, j, k, max(qty) AS q FROM lines WHERE tax>0.04::DOUBLE GROUP BY ALL) SELECT batch_id, i, j, k, n::DOUBLE AS first, q AS second, 2 AS channels FROM a JOIN b USING (batch_id, i, j, k)")
def p27(spark, d):
    c = cells(spark, d)
    one = c.groupBy(*voxel.KEY).agg(F.array(F.count("*").cast("double")).alias("a"))
    two = c.where(F.col("tax") > 0.04).groupBy(*voxel.KEY).agg(F.array(F.max("qty")).alias("b"))
    out = voxel.concat_features(one, two, "a", "b")
    return out.select(*voxel.KEY, F.col("features")[0].alias("first"), F.col("features")[1].alias("second"), F.size("features").alias("channels"))


@query("X18_polygons", "SELECT s_suppkey AS poly_id, r::INT AS row, c::INT AS col FROM supplier, range(40) t(r), range(40) u(c) WHERE r<10+s_nationkey AND c<20+s_suppkey%20+(r*(0-20-s_suppkey%20))/(10+s_nationkey)::DOUBLE")
def x18(spark, d):
    """Right-angled triangles with the corner at the origin."""
    a, b = (20 + F.col("s_suppkey") % 20).cast("double"), (10 + F.col("s_nationkey")).cast("double")
    zero = F.lit(0.0)
    return mask.rasterize(table(spark, d, "supplier").select(F.col("s_suppkey").alias("poly_id"), F.array(zero, a, zero).alias("xs"), F.array(zero, zero, b).alias("ys")), 40, 40)


@query("J25_undo", f"WITH {PTS} SELECT pid, mask_id FROM pts WHERE z>100 AND mask_id=2")
def j25(spark, d):
    """A crop, a second one that is undone, and a third."""
    p = points(spark, d).select("pid", "mask_id", "z")
    view = relational.Snapshots(p)
    view.crop(p.where("z > 100").select("pid"))
    view.crop(p.where("mask_id = 1").select("pid"))
    view.undo()
    return view.crop(p.where("mask_id = 2").select("pid")).select("pid", "mask_id")
