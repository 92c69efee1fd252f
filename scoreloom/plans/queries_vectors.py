"""Queries over vectors, sequences of vectors and hidden states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import vectors as v
from scoreloom.functions.values import fence
from scoreloom.operators import hidden_states as h
from scoreloom.operators import trajectories as tr
from scoreloom.operators import vector_sets as vs
from scoreloom.operators.skew import with_neighbours
from scoreloom.plans.fixtures import SQL_VIEWS
from scoreloom.plans.registry import query
from scoreloom.sources.folders import new_folder

DIM = 64
SQL_VIEWS["fx_vec"] = "select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) v from embeddings"
SQL_VIEWS["fx_seq"] = """select label, vec_id, v, row_number() over (partition by label order by vec_id) - 1 idx,
    lag(v) over (partition by label order by vec_id) p, lead(v) over (partition by label order by vec_id) nx from fx_vec"""
# a point, its neighbour, and a tangent at the point
SQL_VIEWS["fx_tri"] = """select vec_id, x, y, list_transform(range(1, 65), lambda i: w[i] - x[i] * list_inner_product(w, x)) t from (
    select vec_id, list_transform(v, lambda c: c / sqrt(list_inner_product(v, v))) x, list_transform(nx, lambda c: c / sqrt(list_inner_product(nx, nx))) y, p w
    from fx_seq where p is not null and nx is not null)"""


def show(vector: str) -> str:
    """A vector in the checking SQL: its ends, sum and length."""
    return (f"round({vector}[1], 6) a, round({vector}[64], 6) z, round(list_sum({vector}), 6) total, "
            f"round(sqrt(list_inner_product({vector}, {vector})), 6) size")


def shown(x: Column) -> list[Column]:
    r = lambda c, name: F.round(c, 6).alias(name)
    return [r(x[0], "a"), r(x[DIM - 1], "z"), r(v.total(v.doubles(x)), "total"), r(v.norm(x), "size")]


def neighbours(t) -> DataFrame:
    return with_neighbours(t.steps, ["seq_id"], "idx", before={"p": "embedding"}, after={"nx": "embedding"})


def triples(t) -> DataFrame:
    n = neighbours(t).where("p is not null and nx is not null")
    n = n.select("vec_id", v.normalize(F.col("embedding")).alias("x"), v.normalize(F.col("nx")).alias("y"), F.col("p").alias("w"))
    return n.select("vec_id", "x", "y", v.tangent(F.col("x"), F.col("w")).alias("t"))


@query("d1_normalize", f"select vec_id, {show('u')} from (select vec_id, list_transform(w, lambda c: c / sqrt(list_inner_product(w, w))) u from (select vec_id, list_transform(v, lambda c: c * 3) w from fx_vec))")
def _(t):
    scaled = F.transform("embedding", lambda c: c.cast("double") * 3)
    return t.embeddings.select("vec_id", v.normalize(scaled).alias("u")).select("vec_id", *shown(F.col("u")))


@query("d2_chord", "select vec_id, round(list_distance(v, p), 6) chord from fx_seq where p is not null")
def _(t):
    return neighbours(t).where("p is not null").select("vec_id", F.round(v.chord(F.col("embedding"), F.col("p")), 6).alias("chord"))


@query("d3_arc", "select vec_id, round(acos(greatest(-1, least(1, list_inner_product(v, p)))), 6) arc from fx_seq where p is not null")
def _(t):
    return neighbours(t).where("p is not null").select("vec_id", F.round(v.arc(F.col("embedding"), F.col("p")), 6).alias("arc"))


@query("d4_cosine", "select vec_id, round(1 - list_inner_product(v, p) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(p, p))), 6) cosine from fx_seq where p is not null")
def _(t):
    return neighbours(t).where("p is not null").select("vec_id", F.round(v.cosine_distance(F.col("embedding"), F.col("p")), 6).alias("cosine"))


@query("d5_geodesic_to_reference", """select e.vec_id, round(acos(greatest(-1, least(1, list_inner_product(e.v, r.v)
       / sqrt(list_inner_product(e.v, e.v) * list_inner_product(r.v, r.v))))), 5) distance from fx_vec e, (select v from fx_vec where vec_id = 0) r where e.vec_id <> 0""")
def _(t):
    # one vector by its key: a scalar, not a table
    reference = t.embeddings.where("vec_id = 0").agg(F.first("embedding")).scalar()
    ranked = vs.distances_to(t.embeddings.where("vec_id <> 0").select("vec_id", "embedding"), "embedding", reference, "vec_id")
    return ranked.select("vec_id", F.round("distance", 5).alias("distance"))


BAND = "fx_seq a join fx_seq b on a.label = b.label and b.idx between a.idx + 1 and a.idx + 4"


def band(t) -> DataFrame:
    return vs.band_pairs(t.steps.select("seq_id", "idx"), ["seq_id"], "idx", 4)


@query("d6_pairwise", f"""select cast(a.label as int) seq, a.idx i, b.idx j, round(list_distance(a.v, b.v), 6) chord,
       round(1 - list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)), 6) cosine from {BAND}""")
def _(t):
    d = vs.pair_distances(t.steps, band(t), ["seq_id", "idx"], "embedding", ["chord", "cosine"])
    return d.select(F.col("seq_id_a").alias("seq"), F.col("idx_a").alias("i"), F.col("idx_b").alias("j"), F.round("chord", 6).alias("chord"), F.round("cosine", 6).alias("cosine"))


@query("d6_pairwise_rows", """select a.label, a.vec_id, count(*) n, round(min(list_distance(a.v, b.v)), 6) least, round(avg(list_distance(a.v, b.v)), 6) mean,
       round(max(list_distance(a.v, b.v)), 6) most from fx_vec a join fx_vec b on a.label = b.label and a.vec_id <> b.vec_id group by 1, 2""")
def _(t):
    s = vs.distance_summary(t.embeddings, t.embeddings, "label", "vec_id", "embedding", skip_self=True)
    return s.select("label", "vec_id", "n", *[F.round(c, 6).alias(c) for c in ("least", "mean", "most")])


@query("d7_pairwise_dots", f"""select cast(a.label as int) seq, a.idx i, b.idx j, round(list_inner_product(a.v, b.v), 6) dot,
       round(acos(greatest(-1, least(1, list_inner_product(a.v, b.v)))), 6) arc from {BAND}""")
def _(t):
    d = vs.pair_distances(t.steps, band(t), ["seq_id", "idx"], "embedding", ["dot", "arc"])
    return d.select(F.col("seq_id_a").alias("seq"), F.col("idx_a").alias("i"), F.col("idx_b").alias("j"), F.round("dot", 6).alias("dot"), F.round("arc", 6).alias("arc"))


@query("d7_pair_moments", """select a.label, max(n) n, count(*) n_pairs, round(avg(list_inner_product(a.v, b.v)), 6) mean_dot,
       round(stddev_pop(list_inner_product(a.v, b.v)), 6) sd_dot, round(avg(list_distance(a.v, b.v) ** 2), 5) mean_squared_chord
       from fx_vec a join fx_vec b on a.label = b.label and a.vec_id < b.vec_id join (select label, count(*) n from fx_vec group by 1) c on a.label = c.label group by 1""")
def _(t):
    m = vs.pair_moments(t.embeddings, ["label"], "embedding")
    return m.select("label", "n", "n_pairs", F.round("mean_dot", 6).alias("mean_dot"), F.round("sd_dot", 6).alias("sd_dot"), F.round("mean_squared_chord", 5).alias("mean_squared_chord"))


@query("d8_semantic_volume", "select label, count(*) n from fx_vec group by 1")
def _(t):
    volumes = vs.semantic_volume(t.embeddings, "label", "vec_id", "embedding")
    return volumes.where("volume >= 0 and log_volume > -1e6").select("label", "n")


def volumes_sql(vectors: str) -> str:
    """The same by elimination: half the logarithm of the determinant of the smaller matrix of products, less ln (n - 1)!."""
    return f"""with recursive x as (select label, vec_id, {vectors} v from fx_vec), o as (select label, arg_min(v, vec_id) o, count(*) n, len(any_value(v)) d from x group by 1),
         a as materialized (select x.label, vec_id, n, d, list_transform(range(1, d + 1), lambda i: v[i] - o[i]) v, row_number() over (partition by x.label order by vec_id) - 1 k from x join o on x.label = o.label),
         small as (select p.label, p.k i, list(list_inner_product(p.v, q.v) order by q.k) as row from a p join a q on p.label = q.label where p.n - 1 <= p.d and p.k > 0 and q.k > 0 group by 1, 2),
         wide as (select label, i, list(s order by j) as row from (select label, i, j, sum(v[i] * v[j]) s from a, range(1, 65) r(i), range(1, 65) c(j) where n - 1 > d and i <= d and j <= d group by 1, 2, 3) group by 1, 2),
         m as (select label, list(row order by i) as m, cast(0 as double) as logdet from (select * from small union all select * from wide) group by 1),
         e as (select * from m union all select label, list_transform(m[2:], lambda r: list_transform(range(2, len(r) + 1), lambda j: r[j] - r[1] / m[1][1] * m[1][j])), logdet + ln(m[1][1]) from e where len(m) > 0)
       select e.label, n, round(logdet / 2 - lgamma(n), 6) log_volume from e join o on e.label = o.label where len(m) = 0"""


@query("d8_log_volume", volumes_sql("v"))
def _(t):
    return vs.semantic_volume(t.embeddings, "label", "vec_id", "embedding").select("label", "n", F.round("log_volume", 6).alias("log_volume"))


@query("d8_more_vectors_than_dimensions", volumes_sql("v[1:8]"))
def _(t):
    short = t.embeddings.withColumn("embedding", F.slice("embedding", 1, 8))
    return vs.semantic_volume(short, "label", "vec_id", "embedding").select("label", "n", F.round("log_volume", 6).alias("log_volume"))


@query("d8_triangle_areas", """select concat(label, '-', idx // 3) triple, cast(3 as bigint) n, round(ln(sqrt(aa * bb - ab * ab) / 2), 6) log_volume from (
       select label, idx, list_inner_product(a, a) aa, list_inner_product(b, b) bb, list_inner_product(a, b) ab from (
       select label, idx, list_transform(range(1, 65), lambda i: v[i] - p[i]) a, list_transform(range(1, 65), lambda i: nx[i] - p[i]) b
       from fx_seq where idx % 3 = 1 and nx is not null))""")
def _(t):
    # three vectors in a row: the simplex is a triangle, whose area has a closed form
    triples = t.steps.select(F.concat(F.col("seq_id").cast("string"), F.lit("-"), F.floor(F.col("idx") / 3).cast("string")).alias("triple"), "idx", "embedding")
    volumes = vs.semantic_volume(triples, "triple", "idx", "embedding").where("n = 3")
    return volumes.select("triple", "n", F.round("log_volume", 6).alias("log_volume"))


@query("d9_nearest_source", """select g.label, g.vec_id, round(min(list_distance(g.v, s.v)), 6) least from fx_vec g join fx_vec s on g.label = s.label and g.vec_id <> s.vec_id where g.vec_id % 3 = 0 group by 1, 2""")
def _(t):
    near = vs.nearest_distances(t.embeddings.where("vec_id % 3 = 0"), t.embeddings, "label", "vec_id", "embedding", skip_self=True)
    return near.select("label", "vec_id", F.round("least", 6).alias("least"))


@query("d9_min_mean_to_sources", """select g.vec_id, round(min(list_distance(g.v, s.v)), 6) least, round(avg(list_distance(g.v, s.v)), 6) mean from fx_vec g join fx_vec s
       on g.label = s.label where g.vec_id % 3 = 0 and s.vec_id % 3 <> 0 group by 1""")
def _(t):
    # a third of the vectors are answers, the others are their sources
    generated, sources = t.embeddings.where("vec_id % 3 = 0"), t.embeddings.where("vec_id % 3 <> 0")
    s = vs.distance_summary(generated, sources, "label", "vec_id", "embedding")
    return s.select("vec_id", F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"))


@query("d10_tangent", f"select vec_id, {show('t')}, abs(list_inner_product(t, x)) < 1e-9 on_plane from fx_tri")
def _(t):
    return triples(t).select("vec_id", *shown(F.col("t")), (F.abs(v.dot(F.col("t"), F.col("x"))) < 1e-9).alias("on_plane"))


@query("d11_exp_map", f"""select vec_id, {show('u')} from (select vec_id, list_transform(range(1, 65), lambda i: cos(n) * x[i] + sin(n) * t[i] / n) u
       from (select *, sqrt(list_inner_product(t, t)) n from fx_tri))""")
def _(t):
    return triples(t).select("vec_id", v.exp_map(F.col("x"), F.col("t")).alias("u")).select("vec_id", *shown(F.col("u")))


LOG = "list_transform(range(1, 65), lambda i: acos(c) / sin(acos(c)) * ({to}[i] - c * {at}[i]))"


@query("d12_log_map", f"""select vec_id, {show('u')}, true returns from (select vec_id, {LOG.format(at='x', to='y')} u from (select *, list_inner_product(x, y) c from fx_tri))""")
def _(t):
    d = triples(t).select("vec_id", "x", "y", v.log_map(F.col("x"), F.col("y")).alias("u"))
    back = v.chord(v.exp_map(F.col("x"), F.col("u")), F.col("y"))
    return d.select("vec_id", *shown(F.col("u")), (back < 1e-9).alias("returns"))


@query("d13_parallel_transport", f"""select vec_id, {show('u')}, true keeps_size from (select vec_id, list_transform(range(1, 65), lambda i: t[i] - k * (ux[i] + uy[i])) u from (
       select *, list_inner_product(t, ux) k from (select vec_id, t, list_transform(lx, lambda c: c / sqrt(list_inner_product(lx, lx))) ux,
         list_transform(ly, lambda c: c / sqrt(list_inner_product(ly, ly))) uy from (select *, {LOG.format(at='x', to='y')} lx, {LOG.format(at='y', to='x')} ly
           from (select *, list_inner_product(x, y) c from fx_tri)))))""")
def _(t):
    d = triples(t).select("vec_id", "t", v.parallel_transport(F.col("x"), F.col("y"), F.col("t")).alias("u"))
    return d.select("vec_id", *shown(F.col("u")), (F.abs(v.norm(F.col("u")) - v.norm(F.col("t"))) < 1e-9).alias("keeps_size"))


@query("d14_to_spherical", """select vec_id, cast(k - 1 as int) k, round(case when k = 63 and x[64] < 0 then 2 * pi() - a else a end, 6) angle from (
       select vec_id, x, k, acos(greatest(-1, least(1, x[k] / sqrt(list_inner_product(x[k:], x[k:]))))) a from (
         select vec_id, list_transform(v, lambda c: c / sqrt(list_inner_product(v, v))) x, unnest(range(1, 64)) k from fx_vec))""")
def _(t):
    x = v.normalize(F.col("embedding"))
    angles = fence(fence(t.embeddings.select("vec_id", x.alias("x")), ["x"]).select("vec_id", v.to_spherical(F.col("x")).alias("angles")), ["angles"])
    return angles.select("vec_id", F.posexplode("angles").alias("k", "angle")).select("vec_id", "k", F.round("angle", 6).alias("angle"))


@query("d15_from_spherical", f"select vec_id, {show('u')} from (select vec_id, list_transform(v, lambda c: c / sqrt(list_inner_product(v, v))) u from fx_vec)")
def _(t):
    # there and back again
    unit = fence(t.embeddings.select("vec_id", v.normalize(F.col("embedding")).alias("x")), ["x"])
    d = fence(unit.select("vec_id", v.to_spherical(F.col("x")).alias("angles")), ["angles"])
    return fence(d.select("vec_id", v.from_spherical(F.col("angles")).alias("u")), ["u"]).select("vec_id", *shown(F.col("u")))


@query("d16_tangent_basis", "select vec_id, cast(63 as int) n_vectors, true orthonormal, true tangent from embeddings")
def _(t):
    at = t.embeddings.select("vec_id", F.col("embedding").alias("own"))
    both = t.embeddings.join(at, "vec_id").withColumns({"y": v.normalize(F.col("embedding")), "x": v.normalize(F.col("own"))})
    joined = fence(vs.tangent_bases(both, "vec_id", "y", keep=["x"]), ["basis"])
    off = F.array_max(F.transform("basis", lambda u: F.abs(v.dot(u, F.col("x")))))
    # unit vectors at right angles: every length is 1, and so is the length of their mean times the root of their number
    unit = F.array_max(F.transform("basis", lambda u: F.abs(v.norm(u) - 1.0)))
    whole = F.aggregate("basis", F.array_repeat(F.lit(0.0), DIM), v.add)
    return joined.select("vec_id", F.size("basis").alias("n_vectors"),
                         ((unit < 1e-9) & (F.abs(v.dot(whole, whole) - F.size("basis")) < 1e-6)).alias("orthonormal"), (off < 1e-9).alias("tangent"))


@query("d17_kinetic_energy", "select vec_id, round(0.5 * list_inner_product(list_transform(range(1, 65), lambda i: v[i] - p[i]), list_transform(range(1, 65), lambda i: v[i] - p[i])), 6) energy from fx_seq where p is not null")
def _(t):
    return neighbours(t).where("p is not null").select("vec_id", F.round(v.kinetic_energy(v.subtract(F.col("embedding"), F.col("p"))), 6).alias("energy"))


def particles(t) -> DataFrame:
    return neighbours(t).where("p is not null and nx is not null").select("vec_id", F.col("embedding").alias("position"), F.col("p").alias("velocity"), F.col("nx").alias("acceleration"))


@query("d18_constraint_audit", """select max(abs(sqrt(list_inner_product(v, v)) - 1)) < 1e-6 near_sphere, round(max(abs(list_inner_product(p, v))), 6) velocity_tangency,
       round(max(abs(list_inner_product(nx, v))), 6) acceleration_tangency from fx_seq where p is not null and nx is not null""")
def _(t):
    a = vs.constraint_audit(particles(t))
    return a.select((F.col("position_unit_norm") < 1e-6).alias("near_sphere"), F.round("velocity_tangency", 6).alias("velocity_tangency"), F.round("acceleration_tangency", 6).alias("acceleration_tangency"))


@query("d19_enforce_constraints", "select true position_unit_norm, true velocity_tangency, true acceleration_tangency")
def _(t):
    a = vs.constraint_audit(vs.enforce_constraints(particles(t)))
    return a.select(*[(F.col(c) < 1e-12).alias(c) for c in a.columns])


@query("d20_angular_to_tangent", """select vec_id, true close from fx_seq where p is not null""")
def _(t):
    # against a forward difference along the same rates
    eps = 1e-6
    unit = fence(neighbours(t).where("p is not null").select("vec_id", v.normalize(F.col("embedding")).alias("x"), F.slice("p", 1, DIM - 1).alias("rates")), ["x", "rates"])
    d = fence(unit.select("vec_id", "rates", v.to_spherical(F.col("x")).alias("angles")), ["angles"])
    d = d.withColumn("later", F.zip_with("angles", "rates", lambda a, w: a + eps * w))
    d = fence(fence(d, ["later"]).withColumns({"exact": v.angular_to_tangent(F.col("angles"), F.col("rates")), "here": v.from_spherical(F.col("angles")), "ahead": v.from_spherical(F.col("later"))}),
              ["exact", "here", "ahead"])
    approx = F.transform(v.subtract(F.col("ahead"), F.col("here")), lambda x: x / eps)
    return d.select("vec_id", (v.chord(F.col("exact"), v.tangent(F.col("here"), approx)) < 1e-4).alias("close"))


@query("d21_spread_reps", """select label, cast(k - 1 as int) dim, round(var_samp(v[k]), 6) variance, round(avg(v[k]), 6) mean from (select label, v, unnest(range(1, 65)) k from fx_vec) group by 1, 2""")
def _(t):
    return vs.spread(t.embeddings, ["label"], "embedding").select("label", "dim", F.round("variance", 6).alias("variance"), F.round("mean", 6).alias("mean"))


# ---- sequences ------------------------------------------------------------------------------------


@query("j1_shift", "select vec_id, p is null first, " + show("p") + " from fx_seq")
def _(t):
    s = tr.shift(t.steps, "seq_id", "idx", "embedding")
    prev = F.when(~F.isnan(F.col("previous")[0]), F.col("previous"))
    return s.select("vec_id", (F.col("idx") == 0).alias("first"), *shown(prev))


@query("j2_backward_diff", f"select vec_id, {show('u')} from (select vec_id, list_transform(range(1, 65), lambda i: v[i] - coalesce(p, v)[i]) u from fx_seq)")
def _(t):
    return tr.backward_difference(t.steps, "seq_id", "idx", "embedding").select("vec_id", *shown(F.col("difference")))


@query("j3_forward_diff", f"select vec_id, {show('u')} from (select vec_id, list_transform(range(1, 65), lambda i: coalesce(nx[i] - v[i], 0)) u from fx_seq)")
def _(t):
    return tr.forward_difference(t.steps, "seq_id", "idx", "embedding", fill=0.0).select("vec_id", *shown(F.col("difference")))


@query("j4_step_sizes", "select cast(label as int) seq_id, count(*) n, round(avg(list_distance(v, nx)), 6) mean_step, round(max(list_distance(v, nx)), 6) max_step from fx_seq group by 1")
def _(t):
    s = tr.step_summary(t.steps, "seq_id", "idx", "embedding")
    return s.select("seq_id", "n", F.round("mean_step", 6).alias("mean_step"), F.round("max_step", 6).alias("max_step"))


@query("j5_largest_jump", """select cast(label as int) seq_id, idx idx_from, idx + 1 idx_to, round(d, 6) step from (select *, row_number() over (partition by label order by d desc, idx) rn
       from (select label, idx, list_distance(v, nx) d from fx_seq where nx is not null)) where rn = 1""")
def _(t):
    return tr.largest_jump(t.steps, "seq_id", "idx", "embedding").withColumn("step", F.round("step", 6))


@query("j6_top_dims", """select cast(k - 1 as int) dim, round(sum(v[k] - p[k]), 6) total from (select v, p, unnest(range(1, 65)) k from fx_seq where p is not null)
       group by 1 order by sum(v[k] - p[k]) desc, 1 limit 20""")
def _(t):
    differences = tr.backward_difference(t.steps, "seq_id", "idx", "embedding")
    return tr.top_dimensions(differences, "difference", 20).withColumn("total", F.round("total", 6))


def squares(vector: str) -> str:
    return f"list_sum(list_transform({vector}, lambda c: c * c))"


@query("j7_kinematics", f"""select vec_id, round(0.5 * {squares('vel')}, 6) energy, round(acc[1], 6) a, round(acc[64], 6) z, round(list_sum(acc), 6) total,
       round(sqrt({squares('acc')}), 6) size from (
       select *, case when back is not null then list_transform(range(1, 65), lambda i: vel[i] - back[i]) end acc from (
         select *, lag(vel) over (partition by label order by idx) back from (
           select *, case when p is not null then list_transform(range(1, 65), lambda i: v[i] - p[i]) end vel from fx_seq)))""")
def _(t):
    k = tr.kinematics(t.steps, "seq_id", "idx", "embedding")
    return k.select("vec_id", F.round("energy", 6).alias("energy"), *shown(F.col("acceleration")))


@query("j8_trajectory_table", """select idx t_index, count(*) n_particles, idx * 5e-1 as time from fx_seq group by 1""")
def _(t):
    table = tr.with_times(t.steps.withColumnRenamed("idx", "t_index"), "t_index", 0.5)
    return table.groupBy("t_index").agg(F.count(F.lit(1)).alias("n_particles"), F.round(F.max("time"), 6).alias("time"))


@query("j8_stack", "select vec_id, cast(label as int) seq_id, cast(idx as int) t_index, idx * 25e-2 as time, len(v) as dims from fx_seq")
def _(t):
    # a folder for each step, as a simulation leaves them
    place = new_folder(t.spark, "states")
    rows = t.steps.select("vec_id", "seq_id", "embedding", F.col("idx").alias("step"))
    rows.repartition("step").write.partitionBy("step").parquet(place)
    stacked = tr.stack_states(t.spark, place, rows.drop("step").schema, 0.25)
    return stacked.select("vec_id", "seq_id", "t_index", "time", F.size("embedding").cast("long").alias("dims"))


@query("j8_state_at", "select cast(label as int) seq_id, vec_id from fx_seq where idx = 7")
def _(t):
    return tr.state_at(t.steps.withColumnRenamed("idx", "t_index"), 7).select("seq_id", "vec_id")


@query("j9_trajectory_pairs", """select a.idx, cast(a.label as int) i, cast(b.label as int) j, round(acos(greatest(-1, least(1, list_inner_product(a.v, b.v)))), 6) arc
       from fx_seq a join fx_seq b on a.idx = b.idx and b.label = a.label + 1""")
def _(t):
    s = t.steps.select("idx", "seq_id", "embedding")
    pairs = s.select(F.col("idx").alias("idx_a"), F.col("idx").alias("idx_b"), F.col("seq_id").alias("seq_id_a"), (F.col("seq_id") + 1).alias("seq_id_b"))
    d = tr.trajectory_pairs(s, pairs, "idx", "seq_id", "embedding")
    return d.select(F.col("idx_a").alias("idx"), F.col("seq_id_a").alias("i"), F.col("seq_id_b").alias("j"), F.round("arc", 6).alias("arc"))


# ---- hidden states --------------------------------------------------------------------------------

SQL_VIEWS["fx_cells"] = """select text_id, layer, pos, k, cast(state[k] as double) x from (select *, unnest(range(1, 65)) k from fx_states)"""
SQL_VIEWS["fx_pooled"] = """select text_id, layer, list(m order by k) v from (select text_id, layer, k, avg(x) m from fx_cells group by 1, 2, 3) group by 1, 2"""
SQL_VIEWS["fx_content"] = """select text_id, layer, list(m order by k) v from (select text_id, layer, k, avg(x) m from fx_cells where pos > 0 group by 1, 2, 3) group by 1, 2"""
SQL_VIEWS["fx_state_norm"] = """select text_id, layer, pos, sqrt(sum(x * x)) size from fx_cells group by 1, 2, 3"""


@query("h1_mean_pool", f"select text_id, layer, {show('v')} from fx_pooled")
def _(t):
    return h.mean_pool(t.states).select("text_id", "layer", *shown(F.col("pooled")))


SQL_VIEWS["fx_last"] = "select text_id, layer, list_transform(state, lambda x: cast(x as double)) v from fx_states where pos = 4"


@query("h2_last_token", f"select text_id, layer, {show('v')} from fx_last")
def _(t):
    return h.last_token(t.states).select("text_id", "layer", *shown(v.doubles(F.col("last"))))


@query("h3_layer", "select text_id, pos, layer from fx_states where layer = 3")
def _(t):
    return h.select_layer(t.states, -1, 4).select("text_id", "pos", "layer")


@query("h4_content_pool", f"select text_id, layer, {show('v')} from fx_content")
def _(t):
    return h.content_pool(t.states).select("text_id", "layer", *shown(F.col("pooled")))


@query("h5_norm_profile", "select text_id, layer, round(avg(size), 6) mean_norm, round(max(size) filter (pos = 4), 6) last_norm from fx_state_norm group by 1, 2")
def _(t):
    return h.norm_profile(t.states).select("text_id", "layer", F.round("mean_norm", 6).alias("mean_norm"), F.round("last_norm", 6).alias("last_norm"))


@query("h6_sink_ratio", """select text_id, layer, round(max(size) filter (pos = 0) / quantile_disc(size, 0.5) filter (pos > 0), 6) ratio from fx_state_norm group by 1, 2""")
def _(t):
    return h.sink_ratio(t.states).select("text_id", "layer", F.round("ratio", 6).alias("ratio"))


@query("h7_cosine_by_layer", """select a.text_id, a.layer, round(list_inner_product(a.v, r.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(r.v, r.v))), 6) cosine
       from fx_content a join fx_content r on a.layer = r.layer and r.text_id = 0 where a.text_id <> 0""")
def _(t):
    return h.cosine_by_layer(h.content_pool(t.states), 0).withColumn("cosine", F.round("cosine", 6))


SQL_VIEWS["fx_rsa"] = """select layer, count(*) n_pairs, corr(s, e) r from (
    select a.layer, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) s, list_inner_product(x.v, y.v) e
    from fx_content a join fx_content b on a.layer = b.layer and a.text_id < b.text_id join fx_vec x on x.vec_id = a.text_id join fx_vec y on y.vec_id = b.text_id) group by 1"""


def correlations(t) -> DataFrame:
    return h.rsa(h.content_pool(t.states), t.embeddings.select(F.col("vec_id").alias("text_id"), "embedding"))


@query("h8_rsa", "select layer, n_pairs, round(r, 6) r from fx_rsa")
def _(t):
    return correlations(t).withColumn("r", F.round("r", 6))


@query("h8_best_layer", "select layer, round(r, 6) r from fx_rsa order by r desc, layer limit 1")
def _(t):
    return h.best_layer(correlations(t)).withColumn("r", F.round("r", 6))


SQL_VIEWS["fx_deltas"] = """select a.text_id, a.layer, list_transform(range(1, 65), lambda i: b.v[i] - a.v[i]) d from fx_pooled a join fx_pooled b
    on a.text_id = b.text_id and b.layer = a.layer + 1"""


@query("h9_layer_deltas", f"select text_id, layer, {show('d')} from fx_deltas")
def _(t):
    return h.layer_deltas(h.mean_pool(t.states)).select("text_id", "layer", *shown(F.col("delta")))


@query("h10_var_mean", """select kind, layer, cast(k - 1 as int) dim, round(var_samp(v[k]), 6) variance, round(avg(v[k]), 6) mean from (
       select 'state' kind, layer, v, unnest(range(1, 65)) k from fx_pooled union all select 'delta', layer, d, unnest(range(1, 65)) from fx_deltas) group by 1, 2, 3""")
def _(t):
    pooled = h.mean_pool(t.states)
    both = (h.variance_by_cell(pooled, "pooled").withColumn("kind", F.lit("state"))
            .unionByName(h.variance_by_cell(h.layer_deltas(pooled), "delta").withColumn("kind", F.lit("delta"))))
    return both.select("kind", "layer", "dim", F.round("variance", 6).alias("variance"), F.round("mean", 6).alias("mean"))


@query("h11_rank_cells", """select layer, cast(k - 1 as int) dim, round(var_samp(v[k]), 6) variance from (select layer, v, unnest(range(1, 65)) k from fx_pooled) group by 1, 2
       order by var_samp(v[k]) desc limit 40""".replace("group by 1, 2\n       order by var_samp(v[k]) desc", "group by 1, 2 order by var_samp(v[k]) desc, 1, 2"))
def _(t):
    return h.rank_cells(h.variance_by_cell(h.mean_pool(t.states), "pooled"), 40).select("layer", "dim", F.round("variance", 6).alias("variance"))


@query("h12_next_token_topk", """select vec_id, cast(r - 1 as int) rank, cast(k - 1 as int) token_id, round(exp(x) / z, 6) probability from (
       select vec_id, k, v[k] * 10 x, row_number() over (partition by vec_id order by v[k] desc, k) r, sum(exp(v[k] * 10)) over (partition by vec_id) z
       from (select vec_id, v, unnest(range(1, 65)) k from fx_vec)) where r <= 5""")
def _(t):
    logits = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))
    return h.next_tokens(logits, "vec_id", "logits").withColumn("probability", F.round("probability", 6))


@query("h13_new_token_states", f"select text_id, layer step, layer % 2 layer, {show('v')} from fx_last")
def _(t):
    steps = t.states.withColumns({"step": F.col("layer"), "layer": F.col("layer") % 2})
    return h.new_token_states(steps).select("text_id", "step", "layer", *shown(v.doubles(F.col("state"))))


@query("h14_similarity_matrix", """select a.layer, a.text_id i, b.text_id j, round(list_inner_product(a.v, b.v), 6) dot from fx_pooled a join fx_pooled b
       on a.layer = b.layer and b.text_id between a.text_id + 1 and a.text_id + 3""")
def _(t):
    pooled = h.mean_pool(t.states)
    pairs = vs.band_pairs(pooled.select("layer", "text_id"), ["layer"], "text_id", 3)
    d = vs.pair_distances(pooled, pairs, ["layer", "text_id"], "pooled", ["dot"])
    return d.select(F.col("layer_a").alias("layer"), F.col("text_id_a").alias("i"), F.col("text_id_b").alias("j"), F.round("dot", 6).alias("dot"))
