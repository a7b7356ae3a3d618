"""Registered queries of joint fits, projections, errors of fluxes, meshes, discs and identities."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.functions import sky
from fringeframe.operators import matrix, regions, wcs
from fringeframe.plans import gaussians
from fringeframe.plans.products import Beam
from fringeframe.queries import FOV, IMAGE_SQL, MAPPING_SQL, GRID_SQL, MESH, POINTS_SQL, SIDE, STEP, image, points, query, rounded, sized_pixels
from fringeframe.sources.adapter import table

#: The sources that registered fits begin with: a Gaussian and a point.
START = (gaussians.Source(0.3, 0.02, -0.03, 0.06, 0.04, 0.5), gaussians.Source(0.2, -0.05, 0.04))
#: The same with their places as they are: what the registered fit looks for are fluxes and widths.
HELD = (replace(START[0], held=("x_as", "y_as", "angle")), replace(START[1], held=("x_as", "y_as")))
BEAM = Beam(0.03, 0.02, 30.0)


def columns_sql() -> str:
    """Real and imaginary parts of the model's derivatives and of the residual at START, for DuckDB."""
    k, spread = 2 * math.pi * sky.ARCSEC, 2 * math.pi**2 * sky.ARCSEC**2
    g, p = START
    c, s = math.cos(g.angle), math.sin(g.angle)
    along, across = f"(v * {c!r} - u * {s!r})", f"(u * {c!r} + v * {s!r})"
    taper = f"exp({-spread!r} * ({g.major**2!r} * {along} * {along} + {g.minor**2!r} * {across} * {across}))"
    turn = lambda x: f"({k!r} * (v * {x.y_as!r} - u * {x.x_as!r}))"
    unit = {0: (f"({taper} * cos({turn(g)}))", f"({-1.0!r} * {taper} * sin({turn(g)}))"), 1: (f"cos({turn(p)})", f"(-sin({turn(p)}))")}
    cols = []
    for n, src in enumerate(START):
        re, im = unit[n]
        cols.append((re, im))
        for axis, sign in (("u", 1), ("v", -1)):  # times i k u, or -i k v
            cols.append((f"({-sign * k * src.flux!r} * {axis} * {im})", f"({sign * k * src.flux!r} * {axis} * {re})"))
        if n == 0:
            for factor in (f"({-2 * spread * g.major**2!r} * {along} * {along})", f"({-2 * spread * g.minor**2!r} * {across} * {across})", f"({-2 * spread * (g.minor**2 - g.major**2)!r} * {along} * {across})"):
                cols.append((f"({g.flux!r} * {factor} * {re})", f"({g.flux!r} * {factor} * {im})"))
    model = [" + ".join(f"{src.flux!r} * {unit[n][part]}" for n, src in enumerate(START)) for part in (0, 1)]
    cols.append((f"(re - ({model[0]}))", f"(im - ({model[1]}))"))
    pairs = ", ".join(f"sum(a{i} * a{j} / (sig_re * sig_re) + b{i} * b{j} / (sig_im * sig_im)) s{i}_{j}" for i in range(len(cols)) for j in range(i, len(cols)))
    rows = " union all ".join(f"select {i} i, {j} j, s{i}_{j} / w f from sums" for i in range(len(cols)) for j in range(i, len(cols)))
    parts = ", ".join(f"{a} a{i}, {b} b{i}" for i, (a, b) in enumerate(cols))
    return f"with {POINTS_SQL}, cols as (select sig_re, sig_im, {parts} from points where sig_re > 0 and sig_im > 0), sums as (select sum(1e0 / (sig_re * sig_re)) w, {pairs} from cols) select i, j, round(f, 7) f from ({rows})"


@query("q_gaussian_sums", columns_sql())
def gaussian_sums(spark, sf_dir):
    """What one round of the joint fit sums over all samples, in units of the summed weight."""
    rows = points(spark, sf_dir)
    total = rows.where("sig_re > 0 and sig_im > 0").agg(F.sum(1.0 / (F.col("sig_re") * F.col("sig_re"))).alias("w"))
    return rounded(gaussians.step_sums(rows, START).crossJoin(F.broadcast(total)).select("i", "j", (F.col("f") / F.col("w")).alias("f")), 7)  # one row


@query("q_gaussian_fit")
def gaussian_fit(spark, sf_dir):
    """Fluxes and widths of a Gaussian and a point fitted together to all samples, with standard errors."""
    found = gaussians.fit(points(spark, sf_dir), HELD)
    rows = [(k, n, float(getattr(s, n)), s.errors[n]) for k, s in enumerate(found.sources) for n in s.free()]
    return spark.createDataFrame(rows, "source int, parameter string, value double, error double")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as Gaussians all over the field."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 1e4).alias("flux"), ((key % 29 - 14) * 0.011).alias("x_as"), ((key % 31 - 15) * 0.0098).alias("y_as"), (key % 5 * 0.004).alias("major"), (key % 3 * 0.003).alias("minor"), (key % 7 * 0.4).alias("angle"))


def spread_sql(a: str, b: str, angle: str) -> list[str]:
    s, c = f"sin({angle})", f"cos({angle})"
    return [f"({a} * {a} * {s} * {s} + {b} * {b} * {c} * {c})", f"({a} * {a} * {c} * {c} + {b} * {b} * {s} * {s})", f"(({a} * {a} - {b} * {b}) * {s} * {c})"]


BXX, BYY, BXY = spread_sql(repr(BEAM.major), repr(BEAM.minor), repr(math.pi - math.radians(BEAM.angle)))
SXX, SYY, SXY = spread_sql("major", "minor", "angle")


@query(
    "q_restored_gaussians",
    f"with {GRID_SQL}, src as (select s_acctbal / 1e4 flux, (s_suppkey % 29 - 14) * 11e-3 x, (s_suppkey % 31 - 15) * 98e-4 y, (s_suppkey % 5) * 4e-3 major, (s_suppkey % 3) * 3e-3 minor, (s_suppkey % 7) * 4e-1 angle from supplier), cov as (select flux, x, y, {SXX} + {BXX} xx, {SYY} + {BYY} yy, {SXY} + {BXY} xy from src), met as (select pix_y, pix_x, flux, xx, yy, xy, xx * yy - xy * xy det, x_as - x dx, y_as - y dy from grid, cov where abs(x_as - x) <= 6 * sqrt(xx) and abs(y_as - y) <= 6 * sqrt(yy)) select pix_y, pix_x, round(sum(flux * {BEAM.major * BEAM.minor!r} * exp(-5e-1 * (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / det) / sqrt(det)), 8) as value from met group by all",
)
def restored_gaussians(spark, sf_dir):
    return rounded(gaussians.restored(suppliers(spark, sf_dir), BEAM, SIDE, STEP))


#: The registered image's grid and one of finer, turned pixels of the other projection beside it, degrees.
HERE = wcs.Grid(83.6, -5.4, 7.5, 7.5, -STEP / 3600, -STEP / 3600, SIDE, SIDE)
THERE = wcs.Grid(83.6 + 1.3e-5, -5.4 + 0.7e-5, 11.2, 10.9, -STEP / 5230, STEP / 5170, 24, 22, 17.0, "TAN")


def sky_sql(g: wcs.Grid, x: str, y: str) -> tuple[str, str, str]:
    """SQL of (along, up, toward) of a pixel."""
    c, s = math.cos(math.radians(g.turn)), math.sin(math.radians(g.turn))
    a, b = f"(({x} - {g.ref_x!r}) * {math.radians(g.step_x)!r})", f"(({y} - {g.ref_y!r}) * {math.radians(g.step_y)!r})"
    return f"({a} * {c!r} - {b} * {s!r})", f"({a} * {s!r} + {b} * {c!r})", f"{math.sin(math.radians(g.dec))!r}, {math.cos(math.radians(g.dec))!r}"


ALONG, UP, _ = sky_sql(THERE, "x", "y")
S1, C1, S0, C0 = (f(math.radians(g.dec)) for g in (THERE, HERE) for f in (math.sin, math.cos))


@query(
    "q_wcs_resample",
    f"""with {IMAGE_SQL}, target as (select cast(id // {THERE.n_x} as integer) y, cast(id % {THERE.n_x} as integer) x from range({THERE.n_x * THERE.n_y}) t(id)),
 plane as (select x, y, {ALONG} a, {UP} b from target), ray as (select x, y, a / sqrt(a * a + b * b + 1) e, b / sqrt(a * a + b * b + 1) n, 1 / sqrt(a * a + b * b + 1) t from plane),
 world as (select x, y, degrees(asin(n * {C1!r} + t * {S1!r})) de, degrees(atan2(e, t * {C1!r} - n * {S1!r})) + {THERE.ra!r} ra from ray),
 back as (select x, y, cos(radians(de)) * sin(radians(ra - {HERE.ra!r})) l, sin(radians(de)) * {C0!r} - cos(radians(de)) * {S0!r} * cos(radians(ra - {HERE.ra!r})) m from world),
 placed as (select x, y, cast(floor(l / {math.radians(HERE.step_x)!r} + {HERE.ref_x!r} + 5e-1) as integer) sx, cast(floor(m / {math.radians(HERE.step_y)!r} + {HERE.ref_y!r} + 5e-1) as integer) sy from back)
 select y pix_y, x pix_x, round(dirty, 8) dirty from placed join image on image.pix_y = sy and image.pix_x = sx""",
)
def wcs_resample(spark, sf_dir):
    """The image of all samples on the other grid."""
    return rounded(wcs.resampled(image(spark, sf_dir), "dirty", HERE, THERE))


COV_SQL = f"{MAPPING_SQL}, mapped as (select pix_y, pix_x, mesh_id, weight from mapping where weight > 0), cov as (select cast(i as bigint) i, cast(j as bigint) j, sum(cast(embedding[i + 1] as double) * cast(embedding[j + 1] as double)) c from embeddings, range({MESH * MESH}) x(i), range({MESH * MESH}) y(j) where i <= j group by all)"


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the vectors' first components over all vectors, as the covariance of a mesh."""
    most = MESH * MESH
    return matrix.gram_of_arrays(table(spark, sf_dir, "embeddings"), "embedding").where((F.col("i") < most) & (F.col("j") < most)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("f").alias("c"))


@query("q_mapped_variance", f"with {COV_SQL} select a.pix_y, a.pix_x, round(sum(a.weight * b.weight * c * case when i = j then 1 else 2 end), 6) variance from mapped a join mapped b on a.pix_y = b.pix_y and a.pix_x = b.pix_x join cov on i = a.mesh_id and j = b.mesh_id group by all")
def mapped_variance(spark, sf_dir):
    return rounded(regions.mapped_variance(regions.bilinear_mapping(sized_pixels(spark), MESH, SIDE), covariance(spark, sf_dir)), 6)


@query(
    "q_region_flux_error",
    f"with {IMAGE_SQL}, {COV_SQL.replace(GRID_SQL + ',', '')}, region as (select pix_y, pix_x, dirty from image where beam >= 5e-1), v as (select mesh_id, sum(weight) v from mapped join region using (pix_y, pix_x) group by all), spread as (select sqrt(sum(a.v * b.v * c * case when i = j then 1 else 2 end)) e from cov join v a on i = a.mesh_id join v b on j = b.mesh_id) select count(*) n, round(sum(dirty), 7) flux, round(any_value(e), 6) error from region, spread",
)
def region_flux_error(spark, sf_dir):
    rows = image(spark, sf_dir)
    found = regions.region_flux_error(rows, "dirty", rows.where("beam >= 0.5"), regions.bilinear_mapping(sized_pixels(spark), MESH, SIDE), covariance(spark, sf_dir))
    return rounded(found, 7, error=6)


#: Rings of the registered disc, its radius in arcseconds, the phase that a part of a cell may turn by.
RINGS, RADIUS, TURN = 3, 0.12, 0.5
RINGS_SQL = f"r as (select id ring, greatest(1, cast(round_even(6.283185307179586 * (id + 5e-1), 0) as bigint)) n from range({RINGS}) t(id)), rings as (select ring, n cells, cast(coalesce(sum(n) over (order by ring rows between unbounded preceding and 1 preceding), 0) as bigint) first_cell, ring * {RADIUS / RINGS!r} r_in, (ring + 1) * {RADIUS / RINGS!r} r_out from r), cells as (select first_cell + k cell_id, r_in, r_out, k * 6.283185307179586 / cells th_lo, (k + 1) * 6.283185307179586 / cells th_hi from rings, range(40) s(k) where k < cells)"
VALUES_SQL = "vals as (select p_partkey % 28 cell_id, sum(p_size) * 1e0 as bright from part group by 1)"


def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brightness of the 28 cells: sizes of parts."""
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 28).alias("cell_id")).agg(F.sum("p_size").cast("double").alias("value"))


@query(
    "q_disc_visibilities",
    f"""with {POINTS_SQL}, {RINGS_SQL}, {VALUES_SQL}, far as (select max(sqrt(u * u + v * v)) * {2 * math.pi * sky.ARCSEC / TURN!r} q from points),
 cut as (select cell_id, r_in, r_out, th_lo, th_hi, cast(greatest(ceil((r_out - r_in) * q), 1) as bigint) n_r, cast(greatest(ceil(r_out * (th_hi - th_lo) * q), 1) as bigint) n_t from cells, far),
 node as (select (th_hi - th_lo) / 2 * (r_out * r_out - r_in * r_in) / (n_r * n_t) * bright w, sqrt(r_in * r_in + (r_out * r_out - r_in * r_in) * (a.k + 5e-1) / n_r) r, th_lo + (th_hi - th_lo) * (b.k + 5e-1) / n_t t from cut join vals using (cell_id), (select unnest(range(200)) k) a, (select unnest(range(200)) k) b where a.k < n_r and b.k < n_t),
 xy as (select sum(w) w, r * cos(t) x, r * sin(t) y from node group by r, t),
 uvs as (select spw, chan, u, v, count(*) n from points group by all),
 seen as (select spw, chan, u, v, n, sum(w * cos({2 * math.pi * sky.ARCSEC!r} * (v * y - u * x))) re, -sum(w * sin({2 * math.pi * sky.ARCSEC!r} * (v * y - u * x))) im from uvs, xy group by all)
 select spw, chan, cast(sum(n) as bigint) n, round(sum(n * re) / sum(n), 6) re, round(sum(n * im) / sum(n), 6) im from seen group by all""",
)
def disc_visibilities(spark, sf_dir):
    """Mean model visibility of a tiled disc at all samples, by channel; samples of one place are seen once."""
    from fringeframe.operators import disc

    places = points(spark, sf_dir).groupBy("spw", "chan", "u", "v").agg(F.count(F.lit(1)).alias("n"))
    longest = places.agg(F.max(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))).first()[0] or 0.0
    seen = disc.cell_visibilities(places, disc.nodes(disc.cells(spark, RINGS, RADIUS), longest, TURN), brightness(spark, sf_dir))
    mean = lambda c: (F.sum(F.col("n") * F.col(f"model_{c}")) / F.sum("n")).alias(c)
    return rounded(seen.groupBy("spw", "chan").agg(F.sum("n").alias("n"), mean("re"), mean("im")), 6)


@query(
    "q_disc_rendered",
    f"with {GRID_SQL}, {RINGS_SQL}, {VALUES_SQL}, fine as (select pix_y, pix_x, x_as + ((j + 5e-1) / 4 - 5e-1) * {STEP!r} x, y_as + ((i + 5e-1) / 4 - 5e-1) * {STEP!r} y from grid, range(4) a(i), range(4) b(j)), placed as (select pix_y, pix_x, cast(floor(sqrt(x * x + y * y) / {RADIUS / RINGS!r}) as bigint) ring, case when atan2(y, x) < 0 then atan2(y, x) + 6.283185307179586 else atan2(y, x) end angle from fine), met as (select pix_y, pix_x, first_cell + least(cast(floor(angle / 6.283185307179586 * cells) as bigint), cells - 1) cell_id from placed join rings using (ring)) select pix_y, pix_x, round(sum(bright) / 16e0, 6) as value from met join vals using (cell_id) group by all",
)
def disc_rendered(spark, sf_dir):
    from fringeframe.operators import disc

    return rounded(disc.rendered(sized_pixels(spark), disc.rings(spark, RINGS, RADIUS), brightness(spark, sf_dir), STEP), 6)


def hilbert_sql(bits: int) -> str:
    """The place along the curve through (pix_y, pix_x), one level after the other."""
    out = "h0 as (select pix_y, pix_x, beam, cast(pix_y as bigint) r, cast(pix_x as bigint) c, cast(0 as bigint) at_ from image)"
    for n, k in enumerate(reversed(range(bits))):
        s = 1 << k
        right, up, lc, lr = f"((c // {s}) % 2)", f"((r // {s}) % 2)", f"(c % {s})", f"(r % {s})"
        out += f", h{n + 1} as (select pix_y, pix_x, beam, at_ + {s * s} * case when {right} = 1 then case when {up} = 1 then 2 else 3 end else {up} end at_, case when {up} = 0 then case when {right} = 1 then {s - 1} - {lr} else {lr} end else {lc} end c, case when {up} = 0 then case when {right} = 1 then {s - 1} - {lc} else {lc} end else {lr} end r from h{n})"
    return out


@query(
    "q_hilbert_points",
    f"with {IMAGE_SQL}, {hilbert_sql(4)}, masked as (select * from h4 where pix_y + pix_x >= 5), top as (select max(beam) p from masked), dens as (select pix_y, pix_x, at_, greatest((greatest(beam, 0e0) / p) ** 2, 1e-2) d from masked, top), summed as (select *, sum(d) over (order by at_ rows between unbounded preceding and current row) upto, sum(d) over () total from dens), n as (select pix_y, pix_x, cast(floor(upto / total * 150 + 499999999e-9) - floor((upto - d) / total * 150 + 499999999e-9) as bigint) points from summed) select pix_y, pix_x, points from n where points > 0",
)
def hilbert_points(spark, sf_dir):
    """Mesh points over the beam of all samples inside a mask."""
    from fringeframe.operators.mesh import hilbert_points as drawn

    rows = image(spark, sf_dir)
    return drawn(rows, "beam", 4, 150, mask=rows.where("pix_y + pix_x >= 5"), stretch=40)


@query(
    "q_content_identity",
    "with v as (select l_linestatus, case when l_orderkey is null then '-' else length(l_orderkey::varchar) || ':' || l_orderkey end || '|' || case when l_returnflag is null then '-' else length(l_returnflag) || ':' || l_returnflag end || '|' || case when l_suppkey is null then '-' else length(l_suppkey::varchar) || ':' || l_suppkey end as name from lineitem) select count(*) n, cast(sum(cast('0x' || substr(md5(name), 1, 15) as bigint)) as varchar) as content from v",
)
def content_identity(spark, sf_dir):
    from fringeframe.plans.products import content_identity as identity

    return identity(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag", "l_suppkey"])


def argmax_sql(rounds: int, steps: int = 8) -> str:
    """A grid for each round, the best trial of each channel, and the next grid round it."""
    ranges = {"m": (-1.0, 1.0), "s": (0.05, 2.05)}
    sql = f"with {POINTS_SQL}, stats as (select spw, chan, count(*) * 1e0 n, sum(re) a, sum(re * re) b from points group by spw, chan), b0 as (select spw, chan, " + ", ".join(f"{lo!r} {n}_low, {hi!r} {n}_high" for n, (lo, hi) in ranges.items()) + " from stats)"
    for k in range(rounds):
        sql += f", t{k} as (select stats.*, m_low, m_high, s_low, s_high, m_low + (m_high - m_low) * i / {steps}e0 m, s_low + (s_high - s_low) * j / {steps}e0 s from stats join b{k} using (spw, chan), range({steps + 1}) x(i), range({steps + 1}) y(j)), s{k} as (select *, -n * ln(s) - (b - 2 * m * a + n * m * m) / (2 * s * s) score from t{k}), w{k} as (select * from (select *, row_number() over (partition by spw, chan order by score desc, m, s) turn from s{k}) where turn = 1), b{k + 1} as (select spw, chan, "
        sql += ", ".join(f"greatest({n} - ({n}_high - {n}_low) / {steps}e0, {lo!r}) {n}_low, least({n} + ({n}_high - {n}_low) / {steps}e0, {hi!r}) {n}_high" for n, (lo, hi) in ranges.items()) + f" from w{k})"
    return sql + f" select spw, chan, round(m, 9) m, round(s, 9) s, round(score / n, 6) score from w{rounds - 1}"


@query("q_nested_argmax", argmax_sql(4))
def nested_argmax(spark, sf_dir):
    """Mean and deviation of largest likelihood of each channel's real parts."""
    from fringeframe.operators.search import nested_argmax as searched

    re = F.col("re")
    stats = points(spark, sf_dir).groupBy("spw", "chan").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(re).alias("a"), F.sum(re * re).alias("b"))
    m, s = F.col("m"), F.col("s")
    score = -F.col("n") * F.log(s) - (F.col("b") - 2 * m * F.col("a") + F.col("n") * m * m) / (2 * s * s)
    found = searched(stats, ("spw", "chan"), {"m": (-1.0, 1.0), "s": (0.05, 2.05)}, score)
    return rounded(found.join(stats.select("spw", "chan", "n"), ["spw", "chan"]).select("spw", "chan", "m", "s", (F.col("score") / F.col("n")).alias("score")), 9, score=6)
