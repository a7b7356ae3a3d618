"""Command line: convert, fit, points, cube and demo on visibility files; to be run by spark-submit or python -m fringeframe.cli."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe import config
from fringeframe.operators import imaging, noise, selection
from fringeframe.plans import inversion, pointfit, products, strategy
from fringeframe.session import build_session
from fringeframe.sources import files, mock


class Parser(argparse.ArgumentParser):
    """Whole option names only; what it refuses is a ValueError."""

    def __init__(self, *args, **kwargs):
        super().__init__(*args, **{**kwargs, "allow_abbrev": False})

    def error(self, message: str) -> None:
        raise ValueError(message)


def parser() -> argparse.ArgumentParser:
    top = Parser(prog="fringeframe")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("--out", required=True)
        p.set_defaults(run=run)
        return p

    p = command("convert", convert, "estimate noise anew and write Parquet")
    p.add_argument("--dataset", required=True)
    p.add_argument("--noise", choices=["keep", "difference", "scaled", "hybrid"], default="keep")
    for name, run, text in (("fit", fit, "one image of all channels"), ("cube", cube, "an image for each channel"), ("points", points, "point components")):
        p = command(name, run, text)
        p.add_argument("--dataset", required=True)
        p.add_argument("--fov", type=float, required=True)
        p.add_argument("--image-centre", type=config.pair, default=(0.0, 0.0))
        p.add_argument("--reg", choices=["matern", "gaussian", "exponential"], default="matern")
        p.add_argument("--scale", type=float)
        p.add_argument("--criterion", choices=["evidence", "discrepancy"], default="evidence")
        p.add_argument("--log-strength", type=float)
        p.add_argument("--positive", action="store_true")
        p.add_argument("--significance", type=float, default=5.0)
        p.add_argument("--max-points", type=int, default=5)
    p = command("moments", moments, "moment maps of a FITS cube")
    p.add_argument("--dataset", required=True)
    p.add_argument("--rest-hz", type=float)
    p.add_argument("--systemic", type=float, default=0.0)
    p.add_argument("--mask-from", default="auto", choices=["auto", "snr", "residual", "empty", "self"])
    p.add_argument("--n-sigma", type=float, default=5.0)
    p.add_argument("--empty-planes", default="0")
    p.add_argument("--min-channels", type=int, default=1)
    p = command("demo", demo, "write a mock observation")
    p.add_argument("--samples", type=int, default=4000)
    return top


def prepared(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, strategy.Geometry]:
    vis = files.read_visibilities(spark, args.dataset)
    flat = vis if "u" in vis.columns else imaging.samples(vis, F.col("freq_hz"))
    x, y = args.image_centre
    moved = selection.recentred(flat, -x, y)
    q = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    sizes = moved.agg(F.max(q).alias("longest"), F.percentile_approx(q, 0.95).alias("effective")).first()
    return moved, strategy.geometry(args.fov, sizes.longest, sizes.effective)


def solved(spark: SparkSession, args: argparse.Namespace, rows: DataFrame, shape: strategy.Geometry) -> tuple[inversion.System, inversion.Trial]:
    system = inversion.System(inversion.collect_terms(rows, shape.mesh, args.fov), shape.mesh_step, args.scale or 3 * shape.mesh_step, args.reg)
    if args.log_strength is not None:
        return system, system.trial(args.log_strength, args.positive)
    search = inversion.search_evidence if args.criterion == "evidence" else inversion.search_discrepancy
    return system, search(system, positive=args.positive)[-1]


def convert(spark: SparkSession, args: argparse.Namespace) -> None:
    """keep: the noise as it is; difference: from neighbours in time; scaled: the given noise times one factor from them; hybrid: their level, the given noise's course in time."""
    vis = files.read_visibilities(spark, args.dataset)
    if args.noise != "keep":
        keyed = vis.withColumns({"ok": F.col("row_id"), "ln": F.lit(0), "pk": F.lit(0), "sk": F.lit(0), "px": F.lit(0.0)})
        claimed = F.col("sig_re")
        if args.noise == "difference":
            made = noise.estimated_sigma(keyed).withColumns({"sig_re": F.col("est_re"), "sig_im": F.col("est_im")})
        elif args.noise == "scaled":
            k = noise.relative_scale(keyed, claimed).first()
            re, im = noise.one_or_both(k["k_re"], k["k_im"])
            made = keyed.withColumns({"sig_re": claimed * re, "sig_im": claimed * im})
        else:
            made = noise.hybrid_sigma(keyed, noise.adjacent_pairs(keyed), claimed).withColumns({"sig_re": F.col("hyb_re"), "sig_im": F.col("hyb_im")})
        vis = noise.repaired(made.select(vis.columns))
    files.write_visibilities(vis, args.out, {"noise": args.noise, "source": args.dataset})


def fit(spark: SparkSession, args: argparse.Namespace) -> None:
    rows, shape = prepared(spark, args)
    system, best = solved(spark, args, rows, shape)
    n = shape.mesh
    image = best.image.reshape(n, n)
    dirty = system.terms.dirty / system.terms.sum_w
    residual = dirty - products.Response(system.terms.kernel).to(image) / system.terms.sum_w
    lobe = system.terms.kernel[n // 2 : n // 2 + n, n // 2 : n // 2 + n] / system.terms.sum_w
    beam = products.fit_beam(lobe, shape.mesh_step)
    arrays = {"model": image, "sigma": system.posterior(best.log_strength).reshape(n, n), "dirty": dirty, "residual": residual, "restored": products.restore(image, residual, beam, shape.mesh_step)}
    products.planes(spark, arrays).write.parquet(f"{args.out}/planes")
    chi2 = best.chi2 / (2 * system.terms.n_vis)
    write_text(args.out, "parameters.json", products.run_record(options=vars(args) | {"run": "fit"}, geometry=vars(shape), log_strength=best.log_strength, chi2_per_datum=chi2, log_evidence=best.log_evidence, beam=vars(beam)))


def cube(spark: SparkSession, args: argparse.Namespace) -> None:
    rows, shape = prepared(spark, args)
    _, best = solved(spark, args, rows, shape)
    channels = inversion.solve_channels(rows, shape.mesh, args.fov, best.log_strength, args.scale or 3 * shape.mesh_step, args.reg)
    channels.write.partitionBy("spw").parquet(f"{args.out}/cube")


def points(spark: SparkSession, args: argparse.Namespace) -> None:
    rows, shape = prepared(spark, args)
    found = pointfit.detect(rows, shape.image, args.fov, args.significance, args.max_points, 3 * shape.mesh_step)
    spark.createDataFrame([(c.x_as, c.y_as, c.flux, c.error) for c in found], "x_as double, y_as double, flux double, error double").write.parquet(f"{args.out}/components")


def demo(spark: SparkSession, args: argparse.Namespace) -> None:
    mock.observation(spark, args.samples, [mock.Gaussian(0.0, 0.0, 0.05, 0.3, 0.2, 0.5), mock.Point(-0.85, -0.65, 0.004)]).write.partitionBy("spw").parquet(args.out)


def moments(spark: SparkSession, args: argparse.Namespace) -> None:
    from fringeframe.plans.moments import run

    run(spark, args.dataset, args.out, args.rest_hz, args.systemic, args.mask_from, args.n_sigma, args.empty_planes, args.min_channels)


def write_text(folder: str, name: str, text: str) -> None:
    store, path = files.place(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as f:
        f.write(text.encode())


def arguments(argv: list[str]) -> argparse.Namespace:
    """Parsed flags; those of a configuration come before the given ones, which win."""
    early = argparse.ArgumentParser(add_help=False)
    early.add_argument("--config")
    found, rest = early.parse_known_args(argv)
    given = config.as_arguments(config.load(found.config)) if found.config else []
    return parser().parse_args([*rest[:1], *given, *rest[1:]])


def main(argv: list[str] | None = None) -> None:
    try:
        args = arguments(sys.argv[1:] if argv is None else argv)
    except ValueError as e:
        raise SystemExit(f"fringeframe: {e}") from None
    spark = build_session()
    write_text(args.out + "-input", "input_parameters.json", config.record(args))
    args.run(spark, args)


if __name__ == "__main__":
    main()
