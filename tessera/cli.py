"""Command line: inspect, convert, annotate, process, plugins, experiment."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from tessera import __version__
from tessera.model.spec import ColumnSpec, FrameSpec, Mode


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _load(files: list[str], mode: Mode = Mode.IGNORE, required: bool = False):
    from tessera.frame import AnnotatedFrame

    return AnnotatedFrame.from_files(_spark(), files, metadata_required=required, mode=mode)


def inspect(args: argparse.Namespace) -> None:
    from tessera.operators.filters import filter_by_expressions
    from tessera.sources.archive import expanded

    with expanded(args.files) as files:
        frame = _load(list(map(str, files)))
        if args.filter:
            frame = frame._with(filter_by_expressions(frame.df, args.filter), frame.spec).validate(Mode.UPDATE_METADATA)
        if args.columns:
            frame = frame._with(frame.df.select(*args.columns), frame.spec.select(args.columns))
        for c in frame.spec.columns:
            print(f"{c.name}:")
            for key, value in c.to_dict().items():
                if key != "name":
                    print(f"    {key}: {value}")
        for name, note in frame.spec.annotations.items():
            print(f"{name}: {note.to_dict()[name]}")
        if args.head:
            frame.df.show(args.head, truncate=False)
        if args.tail:
            for row in frame.df.tail(args.tail):
                print(row)


def convert(args: argparse.Namespace) -> None:
    from tessera.sources.archive import expanded
    from tessera.sources.writers import save

    spec = FrameSpec.load_yaml(args.metadata_input) if args.metadata_input else None
    with expanded(args.files) as files:
        groups = [[f] for f in files] if args.output_dir else [list(files)]
        for group in groups:
            frame = _load(list(map(str, group)))
            if spec is not None:
                frame = type(frame)(frame.df, spec, Mode(args.validation_mode), strict_types=False)
            target = Path(args.output_dir) / f"{group[0].stem}{args.output_type}" if args.output_dir else Path(args.output_file)
            save(frame, target)
            print(f"Saved: {target}")


def annotate(args: argparse.Namespace) -> None:
    from tessera import validation
    from tessera.sources.specfiles import spec_name
    from tessera.sources.writers import save

    groups = [[f] for f in args.files] if args.inplace else [args.files]
    for group in groups:
        frame = _load(group)
        spec = FrameSpec.load_yaml(args.apply) if args.apply else validation.infer(frame.df, known=frame.spec)
        changes: dict[str, dict] = {}
        for key in ("description", "abbreviation", "unit", "representation_type"):
            for item in getattr(args, f"set_{key}") or []:
                column, _, value = item.partition(":")
                if column not in spec:
                    raise KeyError(f"annotate: no column '{column}'")
                changes.setdefault(column, {})[key] = value
        spec = spec.with_columns(*[spec[c].but(**body) for c, body in changes.items()])
        if args.apply or args.inplace:
            target = Path(group[0]) if args.inplace else Path(args.output_dir or ".") / Path(group[0]).name
            frame = type(frame)(frame.df, spec, Mode.READONLY, strict_types=False)
            fresh = target.with_name(target.name + ".new") if args.inplace else target
            save(frame, fresh.with_suffix(target.suffix) if not args.inplace else fresh)
            if args.inplace:
                _replace(fresh, target, frame.spec)
            print(f"Saved: {target}")
        else:
            path = Path(args.output_dir or Path(group[0]).parent) / spec_name(group).name
            spec.save_yaml(path)
            print(f"Saved: {path}")


def _replace(fresh: Path, target: Path, spec: FrameSpec) -> None:
    """Put a complete new dataset in the place of the old one."""
    import shutil

    from tessera.sources.specfiles import spec_name

    fresh.with_name(fresh.stem + ".spec.yaml").unlink(missing_ok=True)
    shutil.rmtree(target) if target.is_dir() else target.unlink()
    fresh.rename(target)
    spec.save_yaml(spec_name([target]))


def process(args: argparse.Namespace) -> None:
    from tessera.plans.pipeline import Pipeline
    from tessera.sources.archive import expanded
    from tessera.sources.writers import save

    pipeline = Pipeline.load(args.pipeline)
    with expanded(args.files) as files:
        result = pipeline.transform(_load(list(map(str, files))))
        if args.output_file:
            save(result, args.output_file)
            print(f"Saved: {args.output_file}")
        result.df.show(args.head)


def plugins(args: argparse.Namespace) -> None:
    import tessera.domains.maritime.steps  # noqa: F401 - their steps are listed too
    from tessera.plans.plugins import listing

    print("\n".join(listing()))


def experiment(args: argparse.Namespace) -> None:
    from tessera.experiments import Experiment

    report = Experiment.load(args.file).run(_spark())
    print(f"Finished: {report['label']}")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tessera", description="Annotated data and checked pipelines on Spark")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--loglevel", default="WARNING")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, text: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.set_defaults(run=run)
        return p

    p = command("inspect", inspect, "show specification and rows")
    p.add_argument("-f", "--files", nargs="+", required=True)
    p.add_argument("--filter", action="append", help="column operator value, see parse_filter")
    p.add_argument("--columns", nargs="+")
    p.add_argument("--head", type=int, default=0)
    p.add_argument("--tail", type=int, default=0)

    p = command("convert", convert, "write as another format, with a specification")
    p.add_argument("-f", "--files", nargs="+", required=True)
    p.add_argument("-o", "--output-file", default="output.parquet")
    p.add_argument("--output-dir", help="convert each file on its own")
    p.add_argument("--output-type", default=".parquet")
    p.add_argument("-m", "--metadata-input")
    p.add_argument("--validation-mode", choices=[m.value for m in Mode], default=Mode.READONLY.value)

    p = command("annotate", annotate, "extract, change or apply a specification")
    p.add_argument("-f", "--files", nargs="+", required=True)
    p.add_argument("--apply", help="a specification file")
    p.add_argument("--inplace", action="store_true")
    p.add_argument("-o", "--output-dir")
    for key in ("description", "abbreviation", "unit", "representation_type"):
        p.add_argument(f"--set-{key}", action="append", metavar="COLUMN:VALUE", dest=f"set_{key}")

    p = command("process", process, "run a saved pipeline")
    p.add_argument("-f", "--files", nargs="+", required=True)
    p.add_argument("--pipeline", required=True)
    p.add_argument("-o", "--output-file")
    p.add_argument("--head", type=int, default=10)

    command("plugins", plugins, "list steps")
    p = command("experiment", experiment, "run an experiment file")
    p.add_argument("file")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.loglevel.upper())
    try:
        args.run(args)
    except Exception as e:  # noqa: BLE001 - the command line's last resort
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
