"""Command line: ``spark-submit -m scrubline`` or ``python -m scrubline --input ...``."""

from __future__ import annotations

import argparse

from scrubline.options import FILL_MODES, PAD_MODES, PRESETS, CleanOptions
from scrubline.plans.files import clean_files
from scrubline.session import build_session


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="scrubline", description="Clean delimited files with Spark.")
    p.add_argument("--input", "-i", nargs="+", required=True, help="files, folders or globs")
    p.add_argument("--output-dir", "-o")
    p.add_argument("--inplace", action="store_true")
    p.add_argument("--suffix", default="_cleaned")
    p.add_argument("--delimiter")
    p.add_argument("--preset", choices=sorted(PRESETS), help="start from a named preset")
    p.add_argument("--no-trim", dest="trim", action="store_false", default=None)
    p.add_argument("--keep-empty-rows", dest="drop_empty_rows", action="store_false", default=None)
    p.add_argument("--drop-duplicates", action="store_true", default=None)
    p.add_argument("--dedup-keys", nargs="*")
    p.add_argument("--pad-rows", choices=PAD_MODES)
    p.add_argument("--remove-empty-columns", action="store_true", default=None)
    p.add_argument("--audit", help="folder of the audit table (Parquet, appended)")
    p.add_argument("--no-log", dest="log", action="store_false", help="write no audit table")
    p.add_argument("--infer-types", action="store_true", default=None)
    p.add_argument("--parse-dates", action="store_true", default=None)
    p.add_argument("--date-format")
    p.add_argument("--type-threshold", type=float)
    p.add_argument("--fill-missing", choices=FILL_MODES)
    p.add_argument("--fill-constant")
    p.add_argument("--na", dest="na_tokens", action="append")
    return p.parse_args(argv)


def options_from(args: argparse.Namespace) -> CleanOptions:
    """The preset, or the defaults, changed by every option that was given."""
    base = PRESETS[args.preset] if args.preset else CleanOptions()
    given = {
        name: getattr(args, name)
        for name in CleanOptions.__dataclass_fields__
        if getattr(args, name, None) is not None
    }
    for name in ("dedup_keys", "na_tokens"):
        if name in given:
            given[name] = tuple(given[name])
    return base.but(**given)


def main(argv: list[str] | None = None) -> None:
    args = parse_args(argv)
    spark = build_session()
    audit_path = args.audit
    if audit_path is None and args.log and args.output_dir:
        audit_path = args.output_dir.rstrip("/") + "/_audit"
    audit = clean_files(
        spark, args.input, options_from(args), args.output_dir, args.suffix, args.inplace,
        audit_path if args.log else None,
    )
    shown = audit.select("input_path", "output_path", "rows_in", "rows_out")
    for row in shown.orderBy("input_path").collect():  # one row for each input
        print(f"{row['input_path']} -> {row['output_path']}: {row['rows_in']} rows in, {row['rows_out']} out")


if __name__ == "__main__":
    main()
