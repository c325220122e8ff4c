"""Command line: ``python -m annoweave load|ontology|report|compare`` (or via spark-submit)."""

from __future__ import annotations

import argparse

from annoweave.operators.triples import Vocabulary, example_classes, triple_summary
from annoweave.plans.load import (
    CHECKED, REJECTS, UNCHECKED, load_documents, load_lines, read_rejects, rejects_report)
from annoweave.plans.ontology import generate_from_file
from annoweave.plans.report import comparison_report, dataset_report
from annoweave.session import build_session, path_exists, size_shuffles
from annoweave.sinks.tables import FILE_FORMATS, export_csv, folder_bytes
from annoweave.sinks.triples import GROUPED_FORMATS
from annoweave.sources.tables import read_tables


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="annoweave")
    commands = parser.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="shred annotation documents into eight tables")
    load.add_argument("input")
    load.add_argument("output")
    load.add_argument("--format", choices=(*FILE_FORMATS, "catalog"), default="parquet")
    load.add_argument("--sample-size", type=int, help="keep a sample of so many rows; all rows without it")
    load.add_argument("--small-dataset-mode", action="store_true", help="keep a very small sample")
    load.add_argument("--all-images", action="store_true", help="sample annotations only")
    load.add_argument("--strict", action="store_true", help="end on unreadable input instead of reporting it")
    load.add_argument("--unchecked", action="store_true", help="take rows as they come")
    load.add_argument("--lines", action="store_true",
                      help="the input is a folder of <member>.jsonl instead of documents")
    load.add_argument("--load-id", help="publish the tables together, once, under this name")
    load.add_argument("--append", action="store_true", help="add to the published tables")
    load.add_argument("--staging", help="keep staged files in this folder")
    owl = commands.add_parser("ontology", help="turn a category file into triples")
    owl.add_argument("input")
    owl.add_argument("output")
    owl.add_argument("--format", choices=("xml", "nt", *GROUPED_FORMATS), default="xml")
    owl.add_argument("--base", default=Vocabulary.base)
    owl.add_argument("--dataset", default=Vocabulary.dataset)
    owl.add_argument("--see-also", default=Vocabulary.see_also)
    owl.add_argument("--lenient", action="store_true", help="leave out categories that cannot be used")
    export = commands.add_parser("export", help="write a stored dataset as CSV")
    export.add_argument("root")
    export.add_argument("output")
    report = commands.add_parser("report", help="statistics of a stored dataset")
    report.add_argument("root")
    both = commands.add_parser("compare", help="compare a dataset with its sample")
    both.add_argument("full")
    both.add_argument("sample")
    for command in (report, both, export):
        command.add_argument("--format", choices=FILE_FORMATS, default="parquet")
    return parser


def _show(frames: dict) -> None:
    for title, df in frames.items():
        print(title)
        df.show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session()
    sources = [vars(args).get(name) for name in ("input", "root", "full", "sample")]
    size_shuffles(spark, sum(folder_bytes(spark, path) for path in sources
                             if path and path_exists(spark, path)))
    if args.command == "load":
        base = UNCHECKED if args.unchecked else CHECKED
        options = type(base)(**{**vars(base), "sample_size": args.sample_size,
                                "small_dataset_mode": args.small_dataset_mode,
                                "all_images": args.all_images, "fail_on_rejects": args.strict})
        load = load_lines if args.lines else load_documents
        tables = load(spark, args.input, args.output, options, fmt=args.format,
                      staging=args.staging, load_id=args.load_id, append=args.append)
        _show({"statistics": dataset_report(tables)["statistics"]})
        if args.format != "catalog":
            names = REJECTS if not args.unchecked else REJECTS[:4]
            _show({"left out": rejects_report(spark, args.output, (*names, "duplicates"))})
            if not args.unchecked:
                _show({"placeholder licenses": read_rejects(spark, args.output, "licenses")})
    elif args.command == "ontology":
        words = Vocabulary(base=args.base, dataset=args.dataset, see_also=args.see_also)
        triples = generate_from_file(spark, args.input, args.output, args.format, words,
                                     strict=not args.lenient)
        _show({"summary": triple_summary(triples), "classes": example_classes(triples)})
    elif args.command == "export":
        export_csv(read_tables(spark, args.root, args.format), args.output)
    elif args.command == "report":
        _show(dataset_report(read_tables(spark, args.root, args.format)))
    else:
        _show(comparison_report(spark, args.full, args.sample, args.format))


if __name__ == "__main__":
    main()
