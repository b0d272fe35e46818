"""Command line: run, run-stage, evaluate, validate-config, status, clear-checkpoints."""

from __future__ import annotations

import argparse
import sys

import tidemark


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidemark").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description="Curation of instruction-tuning data on Spark")
    p.add_argument("--version", action="version", version=tidemark.__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple) -> None:
        s = sub.add_parser(name)
        for names, options in flags:
            s.add_argument(*names, **options)

    data, out, conf = (("-i", "--input"), {"required": True}), (("-o", "--output"), {}), ("-c", "--config")
    command("run", (conf, {"required": True}), data, out, (("-r", "--resume"), {}))
    command("run-stage", (("stage",), {}), data, out, (conf, {}))
    command("evaluate", data, (("-r", "--report"), {"default": "reports"}))
    command("validate-config", (("config",), {}))
    command("status", (("-d", "--checkpoint-dir"), {"default": ".checkpoints"}))
    command("clear-checkpoints", (("-d", "--checkpoint-dir"), {"default": ".checkpoints"}), (("-y", "--yes"), {"action": "store_true"}))
    a = p.parse_args(argv)

    from tidemark.plans.config import load_config
    from tidemark.plans.pipeline import Checkpointer, Pipeline, Tidemark
    from tidemark.plans.stages import EvaluateStage
    from tidemark.sources.files import read_data, write_data

    if a.command == "run":
        app = Tidemark(_session(), a.config)
        result = app.run_pipeline(app.load(a.input), a.resume)
        result.report()
        if a.output:
            write_data(result.data, a.output)
    elif a.command == "run-stage":
        samples = read_data(_session(), a.input)
        result = Pipeline(load_config(a.config) if a.config else None).run_stage(a.stage, samples)
        if a.output:
            write_data(result, a.output)
        else:
            print(f"{len(samples)} -> {len(result)} samples")
    elif a.command == "evaluate":
        EvaluateStage(report_path=f"{a.report}/quality_report.html", metrics_path=f"{a.report}/metrics.json").process(read_data(_session(), a.input))
        print(f"reports are in {a.report}")
    elif a.command == "validate-config":
        try:
            c = load_config(a.config)
        except Exception as e:
            print(f"invalid: {e}", file=sys.stderr)
            return 1
        print(f"valid: {c.name} {c.version}\n" + "\n".join(f"  {s.name}: {len(s.operators)} operators" for s in c.stages))
    elif a.command == "status":
        found = Checkpointer(a.checkpoint_dir).list_checkpoints()
        print("\n".join(f"{x}: {Checkpointer(a.checkpoint_dir).facts(x)['sample_count']} samples" for x in found) or "no checkpoints")
    else:
        if a.yes or input("Delete all checkpoints? [y/N] ").strip().lower() == "y":
            Checkpointer(a.checkpoint_dir).clear()
            print("deleted")
    return 0


if __name__ == "__main__":
    sys.exit(main())
