"""Command line: monitor, analyze, ids, infer."""

from __future__ import annotations

import argparse
import contextlib
import dataclasses
import json
import os
import sys
import time
from fractions import Fraction

from streamspec.analysis.checker import check
from streamspec.analysis.graph import buffers, memory, required_inputs
from streamspec.lang import tree as t
from streamspec.lang.diagnostics import SpecError
from streamspec.lang.parser import parse
from streamspec.sinks import text


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="streamspec")
    sub = p.add_subparsers(dest="command", required=True)

    def common(q: argparse.ArgumentParser) -> None:
        q.add_argument("spec")
        out = q.add_mutually_exclusive_group()
        out.add_argument("--stdout", action="store_true")
        out.add_argument("--stderr", action="store_true")
        out.add_argument("--output", metavar="FOLDER")
        q.add_argument("--delay")
        q.add_argument("--verbosity", choices=[*text.VERBOSITY, "quiet"], default="triggers")
        q.add_argument("--time-info-rep", choices=text.TIMES, default="hide")

    m = sub.add_parser("monitor", help="run a specification over a CSV trace")
    common(m)
    source = m.add_mutually_exclusive_group(required=True)
    source.add_argument("--csv-in", metavar="FILE")
    source.add_argument("--stdin", action="store_true")
    m.add_argument("--csv-time-column", type=int)
    m.add_argument("--online", action="store_true", help="events are stamped as they are read, deadlines come by the clock")
    i = sub.add_parser("ids", help="run a specification over a packet capture")
    common(i)
    i.add_argument("network")
    packets = i.add_mutually_exclusive_group(required=True)
    packets.add_argument("--pcap-in", metavar="FILE")
    packets.add_argument("--net-iface", metavar="NAME", help="follow the packets of a network interface")
    i.add_argument("--packets", type=int, help="end after so many packets of the interface")
    a = sub.add_parser("analyze", help="what the analyses know of a specification")
    a.add_argument("spec")
    a.add_argument("mode", nargs="?", choices=("parse", "ast", "pretty-print", "analyze", "ir"), default="analyze", help="whether it can be parsed, its syntax tree, its normalised text, what the analyses know, or the streams in order of evaluation")
    f = sub.add_parser("infer", help="guess the schema of a CSV file")
    f.add_argument("file")
    return p


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("streamspec").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def describe(source: str) -> dict:
    """Types, clocks, layers, inputs and memory of a specification."""
    spec = check(source)
    bound, needs = memory(spec), required_inputs(spec)
    return {
        "inputs": {n: str(s.type) for n, s in spec.inputs.items()},
        "outputs": {n: {"type": str(s.type), "clock": str(s.clock), "layer": s.layer, "inputs": sorted(needs[n])} for n, s in spec.outputs.items()},
        "triggers": [{"message": x.message, "clock": str(x.stream.clock)} for x in spec.triggers],
        "windows": [{"target": w.target, "seconds": float(w.duration), "function": w.function, "exactly": w.exactly} for w in spec.windows],
        "bytes": bound.bytes, "buffers": bound.buffers, "warnings": [str(w) for w in spec.warnings],
    }


def syntax(node: object) -> object:
    """A syntax tree as JSON: the kind of each node, its place, and its parts."""
    if dataclasses.is_dataclass(node):
        parts = {f.name: syntax(getattr(node, f.name)) for f in dataclasses.fields(node) if f.name not in ("source", "warnings")}
        return {"node": type(node).__name__, **parts}
    if isinstance(node, (list, tuple)):
        return [syntax(x) for x in node]
    return str(node) if isinstance(node, Fraction) else node


def lowered(source: str) -> dict:
    """The streams in order of evaluation, with types of all expressions, accesses, clocks and memory."""
    spec = check(source)
    depth = buffers(spec)

    def typed(e: t.Expr) -> dict:
        kind = spec.types.get(e)
        inner = [typed(x) for x in vars(e).values() if isinstance(x, t.Expr)] + [typed(x) for v in vars(e).values() if isinstance(v, list) for x in v if isinstance(x, t.Expr)]
        return {"expression": str(e), "operation": type(e).__name__, "type": None if kind is None else str(kind)} | ({"of": inner} if inner else {})

    order = sorted(((s.layer, n, s) for n, s in spec.streams().items() if not s.is_input), key=lambda x: x[:2])
    return {
        "inputs": [{"name": n, "type": str(s.type), "values": depth[n]} for n, s in spec.inputs.items()],
        "order": [
            {"name": n, "layer": layer, "type": str(s.type), "clock": str(s.clock), "values": depth.get(n, 1), "uses": [dataclasses.asdict(u) for u in s.uses], "body": typed(s.expr)}
            for layer, n, s in order
        ],
        "windows": [{"target": w.target, "seconds": float(w.duration), "function": w.function, "exactly": w.exactly, "type": str(w.type)} for w in spec.windows],
        "triggers": [{"stream": x.stream.name, "message": x.message} for x in spec.triggers],
    }


def analyzed(source: str, mode: str) -> str:
    if mode == "parse":
        tree = parse(source)
        return f"{len(tree.inputs)} inputs, {len(tree.outputs)} outputs, {len(tree.triggers)} triggers, {len(tree.constants)} constants"
    if mode == "pretty-print":
        return str(parse(source))
    made = syntax(parse(source)) if mode == "ast" else lowered(source) if mode == "ir" else describe(source)
    return json.dumps(made, indent=2, ensure_ascii=False)


def _followed(args: argparse.Namespace, spec, channel: str, verbosity: str) -> None:
    """Evaluates events as they are read, in this process."""
    from streamspec.sources import pcap
    from streamspec.streaming import live
    from streamspec.streaming.monitor import Monitor

    monitor = Monitor(spec)
    with contextlib.ExitStack() as stack:
        out = sys.stdout if channel == "stdout" else sys.stderr
        if channel == "file":
            os.makedirs(args.output, exist_ok=True)
            out = stack.enter_context(open(os.path.join(args.output, "lines.txt"), "w", encoding="utf-8"))
        printer, began = text.Printer(monitor, args.time_info_rep, verbosity, out), time.perf_counter()
        if args.command == "ids":
            packets = pcap.live(args.net_iface, args.network, args.packets)
            live.follow(({n: f.get(n) for n in spec.inputs} for f in packets), monitor, printer)
        else:
            lines = sys.stdin if args.stdin else stack.enter_context(open(args.csv_in, newline="", encoding="utf-8"))
            timed, rows = live.rows(lines, spec, args.csv_time_column)
            if args.online or not timed and args.delay is None:
                live.follow((values for _, values in rows), monitor, printer)
            else:
                live.replay(rows, monitor, printer, args.delay)
        printer.summary(time.perf_counter() - began)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "infer":
        from streamspec.sources.infer import describe as guess

        print(guess(_session(), args.file))
        return 0
    with open(args.spec, encoding="utf-8") as f:
        source = f.read()
    try:
        if args.command == "analyze":
            print(analyzed(source, args.mode))
            return 0
        spec = check(source)
    except SpecError as e:
        print(e, file=sys.stderr)
        return 1
    channel = "file" if args.output else "stdout" if args.stdout else "stderr"
    verbosity = "silent" if args.verbosity == "quiet" else args.verbosity
    if args.command == "ids" and args.net_iface or args.command == "monitor" and (args.stdin or args.online):
        _followed(args, spec, channel, verbosity)
        return 0
    from streamspec.plans.batch import evaluate
    from streamspec.sources import csv, pcap

    spark = _session()
    if args.command == "ids":
        trace = pcap.read(spark, args.pcap_in, spec, args.network, args.delay)
    else:
        trace = csv.read(spark, args.csv_in, spec, args.csv_time_column, args.delay)
    text.show(evaluate(spec, trace.df), trace.start, args.time_info_rep, verbosity, channel, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
