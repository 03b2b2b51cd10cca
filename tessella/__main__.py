"""Command line: python -m tessella index | query | evaluate | run | suite."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from tessella.operators.evaluation import Gates
from tessella.operators.filters import parse_filter
from tessella.plans.knowledge import run_all, run_evaluation, run_index, run_query
from tessella.plans.settings import Settings, load_settings
from tessella.session import get_session


def _ks(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.replace(" ", "").split(",") if x)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella", description="Build and query a document knowledge base.")
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--store", help="directory of the snapshots")
    shared.add_argument("--reranker", help="cross_encoder, colbert or none")
    shared.add_argument("--provider", help="registered provider")
    shared.add_argument("--env-file", action="append", default=[])
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, summary: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=summary, parents=[shared])

    index = command("index", "bring the store in line with a source")
    query = command("query", "answer a question")
    evaluate = command("evaluate", "measure retrieval on labelled queries")
    everything = command("run", "index, answer and evaluate")
    for p in (index, everything):
        p.add_argument("source")
        p.add_argument("--acl", action="append")
        p.add_argument("--reset", action="store_true")
    for p in (query, everything):
        p.add_argument("query")
        p.add_argument("--top-k", type=int)
        p.add_argument("--filter", help="JSON object of metadata conditions")
    evaluate.add_argument("--query")
    for p in (evaluate, everything):
        p.add_argument("--dataset")
        p.add_argument("--top-k-values", type=_ks, default=(1, 3, 5))
        for kind in ("sources", "doc-ids", "chunk-ids"):
            p.add_argument(f"--relevant-{kind}", nargs="*", default=[])
    cases = command("suite", "run the quality suite against its gates")
    cases.add_argument("cases")
    cases.add_argument("--gates", help="JSON file of thresholds")
    cases.add_argument("--output")
    cases.add_argument("--fail-on-regression", default=False, action="store_true")
    return top


def _settings(args: argparse.Namespace) -> Settings:
    given = {k: getattr(args, k) for k in ("store", "reranker", "provider") if getattr(args, k)}
    return replace(load_settings(tuple(args.env_file)), **given).checked()


def _labels(args: argparse.Namespace) -> dict[str, list[str]]:
    return {"relevant_sources": args.relevant_sources, "relevant_doc_ids": args.relevant_doc_ids, "relevant_chunk_ids": args.relevant_chunk_ids}


def main(arguments: "list[str] | None" = None) -> int:
    args = parser().parse_args(arguments)
    settings = _settings(args)
    spark = get_session()
    out: object
    if args.command == "index":
        out = vars(run_index(spark, args.source, settings, acl=args.acl, reset=args.reset))
    elif args.command == "query":
        out = run_query(spark, args.query, settings, args.top_k, parse_filter(args.filter))
    elif args.command == "evaluate":
        out = run_evaluation(spark, settings, args.query, args.dataset, _labels(args), args.top_k_values)
    elif args.command == "run":
        wanted = {"dataset": args.dataset} if args.dataset else {"labels": _labels(args)} if any(_labels(args).values()) else {}
        out = run_all(spark, args.source, args.query, settings, **wanted)
        out["index"] = vars(out["index"])
    else:
        from tessella.plans.suite import run_suite
        from tessella.sources.datasets import write_report

        gates = Gates()
        if args.gates:
            with open(args.gates, encoding="utf-8") as f:
                gates = Gates.load(f.read())
        out = run_suite(spark, args.cases, gates)
        if args.output:
            write_report(out, args.output)
        print(json.dumps(out, ensure_ascii=False, default=str))
        return int(args.fail_on_regression and not out["ok"])
    print(json.dumps(out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
