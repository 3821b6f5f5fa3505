"""Command line: condense or translate the books of a file or folder."""

from __future__ import annotations

import argparse
import json
import os
import sys

import foliant


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foliant")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    for name in ("condense", "translate"):
        one = sub.add_parser(name)
        one.add_argument("input")
        one.add_argument("--out", default="out")
        one.add_argument("--formats", default="md")
        one.add_argument("--dry-run", action="store_true")
        one.add_argument("--resume", action="store_true")
        one.add_argument("--to", required=name == "translate", help="language to translate to")
        one.add_argument("--from", dest="source", help="language to translate from")
        one.add_argument("--manual-toc", help="JSON file with the chapters of a PDF: titles and start pages")
        one.add_argument("--glossary", help="JSON file of source and target terms")
        one.add_argument("--service", help="a known service; its keys are read from the environment")
        one.add_argument("--thinking", help="how much the service is to think, or auto")
        one.add_argument("--url", help="the address of a chat-completions service; without one, texts are cut by rule")
        one.add_argument("--model", default="")
        one.add_argument("--keys", help="keys of the service, parted by commas")
        one.add_argument("--host", action="append", default=[], help="a host that keys may go to")
        one.add_argument("--rank-images", action="store_true", help="let the service choose the images")
        if name == "condense":
            one.add_argument("--ratio", type=float, default=0.30)
            one.add_argument("--chunk-tokens", type=int, default=2000)
    return top


def pdf_options(spark, args, provider) -> dict[str, object]:
    """What reading a PDF needs besides its path: contents given by hand, else a service that infers them."""
    from foliant.functions.prompts import manual_toc
    from foliant.functions.provider import Extracting

    if not args.input.lower().endswith(".pdf"):
        return {}
    toc = manual_toc(spark, args.manual_toc) if args.manual_toc else None
    return {"manual_toc": toc, "provider": None if isinstance(provider, Extracting) else provider}


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(foliant.__version__)
        return 0
    from foliant import engine
    from foliant.functions.provider import ChatProvider, Extracting, service
    from foliant.operators.render import formats
    from foliant.session import local_session

    asked = formats(args.formats.split(","))
    spark = spark or local_session("foliant")
    if args.service:
        provider = service(args.service, args.model, dict(os.environ), url=args.url, thinking=args.thinking)
    else:
        provider = ChatProvider(args.url, args.model, args.keys, frozenset(args.host)) if args.url else Extracting()
    books = engine.read(spark, args.input, **pdf_options(spark, args, provider))
    if args.dry_run:
        rows = engine.estimate(books, ratio=getattr(args, "ratio", 1.0), chunk_tokens=getattr(args, "chunk_tokens", 2000), model=args.model, translate=bool(args.to))
        print("\n".join(rows.toJSON().collect()))  # a line a book
        return 0
    outcomes = []

    def told(phase: str, counts: dict[str, int]) -> None:
        print(f"{phase}: {counts['rows']} rows, {counts['reused']} reused, {counts['calls']} calls", file=sys.stderr)

    logged = lambda name: {"log_path": f"{args.out}/.foliant/{name}", "resume": args.resume, "model": args.model, "tell": told}
    if args.command == "condense":
        outcomes.append(engine.condense(spark, books, provider, ratio=args.ratio, chunk_tokens=args.chunk_tokens, **logged("condense")))
        books = outcomes[-1].books
    if args.to:
        terms = None
        if args.glossary:
            with open(args.glossary, encoding="utf-8") as f:
                terms = {str(a): str(b) for a, b in json.load(f).items() if str(a).strip() and str(b).strip()}
        outcomes.append(engine.translate(books, provider, args.to, terms=terms, source=args.source, **logged("translate")))
        books = outcomes[-1].books
    if args.rank_images:
        if not hasattr(provider, "generate_with_image"):
            raise ValueError("images can only be ranked by a service that sees them")
        outcomes.append(engine.judge_images(books, provider, **logged("images")))
        books = outcomes[-1].books
    _, skipped = engine.write(engine.chosen(books), args.out, asked)
    for outcome in outcomes:
        for table in (outcome.report, outcome.usage(), outcome.reuse()):
            for row in [] if table is None else table.toJSON().collect():  # a line a book and phase
                print(row)
        warned = outcome.warned()
        for row in [] if warned is None else warned.collect():
            print(f"warning: {row['doc']}: {row['warning']}", file=sys.stderr)
    for text in skipped:
        print(f"warning: {text}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
