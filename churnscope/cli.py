"""python -m churnscope.cli scan | hotspots | explain"""

from __future__ import annotations

import argparse
import os
import sys

from churnscope.plans import documents
from churnscope.plans.scan import Scan
from churnscope.session import session
from churnscope.sources.store import IndexIncomplete, IndexLocked, Store
from churnscope.sources.walk import INDEX_DIR

VERSION = "0.1.0"


def index_root(start: str) -> str:
    """The nearest folder from ``start`` upwards that holds an index."""
    at = os.path.realpath(start)
    while not os.path.isdir(os.path.join(at, INDEX_DIR)):
        if at == os.path.dirname(at):
            raise IndexIncomplete("no index here or above; run a scan first")
        at = os.path.dirname(at)
    return at


def inside(root: str, path: str, cwd: str) -> str:
    """A path as the index names it; ValueError outside the root."""
    full = os.path.normpath(os.path.join(cwd, path)) if path else ""
    if not full.startswith(root + os.sep):
        raise ValueError(f"{path!r} is not inside {root}")
    return os.path.relpath(full, root).replace(os.sep, "/")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="churnscope")
    p.add_argument("-v", "--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("path", nargs="?", default=".")
    for flag in ("--json", "--pretty", "--full"):
        scan.add_argument(flag, action="store_true")
    hot = sub.add_parser("hotspots")
    for flag in ("--include-tests", "--json", "--verbose"):
        hot.add_argument(flag, action="store_true")
    size = hot.add_mutually_exclusive_group()
    size.add_argument("--top", type=int, default=5)
    size.add_argument("--all", action="store_true")
    sub.add_parser("explain").add_argument("path")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.command == "scan" and args.pretty and not args.json:
        p.error("--pretty needs --json")
    try:
        spark = spark or session(master=os.environ.get("SPARK_MASTER", "local[*]"))
        if args.command == "scan":
            done = Scan(spark, args.path).run(full=args.full)
            print(documents.to_json(done, args.pretty) if args.json else documents.scan_text(done))
            return 0
        root = index_root(".")
        store = Store(spark, f"file://{root}/{INDEX_DIR}")
        with store.lock(args.command):  # no scan may move tables while they are read
            if args.command == "hotspots":
                found = documents.hotspots_document(store, args.include_tests, None if args.all else args.top)
                print(documents.hotspots_json(found) if args.json else documents.hotspots_text(found, args.verbose))
            else:
                print(documents.explain_text(documents.explain_document(store, inside(root, args.path, os.path.realpath(".")))))
        return 0
    except (IndexLocked, IndexIncomplete, LookupError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
