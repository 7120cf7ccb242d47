"""Command line: ``python -m botledger.cli parse FILE... [--json]`` and ``check VALUE``.

Exit codes: 0 done, 1 a damaged file or no match, 2 wrong use, an unknown format or an unreadable file.
"""

from __future__ import annotations

import argparse
import json
import sys

from botledger.operators import report as rep
from botledger.plans.engine import Engine
from botledger.sources.logfiles import UnknownFormatError


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("botledger").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def render(data: dict) -> str:
    """The report as plain tables: AI crawlers, search engines, referrals, pages and a summary line."""
    out: list[str] = []

    def grid(title: str, head: list[str], rows: list[list]) -> None:
        if rows:
            cells = [head] + [[str(c) for c in r] for r in rows]
            widths = [max(len(r[i]) for r in cells) for i in range(len(head))]
            out.extend([title, *("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells), ""])

    top = lambda r: ", ".join(p["path"] for p in r["top_pages"][:3])
    for title, ai in (("AI crawlers", True), ("Search engines", False)):
        rows = [[r["token"], r["vendor_name"], r["purpose"], r["requests"], r["unique_pages"], r["last_seen"], top(r)] for r in data["crawlers"] if r["ai_specific"] is ai]
        grid(title, ["Crawler", "Vendor", "Purpose", "Requests", "Pages", "Last seen", "Top pages"], rows)
    grid("AI referrals", ["Product", "Visits", "Pages", "Last seen", "Top pages"], [[r["product"], r["visits"], r["unique_pages"], r["last_seen"], top(r)] for r in data["referrals"]])
    grid(
        "Pages", ["Path", "Crawlers", "Referrals", "By"],
        [[p["path"], p["crawler_requests"], p["referral_visits"], ", ".join(f"{x.get('token') or x.get('product')} {x['count']}" for x in p["crawlers"] + p["referrals"])] for p in data["pages"]],
    )
    s = data["summary"]
    out.append(f"{s['records']} requests, {s['skipped']} lines skipped, {s['ai_crawler_requests']} by AI crawlers, {s['ai_referral_visits']} visits from AI products")
    return "\n".join(out)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="botledger")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("parse")
    p.add_argument("files", nargs="+")
    p.add_argument("--format", choices=("combined", "cloudfront", "alb"))
    p.add_argument("--since")
    p.add_argument("--top", type=int, default=rep.DEFAULT_TOP)
    p.add_argument("--own-host")
    p.add_argument("--json", action="store_true")
    c = commands.add_parser("check")
    c.add_argument("value")
    c.add_argument("--own-host")
    c.add_argument("--json", action="store_true")
    try:
        args = parser.parse_args(argv)
    except SystemExit as err:
        return int(err.code or 0)
    try:
        if args.command == "check":
            row = Engine(_session()).check(args.value, args.own_host).first().asDict(recursive=True)
            if args.json:
                print(json.dumps(row["match"], ensure_ascii=False))
            elif row["match"]:
                print("\n".join(f"{k}: {v}" for k, v in row["match"].items() if v is not None))
            else:
                print("no match" + (f"; did you mean {row['did_you_mean']}" if row["did_you_mean"] else ""))
            return 0 if row["match"] else 1
        if args.top < 1:
            raise ValueError("--top must be 1 or more")
        since = rep.parse_since(args.since) if args.since else None
        engine = Engine(_session())
        found = engine.report(args.files, args.format, since, args.top, args.own_host)
        data, damaged = found.to_dict(), [r["file"] for r in found.files.where("damaged").orderBy("file").collect()]
        found.release()
    except (UnknownFormatError, ValueError, OSError) as err:
        print(err, file=sys.stderr)
        return 2
    print(json.dumps(data, ensure_ascii=False, indent=2) if args.json else render(data))
    for f in damaged:
        print(f"{f}: compressed data breaks off; complete lines were used", file=sys.stderr)
    return 1 if damaged else 0


if __name__ == "__main__":
    sys.exit(main())
