"""Command line: list businesses, or find the themes of one."""

from __future__ import annotations

import argparse
import sys

from lodestone.operators.relational import find_businesses, top_rows
from lodestone.plans.pipeline import run_themes
from lodestone.session import build_session
from lodestone.sources.readers import read_table
from lodestone.sources.sinks import write_result


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone", description="Themes of customer reviews.")
    p.add_argument("--businesses", required=True, help="business table (.parquet, .csv, .json)")
    p.add_argument("--reviews", help="review table")
    p.add_argument("--out", default="themes", help="folder for themes.json")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("-b", "--business-id")
    what.add_argument("-n", "--name")
    what.add_argument("--list-businesses", action="store_true")
    p.add_argument("--fuzzy", action="store_true", help="the name need only be part of the business's name")
    p.add_argument("--top", type=int, default=20)
    a = p.parse_args(argv)
    spark = build_session("lodestone-cli")
    businesses = read_table(spark, a.businesses)
    if a.list_businesses:
        top_rows(businesses.select("business_id", "name", "city", "state", "review_count").distinct(), "review_count", a.top, "business_id").show(a.top, False)
        return 0
    if not a.reviews:
        p.error("--reviews is needed to find themes")
    if a.name:
        hit = find_businesses(businesses, a.name, a.fuzzy).first()
        if hit is None:
            print(f"no open business is called {a.name!r}", file=sys.stderr)
            return 1
        bid, name = hit["business_id"], hit["name"]
    else:
        hit = businesses.filter(businesses["business_id"] == a.business_id).first()
        bid, name = a.business_id, hit["name"] if hit else None
    result = run_themes(read_table(spark, a.reviews), bid, name)
    if not result:
        print("too few reviews", file=sys.stderr)
        return 1
    print(write_result(result, a.out, bid))
    return 0


if __name__ == "__main__":
    sys.exit(main())
