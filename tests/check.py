"""Command line: python tests/check.py [sf] [name prefix ...]"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
import oracle  # noqa: E402
from seismark.session import build_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            r = oracle.compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:1500]}"}
        bad += not r["ok"]
        print(("ok  " if r["ok"] else "BAD ") + " ".join(f"{k}={v}" for k, v in r.items() if k != "ok"), flush=True)
    print(f"done, {bad} bad of {len(qs)}")


if __name__ == "__main__":
    main()
