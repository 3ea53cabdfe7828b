"""Run every registered query against its DuckDB oracle and report matches.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def canon(v):
    if v is None or v is getattr(__import__("pandas"), "NA"):
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 9)) if v != 0 else "0.0"
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return canon(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "to_pydatetime"):
        return v.to_pydatetime().isoformat()
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        seq = v.tolist() if hasattr(v, "tolist") else v
        return "[" + ",".join(canon(x) for x in seq) + "]"
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(canon(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    only = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as entry
    from tremor.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sql = entry.queries(), entry.oracle_sql()
    report = {}
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            spdf = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            report[name] = {"status": "spark_error", "error": str(e)[:400]}
            print(name, report[name], flush=True)
            continue
        t1 = time.time()
        entry_ = {"rows": len(spdf), "spark_sec": round(t1 - t0, 2)}
        if name in sql:
            try:
                ddf = con.execute(sql[name]).df()
            except Exception as e:  # noqa: BLE001
                entry_.update(status="sql_error", error=str(e)[:400])
                report[name] = entry_
                print(name, entry_, flush=True)
                continue
            sc, sr = rows_of(spdf)
            dc, dr = rows_of(ddf)
            entry_["oracle_rows"] = len(ddf)
            if sc != dc:
                entry_.update(status="schema_mismatch", spark_cols=sc, oracle_cols=dc)
            elif sr != dr:
                diff = [r for r in sr if r not in set(dr)][:3]
                entry_.update(status="value_mismatch", spark_only=diff, oracle_only=[r for r in dr if r not in set(sr)][:3])
            else:
                entry_["status"] = "match"
        else:
            entry_["status"] = "rows_only"
        report[name] = entry_
        print(name, json.dumps(entry_, ensure_ascii=False, default=str)[:1500], flush=True)
    ok = sum(1 for v in report.values() if v.get("status") in ("match", "rows_only"))
    print(f"SUMMARY {ok}/{len(report)} ok", flush=True)
    return report


if __name__ == "__main__":
    main(sys.argv)
