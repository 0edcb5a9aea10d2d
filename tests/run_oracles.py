"""Runs registered queries against their DuckDB equivalents: python tests/run_oracles.py SF_DIR [NAME...]."""

import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return repr(round(v, 9)) if v == v else "nan"
        return repr(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = canonical(cur.fetchall(), names)
    return sorted(df.columns) == sorted(names) and got == want, got, want, df.columns, names


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "5g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    from cubetally import registry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    con = connection(sf_dir)
    bad = 0
    for name, f in registry.QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in registry.ORACLES:
                same, got, want, a, b = compare(spark, con, f, registry.ORACLES[name], sf_dir)
                if not same:
                    bad += 1
                    print("DIFF", name, a, b, len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
                    continue
                print(f"ok {name} {len(got)} {time.time() - t:.1f}s")
            else:
                print(f"rows {name} {f(spark, sf_dir).count()} {time.time() - t:.1f}s")
        except Exception as e:
            bad += 1
            print("FAIL", name, str(e)[:600].replace("\n", " "))
    print("bad", bad)
