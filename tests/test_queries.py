"""Every query that has a SQL twin gives the twin's rows at the smallest scale."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(n for n in entry.ORACLES))
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*columns).collect()), key=str)
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "hits", "peak", "band"]


def test_whole_tables_are_scored_and_ranked(spark, duck):
    got = {r.source_ip: r.score for r in entry.queries()["agg03_count_score_all"](spark, DATA).collect()}
    n = dict(duck.sql("select concat('10.0.', user_id % 4, '.', user_id % 250), count(*) from events group by 1").fetchall())
    assert got == {ip: min(100, 20 * c) for ip, c in n.items()}
    ks = duck.sql("select event_type, list_sort(list(cast(json_extract_string(props, '$.k') as int))) from events group by 1").fetchall()
    got = {r.event_type: r.p75 for r in entry.queries()["fn_nearest_rank_all"](spark, DATA).collect()}
    assert got == {t: k[min(len(k) * 75 // 100, len(k) - 1)] for t, k in ks}


def test_payloads_override_ports_on_all_packets(spark, duck):
    n = {r.app: r["count"] for r in entry.queries()["par10_app_protocol_all"](spark, DATA).groupBy("app").count().collect()}
    assert sum(n.values()) == duck.sql("select count(*) from events").fetchall()[0][0]
    assert {"http", "ssh", "tls", "smtp", "ftp", "dns", "mysql", None} == set(n)


def test_flows_go_both_ways(spark, duck):
    r = entry.queries()["agg15_flow_features"](spark, DATA).selectExpr("sum(packets)", "sum(fwd_packets)", "sum(bwd_packets)", "sum(bwd_bytes)", "max(bwd_len_mean)").first()
    n, replies = duck.sql("select count(*), count(*) filter (cast(json_extract_string(props, '$.k') as int) % 2 = 0) from events").fetchall()[0]
    assert r[0] == n + replies == r[1] + r[2] and r[2] > replies // 2 and r[3] > 0 and r[4] > 0
