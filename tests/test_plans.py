import ast
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexifold.operators import ranks
from lexifold.plans import registry

ROOT = Path(__file__).parents[1]


def test_ranks(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.when(F.col("id") % 2 == 0, "b")).alias("g"), (F.col("id") % 7).alias("v"), F.col("id").alias("k"))
    got = ranks.ranked(rows, ["g"], [F.col("v").desc(), F.col("k")])
    want = {}
    for g, v, k in sorted(map(tuple, rows.collect()), key=lambda r: (str(r[0]), -r[1], r[2])):
        want.setdefault(g, []).append(k)
    held = {(r.g, r.k): r["rank"] for r in got.collect()}
    assert held == {(g, k): n for g, ks in want.items() for n, k in enumerate(ks, 1)}
    assert ranks.ranked(rows.limit(0), ["g"], ["k"]).count() == 0


def test_registry():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_llm_stands_alone():
    """Nothing outside the subpackage imports it, but for the entry, which can do without."""
    for path in [*ROOT.glob("lexifold/**/*.py"), ROOT / "bench.py"]:
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


@pytest.mark.parametrize("name", ["search_or", "zipf_ranked", "doc_numbers", "p4_found", "spell_query", "w2v_vocab"])
def test_on_small_tables(spark, name):
    import duckdb

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no tables here")
    connection = duckdb.connect()
    for f in folder.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = registry.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    key = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    ours = sorted((key(r) for r in df.select(*columns).collect()), key=str)
    theirs = sorted((key(r) for r in connection.sql(registry.ORACLES[name]).select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()), key=str)
    assert ours == theirs and ours


def _both(spark, tables, name, folder):
    """Sorted rows of the query and of its SQL."""
    import duckdb

    connection = duckdb.connect()
    for table in tables:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    return sorted(map(tuple, df.select(*columns).collect())), sorted(connection.sql(registry.ORACLES[name]).select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_nearest_of_every_hundredth(spark):
    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no tables here")
    ours, theirs = _both(spark, ["embeddings"], "nearest_vectors", folder)
    assert ours == theirs
    df = registry.QUERIES["nearest_vectors"](spark, str(folder))
    assert {r["query"]: r["count"] for r in df.groupBy("query").count().collect()} == {0: 10, 100: 10, 200: 10, 300: 10, 400: 10}


def test_example_cap(spark):
    from lexifold.operators import embedding

    rows = spark.range(60_010).select(F.lit("x").alias("collection_id"), (60_009 - F.col("id")).alias("article_no"), F.lit(0).alias("pos"), F.lit(0).alias("k"))
    assert embedding.capped(rows).agg(F.count("*"), F.max("article_no")).first()[:] == (60_000, 59_999)
    assert sorted(r.article_no for r in embedding.capped(rows, 3).collect()) == [0, 1, 2]


def test_example_cap_of_query(spark):
    """A topic of fewer than 60,000 pairs keeps them all."""
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no tables here")
    counts = lambda name: {r.collection_id: r["count"] for r in registry.QUERIES[name](spark, folder).groupBy("collection_id").count().collect()}
    held, pairs = counts("w2v_example_cap"), counts("w2v_pairs_skipgram")
    assert held == {k: min(n, 60_000) for k, n in pairs.items()} and max(held.values()) > 1_000


def test_example_cap_sorts_no_topic(spark):
    from lexifold.operators import embedding

    rows = spark.range(5000).select(F.when(F.col("id") % 5 > 0, "hot").otherwise("b").alias("collection_id"), (F.col("id") * 7 % 5000).alias("article_no")).crossJoin(spark.range(3).withColumnRenamed("id", "pos"))
    for most in (1, 2, 100, 2999, 3000, 12_000, 10**6):
        for steps in (1, 7, 1024):
            got = embedding.capped(rows, most, steps)
            want = {}
            for g, a, p in sorted(map(tuple, rows.collect())) if steps == 1 else ():
                want.setdefault(g, []).append((a, p))
            if want:
                assert sorted(map(tuple, got.collect())) == sorted((g, a, p) for g, rs in want.items() for a, p in rs[:most])
            assert {r[0]: r[1] for r in got.groupBy("collection_id").count().collect()} == {"hot": min(most, 12_000), "b": min(most, 3000)}


def test_ranks_exchange_once(spark):
    rows = spark.range(100).withColumn("g", F.col("id") % 2)
    plan = ranks.ranked(rows, ["g"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window [row_number" not in plan


@pytest.mark.parametrize("name", ["zipf_top50", "compare_top10", "search_top100"])
def test_top_rows_are_cut_before_the_exchange(spark, name):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no tables here")
    assert "WindowGroupLimit" in registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_scopes(spark, tmp_path):
    """A scope deletes its tables at its end, but for those that outlive it."""
    from lexifold import runtime

    with runtime.scope():
        gone = runtime.materialise(spark.range(3), "gone")
        with runtime.kept():
            held = runtime.materialise(spark.range(4), "held")
        assert gone.count() == 3
    assert held.count() == 4 and not Path(gone.inputFiles()[0].removeprefix("file://")).exists()


def test_shared_folder():
    """Without a shared folder a cluster's session is refused, a local one warned."""
    from types import SimpleNamespace

    from lexifold import runtime

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master, applicationId="a-test"))
    with pytest.raises(RuntimeError):
        runtime.shared_folder(session("spark://host:7077"))
    with pytest.warns(UserWarning):
        assert runtime.shared_folder(session("local[2]"))
