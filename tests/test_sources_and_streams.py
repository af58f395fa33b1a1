import datetime as dt
import time
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlake.operators import gaps
from pitlake.sources import manifest, panels, upsert, workbook_sink, workbooks
from pitlake.streaming import incremental, maturing

D = dt.date


def workbook(path, rows):
    """A minimal workbook: shared strings for text, raw values for numbers, gaps for None."""
    strings, cells = [], []
    for r, row in enumerate(rows, 1):
        out = ""
        for c, v in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if isinstance(v, str):
                strings.append(v)
                out += f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'
            elif v is not None:
                out += f'<c r="{ref}"><v>{v}</v></c>'
        cells.append(f'<row r="{r}">{out}</row>')
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(cells)}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a_2020.xlsx", [["Stkcd", "Trddt", "Clsprc"], ["code", "date", "price"], ["1", 43833, 10.5], ["2", None, "x"]])
    workbook(tmp_path / "a_2021.xlsx", [["Symbol", "Trddt", "Clsprc"], ["", "", ""], ["600000.0", "2021-01-04", "1,234.5"]])
    (tmp_path / "~$a_2020.xlsx").write_text("lock")
    workbooks.register(spark)
    raw = spark.read.format("workbook").schema("Stkcd string, Trddt string, Clsprc string").options(path=str(tmp_path), skipRows="1", aliases='{"Stkcd": ["Symbol"]}').load()
    clean = panels.clean_daily(raw.toDF("code", "trade_date", "close"))
    got = {r.code: (r.trade_date, r.close, r.reason) for r in clean.collect()}
    assert got == {"000001": (D(2020, 1, 3), 10.5, None), "000002": (None, None, "missing essential"), "600000": (D(2021, 1, 4), 1234.5, None)}
    assert len(workbooks.discover(str(tmp_path), range(2021, 2022))) == 1


def test_filters_reach_the_workbooks(spark, tmp_path):
    head = ["Stkcd", "Trddt", "Clsprc", "Other"]
    for y in (2019, 2020, 2021):
        workbook(tmp_path / f"daily_{y}.xlsx", [head, *[[f"{i % 7:06d}", f"{y}-01-{i % 28 + 1:02d}", i + 0.5, "x"] for i in range(400)]])
    (tmp_path / "daily_2022.xlsx").write_text("no workbook: opening it fails")
    workbooks.register(spark)
    raw = spark.read.format("workbook").schema("Stkcd string, Clsprc string, source_year int, source_row string").options(path=str(tmp_path), splitBytes="4000").load()
    with pytest.raises(Exception, match="zip"):
        raw.count()
    some = raw.where("source_year = 2020 and Stkcd in ('000001', '000003')")
    assert some.rdd.getNumPartitions() > 4  # one sheet in several partitions
    got = sorted((int(r.source_row), r.Stkcd, float(r.Clsprc)) for r in some.collect())
    assert got == [(i + 2, f"{i % 7:06d}", i + 0.5) for i in range(400) if i % 7 in (1, 3)]
    assert raw.where("source_year < 2022 and source_year >= 2020").count() == 800 and raw.where("source_year in (2019, 1999)").count() == 400
    assert raw.where("source_year = 1990").count() == 0 and raw.where("source_year = 2019 and Stkcd = '000001' and Stkcd = '000002'").count() == 0
    reader = workbooks._Reader(raw.schema, {"path": str(tmp_path), "splitBytes": "4000"})
    left = list(reader.pushFilters([workbooks.EqualTo(("Stkcd",), "1"), workbooks.GreaterThan(("Stkcd",), "1"), workbooks.EqualTo(("source_year",), 2020)]))
    assert left == [workbooks.GreaterThan(("Stkcd",), "1")] and {Path(p.path).stem for p in reader.partitions()} == {"daily_2020"}
    for split in (50, 333, 10**6):  # whatever the ranges, each row comes once, and headers never
        n = spark.read.format("workbook").schema("Stkcd string").options(path=str(tmp_path / "daily_2021.xlsx"), splitBytes=str(split), skipRows="2").load()
        assert n.count() == 398


def test_sink_round_trip(spark, tmp_path):
    workbooks.register(spark)
    spark.dataSource.register(workbook_sink.WorkbookSink)
    path = str(tmp_path / "out.xlsx")
    df = spark.range(0, 3000, 1, 6).select(F.col("id").cast("string").alias("k"), (F.col("id") * 0.5).alias("v"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("<&> "), "id")).alias("t"))
    df.write.format("workbook_sink").mode("overwrite").options(path=path, sheet="Rows").save()
    back = spark.read.format("workbook").schema("k string, v string, t string, source_row string").options(path=path, splitBytes="20000").load()
    rows = {r.k: (float(r.v), r.t) for r in back.collect()}
    assert rows == {str(i): (i * 0.5, f"<&> {i}" if i % 3 == 0 else None) for i in range(3000)} and back.rdd.getNumPartitions() > 3
    assert [c[0] for _, _, c in workbooks.rows_of(path)][1:] == [str(i) for i in range(3000)]  # partitions in order
    with pytest.raises(Exception, match="there already"):
        df.write.format("workbook_sink").mode("append").option("path", path).save()
    dies = df.withColumn("v", F.when(F.col("k") == "2999", F.raise_error(F.lit("dies")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="dies"):
        dies.write.format("workbook_sink").mode("overwrite").option("path", path).save()
    assert len(list(workbooks.rows_of(path))) == 3001 and sorted(p.name for p in tmp_path.iterdir()) == ["out.xlsx"]


def test_chained_prices_and_overlap(spark):
    old = spark.createDataFrame([("a", D(2024, 1, 2), 10.0, 20.0)], "code string, trade_date date, close double, adj_close double")
    new = spark.createDataFrame([("a", D(2024, 1, 2), 10.5, 0.0), ("a", D(2024, 1, 3), 11.0, 0.1), ("a", D(2024, 1, 4), 11.0, 0.0), ("b", D(2024, 1, 3), 5.0, 0.2)], "code string, trade_date date, close double, daily_return double")
    got = {(r.code, r.trade_date.day): round(r.adj_close, 9) for r in panels.chain_prices(old, new).collect()}
    assert got == {("a", 3): 22.0, ("a", 4): 22.0, ("b", 3): 5.0}
    r = panels.overlap_report(old, new).first()
    assert (r.overlap, r.mismatched) == (1, 1)


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, D(2024, 1, 1), "x"), ("b", 2, D(2024, 1, 1), "y")], "code string, v int, d date, note string")
    new = spark.createDataFrame([("a", 5, D(2024, 2, 1), None), ("c", 6, D(2024, 1, 1), "z")], "code string, v int, d date, note string")
    got = {r.code: (r.v, r.note) for r in upsert.update_dimension(old, new, "code", "d", ["note"]).collect()}
    assert got == {"a": (5, "x"), "b": (2, "y"), "c": (6, "z")}
    files = spark.createDataFrame([("f1", 1, 1), ("f2", 1, 2)], "source_file string, size int, mtime int")
    done = spark.createDataFrame([("f1", 1, 1, "complete"), ("f2", 1, 1, "complete")], "source_file string, size int, mtime int, status string")
    assert [r.source_file for r in upsert.changed_sources(files, done).collect()] == ["f2"]


def test_panel_reader(spark, tmp_path):
    (tmp_path / "p.csv").write_text("date,code,forward_return,f,era\n2024-01-05,1,0.1,x,train\n20240112,2,inf,2.5,test\n")
    rows = panels.read_panel(spark, str(tmp_path / "p.csv")).orderBy("date").collect()
    assert rows[0].f is None and rows[1].forward_return is None and rows[1].date == D(2024, 1, 12)


def test_incremental_ingestion_is_idempotent(spark, tmp_path):
    schema = "code string, trade_date date, close double"
    src, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    store = manifest.SourceStore(spark, target, schema)
    assert store.read().count() == 0 and store.vacuum() == 0
    spark.createDataFrame([("a", D(2024, 1, 2), 1.0), ("a", D(2023, 1, 2), 2.0)], schema).write.mode("append").parquet(src)
    run = lambda: incremental.ingest(incremental.daily_stream(spark, src, schema), store, ["code", "trade_date"], "trade_date", check).awaitTermination()
    run()
    spark.createDataFrame([("a", D(2024, 1, 2), 9.0), ("b", D(2024, 1, 3), 3.0)], schema).write.mode("append").parquet(src)
    run()
    run()
    got = {(r.code, str(r.trade_date)): r.close for r in store.read().collect()}
    assert got == {("a", "2024-01-02"): 9.0, ("a", "2023-01-02"): 2.0, ("b", "2024-01-03"): 3.0}
    assert store.vacuum() == 1 and store.read().count() == 3


def test_a_load_that_is_killed_is_repaired_by_the_next(spark, tmp_path):
    store = manifest.SourceStore(spark, str(tmp_path / "s"), "v long")
    files = lambda **k: spark.createDataFrame([(f, s, 1) for f, s in k.items()], "source string, size long, mtime long")
    rows = lambda todo: todo.select("source", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("v"))
    state = lambda: {r.source: r.n for r in store.read().groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert store.load(files(a=3, b=2), rows) == ["a", "b"] and state() == {"a": 3, "b": 2}
    assert store.load(files(a=3, b=2), rows) == []

    def dies(todo):  # after some rows have been written
        return rows(todo).withColumn("v", F.when(F.col("v") > 4, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("v")))

    with pytest.raises(Exception, match="killed"):
        store.load(files(a=5, b=4, c=1), dies)
    assert state() == {"a": 3, "b": 2}  # the rows of before, whole
    assert store.manifest().where("status = 'running'").count() == 5
    # Worse: all rows are there, but the load ended before it could say so.
    record, store._record = store._record, lambda df: record(df) if df.first().status == "running" else 1 / 0
    with pytest.raises(ZeroDivisionError):
        store.load(files(a=4, b=2), rows)
    store._record = record
    assert state() == {"a": 3, "b": 2}
    assert store.load(files(a=5, b=2, c=1), rows) == ["a", "c"] and state() == {"a": 5, "b": 2, "c": 1}
    assert {(r.source, r.rows) for r in manifest.current(store.manifest()).collect()} == {("a", 5), ("b", 2), ("c", 1)}
    assert store.vacuum() >= 2 and state() == {"a": 5, "b": 2, "c": 1}
    assert store.load(files(c=0), lambda todo: rows(todo.where("size > 0"))) == ["c"] and state() == {"a": 5, "b": 2}


def test_gap_stream_equals_the_batch_and_numpy(spark, tmp_path):
    rng = np.random.default_rng(1)
    schema = "code string, trade_date date, open double, prev_close double"
    rows = [(c, D(2024, 1, 1) + dt.timedelta(d), float(10 + rng.normal()) if rng.random() < 0.95 else None, float(rng.choice([10.0, 10.0, 10.0, 0.0, 5.0]))) for c in ("a", "b", "c") for d in range(40)]
    src = str(tmp_path / "days")
    for k in range(4):  # a file for ten days each
        part = [r for r in rows if (r[1] - D(2024, 1, 1)).days // 10 == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)  # files are taken in order of their time
    spec = gaps.Gaps(lookback=12, least=5, market_days=4)
    start = lambda: incremental.gap_estimator(incremental.daily_stream(spark, src, schema, 1), spec).writeStream.format("memory").queryName("gap_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    start().awaitTermination()
    key = lambda df: sorted((r.code, r.trade_date, r.observations, r.stock_low, r.stock_mid, r.stock_high) for r in df.collect())
    days = spark.createDataFrame(rows, schema)
    batch = key(gaps.stock_quantiles(days, spec))
    assert key(spark.table("gap_rows")) == batch and len(batch) == 120
    per_day, seen = {}, {}
    market = []
    estimates = {(r.code, r.trade_date): r for r in gaps.opening_gaps(days, spec).collect()}
    for d in sorted({r[1] for r in rows}):
        valid = [(c, o / p - 1) for c, day, o, p in rows if day == d and o and p and abs(o / p - 1) <= 0.35]
        for c, g in valid:
            seen.setdefault(c, []).append(g)
        if valid:
            market.append(np.quantile([g for _, g in valid], spec.levels))
        for c in "abc":
            own = seen.get(c, [])[-12:]
            m = np.median(market[-4:], axis=0) if market else np.array(gaps.NO_MARKET)
            n = len(own)
            trust = n / (n + 40) * min(1, n / 5)
            want = sorted(trust * np.quantile(own, spec.levels) + (1 - trust) * m) if n else m
            r = estimates[(c, d)]
            per_day[(c, d)] = n
            assert (r.lower_gap, r.expected_gap, r.upper_gap) == pytest.approx(tuple(want)) and r.observations == n
    assert [b[2] for b in batch] == [per_day[b[:2]] for b in batch]


def test_labels_mature_across_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(4)
    T0 = dt.datetime(2024, 1, 1)
    schema = "code string, entry timestamp, exit timestamp, value double"
    rows = [(f"c{i % 5}", T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i + int(rng.integers(1, 60))), float(i)) for i in range(120)]
    late = [("c0", T0 + dt.timedelta(hours=3), T0 + dt.timedelta(hours=200), -1.0)]  # enters behind the watermark
    passed = ("c1", T0 + dt.timedelta(hours=112), T0 + dt.timedelta(hours=60), -2.0)  # exit long past, entry not
    src, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))

    def put(part):
        rng.shuffle(part)
        spark.createDataFrame([tuple(x) for x in part], schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = maturing.mature(stream, "10 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.value for r in spark.read.schema(schema).parquet(out).collect()}

    put(rows[:60])
    first = run()
    mark = T0 + dt.timedelta(hours=59 - 10)
    assert first == {v for _, _, e, v in rows[:60] if e <= mark}
    put(rows[60:] + [rows[7]])  # one that came out already, and is late now
    put(late + [passed])
    got = run()
    mark = T0 + dt.timedelta(hours=119 - 10)
    assert got == {v for _, _, e, v in rows if e <= mark} | {-2.0}
    whole = spark.read.schema(schema).parquet(out)
    assert whole.count() == len(got)  # nothing twice
    batch, waiting = maturing.matured(spark.createDataFrame(rows, schema).withColumn("exit_date", F.col("exit")), mark)
    assert {r.value for r in batch.collect()} == got - {-2.0} and waiting.count() == 120 - len(got) + 1


def test_reports_carry_the_mark_and_json_nulls(spark, tmp_path):
    from pitlake.sources import panels

    df = spark.createDataFrame([("a", float("nan"), 1.0), ("b", 2.0, None)], "k string, x double, y double")
    panels.write_report(df, f"{tmp_path}/csv")
    raw = next((tmp_path / "csv").glob("part-*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfk,x,y")
    panels.write_json(df, f"{tmp_path}/json")
    rows = next((tmp_path / "json").glob("part-*.json")).read_text().splitlines()
    assert rows == ['{"k":"a","x":null,"y":1.0}', '{"k":"b","x":2.0,"y":null}']
