from datetime import datetime

import pytest

from staffline.operators import columns, duplicates
from staffline.operators.history import ORDINAL
from staffline.plans.process import clean_source, process_all, process_source
from staffline.plans.sources import BY_OUTPUT, SOURCES
from staffline.registry.queries import QUERIES
from staffline.registry.standins import RAW, raw_extract, raw_history
from staffline.session import COMPILED_BYTES, compiled_methods
from staffline.sources.csv import read_csv


def test_the_sources_are_all_there():
    assert len(SOURCES) == 18 == len(BY_OUTPUT)
    assert set(RAW) | {"historial_laboral_personas"} == set(BY_OUTPUT)


def test_extracts_from_csv_to_table(spark, sf_dir, tmp_path):
    """Extracts of every special kind written as CSV, processed and read back."""
    chosen = [BY_OUTPUT[o] for o in (
        "carga_politecnica_disponible", "catalogo_idiomas", "heteroevaluacion_disponible",
        "historial_laboral_personas",
    )]
    for source in chosen:
        if source.output in RAW:
            raw = raw_extract(spark, sf_dir, source.output)
        else:
            raw = raw_history(spark, sf_dir)
        raw.toPandas().to_csv(tmp_path / f"{source.file}.csv", index=False, encoding="utf-8-sig")
    written = process_all(spark, str(tmp_path), str(tmp_path / "out"), "2002-01-01", chosen)
    assert set(written) == {s.output for s in chosen} | {
        "historial_laboral_periodos_continuos", "historial_laboral_features",
    }
    tables = {name: spark.read.parquet(path) for name, path in written.items()}
    assert all(t.count() for t in tables.values())
    assert all(ORDINAL not in t.columns for t in tables.values())
    contracts = tables["historial_laboral_personas"]
    assert "HORAS" not in contracts.columns and "NOMBRETABLA" in contracts.columns
    assert dict(contracts.dtypes)["FECHAINICIOCONTRATO"] == "timestamp_ntz"
    persons = contracts.select("IDPERSONA").distinct().count()
    features = tables["historial_laboral_features"]
    assert features.count() == persons
    assert not [c for c in features.columns if c.startswith("RMU")]


def test_reports_and_corrections(spark, tmp_path):
    rows = "".join(f"1,{i},2010-01-{i:02d},2010-03-31,JEFE,A,{i}\n" for i in range(1, 21))
    (tmp_path / "historialaboralpersonas.csv").write_text(
        "IDPERSONA,IDCONTRATOLABORAL,FECHAINICIOCONTRATO,FECHAFINCONTRATO,CARGO,NOMBRE,RMU\n"
        + rows + "2,99,2010-01-01,,JEFE,B,5000\n"
    )
    source = BY_OUTPUT["historial_laboral_personas"]
    folders = str(tmp_path), str(tmp_path / "out")
    written = process_source(spark, source, *folders, "2011-01-01", reports=True)
    review = spark.read.parquet(written["historial_laboral_personas_pay_review"])
    assert [(r.IDCONTRATOLABORAL, r.RMU) for r in review.collect()] == [(99, 5000.0)]
    shape = spark.read.parquet(written["historial_laboral_personas_summary"])
    assert {r.stage: r.rows for r in shape.collect()} == {"before": 21, "after": 21}
    assert spark.read.parquet(written["historial_laboral_personas_periods"]).count() == 1
    fixed = spark.createDataFrame([(99, 12.0)], "IDCONTRATOLABORAL long, RMU double")
    out = str(tmp_path / "fixed")
    written = process_source(spark, source, folders[0], out, "2011-01-01", corrections=fixed)
    pay = spark.read.parquet(written["historial_laboral_personas"]).where("IDPERSONA = 2").first().RMU
    assert pay == 12.0
    with pytest.raises(ValueError, match="not unique"):
        process_source(spark, source, folders[0], out, "2011-01-01", corrections=fixed.union(fixed))


def test_file_order_breaks_ties(spark, tmp_path):
    """Contracts that start together keep the order of the file."""
    (tmp_path / "historialaboralpersonas.csv").write_text(
        "IDPERSONA,IDCONTRATOLABORAL,FECHAINICIOCONTRATO,FECHAFINCONTRATO,CARGO,NOMBRE\n"
        "1,9,2010-01-01,2010-03-31,JEFE,A\n"
        "1,5,2010-01-01,2010-02-28,ANALISTA,\n"
        "2,7,2010-05-01-00.00.00.000000,,JEFE,B\n"
    )
    source = BY_OUTPUT["historial_laboral_personas"]
    written = process_source(spark, source, str(tmp_path), str(tmp_path / "out"), "2011-01-01")
    periods = spark.read.parquet(written["historial_laboral_periodos_continuos"])
    assert sorted((r.IDPERSONA, r.IDCONTRATOLABORAL, r.PERIODO_VIGENTE) for r in periods.collect()) == [
        (1, "9,5", False), (2, "7", True),
    ]
    features = spark.read.parquet(written["historial_laboral_features"])
    current = {r.IDPERSONA: (r.CARGO_ACTUAL, r.UNIDAD_ACTUAL_NOMBRE) for r in features.collect()}
    assert current == {1: ("ANALISTA", "DESCONOCIDA"), 2: ("JEFE", "B")}


def test_repeated_headers_collapse_after_trimming(spark, tmp_path):
    (tmp_path / "idiomaspersonas.csv").write_text(
        "IDPERSONA,IDIDIOMA,IDIOMA,LENGUANATIVA,IDPERSONA,IDIDIOMA\n"
        "1,2, Inglés ,S,x,y\n3,4,Francés,,x,y\n"
    )
    raw = read_csv(spark, str(tmp_path / "idiomaspersonas.csv"))
    got = clean_source(raw, BY_OUTPUT["idiomas_personas"])
    # One distinct flag is left after nulls, so the column carries no information.
    assert got.columns == ["IDPERSONA", "IDIDIOMA", "IDIOMA"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, "Inglés"), (3, 4, "Francés")]


def test_unknown_training_area_stops_the_source(spark):
    raw = spark.createDataFrame(
        [("1", "DI", "R"), ("2", "QQ", "I")],
        "IDCAPACITACION string, AREACAPACITACIONDESCRIPCION string, FORMACONOCIM string",
    )
    with pytest.raises(AssertionError, match="QQ"):
        clean_source(raw, BY_OUTPUT["capacitaciones_todas"])
    with pytest.raises(KeyError):
        clean_source(raw.drop("AREACAPACITACIONDESCRIPCION"), BY_OUTPUT["capacitaciones_todas"])


@pytest.mark.parametrize(
    "output", ["capacitaciones_todas", "experiencia_externa", "heteroevaluacion_disponible"]
)
def test_chart_data(spark, sf_dir, output):
    source = BY_OUTPUT[output]
    cleaned = clean_source(raw_extract(spark, sf_dir, output), source).cache()
    for chart in source.charts:
        data = chart.data(cleaned)
        assert data.columns[-1] == "n" and data.agg({"n": "sum"}).first()[0] > 0
        if chart.kind == "top":
            assert data.count() <= chart.top
    cleaned.unpersist()


def test_ages(spark):
    raw = spark.createDataFrame(
        [("1", "2000-08-31", "F"), ("2", "2000-09-01", "M"), ("3", None, None)],
        "IDPERSONA string, FECHANACIMIENTO string, SEXO string",
    )
    got = clean_source(raw, BY_OUTPUT["datos_personales_ultimos_5anios"])
    days = [(datetime(2026, 8, 31) - born).days for born in (datetime(2000, 8, 31), datetime(2000, 9, 1))]
    expected = [int(d // 365.25) for d in days] + [None]
    assert [r.EDAD for r in got.orderBy("IDPERSONA").collect()] == expected


def test_only_new_files_are_profiled(spark, tmp_path, monkeypatch):
    from staffline.operators import columns
    from staffline.plans import profiles
    from staffline.plans.process import trimmed

    source = BY_OUTPUT["idiomas_personas"]
    folder, store = tmp_path / f"{source.file}.csv", str(tmp_path / "store")
    folder.mkdir()
    head = "IDPERSONA,IDIOMA,IDIOMA,NIVELMCER,VACIA,LENGUANATIVA\n"
    (folder / "1.csv").write_text(head + "1,EN,EN,B1,,S\n2,FR,FR,B1,,N\n")
    (folder / "2.csv").write_text(head + "3,EN,EN,B1,,S\n")
    looked = []
    plain = read_csv
    monkeypatch.setattr(profiles, "read_csv", lambda s, paths, **k: (looked.append([p.rsplit("/", 1)[-1] for p in paths]), plain(s, paths, **k))[1])

    def run():
        written = process_source(spark, source, str(tmp_path), str(tmp_path / "out"), "2020-01-01", profile_store=store)
        got = spark.read.parquet(written[source.output])
        own = clean_source(plain(spark, str(folder)), source)
        assert got.columns == own.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, own.collect()))
        raw = trimmed(plain(spark, str(folder), with_ordinal=True), source)
        names = [n for n in raw.columns if n != ORDINAL]
        kept = profiles.stored_profiles(spark, source, str(folder), f"{store}/{source.output}", names, trimmed)
        assert kept == columns.profile(raw, flags=True)
        return got.columns

    assert "NIVELMCER" not in run() and looked == [["1.csv", "2.csv"]]
    (folder / "3.csv").write_text(head + "4,DE,DE,C1,x,N\n")
    assert "NIVELMCER" in run() and looked[1:] == [["3.csv"]]
    (folder / "3.csv").write_text(head + "4,DE,DE,B1,,N\n5,DE,DE,B1,,N\n")
    assert "NIVELMCER" not in run() and looked[2:] == [["3.csv"]]
    (folder / "2.csv").unlink()
    run()
    assert len(looked) == 3


def test_charts_of_a_source_scan_it_once(spark, tmp_path):
    """Beside the passes for clip limits and ranges; the numbers are those of each chart alone."""
    from pyspark.sql import functions as F

    from staffline.plans import charts
    from staffline.plans.sources import Chart

    rows = [(f"{2000 + i % 4}-05-0{i % 9 + 1}", f" n{i % 23} ", None if i % 7 == 0 else i % 5, float(i % 101) if i % 11 else float("nan"), i % 13) for i in range(3000)]
    rows += [(None, "", None, None, None), ("x", " ", 1, -0.0, None)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "d string, w string, k int, v double, p int").write.parquet(path)
    cleaned = spark.read.parquet(path)
    shown = (
        Chart("year", "d"), Chart("top", "w", top=7), Chart("counts", "k"), Chart("histogram", "v", bins=9), Chart("per_key", "p"),
        Chart("histogram", "twice", bins=4, clip=None, value=lambda: F.col("v") * 2), Chart("top", "gone"), Chart("top", "d", top=3),
    )
    source = type("S", (), {"charts": shown})()
    plain = [r for c in shown if c.value or c.column in cleaned.columns for r in charts._alone(c, cleaned).collect()]
    for small in (0, 1 << 40):
        df = charts.chart_rows(cleaned, source, small_bytes=small)
        assert sorted(map(str, df.collect())) == sorted(map(str, plain))
    few = type("S", (), {"charts": [c for c in shown if c.kind != "per_key"]})()
    plan = charts.chart_rows(cleaned, few)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


@pytest.mark.parametrize("name", ["source_certificados_todos", "summary_certificados_todos", "charts_certificados_todos"])
def test_queries_of_sources_go_on_from_written_tables(spark, sf_dir, name):
    """The raw extract is made once; nothing after that runs it again."""
    read = QUERIES[name](spark, sf_dir).inputFiles()
    assert not [f for f in read if f.startswith("file:" + sf_dir) or sf_dir in f]


def test_staging_keeps_the_limit_of_methods(spark):
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    for own in ("65535", "4000"):
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", own)
        try:
            with compiled_methods(spark):
                assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == min(int(own), COMPILED_BYTES)
            assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == own
        finally:
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)


def test_raw_rows_are_dealt_to_all_cores(spark, sf_dir):
    """A small file is one split, but its rows become wide: one task did all the work."""
    raw = raw_extract(spark, sf_dir, "proyectos_investigacion_disponible")
    assert raw.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_results_of_sources_are_read_not_worked_out_again(spark, sf_dir):
    """Casting is done while writing, in methods that the JVM compiles, whatever the session's limit."""
    plan = QUERIES["source_certificados_todos"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Relation") and "regexp" not in plan.lower()


def test_trimmed_text_is_cast_in_two_projections(spark):
    cells = [("2015-01-02-10.11.12.120456", "12", "si", "1.5"), ("9999-12-31", "7.0", "x", "n"), (None,) * 4,
             ("2010-02-30", "+3", "NO", "1e3"), ("2015-01-02", "abc", "1", ".5")]
    df = spark.createDataFrame(cells, "t string, i string, f string, n string").repartition(2)
    cast = columns.cast_trimmed(df, ["t", "gone"], ["i"], ["f"], ["n"])
    common = columns.cast_timestamps(df, ["t"])
    common = columns.cast_numbers(columns.cast_flags(columns.cast_integers(common, ["i"]), ["f"]), ["n"])
    assert cast.schema == common.schema
    assert sorted(map(str, cast.collect())) == sorted(map(str, common.collect()))
    assert cast._jdf.queryExecution().optimizedPlan().toString().count("Project") <= 2


def test_profile_on_the_way_is_the_profile(spark):
    """Hashes stand for texts in the aggregate; what they suggest is confirmed."""
    rows = [("a", None, "x", 1, float("nan"), None), ("a", None, "y", 1, 2.0, "z"), ("a", None, None, 2, 2.0, None)]
    df = spark.createDataFrame(rows, "same string, none string, two string, k int, d double, `one.1` string")
    for table in (df, df.limit(0)):
        staged, found = columns.staged_with_profile(table)
        assert found == columns.profile(table) and staged.count() == table.count()
    assert not any("max(same" in str(c) for c in columns._way_aggregates(df)[1])


def test_rows_without_a_like_are_digested_once(spark):
    """With no digest twice there is nothing to compare, and the rows are not read again."""
    df = spark.range(200).selectExpr("id", "concat('v', id % 7) t")
    doubtful, single = duplicates._with_like(df)
    assert doubtful.count() == 0 and single is df
    assert duplicates.without_duplicates(df).count() == 200
    assert df.agg(duplicates.duplicate_count(df).alias("n")).first().n == 0
