import pytest

from ledgerloom.sources.archive import current_tables, export_archive, inspect_archive, restore_archive, restore_into


def test_round_trip_and_damage(spark, tmp_path):
    path = f"{tmp_path}/a"
    rows = [(1, "line\nbreak   é", None), (2, None, 2.5), (2, None, 2.5), (None, "", 0.0)]
    tables = {"raw": spark.createDataFrame(rows, "id long, `note.text` string, x double"), "none": spark.createDataFrame([], "id long")}
    manifest = {r["table"]: r["rows"] for r in export_archive(tables, path).collect()}
    assert manifest == {"raw": 4, "none": 0}
    back = restore_archive(spark, path, {n: df.schema for n, df in tables.items()})
    assert sorted(map(str, back["raw"].collect())) == sorted(map(str, tables["raw"].collect())) and back["none"].count() == 0
    with pytest.raises(ValueError, match="not in the archive"):
        restore_archive(spark, path, {"other": tables["raw"].schema})
    tables["raw"].limit(1).selectExpr("to_json(struct(id)) AS value").write.mode("append").text(f"{path}/data/raw")
    with pytest.raises(ValueError, match="rows is 5"):
        restore_archive(spark, path, {"raw": tables["raw"].schema})
    faults = {r["table"]: r["fault"] for r in inspect_archive(spark, path).collect()}
    assert faults == {"none": None, "raw": "rows is 5, the manifest has 4"}


def test_restore_is_all_or_nothing(spark, tmp_path):
    path, target = f"{tmp_path}/a", f"{tmp_path}/ledger"
    tables = {"raw": spark.createDataFrame([(1, "x")], "id long, note string"), "links": spark.createDataFrame([(1, 2)], "a long, b long")}
    schemas = {n: df.schema for n, df in tables.items()}
    export_archive(tables, path)
    assert current_tables(spark, target) == {}
    with pytest.raises(ValueError, match="columns are"):
        restore_archive(spark, path, {"raw": tables["links"].schema})
    with pytest.raises(ValueError, match="the archive holds"):
        restore_into(spark, path, {"raw": schemas["raw"]}, target)
    assert current_tables(spark, target) == {}
    for _ in range(2):
        back = restore_into(spark, path, schemas, target)
    assert [tuple(r) for r in back["raw"].select("id", "note").collect()] == [(1, "x")] and back["links"].count() == 1
    tables["raw"].selectExpr("to_json(struct(id)) AS value").write.text(f"{path}/data/stray")
    with pytest.raises(ValueError, match="stray"):
        restore_into(spark, path, schemas, target)
    assert set(current_tables(spark, target)) == {"raw", "links"}
