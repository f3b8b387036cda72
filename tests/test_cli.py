import json

from snapledger.__main__ import main
from snapledger.sources.config import Config, read_config


def run(capsys, *argv):
    code = main(list(argv))
    return code, capsys.readouterr().out


def test_import_and_look(spark, tmp_path, capsys):
    for day, rows in (("01_02_2020", "1,é\n"), ("02_02_2020", "1,e\n2,x\n")):
        folder = tmp_path / "in" / f"a_{day}"
        folder.mkdir(parents=True)
        (folder / "t.csv").write_text("id,name\n" + rows)
    root, store = str(tmp_path / "in"), str(tmp_path / "store")
    code, out = run(capsys, "import", "--input", f"{root}/a_01_02_2020", "--output", store)
    assert code == 0 and "t_20200201" in out and "t_20200202" not in out
    code, out = run(capsys, "import", "--input", root, "--output", store, "--batch",
                    "--manifest", str(tmp_path / "manifest"))
    assert code == 0 and "SKIPPED_EXISTS" in out and "t_20200202" in out
    assert spark.read.json(str(tmp_path / "manifest")).count() == 1
    assert run(capsys, "import", "--input", root, "--output", f"{store}2", "--latest", "--text")[0] == 0
    code, out = run(capsys, "snapshots", store, "t")
    assert code == 0 and out.count("2020-02-02") == 2
    assert main(["import", "--input", f"{root}/none", "--output", store]) == 1


def test_view_search_compare_and_export(spark, small, tmp_path, capsys):
    code, out = run(capsys, "tables", "--dataset", small)
    assert code == 0 and "lineitem" in out
    assert "VARCHAR" in run(capsys, "schema", "nation", "--dataset", small)[1]
    assert run(capsys, "preview", "nation", "--rows", "3", "--dataset", small)[1].count("NATION_") == 3
    assert "Showing 25 of 25 rows" in run(capsys, "count", "nation", "--dataset", small)[1]
    assert "25" in run(capsys, "sql", "SELECT count(*) AS n FROM nation", "--dataset", small)[1]
    assert "NATION_7" in run(capsys, "search", "nation", "nátion_7", "--dataset", small)[1]
    some = json.dumps({"or": [{"column": "n_nationkey", "op": "<", "value": 2}, {"column": "n_name", "op": "=", "value": "NATION_9"}]})
    shown = run(capsys, "preview", "nation", "--filter", some, "--order-by", "n_name", "--dataset", small)[1]
    assert [n for n in range(25) if f"NATION_{n} " in shown or f"NATION_{n}|" in shown] == [0, 1, 9]
    found = run(capsys, "search", "nation", "nation_1", "--filter", some, "--dataset", small)[1]
    assert "NATION_1" in found and "NATION_12" not in found
    parts = {"table": "nation", "group_by": ["n_regionkey"], "aggregates": {"n": {"function": "count"}}, "sort": [["n_regionkey", "desc"]]}
    code, out = run(capsys, "build", json.dumps(parts), "--dataset", small)
    assert code == 0 and out.count("|5 ") == 5
    assert main(["build", '{"table": "nation", "colour": 1}', "--dataset", small]) == 1
    assert main(["preview", "nope", "--dataset", small]) == 1
    assert main(["preview", "nope", "--dataset", f"{small}/nowhere"]) == 1
    assert run(capsys, "sql", "SELECT * FROM region", "--dataset", small, "--csv", str(tmp_path / "r"))[0] == 0
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 5
    assert "both" in run(capsys, "compare", small, "--dataset", small)[1]
    same = ("compare", small, "--dataset", small, "--table", "nation")
    assert "same" in run(capsys, *same)[1]
    assert run(capsys, *same, "--key", "n_nationkey")[1].count("same") == 25
    assert "NATION" not in run(capsys, *same, "--key", "n_nationkey", "--cells")[1]
    config = tmp_path / "config"
    for folder, name, content in [
            ("schemas", "a.json", {"tables": {"nation": {"columns": {"n_nationkey": {"type": "INTEGER"}}}}}),
            ("schemas", "b.json", {"tables": {"nation": {"columns": {"n_nationkey": {"primary_key": True}}}}}),
            ("table_rules", "r.json", {"foreign_keys": {"nation": {"n_regionkey": {
                "references": "region.r_regionkey"}}}}),
            ("display_preferences", "v.json", {"nation": {"visible_columns": ["n_name"], "sort_by": "n_nationkey",
                                                          "sort_order": "DESC"}})]:
        (config / folder).mkdir(parents=True, exist_ok=True)
        (config / folder / name).write_text(json.dumps(content))
    out = run(capsys, "validate", "--dataset", small, "--config", str(config))[1]
    assert "primary_key" in out and "foreign_key" in out
    shown = run(capsys, "preview", "nation", "--dataset", small, "--config", str(config), "--rows", "1")[1]
    assert "NATION_24" in shown and "n_regionkey" not in shown
    assert read_config(spark, str(tmp_path / "nowhere")) == Config() == read_config(spark, None)
