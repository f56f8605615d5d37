import io
import sys

from tidemark import shell


def test_script(spark):
    lines = ["PUT hello world wide", "GET hello", "get nope", "PUT x", "frob 1", "", "del hello", "GET hello", "?", "delete", "Put hello  again", "GET hello", "QUIT", "GET hello"]
    got = {r.line_no: r.output for r in shell.script(spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")).collect()}
    assert got == {
        0: "OK", 1: "world wide", 2: "(not found)", 3: shell.USAGE["PUT"], 4: "unknown command: FROB (try HELP)", 6: "OK", 7: "(not found)", 8: shell.HELP, 9: shell.USAGE["DELETE"], 10: "OK", 11: "again",
    }


def test_interactive(spark, monkeypatch, capsys, tmp_path):
    folder = f"file://{tmp_path}/db"
    monkeypatch.setattr(sys, "stdin", io.StringIO("PUT a 1\nPUT b 2\nDEL a\nGET b\nGET a\nNOPE\nEXIT\nGET b\n"))
    shell.main(["-dir", folder, "-memtable-size", "2"])
    assert capsys.readouterr().out.split("\n")[:6] == ["OK", "OK", "OK", "2", "(not found)", "unknown command: NOPE (try HELP)"]
    monkeypatch.setattr(sys, "stdin", io.StringIO("GET b\nGET a\n"))
    shell.main(["-dir", folder])
    assert capsys.readouterr().out.split("\n")[:2] == ["2", "(not found)"]
