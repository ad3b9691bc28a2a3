"""Folders by value are written by tasks that are dealt by the number of folders."""

import re

from ledgerloom.plans import queries as core
from ledgerloom.plans import storage


def writers(folder):
    return {re.match("part-([0-9]+)", f.name)[1] for f in folder.rglob("part-*")}


def test_folders_of_a_small_table_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "FOLDERS", 20)
    monkeypatch.setattr(storage, "shared_dir", lambda spark: str(tmp_path))
    core.QUERIES["load_accounting_cases"](spark, "/root/testdata/sf0.01")
    for name in ("accounting-cases", "accounting-documents"):
        (written,) = tmp_path.glob(f"{name}-*")
        assert len(list(written.glob("*=*"))) == 100
        assert len(list(written.rglob("part-*"))) == 100
        assert len(writers(written)) > 2
