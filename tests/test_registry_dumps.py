"""Registry dumps: the pages of a few files hold every reporter, in JSON and YAML."""

import pytest

from reportlake.schema import REGISTRY_SCHEMA
from reportlake.sources import doc_writers, documents


def _registry(spark, n):
    rows = [(f"reporter1{k:06d}", f"name: {k} --- \"x\"\n---\n[,]" if k % 7 == 0 else f"m{k}", f"{k}0", k % 3 == 0,
             5_000 if k % 3 == 0 else None, 1_000 * k, 10, k % 11, 77, 77) for k in range(n)]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


@pytest.mark.parametrize("n", [0, 1, 1_500])
@pytest.mark.parametrize("kind", ["json", "yaml"])
def test_dump_in_few_files(spark, tmp_path, monkeypatch, kind, n):
    monkeypatch.setattr(doc_writers, "FILE_PAGES", 8)
    path, registry = str(tmp_path / "dump"), _registry(spark, n)
    {"json": doc_writers.write_registry_json, "yaml": doc_writers.write_registry_yaml}[kind](registry, path)
    read = {"json": documents.read_registry_json, "yaml": documents.read_registry_yaml}[kind](spark, path, 77)
    assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, registry.select(*read.columns).collect()), key=str)
    files = [x for x in (tmp_path / "dump").rglob("part-*")]
    assert len(files) <= max(1, -(-n // 800))  # 15 pages of 100 are two files
    assert all(x.parent == tmp_path / "dump" for x in files)
