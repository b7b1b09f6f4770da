"""Searches by index against scans of all titles."""

import random

import pytest

from folio.operators.catalogue import search_catalogue
from folio.sources import title_index as ti


@pytest.fixture(scope="module")
def catalogue(spark, tmp_path_factory):
    rng = random.Random(5)
    parts = ["Naruto", "원피스", "特別編", "ＡＢＣ", "aaaa", "ab", "x", "100%", "_", "é", "  ", "", "the End"]
    title = lambda: "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(5)))
    works = spark.createDataFrame([(k, title(), k) for k in range(60)] + [(99, None, 99)], "work_id long, title string, work_ord int")
    chapters = spark.createDataFrame([(k, rng.randrange(50), title(), k) for k in range(300)], "chapter_id long, work_id long, title string, chapter_ord int")
    path = str(tmp_path_factory.mktemp("index") / "i")
    ti.write_title_index(ti.catalogue_titles(works, chapters), path)
    return works, chapters, path


@pytest.mark.parametrize("query", ["naruto", "피스", "aaa", "aaaaa", "a", "AB", "abc", "0% ", "x x", "the endnaruto", "zzz", "é", "別編ａ", " ", "aaaa aaaa"])
def test_index_finds_what_a_scan_finds(catalogue, query):
    works, chapters, path = catalogue
    key = lambda r: (r.work_id, r.chapter_id if r.chapter_id is not None else -1, r.work_ord)
    got, want = ti.search_indexed(works, chapters, path, query).collect(), search_catalogue(works, chapters, query).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_search_reads_few_files(spark, catalogue):
    path = catalogue[2]
    plan = ti.search_titles(spark, path, "naruto")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(gram" in plan.replace(" ", "")
    read = spark.read.schema(ti.POSTING).parquet(path)
    hit = read.where(ti.F.col("bucket").isin([r[0] for r in read.where("gram = 'nar'").select("bucket").distinct().collect()]))
    assert len(hit.inputFiles()) * 4 < len(read.inputFiles()) or hit.select("bucket").distinct().count() == 1
    with pytest.raises(ValueError):
        ti.search_titles(spark, path, "  ")


def test_writers_grow_with_titles(spark, tmp_path, monkeypatch):
    titles = spark.range(4000).selectExpr("'work' AS kind", "id", "'a' AS title")  # one n-gram, so one bucket
    files = []
    for chars in (4000, 500):
        monkeypatch.setattr(ti, "WRITER_CHARS", chars, raising=False)
        ti.write_title_index(titles, str(tmp_path / str(chars)))
        files.append(len(spark.read.parquet(str(tmp_path / str(chars))).inputFiles()))
        assert ti.search_titles(spark, str(tmp_path / str(chars)), "a").count() == 4000
    assert files[0] <= ti.WRITERS < files[1] <= 8
