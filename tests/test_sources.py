import pytest

from lexmill.sources import tables


@pytest.fixture
def paths(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "documents.csv").write_text('doc_id,text\n007,"a ""b""\nc"\n8,\n', encoding="utf-8")
    (raw / "train.csv").write_text("qid,question\n1,x\n", encoding="utf-8")
    (tmp_path / "p.yaml").write_text(f"raw_data_dir: {raw}\nprocessed_data_dir: p\noutputs_dir: o\n")
    return tables.load_paths("p.yaml", str(tmp_path))


def test_ids_stay_and_null_text_is_empty(spark, paths):
    assert [tuple(r) for r in tables.load(spark, paths, "documents").orderBy("doc_id").collect()] == [("007", 'a "b"\nc'), ("8", "")]


def test_missing_columns_and_files(spark, paths, tmp_path):
    with pytest.raises(ValueError, match="gold_doc_id"):
        tables.load(spark, paths, "train")
    with pytest.raises(FileNotFoundError):
        tables.load(spark, paths, "test")
    (tmp_path / "bad.yaml").write_text("raw_data_dir: x\n")
    with pytest.raises(KeyError):
        tables.load_paths(str(tmp_path / "bad.yaml"))
    assert [x["exists"] for x in tables.inventory(spark, paths)] == [True, True, False, False]


def test_repeated_ids(spark):
    with pytest.raises(ValueError):
        tables.require_unique(spark.createDataFrame([("a",), ("a",)], "doc_id string"), "doc_id", "documents")


def test_sinks(spark, paths, tmp_path):
    df = spark.createDataFrame([("q", 2, "b"), ("q", 1, "a")], "qid string, rank long, doc_id string")
    tables.ensure_output_dirs(paths)
    assert all((tmp_path / x).is_dir() for x in ("p", "o/predictions", "o/metrics", "o/submissions"))
    tables.write_csv(df, str(tmp_path / "csv"))
    assert [r["doc_id"] for r in tables.read_csv(spark, str(tmp_path / "csv")).collect()] == ["a", "b"]
    tables.write_json({"ключ": 1}, str(tmp_path / "x.json"))
    assert "ключ" in (tmp_path / "x.json").read_text(encoding="utf-8")
    tables.write_report("R", {"part": df.orderBy("rank")}, str(tmp_path / "r.md"))
    assert "| q | 1 | a |" in (tmp_path / "r.md").read_text(encoding="utf-8")


def test_paths_of_home_and_other_stores(tmp_path):
    (tmp_path / "p.yaml").write_text("raw_data_dir: ~/raw\nprocessed_data_dir: hdfs://store/p\noutputs_dir: /o\n")
    got = tables.load_paths(str(tmp_path / "p.yaml"))
    assert got.raw_data_dir.endswith("/raw") and "~" not in got.raw_data_dir and (got.processed_data_dir, got.outputs_dir) == ("hdfs://store/p", "/o")


def test_shown_values():
    assert [tables.shown(x) for x in (None, 0.25, 3, {"a": 0.5, "b": None})] == ["-", "0.2500", "3", "a: 0.5000, b: -"]
    assert tables.shown(0.256, percent=True) == "25.6 %"


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_a_declared_scan_reads_what_was_written(spark, tmp_path, kind):
    rows = [(1, None), (2, ""), (3, "  x\t"), (4, 'a "b", c\nd\\'), (5, "x\r\ny\rz"), (6, "\n"), (7, "\u0416 \U0001f600"), (None, '"'), (9, "\\"), (10, "w " * 60_000), (11, "null"), (12, "#x")]
    tables.write_scannable(spark.createDataFrame(rows, SCHEMA).coalesce(2), str(tmp_path / "t"), kind)
    got = [tuple(r) for r in tables.scan(spark, str(tmp_path / "t"), SCHEMA, kind).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
    tables.write_scannable(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), kind)
    assert tables.scan(spark, str(tmp_path / "none"), SCHEMA, kind).count() == 0


@pytest.mark.parametrize("kind,lines", [("csv", ["doc_id,text", "1,a", "x,b", "3,c,d", "4,e"]), ("json", ['{"doc_id": 1, "text": "a"}', '{"doc_id": "x", "text": "b"}', "{broken", '{"doc_id": 4, "text": "e"}'])])
def test_rows_that_do_not_fit(spark, tmp_path, kind, lines):
    (tmp_path / "t").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "t")
    with pytest.raises(Exception, match="MALFORMED"):
        tables.scan(spark, path, SCHEMA, kind).select("text").collect()
    assert [r["doc_id"] for r in tables.scan(spark, path, SCHEMA, kind, "drop").orderBy("doc_id").collect()] == [1, 4]
    kept = tables.scan(spark, path, SCHEMA, kind, "keep").collect()
    assert sorted(r[tables.BAD] for r in kept if r[tables.BAD]) == sorted(lines[-3:-1]) and len(kept) == 4
    for options in ({"bad": "skip"}, {"kind": "xml"}):
        with pytest.raises(ValueError):
            tables.scan(spark, path, SCHEMA, **options)


def test_a_header_must_name_the_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("text,doc_id\na,1\n")
    with pytest.raises(Exception, match="header"):
        tables.scan(spark, str(tmp_path / "t.csv"), SCHEMA).collect()


def test_records(spark, tmp_path):
    value = {"strict_cv_mean": 0.5, "strict_cv_std": 0.1, "strict_holdout": None}
    for name in ("a", "b"):
        tables.write_json({"experiment": name, "retriever": {"name": "bm25", "top_k": 5}, "fold_metrics": [{"fold": 0, "recall_at_5": 0.5}], "all_metrics": {"recall_at_5": value}}, str(tmp_path / f"{name}_metrics.json"))
    got = tables.records(spark, str(tmp_path / "*_metrics.json")).orderBy("experiment").collect()
    assert [tuple(r) for r in got] == [("a", "recall_at_5", 0.5, 0.1, None), ("b", "recall_at_5", 0.5, 0.1, None)]


def test_parts_are_in_order(spark, tmp_path):
    rows = [(f"s{i % 10 == 0}", i * 7919 % 1000) for i in range(1000)]
    tables.write_parts(spark.createDataFrame(rows, "split string, qid long"), str(tmp_path / "p"), ("split",), ("qid",))
    for split in ("sTrue", "sFalse"):
        ranges = []
        for file in (tmp_path / "p" / f"split={split}").glob("*.parquet"):
            ids = [r["qid"] for r in spark.read.parquet(str(file)).collect()]
            assert ids == sorted(ids)
            ranges.append((ids[0], ids[-1]))
        ranges.sort()
        assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1000
