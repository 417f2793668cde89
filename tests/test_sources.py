import io
import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from slicewise import schemas
from slicewise.functions import packed
from slicewise.operators import labels, ledger
from slicewise.session import fresh_path, local_session, shared_folder
from slicewise.sources import documents, files, tables


def test_files_and_headers(spark, tmp_path):
    def decode(content: bytes) -> dict:
        return json.loads(content)

    for i, (name, head) in enumerate([("s1/a/1.dcm", {"study_uid": "u", "slice_thickness": 5, "image_type": ["ORIGINAL", "AXIAL"]}),
                                      ("s1/a/2.DCM", {"study_uid": "u", "series_uid": "x"}), ("s1/b/3.dcm", None), ("s1/b/4.txt", {})]):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("broken" if head is None else json.dumps(head))
    assert files.list_files(spark, str(tmp_path)).count() == 2
    listed = files.list_files(spark, str(tmp_path), any_case=True)
    assert listed.count() == 3 and listed.columns == ["path", "length", "modificationTime"]
    heads = files.read_headers(spark, str(tmp_path), decode, any_case=True)
    rows = sorted(heads.collect(), key=lambda r: r["path"])
    assert len(rows) == 2 and rows[0]["slice_thickness"] == "5" and rows[0]["image_type"] == ["ORIGINAL", "AXIAL"]
    assert rows[0]["series_uid"] == "unknown" and rows[1]["modality"] == ""
    kept = files.read_headers(spark, str(tmp_path), decode, keep_errors=True)
    assert kept.filter("error IS NOT NULL").count() == 1
    few = files.read_headers(spark, str(tmp_path), decode, paths=listed.filter(F.col("path").endswith("1.dcm")))
    assert few.count() == 1
    assert files.read_headers(spark, str(tmp_path), decode, since="2100-01-01").count() == 0
    assert files.read_headers(spark, str(tmp_path), decode, since="2000-01-01").count() == 1


def test_quarantine(spark):
    df = spark.createDataFrame([("a", [1.0], "ok", None), ("b", None, "error", "why")], "image_id string, values array<double>, status string, message string")
    good, bad = fresh_path(spark, "good"), fresh_path(spark, "bad")
    files.with_quarantine(df, good, bad)
    assert [r["image_id"] for r in spark.read.parquet(good).collect()] == ["a"]
    assert [(r["image_id"], r["reason"]) for r in spark.read.parquet(bad).collect()] == [("b", "why")]


def test_labels_and_votes(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("ID,Label\nID_a_any,1\nID_b_any,0\n")
    rows = documents.read_labels(spark, str(tmp_path / "labels.csv")).orderBy("ord").collect()
    assert [(r["ID"], r["Label"]) for r in rows] == [("ID_a_any", 1), ("ID_b_any", 0)]
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "a.csv").write_text("ID,Label\nID_a_any,1\n")
    (folder / "b.csv").write_text("ID,Label\nID_a_any,0\n" + "".join(f"ID_x{i}_any,0\n" for i in range(50)))
    both = documents.read_labels(spark, str(folder))
    assert {r["image_id"]: r["any"] for r in labels.labels_wide(both).collect()}["ID_a"] == 1
    assert {r["image_id"]: r["any"] for r in labels.labels_wide(both, "last").collect()}["ID_a"] == 0
    (tmp_path / "reads.csv").write_text("name,R1:SDH,R2:SDH\nX-1,1,\n")
    row = documents.read_votes(spark, str(tmp_path / "reads.csv")).first()
    assert row["R1:SDH"] == "1" and row["R2:SDH"] is None


def test_split_document(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"train_ids": ["a", "b"], "val_ids": ["c"], "test_ids": []}, indent=1))
    got = {(r["image_id"], r["split"]) for r in documents.read_split_document(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("a", "train"), ("b", "train"), ("c", "val")}


def test_metrics_document_and_defaults(spark, tmp_path):
    one = {"auc": 0.9856, "prevalence": 0.145, "sensitivity": 0.940012, "specificity": 0.945273, "ppv": 0.74, "npv": 0.99,
           "lr_positive": 17.2, "lr_negative": 0.06, "threshold": 0.35, "n_positive": 5, "n_total": 9}
    (tmp_path / "m.json").write_text(json.dumps({"n_test": 9, "mean_auc": 0.986447, "per_class": {"any": one}}, indent=1))
    rows = documents.read_metrics(spark, str(tmp_path / "m.json"))
    assert rows.first()["class"] == "any"
    assert tuple(documents.headline(rows, spark).first()) == (0.94, 0.9453, 0.9864)
    assert tuple(documents.headline(None, spark).first()) == (0.98, 0.97, 0.9877)
    assert tuple(documents.headline(rows.filter("false"), spark).first()) == (0.98, 0.97, 0.9877)


def test_infinite_ratio_survives_the_document(spark):
    names = "class string, " + ", ".join(f"{n} double" for n in documents.METRIC_FIELDS[:9]) + ", n_positive long, n_total long"
    df = spark.createDataFrame([("any", *[0.5] * 6, float("inf"), 0.1, float("inf"), 1, 2)], names)
    got = documents.roundtrip_metrics(df).first()
    assert got["lr_positive"] == float("inf") and got["threshold"] == float("inf")


def test_manifest(spark, tmp_path):
    doc = {"positive": [{"study_uid": "1", "dominant_class": "subdural", "subtype_labels": {"any": 1}, "n_slices": 30, "n_labelled": 30, "folder": "p/1"}],
           "negative": [{"study_uid": "2", "n_slices": 28, "n_labelled": 28, "folder": "n/2"}]}
    (tmp_path / "manifest.json").write_text(json.dumps(doc, indent=2))
    got = {r["study_uid"]: r for r in documents.read_manifest(spark, str(tmp_path / "manifest.json")).collect()}
    assert got["1"]["group"] == "positive" and got["1"]["subtype_labels"] == {"any": 1}
    assert got["2"]["dominant_class"] == "negative" and got["2"]["subtype_labels"] is None


def test_worklist_files(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps([{"study_uid": "b", "ai_positive": True, "exam_time": "2"}, {"study_uid": "a", "physician_stat": True}], indent=1))
    entries = documents.read_worklist(spark, str(tmp_path / "w.json"))
    assert entries.count() == 2
    path = fresh_path(spark, "worklist")
    documents.write_worklist(entries, path)
    again = documents.read_worklist_snapshot(spark, path, entries.schema)
    assert [r["study_uid"] for r in again.coalesce(1).collect()] == ["a", "b"]


def test_ledger(spark):
    path = fresh_path(spark, "ledger")
    rows = [("t", "s1", "read", "m", 10, 5, None, 2, 17, 100, "end"), ("t", "s1", "count [count_only]", "m", 3, None, None, None, 3, None, "count_only")]
    for r in rows:
        documents.append_ledger(spark.createDataFrame([r], schemas.LEDGER), path)
    back = documents.read_ledger(spark, path)
    assert back.count() == 2 and back.agg(F.sum("output_tokens")).first()[0] == 5
    total = ledger.totals_per_study(ledger.with_total(back.drop("total_tokens"))).first()
    assert (total["calls"], total["input_tokens"], total["total_tokens"]) == (2, 13, 20)
    average = ledger.average_per_study(ledger.totals_per_study(back)).first()
    assert average["studies"] == 1 and average["avg_total_tokens"] == 20.0


def test_export_drops_the_slice_block(spark):
    path = fresh_path(spark, "export")
    documents.export_results(spark.createDataFrame([("s", [1.0])], "study_uid string, per_slice_probs array<double>"), path)
    assert spark.read.json(path).columns == ["study_uid"]


def test_tensor_store_skips_existing(spark):
    path = tables.new_store(spark, "tensors")
    df = spark.createDataFrame([("a", 1, 1, [0.5], "medium", "train"), ("b", 1, 1, [0.5], "medium", "val")], schemas.TENSORS)
    tables.append_tensors(spark, path, df.limit(1))
    tables.append_tensors(spark, path, df)
    tables.append_tensors(spark, path, df.withColumn("window", F.lit("narrow")))
    assert tables.read_tensors(spark, path).count() == 4


def test_tensor_store_holds_two_bytes_a_cell(spark):
    path = tables.new_store(spark, "tensors")
    rng = random.Random(4)
    rows = [(f"i{i}", 64, 64, [rng.random() for _ in range(64 * 64)], "medium", "train") for i in range(40)]
    df = spark.createDataFrame(rows, schemas.TENSORS)
    tables.append_tensors(spark, path, df.coalesce(1))
    stored = tables.read_tensors(spark, path)
    assert stored.filter(packed.fits(F.col("image_half"), F.col("h"), F.col("w"))).count() == 40
    size = sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))
    assert size <= 40 * 64 * 64 * 2 + 8192
    tables.append_tensors(spark, path, stored.withColumn("window", F.lit("narrow")))  # packed blocks go in as they are
    back = {(r["window"], r["image_id"]): bytes(r["image_half"]) for r in tables.read_tensors(spark, path).collect()}
    assert len(back) == 80 and all(back["medium", r[0]] == back["narrow", r[0]] == packed.to_bytes(r[3]) for r in rows)


def test_visited_log(spark):
    path = tables.new_store(spark, "visited")
    assert tables.read_visited(spark, path).count() == 0
    tables.mark_visited(spark.createDataFrame([("f", "ready")], tables.VISITED), path)
    assert tables.read_visited(spark, path).first()["status"] == "ready"


def test_catalog_table(spark):
    df = spark.createDataFrame([("a", "2024-01-31")], "study_uid string, d string").select("study_uid", F.to_date("d").alias("exam_date"))
    tables.save_as_table(df, "study_results_test")
    assert spark.table("study_results_test").first()["exam_month"] == "2024-01"


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x").startswith(shared_folder(spark))
    assert local_session("8").sparkContext.master.startswith("local")


def test_staged_reading_fetches_heads_only(spark, tmp_path):
    """One file a study first, leading bytes only; a file that cannot be read rejects its own study."""
    import datetime as dt
    import json

    from slicewise.plans import flows
    from slicewise.plans.inputs import json_head

    def put(path, **head):
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes((json.dumps(head).encode() if head else b"broken") + b"\0" + b"p" * 50_000)

    good = {"modality": "CT", "series_description": "HEAD", "study_date": "20240101", "image_type": ["ORIGINAL"]}
    for i in range(3):
        put(f"ready/s1/{i}.dcm", study_uid="1", series_uid="a", **good)
        put(f"ready/s2/{i}.dcm", study_uid="1", series_uid="b", **good | {"series_description": "SCOUT", "note": "x" * 3000})
        put(f"chest/s1/{i}.dcm", study_uid="2", series_uid="c", **good | {"study_description": "CT CHEST"})
        put(f"known/s1/{i}.dcm", study_uid="3", series_uid="d", **good)
        put(f"bad/s1/{i}.dcm", **({} if i == 0 else good))
        put(f"partly/s1/{i}.dcm", **({} if i == 1 else good | {"study_uid": "5", "series_uid": "e"}))
    listed = files.list_files(spark, str(tmp_path))
    existing = spark.createDataFrame([("3",)], "study_uid string")
    routed, heads = flows.staged_scan(listed, json_head, existing, dt.date(2024, 2, 1), None, 2, head_bytes=512)
    got = {r.study_folder.split("/")[-1] if "ready" in r.study_folder else r.study_folder.split("/")[-2]: r for r in routed.collect()}
    assert {k: (r.status, r.reason, r.study_uid, r.n_files) for k, r in got.items()} == {
        "ready": ("ready", "", "1", 6), "chest": ("not_head_ct", "non_head_desc", "2", 3), "known": ("already_processed", "", "3", 3),
        "bad": ("not_head_ct", "header_read_error", None, 3), "partly": ("ready", "", "5", 3)}
    assert got["ready"].series_uid == "a" and got["partly"].slice_count == 2
    read = heads.collect()
    assert sorted(r.path.split("/")[-3] for r in read if r.stage == 2) == ["partly"] * 2 + ["ready"] * 5
    assert max(r.bytes_read for r in read if "/s2/" in r.path) == 8192 and max(r.bytes_read for r in read if "/s2/" not in r.path) == 512
    gone = files.read_heads(spark.createDataFrame([("f", str(tmp_path / "none.dcm"))], "study_folder string, path string"), json_head).first()
    assert gone.study_folder == "f" and gone.error and gone.bytes_read == 0


def test_packed_files_take_little_disk_and_read_like_loose_ones(spark, tmp_path, monkeypatch):
    """Every order's image lies in an archive, is listed with its whole length and opened by its address."""
    from slicewise.plans import inputs

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert inputs.image_files(spark, "/root/testdata/sf0.001", str(tmp_path / "all")) == orders
    listed = files.list_packed(spark, str(tmp_path / "all"))
    assert listed.distinct().count() == orders and listed.agg(F.min("length")).first()[0] == 5015
    taken = sum(512 * p.stat().st_blocks for p in (tmp_path / "all").rglob("*"))
    assert taken < 200 * orders  # loose files: two blocks of 4,096 bytes each, and their folders

    rows = spark.range(500).selectExpr("concat(id % 7, '/s/', id, '.dcm') name", "repeat('x', int(id * 37)) body").coalesce(1).sortWithinPartitions("name")
    monkeypatch.setattr(files, "ARCHIVE_BYTES", 1 << 20)
    for _ in range(2):  # a task that repeats leaves the same archives
        files.pack_files(rows, str(tmp_path / "some"), str.encode)
    got = {r.path.split("some/")[1]: r for r in files.list_packed(spark, str(tmp_path / "some")).collect()}
    assert len(list((tmp_path / "some").glob("*.tar.zst"))) == 5 and len(got) == 500
    opener = files.packed_opener()
    for r in rows.collect():
        with opener(got[r.name].address) as f:
            assert f.read() == r.body.encode() and got[r.name].length == len(r.body)
    heads = files.read_heads(files.by_frame(files.file_studies(files.list_packed(spark, str(tmp_path / "some")))),
                             lambda data: {"study_uid": str(len(data))} if len(data) >= 64 else None, opener=files.packed_opener(), head_bytes=16)
    read = heads.collect()
    assert sorted(r.path.split("some/")[1] for r in read) == sorted(got)
    assert {(r.study_uid, r.error, r.bytes_read) for r in read} == {("64", None, 64), (None, "header without an end", 0), (None, "header without an end", 37)}


def listing_in_python(spark, studies):
    """A listing that a Python step gives out, as that of archives is: the plan knows nothing of its size."""
    kind = "path string, length bigint"
    rows = spark.range(studies).selectExpr("id", "explode(sequence(0, 5)) f").selectExpr(
        "if(id % 3 = 0, concat('in/', id, '/', f, '.dcm'), concat('in/', id, '/s', f % 2, '/', f, '.dcm')) path", "f length")
    return rows.repartition("path").mapInPandas(lambda batches: batches, kind)


def test_a_listing_never_passes_through_the_driver(spark):
    placed = files.file_studies(listing_in_python(spark, 300))
    got = {tuple(r) for r in placed.groupBy("study_folder").agg(F.count(F.lit(1)), F.sum("length")).collect()}
    assert got == {("in", 600, 1500)} | {(f"in/{i}", 6, 15) for i in range(300) if i % 3}
    placed.collect()
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "MapInPandas" not in plan and plan.count("SortMergeJoin") >= 2


def test_staged_reading_broadcasts_no_studies(spark, monkeypatch):
    """Joins on files and study folders never pass through the driver, however small their files look."""
    import datetime as dt

    from slicewise.plans import flows

    plans = {}

    def recorded(df, name, write=flows.durable):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(flows, "durable", recorded)
    head = {"modality": "CT", "series_uid": "a", "series_description": "HEAD", "study_date": "20240101", "image_type": ["ORIGINAL"]}
    existing = spark.createDataFrame([("none",)], "study_uid string")
    routed, _ = flows.staged_scan(listing_in_python(spark, 30).filter("path like '%/s_/%'"), lambda data: head, existing, dt.date(2024, 2, 1), None, 2,
                                  opener=lambda path: io.BytesIO(path.encode()))
    assert {(r.status, r.n_files, r.slice_count) for r in routed.collect()} == {("ready", 6, 6)}
    plans["routed"] = routed._jdf.queryExecution().executedPlan().toString()
    for name in ("other-heads", "routed"):
        assert plans[name].count("SortMergeJoin") >= 2
        assert not [at for at in plans[name].split("BroadcastHashJoin [")[1:] if at.startswith(("path#", "study_folder#"))]
