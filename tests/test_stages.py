"""Stages that are used again, and their manifests."""

import shutil
import uuid

import pytest

from anchorset.plans import bindings, clinical
from anchorset.sources.stages import StageStore
from anchorset.sources.tables import TableSource


@pytest.fixture
def tables(spark, tmp_path):
    """Two source tables as files, and a way to run a small graph over them:
    left -> a, right -> b, a and b -> c, c -> d (with an option), a -> e."""
    for name in ("left", "right"):
        spark.range(10).write.parquet(f"{tmp_path}/{name}")

    def run(option=1):
        store = StageStore(spark, f"{tmp_path}/run", resume=True)
        read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
        a = store.border("a", read("left").selectExpr("id + 1 as id"))
        b = store.border("b", read("right").selectExpr("id * 2 as id"))
        c = store.border("c", a.join(b, "id"))
        d = store.border("d", c.selectExpr(f"id + {option} as id"), option=option)
        e = store.border("e", a.selectExpr("-id as id"))
        rows = {n: sorted(r[0] for r in df.collect()) for n, df in {"a": a, "b": b, "c": c, "d": d, "e": e}.items()}
        return store, rows

    return run


def test_unchanged_stages_are_read(tables):
    first, rows = tables()
    assert first.written == ["a", "b", "c", "d", "e"]
    again, same = tables()
    assert again.written == [] and same == rows


def test_a_changed_source_rebuilds_its_dependants(spark, tables, tmp_path):
    tables()
    spark.range(4).write.mode("append").parquet(f"{tmp_path}/right")
    store, rows = tables()
    assert store.written == ["b", "c", "d"]
    assert rows["b"] == sorted([2 * i for i in range(10)] + [0, 2, 4, 6])


def test_a_changed_option_rebuilds_its_dependants(tables):
    _, before = tables()
    store, rows = tables(option=5)
    assert store.written == ["d"] and rows["d"] == [x + 4 for x in before["d"]]
    # The earlier version is still there.
    assert tables(option=1)[0].written == []


def test_a_broken_stage_is_written_anew(tables, tmp_path):
    tables()
    (broken,) = (tmp_path / "run").glob("c-*")
    (broken / "_SUCCESS").unlink()
    store, _ = tables()
    # Its files are new, so what was made of the old ones is made again.
    assert store.written == ["c", "d"]


def test_drop_takes_what_depends_on_it(tables):
    store, _ = tables()
    assert {p.split("-")[0] for p in store.dependants("b")} == {"b", "c", "d"}
    store.drop("b")
    assert {m["name"] for m in store.manifests().values()} == {"a", "e"}
    assert tables()[0].written == ["b", "c", "d"]


def test_prune_removes_old_versions(tables):
    tables(option=1)
    store, rows = tables(option=2)
    assert len(store.manifests()) == 6
    assert [p.split("-")[0] for p in store.prune()] == ["d"]
    assert len(store.manifests()) == 5 and tables(option=2)[1] == rows


def test_paths_with_odd_characters(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a b%c")
    store = lambda: StageStore(spark, f"{tmp_path}/run", resume=True)
    df = spark.read.parquet(f"{tmp_path}/a b%c")
    first, again = store(), store()
    assert first.border("s", df).count() == again.border("s", df).count() == 3
    assert first.written == ["s"] and again.written == []


def test_the_study_rebuilds_what_a_table_changes(spark, tmp_path):
    """A new laboratory file leaves the cohort alone; an option, the features too."""
    sf = "/root/testdata/sf0.001"
    frames = bindings.clinical_source(spark, sf)
    for name in clinical.reg.TABLES:
        frames.table(name).write.parquet(f"{tmp_path}/in/{name}.parquet")

    def run(**options):
        store = StageStore(spark, f"{tmp_path}/run", resume=True)
        study = clinical.ClinicalStudy(TableSource(spark, path=f"{tmp_path}/in"), store, **options)
        rows = {n: study.table(n).count() for n in ("study_table", "platelet_ratios", "cohort_stays")}
        return store.written, rows

    first, rows = run()
    assert {"subjects", "index", "lab_profile", "history", "ratios"} <= set(first)
    assert run() == ([], rows)
    assert run(day_origin="index")[0] == ["ratios"]
    assert set(run(removal="intent")[0]) >= {"index", "lab_profile", "history"}
    shutil.copytree(f"{tmp_path}/in/lab.parquet", f"{tmp_path}/lab")
    spark.read.parquet(f"{tmp_path}/lab").limit(5).write.mode("append").parquet(f"{tmp_path}/in/lab.parquet")
    changed = run()[0]
    assert not {"subjects", "treated", "index", "diagnoses", "treatments"} & set(changed)
    assert {"lab_profile", "baseline", "population", "history", "ratios", "lookback"} <= set(changed)


def test_unnamed_runs_are_removed(spark):
    StageStore.remove_all(spark)
    stores = [StageStore.for_session(spark) for _ in range(2)]
    for store in stores:
        store.border("a", spark.range(3))
    assert all(store.has("a") for store in stores)
    assert StageStore.remove_all(spark) == 2 and StageStore.remove_all(spark) == 0
    assert not any(store.has("a") for store in stores)


def test_named_runs_are_kept(spark):
    store = StageStore.for_session(spark, f"test-{uuid.uuid4().hex}")
    store.border("a", spark.range(3))
    StageStore.remove_all(spark)
    assert store.has("a")
    store.remove()
    assert not store.has("a")
