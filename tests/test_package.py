"""Stored packages: committed as a whole, or not there."""

import json
from types import SimpleNamespace

import pytest

from loadcast.operators.gram import LinearModel
from loadcast.plans import package as P
from loadcast.sources import storage


def _result(spark, k):
    vocabulary = spark.createDataFrame([("city", f"c{i}", i) for i in range(k + 1)],
                                       "feature string, value string, code int")
    return SimpleNamespace(best_model=LinearModel([float(k)], 1.0), vocabulary=vocabulary,
                           medians={"a": float(k)}, scaler={"a": (0.0, 1.0)},
                           meta={"model_name": f"m{k}", "feature_columns": ["a"],
                                 "selected_indices": [0], "use_scaled": False})


def _whole(pkg, k):
    return (pkg["model_name"] == f"m{k}" and pkg["model"].coefficients == [float(k)]
            and pkg["vocabulary"].count() == k + 1 and pkg["medians"] == {"a": float(k)})


def test_a_writer_that_stops_between_two_writes(spark, tmpdir_path, monkeypatch):
    """Before its manifest is whole, a new package does not exist for readers."""
    path = tmpdir_path + "/pkg"
    assert P.load_package(spark, path) is None
    P.save_package(_result(spark, 1), path)

    def stop(*args, **kwargs):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:                       # after the tables
        m.setattr(P, "_digest", stop)
        with pytest.raises(RuntimeError):
            P.save_package(_result(spark, 2), path)
    assert _whole(P.load_package(spark, path), 1)
    with monkeypatch.context() as m:                       # after the digests
        m.setattr(storage, "write_new", stop)
        with pytest.raises(RuntimeError):
            P.save_package(_result(spark, 2), path)
    assert _whole(P.load_package(spark, path), 1)
    body = json.dumps({"sha256": "0", "body": "{}"})       # in the middle of the manifest
    for text in ("", body[:9], body):
        storage.write_new(spark, f"{path}/manifest-{99 + len(text):09d}.json", text)
        assert _whole(P.load_package(spark, path), 1)
    P.save_package(_result(spark, 3), path)
    assert _whole(P.load_package(spark, path), 3)


def test_two_writers_at_once(spark, tmpdir_path, monkeypatch):
    """A second writer commits while the first is about to: both are whole, the later commit is
    the newest, and only the tables of the newest two stay."""
    path = tmpdir_path + "/pkg"
    P.save_package(_result(spark, 1), path)
    write, calls = storage.write_new, []

    def late(session, target, text):
        if not calls:
            calls.append(target)
            P.save_package(_result(spark, 5), path)        # takes the number first
        return write(session, target, text)

    monkeypatch.setattr(storage, "write_new", late)
    assert P.save_package(_result(spark, 4), path) == 3
    assert _whole(P.load_package(spark, path), 4)
    names = storage.names(spark, path)
    assert [n for n in names if n.startswith("manifest")] == ["manifest-000000002.json",
                                                              "manifest-000000003.json"]
    assert len([n for n in names if n.startswith("v-")]) == 2


def test_tables_that_are_not_the_manifests_are_refused(spark, tmpdir_path):
    path = tmpdir_path + "/pkg"
    P.save_package(_result(spark, 1), path)
    folder = next(n for n in storage.names(spark, path) if n.startswith("v-"))
    _result(spark, 4).vocabulary.write.mode("overwrite").parquet(f"{path}/{folder}/vocabulary")
    assert P.load_package(spark, path) is None
    storage.delete(spark, f"{path}/{folder}/vocabulary")
    assert P.load_package(spark, path) is None


def test_a_store_that_cannot_be_read_raises(spark):
    with pytest.raises(Exception, match="nosuchscheme|No FileSystem"):
        P.load_package(spark, "nosuchscheme://x/pkg")
