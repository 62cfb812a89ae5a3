"""Results over sessions, files that change, copies in a stream."""

import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from inkwell.plans import analysis
from inkwell.plans.incremental import TABLES, Collection
from inkwell.sources import exports, shared
from inkwell.sources.results import Files, ResultStore, chunked, contents
from inkwell.streaming import pages

from .test_files import page


def put(at, name, height):
    (at / name).write_bytes(exports.png(page(height).tobytes(), 320))


def rows(table):
    return sorted(map(tuple, table.select(*sorted(table.columns)).collect()), key=repr)


def test_contents(spark, tmp_path):
    put(tmp_path, "a.png", 120)
    put(tmp_path, "b.png", 144)
    before = contents(spark, f"file://{tmp_path}")
    put(tmp_path, "b.png", 144)
    assert contents(spark, f"file://{tmp_path}") == before and before[0] == 2
    (tmp_path / "b.png").write_bytes((tmp_path / "b.png").read_bytes() + b"x")
    assert contents(spark, f"file://{tmp_path}") != before
    assert contents(spark, f"file://{tmp_path}", "*.tif")[0] == 0


def test_chunked(spark):
    lists = list(chunked(spark.range(1000), 300))
    assert len(lists) == 4 and sorted(r.id for rows in lists for r in rows) == list(range(1000))
    assert list(chunked(spark.range(0), 3)) == []


def test_second_session(spark, tmp_path, monkeypatch):
    """Another session reads what the first has stored, and computes nothing."""
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.png", 120)
    at = f"file://{tmp_path}/in"
    first = analysis.from_files(spark, at, store=ResultStore(spark, f"file://{tmp_path}/kept"))
    want = {name: rows(getattr(first, name)) for name in ("blobs", "density", "regions", "detections", "texts", "crops", "lines")}
    shared.release(spark)
    monkeypatch.setattr(analysis, "from_rasters", lambda *a, **k: pytest.fail("computed again"))
    other = spark.newSession()
    again = analysis.from_files(other, at, store=ResultStore(other, f"file://{tmp_path}/kept"))
    assert {name: rows(getattr(again, name)) for name in want} == want and want["blobs"]
    assert again.held.data == first.held.data and again.gray.first().data == page(120).tobytes()


def test_writers(spark, tmp_path):
    """Several writers of a key give one entry, and all read it."""
    store = ResultStore(spark, f"file://{tmp_path}")
    with ThreadPoolExecutor(4) as pool:
        held = list(pool.map(lambda k: store.publish("k", {"t": spark.range(k, k + 5)}), range(4)))
    assert all(h.tables["t"].count() == 5 for h in held)
    assert list(store.files.names("entries")) == ["k"]
    late = store.publish("k", {"t": spark.range(99)})
    assert late.tables["t"].count() == 5
    named = store.open("k").data
    for h in held:
        h.release()
    store.lease_seconds = 0
    store.evict(10**9)
    assert list(store.files.names("data")) == [named] and store.open("k").tables["t"].count() == 5


def test_eviction(spark, tmp_path):
    """The entry used longest ago goes first, leased ones stay, leases run out."""
    store = ResultStore(spark, f"file://{tmp_path}")
    for k in "abc":
        store.publish(k, {"t": spark.range(1000), "none": spark.range(0)}).release()
        time.sleep(0.05)
    store.open("a").release()
    size = store.files.size("data") // 3
    assert store.evict(2 * size + 100) == ["b"] and store.open("b") is None
    held = store.open("c")
    assert store.evict(0) == ["a"] and held.tables["t"].count() == 1000 and held.tables["none"].columns == ["id"]
    held.renew()
    assert store.evict(0) == []
    store.lease_seconds = 0
    assert store.evict(0) == ["c"] and not store.files.names("data") and store.open("c") is None


def test_entry_gone_under_a_reader(spark, tmp_path):
    """Data that a reader holds outlive their entry."""
    store = ResultStore(spark, f"file://{tmp_path}")
    held = store.publish("k", {"t": spark.range(7)})
    store.files.delete("entries/k")
    store.evict(0)
    assert held.tables["t"].count() == 7
    held.release()
    store.evict(0)
    assert not store.files.names("data")


def test_incremental(spark, tmp_path, monkeypatch):
    """One file changes, one comes, one goes: only the new and the changed one are analysed, and all results equal a full run."""
    at = tmp_path / "in"
    at.mkdir()
    for k in range(5):
        put(at, f"{k}.png", 120 + 24 * k)
    path = f"file://{at}"
    kept = Collection(spark, path, f"file://{tmp_path}/out")
    with pytest.raises(ValueError, match="nothing"):
        kept.table("density")
    assert kept.refresh() == {"analysed": 5, "gone": 0, "kept": 0} and kept.refresh() == {"analysed": 0, "gone": 0, "kept": 5}
    put(at, "1.png", 300)
    put(at, "a b.png", 200)
    (at / "3.png").unlink()
    seen, run = [], analysis.from_rasters
    monkeypatch.setattr(analysis, "from_rasters", lambda r, **k: (seen.extend(x.origin.rsplit("/", 1)[1] for x in r.collect()), run(r, **k))[1])
    assert kept.refresh() == {"analysed": 2, "gone": 1, "kept": 3} and sorted(seen) == ["1.png", "a b.png"]
    monkeypatch.setattr(analysis, "from_rasters", run)
    full = analysis.from_files(spark, path)
    want = {name: rows(getattr(full, name)) for name in TABLES if name != "pages"}
    assert len(want["density"]) == 5 and {name: rows(kept.table(name)) for name in want} == want
    assert kept.table("pages").count() == 5 and kept.manifest().count() == 5
    kept.compact()
    assert {name: rows(kept.table(name)) for name in want} == want and len(kept.files.names("commits")) == 1
    assert kept.refresh() == {"analysed": 0, "gone": 0, "kept": 5}
    with pytest.raises(ValueError, match="other options"):
        Collection(spark, path, f"file://{tmp_path}/out", tile=64).refresh()


def test_stopped_refresh(spark, tmp_path, monkeypatch):
    """A generation without its commit doesn't count and is written anew."""
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.png", 120)
    kept = Collection(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")
    write = Files.write
    monkeypatch.setattr(Files, "write", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError, match="stopped"):
        kept.refresh()
    monkeypatch.setattr(Files, "write", write)
    assert kept.manifest().count() == 0
    assert kept.refresh()["analysed"] == 1 and kept.table("density").count() == 1


def test_copies_in_a_stream(spark, tmp_path):
    """Bytes seen before count once over restarts; statistics follow; nothing that a batch stored stays."""
    at, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    shared.release(spark)
    for names, height in ((["a.png", "copy.png"], 120), (["again.png"], 120), (["b.png"], 144)):
        for name in names:
            put(tmp_path / "in", name, height)
        pages.watch(spark, at, out, state, once=True, copies=False).awaitTermination()
        pages.running(spark, out, f"{out}/stats", f"{state}-stats", once=True).awaitTermination()
    assert pages.results(spark, out, "density").count() == 2
    found = pages.statistics(spark, f"{out}/stats").collect()
    assert sum(r.pages for r in found) == 2 and sum(r.blobs for r in found) == 17 * (3 + 4)
    folder = shared.folder(spark)
    assert not Files(spark, folder).names("")
