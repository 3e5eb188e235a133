"""Slices of a log folded onto stored state give what the whole log gives."""

import pytest
from helpers import TINY, event, random_log, routed

from tocsin.operators.hot import Limits
from tocsin.plans.incremental import AlertStore
from tocsin.plans.run import AlertRun


def rows(df):
    return sorted(map(repr, df.collect()))


def in_order(log):
    return sorted(log, key=lambda e: (e["received_at"], e["seq"]))


def cut(log, slices):
    size = -(-len(log) // slices)
    return [log[i : i + size] for i in range(0, len(log), size)]


@pytest.mark.parametrize("seed,keys,limits", [(22, 25, Limits()), (23, 12, TINY)])
def test_folds_equal_one_run(spark, tmp_path, seed, keys, limits):
    log = in_order(random_log(seed, 160, keys=keys))
    store = AlertStore.create(spark, f"{tmp_path}/store", limits)
    done = []
    for number, part in enumerate(cut(log, 3)):
        store.fold(f"slice-{number}", routed(spark, part))
        done += part
        if number == 2:
            run = AlertRun(routed(spark, done))
            assert rows(store.alerts()) == rows(run.alerts)
            pending = run.parents.filter("resolve_requested").select("family", "requested_at", "remaining_children")
            families = store.tables()["families"]
            asked = families.where("state = 'pending'").selectExpr("family", "requested_at", "remaining AS remaining_children")
            assert rows(asked) == rows(pending)
            assert families.where("(state = 'pending') AND active = 0").count() == 0


def test_a_window_stays_open_between_slices(spark, tmp_path):
    store = AlertStore.create(spark, f"{tmp_path}/store")
    store.fold("a", routed(spark, [event(0, 0, "p")]))
    store.fold("b", routed(spark, [event(1, 1, "p", "resolve"), event(2, 5, "in")]))
    store.fold("c", routed(spark, [event(3, 6, "p"), event(4, 6.5, "p", "resolve"), event(5, 7, "in", "resolve")]))
    store.fold("d", routed(spark, [event(6, 500, "out"), event(7, 501, "never", "resolve")]))
    found = {r.dedup_key: (r.parent_dedup_key, r.status, r.child_count) for r in store.alerts().collect()}
    assert found == {"p": (None, "resolved", 1), "in": ("p", "resolved", 0), "out": (None, "active", 0)}


def test_a_repeated_slice_and_a_torn_fold_change_nothing(spark, tmp_path):
    log = in_order(random_log(31, 60, keys=10))
    first, second = cut(log, 2)
    store = AlertStore.create(spark, f"{tmp_path}/store")
    store.fold("one", routed(spark, first))
    before = rows(store.alerts())
    made = store.fold("one", routed(spark, first))  # repeated
    assert made.version == 1 and rows(store.alerts()) == before
    store._write(store.tables())  # a fold or compaction that ends before its manifest
    assert rows(store.alerts()) == before
    store.fold("two", routed(spark, second))
    whole = rows(AlertRun(routed(spark, log)).alerts)
    assert rows(store.alerts()) == whole
    assert len(store.manifest().parts) == 2
    made = store.compact()
    assert len(made.parts) == 1 and made.slices == ("one", "two")
    assert rows(store.alerts()) == whole
    assert store.fold("two", routed(spark, second)).version == made.version
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store._publish(made)  # another writer took this version


def test_empty_slices(spark, tmp_path):
    store = AlertStore.create(spark, f"{tmp_path}/store")
    assert store.alerts().count() == 0
    store.fold("nothing", routed(spark, []))
    assert store.alerts().count() == 0 and store.manifest().slices == ("nothing",)
