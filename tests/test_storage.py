"""Lifetimes of the tables between stages."""

import os
import threading

import pytest

from lectern import storage


def test_lifetimes(spark):
    with storage.lifetime(spark) as outer:
        kept = storage.written(spark.range(5))
        with storage.lifetime(spark) as inner:
            storage.written(spark.range(3))
            assert len(inner) == 1 and os.path.exists(inner[0])
        assert not os.path.exists(inner[0]) and kept.count() == 5
        with storage.lifetime(spark, keep=True) as handed:
            late = storage.written(spark.range(2))
        assert late.count() == 2 and set(handed) < set(outer)
        # Discarding what goes with the lifetime anyway is no error.
        storage.discard(late)
    assert len(outer) == 2 and not any(map(os.path.exists, outer))


def test_a_failure_leaves_nothing(spark):
    with pytest.raises(ValueError, match="no"), storage.lifetime(spark) as paths:
        storage.written(spark.range(5))
        raise ValueError("no")
    assert len(paths) == 1 and not os.path.exists(paths[0])


def test_threads_have_their_own(spark):
    seen = []
    with storage.lifetime(spark) as paths:
        thread = threading.Thread(target=lambda: seen.append(storage.written(spark.range(4))))
        thread.start()
        thread.join()
    assert paths == [] and seen[0].count() == 4
    storage.discard(seen[0])


def test_tables_outside_of_lifetimes_stay(spark):
    table = storage.written(spark.range(4))
    with storage.lifetime(spark):
        pass
    assert table.count() == 4
    storage.discard(table)


def test_sweep(spark):
    base = storage.shared_dir(spark)
    own = storage.written(spark.range(2))
    for name in ("lectern-local-1-abc", "lectern-local-2-def", "others"):
        os.makedirs(f"{base}/{name}/part")
    for name in ("lectern-local-1-abc", "others"):
        os.utime(f"{base}/{name}", (1_000_000_000, 1_000_000_000))
    assert storage.sweep(spark, 3600) == 1
    assert not os.path.exists(f"{base}/lectern-local-1-abc") and os.path.exists(f"{base}/lectern-local-2-def") and os.path.exists(f"{base}/others")
    assert own.count() == 2
    storage.discard(own)
