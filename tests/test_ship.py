"""The package on executors that don't have it."""

from types import SimpleNamespace

import pytest

from lodegraph import ship


@pytest.mark.parametrize(("master", "path", "sent"), [("spark://host:7077", ship.ROOT, 1), ("spark://host:7077", "", 1), ("local[2]", ship.ROOT, 0), ("local-cluster[2,1,1024]", "", 1)])
def test_once_unless_it_is_there(monkeypatch, master, path, sent):
    """Executors elsewhere don't share the folder that the driver's path names."""
    monkeypatch.setenv("PYTHONPATH", path)
    files = []
    spark = SimpleNamespace(sparkContext=SimpleNamespace(master=master, addPyFile=files.append))
    ship.ship(spark)
    ship.ship(spark)
    assert len(files) == sent
