"""The shared folder: any local master may do without one, no cluster may."""

from types import SimpleNamespace

import pytest

from skytally.sources.shared import work_path


def session(master, **settings):
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=settings.get, set=settings.__setitem__))


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_local_masters_make_one_and_keep_it(master):
    spark = session(master)
    first, second = work_path(spark, "a"), work_path(spark, "a")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn"])
def test_clusters_must_name_one(master):
    with pytest.raises(ValueError):
        work_path(session(master), "a")
    assert work_path(session(master, **{"spark.checkpoint.dir": "s3://b/c/"}), "a").startswith("s3://b/c/skytally/a-")
