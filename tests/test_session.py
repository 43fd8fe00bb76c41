import os
import types

import pytest

from recolta import session


def test_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda key, default=None: default, set=lambda *a: pytest.fail("a folder was set"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        spark = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master))
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_dir(spark)


def test_tables_are_read_again_and_released(spark):
    made = session.materialize(spark.range(5), "numbers")
    folder = session.shared_dir(spark).removeprefix("file://") + "/recolta/" + spark.sparkContext.applicationId
    assert made.count() == 5 and any(x.startswith("numbers") for x in os.listdir(folder))
