from types import SimpleNamespace

import pytest

from tidewater.session import fresh_path, shared_dir


def session(master, folder=None, app="test"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder or default), sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_the_folder_that_the_session_names():
    assert shared_dir(session("spark://host:7077", "hdfs://h/x/")) == "hdfs://h/x"
    a, b = (fresh_path(session("local[4]", "file:///x"), "rows") for _ in range(2))
    assert a != b and a.startswith("file:///x/rows-")


def test_a_local_folder_in_local_mode_alone():
    assert shared_dir(session("local")) == shared_dir(session("local[*]")) != shared_dir(session("local[2]", app="other"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
