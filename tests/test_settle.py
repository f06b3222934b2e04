import os

import pytest

from barframe.plans import settle as st


def test_release_leaves_no_file(spark):
    kept = st.settle(spark.range(10).toDF("x"), "kept")
    gone = st.settle(spark.range(10).toDF("x"), "gone")
    st.release(gone)
    assert not os.path.exists(gone.settled_path) and kept.count() == 10
    st.release(kept)
    assert not os.path.exists(kept.settled_path)


class _Session:
    def __init__(self, master):
        self.sparkContext = type("C", (), {"master": master, "applicationId": "app-1"})()
        self.conf = type("F", (), {"get": staticmethod(lambda k, d: d)})()


def test_a_cluster_without_a_shared_folder_raises():
    for master in ("spark://host:7077", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            st.shared_dir(_Session(master))
    assert st.shared_dir(_Session("local[2]")) == st.shared_dir(_Session("local[2]"))
