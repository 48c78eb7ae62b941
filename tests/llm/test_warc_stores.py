"""Archives on a store that isn't the local disk: the manifest's paths open there, and nowhere else."""

import os
import shutil

import pytest
from pyarrow import fs

from matlink.llm import warc


@pytest.mark.parametrize("scheme", ["far://bucket/a/b", "far://bucket/a/b/", "far://other"])
def test_other_scheme(spark, tmp_path, scheme):
    top = str(tmp_path)

    def store(uri):
        name, _, path = uri.partition("://")
        if name != "far":
            raise ValueError(f"not on this store: {uri}")
        return fs.SubTreeFileSystem(top, fs.LocalFileSystem()), path

    rows = [(1, "u1", "x" * 300), (2, "u2", "x" * 300), (3, None, None), (4, "u4", "é" * 2000)]
    made = warc.write(warc.decide(spark.createDataFrame(rows, "page_id long, url string, html string")), scheme, store=store)
    paths = [r.path for r in made.collect()]
    assert paths and all(p.startswith(scheme.rstrip("/") + "/") and p.endswith(".warc.gz") for p in paths)
    got = {r.page_id: (r.record_type, r.refers_to, r.bytes_so_far) for r in warc.read(made, store=store).where("last").collect()}
    assert got == {1: ("response", None, 300), 2: ("revisit", 1, 300), 3: ("response", None, 0), 4: ("response", None, 4000)}
    assert not os.path.exists("a/b") and not os.path.exists("/bucket")


@pytest.mark.parametrize("form", ["file://{}/w", "file:{}/w", "{}/w"])
def test_local_forms(spark, tmp_path, form):
    made = warc.write(warc.decide(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")), form.format(tmp_path))
    assert warc.read(made).first().bytes_so_far == 4 and len(list((tmp_path / "w").iterdir())) == 1
    shutil.move(tmp_path / "w", tmp_path / "gone")
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        warc.read(made).collect()
