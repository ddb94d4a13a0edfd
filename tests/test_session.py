from pathlib import Path
from urllib.parse import urlsplit

from spanloom.session import scratch, shared_folder, store


def folders(df):
    return {str(Path(urlsplit(f).path).parent) for f in df.inputFiles()}


def test_intermediate_tables_go_and_kept_ones_stay(spark):
    with scratch(spark):
        gone, kept = store(spark.range(5)), store(spark.range(6), keep=True)
        with scratch(spark):
            inner = folders(store(spark.range(7)))
        assert not any(Path(f).exists() for f in inner)
        paths = folders(gone), folders(kept)
        assert gone.count() == 5 and all(Path(f).exists() for f in paths[0] | paths[1])
    assert not any(Path(f).exists() for f in paths[0]) and all(Path(f).exists() for f in paths[1])
    assert kept.count() == 6
    # Outside nothing is deleted.
    outside = store(spark.range(3))
    assert all(Path(f).exists() for f in folders(outside)) and shared_folder(spark) != shared_folder(spark)
