"""Pinned frames: computed once, and gone once discarded."""

from pathlib import Path

from eventlake.session import discard, pinned


def test_pinned_and_discarded(spark):
    first, second = pinned(spark.range(5)), pinned(spark.range(3))
    folders = [Path(frame.pinned_folder.removeprefix("file:")) for frame in (first, second)]
    assert all(folder.exists() for folder in folders) and folders[0] != folders[1]
    discard(first)
    assert not folders[0].exists() and second.count() == 3
