"""Scratch data of pinned frames."""

import glob
import os
import tempfile
import time

from pyspark.sql import functions as F

from eventlake.session import SHUFFLE_CLEANUP, pinned


def shuffle_files(spark):
    folders = {tempfile.gettempdir(), "/tmp", spark.sparkContext.getConf().get("spark.local.dir", "/tmp")}
    return {path for folder in folders for path in glob.glob(f"{folder}/blockmgr-*/*/shuffle_*")}


def test_shuffles_of_a_pinned_frame_are_deleted(spark):
    own = lambda: {path for path in shuffle_files(spark) if os.stat(path).st_mtime >= begun}
    begun = time.time() - 1
    setting = spark.conf.get(SHUFFLE_CLEANUP)
    counted = pinned(spark.range(20_000).groupBy(F.pmod(F.xxhash64("id"), F.lit(5000)).alias("key")).agg(F.count("id").alias("n")))
    deadline = time.time() + 20
    left = True
    while left and time.time() < deadline:
        try:
            left = own()
        except FileNotFoundError:  # deleted just now
            continue
    assert not left
    assert counted.agg(F.sum("n")).first()[0] == 20_000 and spark.conf.get(SHUFFLE_CLEANUP) == setting
