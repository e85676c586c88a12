"""What Python workers load for the near-duplicate stage, and its sketch over several levels."""

import subprocess
import sys

import numpy as np

from tallyspark.llm import near_dup
from tallyspark.llm.words import shingle_sets


def test_workers_load_no_pandas():
    code = "import sys, tallyspark.llm.near_dup, tallyspark.llm.decontaminate; print('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "False"


def test_sketch_of_levels(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "FAN", 3)  # three levels over ten partitions
    texts = [f"w{i} a b c d e f g{i % 3}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(10)
    want = sum(np.bincount((s >> np.uint64(64 - near_dup.BITS)).astype(np.int64), minlength=1 << near_dup.BITS) for s in shingle_sets(texts))
    assert np.array_equal(near_dup.frequency_sketch(docs), want)
