import os
import time
from pathlib import Path

from textloom.llm.common import saved


def test_a_saved_table_gives_freed_memory_of_the_driver_back(spark):
    jvm, pid = spark._jvm, spark.sparkContext._gateway.proc.pid
    resident = lambda: int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
    freed, kept = jvm.java.util.ArrayDeque(), jvm.java.util.ArrayDeque()
    saved(spark.range(3), "few")
    for i in range(3200):  # small blocks, some of which stay and so hold the C library's heap
        (freed if i % 20 else kept).add(jvm.java.nio.ByteBuffer.allocateDirect(64 << 10))
    freed.clear()
    jvm.java.lang.System.gc()
    time.sleep(2)
    before = resident()
    assert saved(spark.range(3), "few").count() == 3
    assert resident() < before - 100
