"""What workers and executors give back between steps."""

import ctypes
import os
import subprocess
import sys

from verbatix.llm import common

HELD = """
import ctypes, os
from verbatix.llm import common

libc = ctypes.CDLL(None)
libc.malloc.restype, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_void_p]
rss = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20
got = [libc.malloc(100_000) for _ in range(2000)]
for p in got:
    ctypes.memset(p, 1, 100_000)
for p in got[:-1]:  # the last block stays, at the top of the heap
    libc.free(p)
before = rss()
common.let_go()
print(before - rss())
"""


def test_a_worker_gives_back_what_its_allocator_holds():
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True)
    assert int(out.stdout) > 150


def test_executors_collect_their_garbage(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    count = lambda: sum(b.getCollectionCount() for b in beans())
    before = count()
    common.settle_executors(spark)
    assert count() >= before + spark.sparkContext.defaultParallelism


def test_the_driver_gives_back_what_its_allocators_hold(spark):
    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    rss = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20
    got = [libc.malloc(100_000) for _ in range(2000)]
    for p in got:
        ctypes.memset(p, 1, 100_000)
    for p in got[:-1]:  # the last block stays, at the top of the heap
        libc.free(p)
    before = rss()
    common.settle(spark)
    assert before - rss() > 150
    libc.free(got[-1])
    said = common.trim_jvm(spark)
    assert said is None or "Trim native heap" in said
