import gc
import os
import time

from riskloom.plans import staging


def test_staged_data_goes_when_unused(spark):
    folder = staging.shared_dir(spark).removeprefix("file:")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}
    before = files()
    staged, rows = staging.stage_counted(spark.range(1000))
    own = files() - before
    assert rows == staged.count() == 1000 and own
    del staged
    for _ in range(60):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
        if not own & files():
            break
    assert not own & files()


def test_broadcast_depends_on_bytes(spark):
    narrow, wide = spark.range(1), spark.range(1).selectExpr(*[f"'x' as c{k}" for k in range(500)])
    assert staging.fits_broadcast(narrow, 100_000) and not staging.fits_broadcast(wide, 100_000)
