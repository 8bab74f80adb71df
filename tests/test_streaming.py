"""ST1/ST2: the streaming job writes what the batch job writes; restart
from the checkpoint adds only new files."""

import os
import shutil
import tempfile

from sombra.operators.mask import mask_table
from sombra.streaming.stream import start_masking

POL = {"event_type": "IGNORAR", "props": "TEXTO_LIVRE"}


def test_stream_equals_batch(spark, key):
    d = tempfile.mkdtemp(prefix="sombra-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.limit(0).write.mode("overwrite").parquet(os.path.join(d, "schema"))
    ev.write.mode("overwrite").parquet(os.path.join(d, "batch1"))
    for f in os.listdir(os.path.join(d, "batch1")):
        if f.endswith(".parquet"):
            shutil.copy(os.path.join(d, "batch1", f), os.path.join(src, "p1-" + f))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_masking(spark, stream, POL, key, os.path.join(d, "out"), os.path.join(d, "ckpt"),
                      audit_path=os.path.join(d, "audit"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(d, "out"))
    expect = mask_table(ev, POL, None, key)
    assert out.count() == ev.count()
    assert out.drop("batch_id").subtract(expect).count() == 0
    # restart with one more file: only it is processed
    for f in os.listdir(os.path.join(d, "batch1")):
        if f.endswith(".parquet"):
            shutil.copy(os.path.join(d, "batch1", f), os.path.join(src, "p2-" + f))
    q = start_masking(spark, stream, POL, key, os.path.join(d, "out"), os.path.join(d, "ckpt"),
                      audit_path=os.path.join(d, "audit"))
    q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(d, "out")).count() == 2 * ev.count()
    assert spark.read.parquet(os.path.join(d, "audit")).count() >= 2


def test_without_audit_the_file_sink_writes(spark, key, tmp_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    start_masking(spark, stream, POL, key, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(mask_table(ev, POL, None, key)).count() == 0
