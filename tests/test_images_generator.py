import os
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from heatwise.operators.eda import separation_check
from heatwise.sources import generator as G
from heatwise.sources import images as I


def write_png(path, arr):
    h, w, _ = arr.shape
    raw = b"".join(b"\x00" + arr[i].tobytes() for i in range(h))

    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xFFFFFFFF)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_statistics_and_labels(spark, tmpdir_path):
    rng = np.random.default_rng(0)
    imgs = {
        "20mm/contours/uniform.png": np.full((8, 10, 3), 120, np.uint8),
        "30mm/contours/gradient.PNG": np.tile(np.arange(0, 250, 25, dtype=np.uint8)[None, :, None],
                                              (8, 1, 3)),
        "40mm/contours/noise.png": rng.integers(0, 256, (8, 10, 3), dtype=np.uint8),
    }
    for rel, a in imgs.items():
        write_png(os.path.join(tmpdir_path, rel), a)
    os.makedirs(os.path.join(tmpdir_path, "25mm/contours"), exist_ok=True)
    with open(os.path.join(tmpdir_path, "25mm/contours/corrupt.png"), "wb") as f:
        f.write(b"not an image")
    cat = I.discover_images(spark, tmpdir_path)
    labels = {os.path.basename(r["path"]): (r["hole_size"], r["label"]) for r in cat.collect()}
    assert labels["uniform.png"] == ("20mm", 0) and labels["gradient.PNG"] == ("30mm", 1)
    assert labels["corrupt.png"] == ("25mm", 0)
    stats = I.with_hints(I.image_statistics(I.read_images(spark, [r["path"] for r in cat.collect()])))
    got = {os.path.basename(r["path"]): r for r in stats.collect()}
    assert "corrupt.png" not in got                        # dropInvalid
    for rel, a in imgs.items():
        grey = a.astype(float).mean(axis=2)
        r = got[os.path.basename(rel)]
        assert abs(r["grey_mean"] - grey.mean()) < 1e-9
        assert abs(r["grey_variance"] - grey.var()) < 1e-9
        assert abs(r["grey_range"] - (grey.max() - grey.min())) < 1e-9
    assert got["uniform.png"]["visual_hint"] == "Uniform"
    assert got["noise.png"]["visual_hint"] == "High Var"


def test_labelled_folders(spark, tmpdir_path):
    write_png(os.path.join(tmpdir_path, "train/leak/a.png"), np.zeros((2, 2, 3), np.uint8))
    write_png(os.path.join(tmpdir_path, "train/no_leak/b.jpg.png"), np.zeros((2, 2, 3), np.uint8))
    c = {r["label"]: r["n_images"] for r in
         I.image_counts(I.discover_labelled_images(spark, tmpdir_path)).collect()}
    assert c == {1: 1, 0: 1}


def test_generator_counts_separation_and_invariance(spark):
    df = G.generate_readings(spark, 5000, 0.4)
    assert df.count() == 5000
    assert df.filter(F.col("leak_status") == 1).count() == 2000
    assert sorted(r[0] for r in df.select("nodenumber").collect()) == list(range(1, 5001))
    sep = separation_check(df).first()
    assert sep["separation_quality"] == "EXCELLENT"
    lo, hi = df.agg(F.min("temperature"), F.max("temperature")).first()
    assert lo >= 295.0 and hi <= 380.0
    a = df.orderBy("nodenumber").limit(20).collect()
    b = G.generate_readings(spark.newSession(), 5000, 0.4).orderBy("nodenumber").limit(20).collect()
    assert a == b
