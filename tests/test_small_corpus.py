"""A corpus of small reading files written here, against a plain restatement of the rules."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatwise.operators.labels import label_files
from heatwise.sources import files as FS

SIZES = ("20mm", "25mm", "30mm", "40mm")


def write(base, seed=3):
    """{(size, name): temperatures kept}, None for a file that is rejected."""
    rng, kept = np.random.default_rng(seed), {}
    for size in SIZES:
        os.makedirs(os.path.join(base, size, "contours"))
        with open(os.path.join(base, size, ".hidden20"), "w") as f:
            f.write("1,0,0,300\n")
        with open(os.path.join(base, size, "contours", "frame1.PNG"), "wb") as f:
            f.write(b"x")
        for i in range(9):
            name, n = f"{size}, 1000mm-{i:04d}", int(rng.integers(1, 60))
            t = np.round(rng.normal(rng.choice([260, 300, 312, 345, 470]), rng.choice([0.0, 2.0, 30.0]), n), 3)
            extra = i == 7
            lines = [("%d,%f,%f,%r" % (k, k * 0.1, -k, float(v)) + (",9" if extra else "")) for k, v in enumerate(t)]
            if i % 3 == 0:
                lines = ["nodenumber, x-coordinate, y-coordinate, temperature", *lines, "5,1,1,n/a", "6,1,1,1e9"]
            elif i % 3 == 1 and not extra:
                lines = ["  " + line.replace(",", "   ") for line in lines] + ["", "   "]
            elif not extra:
                lines = [line.replace(",", "\t") for line in lines]
            if i == 8:
                lines = ["only text"]
            with open(os.path.join(base, size, name), "w") as f:
                f.write("\n".join(lines) + "\n")
            kept[size, name] = None if i in (7, 8) else t[(t > 250) & (t < 1000)]
    return kept


def verdicts(kept, policy):
    """{(size, name): (leak, criteria, confidence)} of the files with valid readings."""
    out = {}
    for size in SIZES:
        f = {"20mm": (0.8, 0.95), "25mm": (1.0, 1.0), "30mm": (1.2, 1.05), "40mm": (1.5, 1.1)}[size][policy == "three"]
        for index, (name, t) in enumerate(sorted((n, t) for (s, n), t in kept.items() if s == size)):
            if t is None or not len(t):
                continue
            thr = (308 if policy == "three" else 305) * f
            hot, mean = np.mean(t > thr), t.mean()
            if policy == "three":
                count = sum([hot > 0.25, mean > thr - 2, t.max() > thr + 8])
                out[size, name] = (int(count >= 2), count, count / 3)
                continue
            sd = t.std()
            far = np.mean(np.abs(t - mean) / sd > 2) if sd > 0 else 0.0
            met = [far > 0.1 * f, hot > 0.15 * f, mean > thr - 3, len(t) > 1 and t.std(ddof=1) > 8 * f]
            if policy == "six":
                met.append(t.max() > thr + 5 * f)
                if hot > 0:
                    met.append(hot > 0.1)
            count, total = sum(met), len(met)
            leak, conf = count >= total // 2, count / total
            if policy == "six":
                if size in ("30mm", "40mm") and count >= 2:
                    leak, conf = True, min(1.0, conf + 0.2)
                if index % 4 == 0 and count >= 1:
                    leak, conf = True, min(1.0, conf + 0.1)
            out[size, name] = (int(leak), count, conf)
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("corpus"))
    return base, write(base)


def test_discovery_lists_data_and_images(spark, corpus):
    base, kept = corpus
    found = FS.discover_files(spark, base)
    assert {(r.hole_size, r.file_count, r.image_count) for r in FS.discovery_counts(found).collect()} == {(s, 9, 1) for s in SIZES}


@pytest.mark.parametrize("policy", ["four", "six", "three"])
def test_labels_match_the_plain_rules(spark, corpus, policy):
    base, kept = corpus
    found = FS.discover_files(spark, base).where("kind = 'data'")
    rows = FS.with_hole_size(FS.read_readings(spark, [r.path for r in found.collect()], extensions=None), "path")
    assert rows.count() == sum(len(t) for t in kept.values() if t is not None)
    files = found.select(F.col("path").alias("file_path"), "hole_size")
    want = verdicts(kept, policy)
    got = {(r.hole_size, r.file_path.rsplit("/", 1)[1]): r for r in label_files(rows, policy, files=files, key="file_path").collect()}
    assert set(got) == set(want) and 0 < sum(v[0] for v in want.values()) < len(want)
    for key, (leak, count, conf) in want.items():
        r = got[key]
        assert (r.leak_status, r.criteria_count) == (leak, count) and r.confidence == pytest.approx(conf, abs=1e-12), key
        assert [r.temp_stats.q75, r.temp_stats.q90, r.temp_stats.q95] == pytest.approx(np.quantile(kept[key], [0.75, 0.9, 0.95]).tolist())
