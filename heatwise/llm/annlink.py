"""Near-duplicate vectors within a label: robust-pruned flat graph, range-expanding search.

1. Equal vectors of a label collapse to their smallest id.
2. Centres are fitted by spherical k-means on a bounded sample (``SAMPLE`` vectors, chosen by
   hash); every vector goes to its ``overlap`` nearest centres, so shards overlap.
3. Each shard (label, centre, block of at most about ``BLOCK`` vectors) builds a graph:
   nearest candidates, then robust pruning (a candidate goes if a kept neighbour is nearer
   to it by the factor ``ALPHA`` than the node is).  Nodes also get links to representatives
   of other groups (rows outside twice the pool radius of earlier ones) and reverse links, so a
   tight group larger than the pool does not shut itself off.  The adjacency lists of a
   vector's shards are united.
4. Each region (label, centre, pair of blocks) is searched over the united lists: a greedy
   beam from the region's medoid, then range expansion: every vector found in range, and
   the query's own place, has its unseen neighbours examined until no more are in range.
   ``CHECKED`` rows of the region are compared with all its rows; if one link of these is
   missing, the region is compared exactly.
5. Hits are verified by cosine in double precision.  A pair is counted in the first centre
   its two vectors share, so counts add up; only counts and joined roots leave a task.
6. Recall is audited: the links of ``AUDIT`` vectors chosen by hash are counted by brute
   force over all vectors, copies counted once; recall is the smaller of the share of links
   and the mean share of a vector.  Below ``RECALL`` all regions are compared exactly; still
   below, the overlap doubles as well: with all centres shared every pair is compared.

Defined cases: null, empty, zero vectors, vectors with null or non-finite components, null
labels and null ids link with nothing (0 links, component = own id, kept); vectors of
different length never link; rows that repeat an id are one vector; an empty table gives no
rows; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from heatwise.llm.graph import components
from heatwise.llm.neardup import _groups
from heatwise.llm.scratch import Scratch

SAMPLE, PER_CENTRE, MOST_CENTRES = 20_000, 1_500, 4_096
BLOCK, POOL, DEGREE, ALPHA, BEAM, QUERIES = 2_048, 32, 16, 1.2, 12, 256
FAR, CHECKED = 8, 64
AUDIT, RECALL = 256, 0.98


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as float64."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def fit_centres(vectors: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    centres = vectors[np.linspace(0, len(vectors) - 1, count).astype(int)].copy()
    for _ in range(8):
        own = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(vectors, len(vectors) // 4096 + 1)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _assign(centres: dict[int, np.ndarray], overlap: int):
    """(id, label, vec, n, near): the nearest centres of each vector, ascending."""
    def run(batches):
        for batch in batches:
            column = batch.column(2)
            near = [None] * batch.num_rows
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                own = centres.get(size)
                if own is None:
                    rows = np.zeros((len(at), 1), dtype=np.int64)
                else:
                    score = _unit(_matrix(column.take(pa.array(at)))) @ own.T
                    k = min(overlap, len(own))
                    rows = np.sort(np.argpartition(-score, k - 1, axis=1)[:, :k], axis=1)
                for i, r in zip(at.tolist(), rows.tolist()):
                    near[i] = r
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))],
                                             ["id", "label", "vec", "n", "near"])
    return run


def prune(unit: np.ndarray, among: np.ndarray | None = None, degree: int = DEGREE) -> np.ndarray:
    """(node, degree) robust-pruned neighbours of every row out of the rows ``among`` (all
    if not given), -1 where there are fewer."""
    m = len(unit)
    among = np.arange(m) if among is None else among
    own = np.full(m, -1)
    own[among] = np.arange(len(among))
    k = min(POOL, len(among) - 1)
    out = np.full((m, degree), -1, dtype=np.int64)
    if k < 1:
        return out
    for low in range(0, m, 512):
        high = min(low + 512, m)
        score = unit[low:high] @ unit[among].T
        self_ = np.flatnonzero(own[low:high] >= 0)
        score[self_, own[low:high][self_]] = -2
        pool = np.argpartition(-score, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(score, pool, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        pool, near = among[np.take_along_axis(pool, order, axis=1)], np.take_along_axis(near, order, axis=1)
        gap = np.sqrt(np.maximum(2 - 2 * near, 0))
        alive = np.ones(pool.shape, dtype=bool)
        rows = np.arange(high - low)
        for slot in range(degree):
            has = alive.any(axis=1)
            if not has.any():
                break
            first = alive.argmax(axis=1)
            pick = pool[rows, first]
            out[low:high, slot] = np.where(has, pick, -1)
            between = np.einsum("id,ikd->ik", unit[pick], unit[pool])
            alive &= ALPHA * np.sqrt(np.maximum(2 - 2 * between, 0)) > gap
            alive[rows, first] = False
    return out


def representatives(unit: np.ndarray) -> np.ndarray:
    """Rows, in a fixed random order, that lie outside twice the pool radius of all earlier ones."""
    m = len(unit)
    k = min(POOL + 1, m)
    covered, out = np.zeros(m, dtype=bool), []
    for row in np.random.default_rng(m).permutation(m).tolist():
        if not covered[row]:
            gap = np.maximum(1 - unit @ unit[row], 0)
            covered |= gap <= 4 * np.partition(gap, k - 1)[k - 1]
            covered[row] = True
            out.append(row)
    return np.array(sorted(out), dtype=np.int64)


def neighbours(unit: np.ndarray) -> list[np.ndarray]:
    """Linked rows of every row: near ones, representatives, and at most DEGREE reverse ones."""
    m = len(unit)
    near = prune(unit)
    src, slot = np.nonzero(near >= 0)
    dst = near[src, slot]
    gap = -np.einsum("id,id->i", unit[src], unit[dst])
    order = np.lexsort((src, gap, dst))
    back = dst[order]
    first = np.searchsorted(back, back)
    order = order[np.arange(len(back)) - first < DEGREE]
    far = prune(unit, representatives(unit), FAR)
    far_src, slot = np.nonzero(far >= 0)
    key = np.unique(np.concatenate([src, far_src, dst[order]]) * m
                    + np.concatenate([dst, far[far_src, slot], src[order]]))
    return np.split(key % m, np.searchsorted(key // m, np.arange(1, m)))


def _build(batches):
    """(src, dst) lists of each shard's graph."""
    for table in _groups(batches):
        ids = table["id"].to_numpy()
        for rows in _same_size(table):
            graph = neighbours(_unit(_matrix(table["vec"].combine_chunks().take(pa.array(rows)))))
            own = ids[rows]
            lists = [own[r] for r in graph]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(lists, pa.list_(pa.int64()))], ["src", "dst"])


def _same_size(table: pa.Table) -> list[np.ndarray]:
    sizes = np.diff(table["vec"].combine_chunks().offsets.to_numpy())
    return [np.flatnonzero(sizes == s) for s in np.unique(sizes)]


def range_search(unit: np.ndarray, graph: np.ndarray, queries: np.ndarray, threshold: float
                 ) -> tuple[np.ndarray, np.ndarray]:
    """(query row, found row) pairs with approximate cosine in range, the query itself left out."""
    m = len(unit)
    narrow = unit.astype(np.float32)
    medoid = int((unit @ unit.mean(axis=0)).argmax())
    limit = np.float32(threshold - 1e-4)
    out_q, out_n = [], []
    for low in range(0, len(queries), QUERIES):
        own = queries[low:low + QUERIES]
        rows = np.arange(len(own))
        seen = np.zeros((len(own), m), dtype=bool)
        beam = np.full((len(own), BEAM), medoid)
        score = np.full((len(own), BEAM), -3, dtype=np.float32)
        score[:, 0] = narrow[own] @ narrow[medoid]
        open_ = np.zeros((len(own), BEAM), dtype=bool)
        open_[:, 0] = True
        seen[:, medoid] = True
        hits = [(rows[score[:, 0] >= limit], np.full(int((score[:, 0] >= limit).sum()), medoid))]
        while open_.any():
            best = np.where(open_, score, -4).argmax(axis=1)
            act = np.flatnonzero(open_.any(axis=1))
            open_[act, best[act]] = False
            more = graph[beam[act, best[act]]]
            new = (more >= 0) & ~seen[act[:, None], more]
            q, slot = np.nonzero(new)
            node = more[q, slot]
            got = np.full(more.shape, -3, dtype=np.float32)
            got[q, slot] = np.einsum("id,id->i", narrow[own[act[q]]], narrow[node])
            seen[act[q], node] = True
            near = got[q, slot] >= limit
            hits.append((act[q[near]], node[near]))
            all_score = np.concatenate([score[act], got], axis=1)
            all_node = np.concatenate([beam[act], more], axis=1)
            all_open = np.concatenate([open_[act], new], axis=1)
            top = np.argpartition(-all_score, BEAM - 1, axis=1)[:, :BEAM]
            score[act], beam[act] = np.take_along_axis(all_score, top, axis=1), np.take_along_axis(all_node, top, axis=1)
            open_[act] = np.take_along_axis(all_open, top, axis=1)
        # the query is an indexed point of its own range
        seen[rows, own] = True
        q = np.concatenate([rows, *(h[0] for h in hits)])
        node = np.concatenate([own, *(h[1] for h in hits)])
        found_q, found_n = [q], [node]
        while len(q):
            next_q, next_n = [], []
            for at in range(0, len(q), 8_192):
                more = graph[node[at:at + 8_192]]
                qq = np.repeat(q[at:at + 8_192], more.shape[1])
                nn = more.reshape(-1)
                ok = nn >= 0
                qq, nn = qq[ok], nn[ok]
                ok = ~seen[qq, nn]
                key = np.unique(qq[ok] * m + nn[ok])
                qq, nn = key // m, key % m
                seen[qq, nn] = True
                near = np.einsum("id,id->i", narrow[own[qq]], narrow[nn]) >= limit
                next_q.append(qq[near])
                next_n.append(nn[near])
            q, node = np.concatenate(next_q), np.concatenate(next_n)
            found_q.append(q)
            found_n.append(node)
        out_q.append(own[np.concatenate(found_q)])
        out_n.append(np.concatenate(found_n))
    q, n = np.concatenate(out_q), np.concatenate(out_n)
    return q[q != n], n[q != n]


def all_pairs(unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Every row pair (a < b) with approximate cosine in range."""
    narrow = unit.astype(np.float32)
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low in range(0, len(unit), 512):
        a, b = np.nonzero(narrow[low:low + 512] @ narrow[low:].T >= np.float32(threshold - 1e-4))
        out_a.append(a[a < b] + low)
        out_b.append(b[a < b] + low)
    return np.concatenate(out_a), np.concatenate(out_b)


def _complete(unit: np.ndarray, key: np.ndarray, threshold: float) -> bool:
    """Whether the pairs (a * m + b, ascending) hold every link of CHECKED rows."""
    m = len(unit)
    rows = np.random.default_rng(m).choice(m, min(m, CHECKED), replace=False)
    a, b = np.nonzero(unit[rows] @ unit.T >= threshold)
    a = rows[a]
    a, b = a[a != b], b[a != b]
    return bool(np.isin(np.minimum(a, b) * m + np.maximum(a, b), key).all())


def _roots(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(m)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def _search(threshold: float, exact: bool):
    """(id, links, mates, root): links counted in this region with and without copies,
    smallest id joined here."""
    def run(batches):
        for table in _groups(batches):
            for rows in _same_size(table):
                part = table.take(pa.array(rows[np.argsort(table["id"].to_numpy()[rows])]))
                yield from region(part)

    def region(part):
        ids, n = part["id"].to_numpy(), part["n"].to_numpy()
        m = len(ids)
        if m < 2:
            return
        unit = _unit(_matrix(part["vec"].combine_chunks()))
        a, b = all_pairs(unit, threshold) if exact else linked(part, ids, unit)
        near = part["near"].combine_chunks().flatten().to_numpy().reshape(m, -1)
        centre, low, high = (part[c][0].as_py() for c in ("centre", "part", "part2"))
        block = part["own"].to_numpy()
        keep = np.ones(len(a), dtype=bool)
        for at in range(0, len(a), 65_536):
            x, y = near[a[at:at + 65_536]], near[b[at:at + 65_536]]
            shared = (x[:, :, None] == y[:, None, :]).any(axis=2)
            first = np.where(shared, x, np.iinfo(np.int32).max).min(axis=1)
            keep[at:at + 65_536] = first == centre
        if low != high:
            keep &= block[a] != block[b]
        a, b = a[keep], b[keep]
        cosine = np.concatenate([np.zeros(0), *(np.einsum("id,id->i", unit[a[i:i + 65_536]], unit[b[i:i + 65_536]])
                                                for i in range(0, len(a), 65_536))])
        a, b = a[cosine >= threshold], b[cosine >= threshold]
        mates = np.bincount(a, minlength=m) + np.bincount(b, minlength=m)
        links = np.bincount(a, weights=n[b], minlength=m) + np.bincount(b, weights=n[a], minlength=m)
        root = _roots(m, a, b)
        has = np.flatnonzero(links)
        if len(has):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[has]), pa.array(links[has].astype(np.int64)), pa.array(mates[has].astype(np.int64)),
                 pa.array(ids[root[has]])], ["id", "links", "mates", "root"])

    def linked(part, ids, unit):
        m = len(ids)
        dst = part["dst"].combine_chunks()
        flat, ends = dst.flatten().to_numpy(), np.diff(dst.offsets.to_numpy())
        src = np.repeat(np.arange(m), ends)
        place = np.minimum(np.searchsorted(ids, flat), m - 1)
        here = ids[place] == flat
        src, place = src[here], place[here]
        degree = np.bincount(src, minlength=m)
        graph = np.full((m, max(int(degree.max()), 1)), -1, dtype=np.int64)
        graph[src, np.arange(len(src)) - np.repeat(np.cumsum(degree) - degree, degree)] = place
        a, b = range_search(unit, graph, np.arange(m), threshold)
        key = np.unique(np.minimum(a, b) * m + np.maximum(a, b))
        return (key // m, key % m) if _complete(unit, key, threshold) else all_pairs(unit, threshold)
    return run


def _true_links(chosen: list[tuple[int, int, np.ndarray]], threshold: float):
    """Brute-force links of the chosen vectors against the rows, copies once: (id, links)."""
    def run(batches):
        for batch in batches:
            total = np.zeros(len(chosen), dtype=np.int64)
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            column = batch.column(2)
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                mine = [i for i, c in enumerate(chosen) if len(c[2]) == size]
                if not mine:
                    continue
                score = _unit(_matrix(column.take(pa.array(at)))) @ np.stack([chosen[i][2] for i in mine]).T
                for k, i in enumerate(mine):
                    hit = (score[:, k] >= threshold) & (labels[at] == chosen[i][1]) & (ids[at] != chosen[i][0])
                    total[i] += hit.sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array([c[0] for c in chosen], pa.int64()), pa.array(total)], ["id", "links"])
    return run


def _regions(members: DataFrame) -> DataFrame:
    """Members dealt to the block pairs of their (label, centre)."""
    size = members.groupBy("label", "centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    return (members.join(size, ["label", "centre"])
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .withColumn("part", F.least("own", "other")).withColumn("part2", F.greatest("own", "other"))
            .withColumn("g", F.xxhash64("label", "centre", "part", "part2")).drop("nb", "other"))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.93, overlap: int = 2, report: dict | None = None) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept); ``report`` receives the recall."""
    scratch = Scratch(vectors.sparkSession, "annlink")
    # labels of any type are told apart by a 64-bit hash of their text
    label = F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col).cast("string")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"),
                          F.col(vec_col).cast("array<double>").alias("vec"))
    usable = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
              & F.forall("vec", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
              & F.exists("vec", lambda x: F.coalesce(x != 0, F.lit(False))))
    good = rows.where(usable)
    reps = scratch.keep(good.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"))
                        .select("id", "label", "vec", "n"), "classes", "snappy")
    total = reps.count()
    step = max(-(-total // SAMPLE), 1)
    sample = reps.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("id", "vec").collect()
    centres, by_size = {}, {}
    for r in sorted(sample):
        by_size.setdefault(len(r.vec), []).append(r.vec)
    for size, found in by_size.items():
        count = min(max(total // PER_CENTRE, 1), MOST_CENTRES, len(found))
        centres[size] = fit_centres(_unit(np.array(found, dtype=np.float64)), count)
    audit_step = max(total // AUDIT, 1)
    chosen = [(r.id, r.label, _unit(np.array([r.vec], dtype=np.float64))[0]) for r in
              reps.where(F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(audit_step)) == 0).collect()]
    truth = reps.mapInArrow(_true_links(chosen, threshold), "id long, links long").groupBy("id").agg(F.sum("links"))
    truth = {r[0]: r[1] for r in truth.collect()}

    exact = False
    while True:
        near = scratch.keep(reps.mapInArrow(_assign(centres, overlap), "id long, label long, vec array<double>, n long, near array<int>"), "near", "snappy")
        if exact:
            listed = near.withColumn("dst", F.array().cast("array<long>"))
        else:
            dealt = _regions(near.withColumn("centre", F.explode("near")))
            shards = dealt.where("part = part2").select("g", "id", "vec").repartition("g").sortWithinPartitions("g", "id")
            edges = shards.mapInArrow(_build, "src long, dst array<long>")
            united = scratch.keep(edges.groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list("dst"))).alias("dst")), "graph")
            listed = near.join(united, near["id"] == united["src"]).drop("src")
        regions = (_regions(listed.withColumn("centre", F.explode("near")))
                   .select("g", "id", "vec", "n", "near", "dst", "centre", "own", "part", "part2")
                   .repartition("g").sortWithinPartitions("g", "id"))
        found = scratch.keep(regions.mapInArrow(_search(threshold, exact), "id long, links long, mates long, root long"), "links")
        mine = found.where(F.col("id").isin([c[0] for c in chosen])).groupBy("id").agg(F.sum("mates")).collect()
        got = {r[0]: r[1] for r in mine}
        shares = {i: min(got.get(i, 0), n) / n for i, n in truth.items() if n}
        pooled = sum(shares[i] * truth[i] for i in shares) / max(sum(truth.values()), 1)
        recall = min(pooled, sum(shares.values()) / max(len(shares), 1))
        done = not shares or recall >= RECALL or exact and overlap >= max(map(len, centres.values()), default=0)
        if report is not None:
            report.update(recall=recall if shares else None, overlap=overlap, audited=len(chosen), exact=exact)
        if done:
            break
        if exact:
            overlap *= 2
        exact = True

    joined = components(scratch, found, "id", "root").select(F.col("node").alias("rep"), "component")
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    classes = (reps.select(F.col("id").alias("rep"), "label", "vec", "n").join(counts, "rep", "left").join(joined, "rep", "left")
               .select("label", "vec", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    linked = good.join(classes, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))
