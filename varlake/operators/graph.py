"""The co-occurrence graph of variants, its greedy thinning, and neighbour graphs of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folder import shared_folder

EDGE = ["celltype", "sample"]


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark, "graph"))
    return df.checkpoint()


def cooccurrence(carriers: DataFrame, least_carriers: int = 20, least_shared: int = 20, jaccard: float = 0.85, overlap: float = 0.95) -> DataFrame:
    """Edges a < b per (celltype, sample) between variants that share carriers. carriers: (celltype, sample, cell, snv).
    Variants with few carriers go before the self-join, which meets only variants of one cell, and of these only such whose
    sizes allow the Jaccard index: it is at most the smaller over the larger."""
    carriers = carriers.select(*EDGE, "cell", "snv").distinct()
    sizes = carriers.groupBy(*EDGE, "snv").agg(F.count("*").alias("n")).filter(F.col("n") >= max(1, least_carriers))
    kept = carriers.join(sizes, [*EDGE, "snv"])
    a = kept.select(*EDGE, "cell", F.col("snv").alias("a"), F.col("n").alias("na"))
    b = kept.select(*EDGE, "cell", F.col("snv").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, [*EDGE, "cell"]).filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= jaccard * (1 - 1e-9) * F.greatest("na", "nb"))).groupBy(*EDGE, "a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    out = pairs.withColumns({"jaccard": F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), "overlap": F.col("shared") / F.least("na", "nb")})
    return out.filter((F.col("shared") >= least_shared) & (F.col("jaccard") >= jaccard) & (F.col("overlap") >= overlap))


def thinned(edges: DataFrame, scores: DataFrame, score: str = "score_euclidean") -> DataFrame:
    """celltype, snv, state (kept or removed) of all variants with an edge: going down by score (missing last), then by
    original order, a variant that still stands removes its neighbours. That is the maximal independent set that comes
    first by priority: in each round, whatever outranks all its undecided neighbours is kept. scores: (celltype, snv,
    score, ord)."""
    both = edges.select("celltype", F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("celltype", F.col("b"), F.col("a"))).distinct()
    value = F.coalesce(F.nanvl(score, F.lit(None).cast("double")), F.lit(float("-inf")))
    rank = scores.select("celltype", F.col("snv").alias("u"), F.struct(value.alias("s"), (-F.col("ord")).alias("o")).alias("p"))
    both = both.join(rank, ["celltype", "u"]).join(rank.select("celltype", F.col("u").alias("v"), F.col("p").alias("q")), ["celltype", "v"])
    open_edges = _checkpointed(both)
    decided = None
    while not open_edges.isEmpty():
        kept = open_edges.groupBy("celltype", "u").agg(F.max("q").alias("q"), F.first("p").alias("p")).filter("p > q").select("celltype", "u")
        removed = open_edges.join(kept, ["celltype", "u"], "left_semi").select("celltype", F.col("v").alias("u")).distinct()
        new = kept.withColumn("state", F.lit("kept")).union(removed.withColumn("state", F.lit("removed")))
        new = _checkpointed(new)
        decided = new if decided is None else decided.union(new)
        gone = new.select("celltype", "u")
        left = open_edges.join(gone, ["celltype", "u"], "left_anti")
        # a variant whose last undecided neighbour has been removed stands alone and is kept
        alone = open_edges.select("celltype", "u").distinct().join(gone, ["celltype", "u"], "left_anti")
        rest = left.join(gone.select("celltype", F.col("u").alias("v")), ["celltype", "v"], "left_anti").select(*open_edges.columns)
        free = alone.join(rest.select("celltype", "u").distinct(), ["celltype", "u"], "left_anti")
        decided = decided.union(_checkpointed(free.withColumn("state", F.lit("kept"))))
        open_edges = _checkpointed(rest)
    if decided is None:
        decided = both.select("celltype", "u").withColumn("state", F.lit("kept")).limit(0)
    return decided.select("celltype", F.col("u").alias("snv"), "state")


def audit(edges: DataFrame, states: DataFrame, scores: DataFrame, score: str = "score_euclidean") -> DataFrame:
    """For each removed variant the highest kept neighbour, and the edge that explains it best: one that touches that
    neighbour, then by Jaccard index, overlap and shared cells; the first by name and sample of equals."""
    both = edges.select(*EDGE, F.col("a").alias("removed_snv"), F.col("b").alias("partner"), "jaccard", "overlap", "shared").union(
        edges.select(*EDGE, F.col("b"), F.col("a"), "jaccard", "overlap", "shared"))
    value = F.coalesce(F.nanvl(score, F.lit(None).cast("double")), F.lit(float("-inf")))
    ranked = scores.select("celltype", "snv", F.struct(value.alias("s"), (-F.col("ord")).alias("o")).alias("p"), F.col(score).alias("sc"))
    removed = states.filter("state = 'removed'").select("celltype", F.col("snv").alias("removed_snv"))
    kept = states.filter("state = 'kept'").select("celltype", F.col("snv").alias("partner")).join(ranked.select("celltype", F.col("snv").alias("partner"), "p"), ["celltype", "partner"])
    touching = both.join(removed, ["celltype", "removed_snv"], "left_semi")
    keepers = touching.join(kept, ["celltype", "partner"]).groupBy("celltype", "removed_snv").agg(F.max_by("partner", "p").alias("kept_snv"))
    rows = touching.join(keepers, ["celltype", "removed_snv"])
    best = F.row_number().over(Window.partitionBy("celltype", "removed_snv").orderBy(F.desc(F.col("partner") == F.col("kept_snv")), F.desc("jaccard"), F.desc("overlap"), F.desc("shared"), "sample", "partner"))
    rows = rows.withColumn("best", best).filter("best = 1")
    rows = rows.join(ranked.select("celltype", F.col("snv").alias("removed_snv"), F.col("sc").alias("removed_score")), ["celltype", "removed_snv"])
    rows = rows.join(ranked.select("celltype", F.col("snv").alias("kept_snv"), F.col("sc").alias("kept_score")), ["celltype", "kept_snv"])
    return rows.select("celltype", "sample", "removed_snv", "kept_snv", F.col("partner").alias("edge_partner_snv"), "removed_score", "kept_score", F.col("jaccard").alias("jaccard_index"), F.col("overlap").alias("overlap_coefficient"), F.col("shared").alias("cooccurrence_count"))


def without(scores: DataFrame, states: DataFrame) -> DataFrame:
    """Scores without the removed variants."""
    return scores.join(states.filter("state = 'removed'").select("celltype", "snv"), ["celltype", "snv"], "left_anti")


PIVOTS = 256  # at most so many; more rows make larger parts, which are cut into units
VALUES = 1 << 22  # numbers in the vectors of a unit, at most: 65,536 rows of 64 dimensions
TILE, EXACT = 1024, 1 << 14  # rows of a product of matrices, and pairs whose exact distances are taken at once


class Nearest:
    """The k nearest so far of each row of x, within a limit, as indices of rows of y, and their distances; ties by rank. A product of
    matrices in single precision, around a centre nearby, only tells which pairs may be near enough; what counts is their exact distance."""

    def __init__(self, x, y, own, others, rank, limit, k: int):
        import numpy as np

        self.x, self.y, self.own, self.others, self.rank, self.limit, self.k = x, y, own, others, rank, limit.copy(), k
        self.d, self.at = np.full((len(x), k), np.inf), np.full((len(x), k), -1)
        self.once = len(np.unique(others)) == len(others)

    def _take(self, r, c) -> None:
        """Candidates: rows r of x, c of y."""
        import numpy as np

        keep = self.own[r] != self.others[c]
        r, c = r[keep], c[keep]
        d = np.empty(len(r))
        for at in range(0, len(r), EXACT):
            which = slice(at, at + EXACT)
            d[which] = np.sqrt(((self.x[r[which]].astype(float) - self.y[c[which]].astype(float)) ** 2).sum(1))
        keep = d <= self.limit[r]
        r, c, d = r[keep], c[keep], d[keep]
        if not len(r):
            return
        rows = np.unique(r)
        old_r, old_k = np.nonzero(self.at[rows] >= 0)
        old_r = rows[old_r]
        old_c, old_d = self.at[rows][self.at[rows] >= 0], self.d[old_r, old_k]
        r, c, d = np.concatenate([old_r, r]), np.concatenate([old_c, c]), np.concatenate([old_d, d])
        order = np.lexsort((self.rank[c], d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
        keep = place < self.k
        self.at[r[keep], place[keep]], self.d[r[keep], place[keep]] = c[keep], d[keep]
        self.limit[rows] = np.minimum(self.limit[rows], self.d[rows, -1])

    def visit(self, rows, first: int, end: int, centre) -> None:
        """Rows of x meet the rows of y from first to end."""
        import numpy as np

        slack = (self.x.shape[1] + 8) * 2.0**-22  # of the norms: more than rounding can do to a squared distance in single precision
        for lo in range(first, end, 4 * TILE):
            y = (self.y[lo:min(end, lo + 4 * TILE)] - centre).astype(np.float32)
            ny = (y**2).sum(1)
            right = np.concatenate([y, ny[:, None], np.ones((len(y), 1), np.float32)], 1).T.copy()
            for at in range(0, len(rows), TILE):
                some = rows[at:at + TILE]
                x = (self.x[some] - centre).astype(np.float32)
                nx = (x**2).sum(1)
                d = np.concatenate([-2 * x, np.ones((len(x), 1), np.float32), nx[:, None]], 1) @ right
                more = slack * (nx + ny.max())
                most = self.limit[some] ** 2 * (1 + 1e-6) + more
                free = np.isinf(most)
                if self.once and d.shape[1] > self.k + 1 and free.any():  # k others are as near as the next one
                    most[free] = np.partition(d[free], self.k, axis=1)[:, self.k] + 2 * more[free]
                near = np.flatnonzero(~(d > most.astype(np.float32)[:, None]))
                if len(near):
                    self._take(some[near // d.shape[1]], lo + near % d.shape[1])


def nearest_cells(latents: DataFrame, k: int = 15, block: int = 2000) -> DataFrame:
    """cell, neighbour, distance, place: exact k nearest by Euclidean distance, ties by name.

    Rows go to the nearest of a few pivots, which makes parts of about `block` rows, or more; very large parts are cut into units. The k-th
    distance within its own unit bounds a cell's neighbourhood; it then visits only the parts that the bound reaches, by the part's radius
    and by the plane between the pivots. Units are bundled, so that a visitor goes to a task with many of them and leaves with its k nearest
    there, and the visitors of a bundle are dealt out: a task holds one bundle and as many visitors, both bounded. Vectors without
    structure reach every part: work is then that of all pairs, as products of matrices."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = "array<float>" if dict(latents.dtypes)["z"] == "array<float>" else "array<double>"  # distances are taken in double precision from either
    rows = _checkpointed(latents.select(F.col("cell").cast("string").alias("cell"), F.col("z").cast(kind).alias("z")))
    found_type = "cell string, neighbour string, distance double"
    count = rows.count()
    if not count:
        return rows.sparkSession.createDataFrame([], found_type + ", place int")
    heads = rows.withColumn("h", F.xxhash64("cell")).orderBy("h", "cell").limit(max(1, min(PIVOTS, -(-count // block)))).collect()
    pivots = np.array([r["z"] for r in heads], float)
    unit = max(1, VALUES // max(1, pivots.shape[1]))
    bundle_rows, visitor_rows = (min(unit, max(block, count // share)) for share in (8, 16))
    matrix = lambda t: t["z"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    apart = lambda x, y: np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))

    def assign(batches):
        for b in batches:
            for at in range(0, len(b), 32):
                part = b.slice(at, 32)
                d = apart(part["z"].flatten().to_numpy().reshape(len(part), -1), pivots)
                yield pa.RecordBatch.from_arrays([part["cell"], part["z"], pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], names=["cell", "z", "part", "d"])

    dealt = _checkpointed(rows.mapInArrow(assign, f"cell string, z {kind}, part int, d double"))
    sizes = {r["part"]: (r["n"], r["far"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n"), F.max("d").alias("far")).collect()}
    units = [max(1, -(-sizes.get(p, (0, 0))[0] // unit)) for p in range(len(pivots))]
    radius = np.array([sizes[p][1] if p in sizes else -np.inf for p in range(len(pivots))])
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("cell"), F.get(F.lit(units), F.col("part"))).cast("int"))
    between = apart(pivots, pivots)
    first, bundles, held = [], 0, 0  # the bundle of each part, or of its first unit: a part of several units has a bundle for each
    for p in range(len(pivots)):
        n = sizes.get(p, (0, 0))[0]
        if held and (units[p] > 1 or held + n > bundle_rows):
            bundles, held = bundles + 1, 0
        first.append(bundles)
        held += n
        if units[p] > 1:
            bundles, held = bundles + units[p], 0

    def codes(*columns):
        """Numbers for names, and the order of the last column's."""
        names = pa.chunked_array([c for column in columns for c in column.chunks], pa.string()).dictionary_encode().unify_dictionaries()
        numbers = np.concatenate([c.indices.to_numpy() for c in names.chunks] or [np.zeros(0, int)])
        rank = np.empty(len(columns[-1]), int)
        rank[pc.sort_indices(columns[-1]).to_numpy()] = np.arange(len(rank))
        return np.split(numbers, np.cumsum([len(c) for c in columns])[:-1]), rank

    def bounds(t: pa.Table) -> pa.Table:
        (own,), rank = codes(t["cell"])
        x, part, d = matrix(t), t["part"].to_numpy(), t["d"].to_numpy()
        near = Nearest(x, x, own, own, rank, np.full(len(t), np.inf), k)
        near.visit(np.arange(len(t)), 0, len(t), pivots[part[0]])
        limit = near.d[:, -1] * (1 + 1e-9) + 1e-12
        visits = []
        for at in range(0, len(t), 32):
            some = slice(at, at + 32)
            to = apart(x[some], pivots)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.nan_to_num((to**2 - d[some, None] ** 2) / (2 * between[part[some]]), nan=0.0, posinf=0.0, neginf=0.0)
            reach = (np.maximum(to - radius, plane) <= limit[some, None] * (1 + 1e-9) + 1e-12) & np.isfinite(radius)
            visits += [np.flatnonzero(r).tolist() for r in reach]
        return pa.table({"cell": t["cell"], "z": t["z"], "bound": pa.array(limit), "visits": pa.array(visits, pa.list_(pa.int32()))})

    visitors = _checkpointed(dealt.groupBy("part", "sub").applyInArrow(bounds, f"cell string, z {kind}, bound double, visits array<int>"))
    of_part = lambda p: F.sequence(F.get(F.lit(first), p), F.get(F.lit(first), p) + F.get(F.lit(units), p) - 1)
    goes = visitors.withColumn("bundle", F.explode(F.array_distinct(F.flatten(F.transform("visits", of_part)))))
    calls = {r["bundle"]: r["n"] for r in goes.groupBy("bundle").agg(F.count("*").alias("n")).collect()}
    pieces = [max(1, -(-calls.get(b, 0) // visitor_rows)) for b in range(bundles + 1)]
    left = goes.select(F.col("cell").alias("from_cell"), F.col("z").alias("from_z"), "bound", F.filter("visits", lambda p: F.array_contains(of_part(p), F.col("bundle"))).alias("visits"), "bundle")
    left = left.withColumn("piece", F.pmod(F.xxhash64("from_cell", F.lit(1)), F.get(F.lit(pieces), F.col("bundle"))).cast("int"))
    right = dealt.select("cell", "z", "part", (F.get(F.lit(first), F.col("part")) + F.col("sub")).alias("bundle"))
    right = right.withColumn("piece", F.explode(F.sequence(F.lit(0), F.get(F.lit(pieces), F.col("bundle")) - 1)))

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"cell": pa.array([], pa.string()), "neighbour": pa.array([], pa.string()), "distance": pa.array([], pa.float64())})
        b = b.sort_by("part")
        (own, others), rank = codes(a["from_cell"], b["cell"])
        parts, visits = b["part"].to_numpy(), a["visits"].combine_chunks()
        of, to = pc.list_parent_indices(visits).to_numpy(), visits.flatten().to_numpy()
        found = Nearest(matrix(a.select(["from_z"]).rename_columns(["z"])), matrix(b), own, others, rank, a["bound"].to_numpy(), k)
        for p in np.unique(parts):
            found.visit(of[to == p], np.searchsorted(parts, p), np.searchsorted(parts, p, "right"), pivots[p])
        r, place = np.nonzero(found.at >= 0)
        return pa.table({"cell": a["from_cell"].take(pa.array(r)), "neighbour": b["cell"].take(pa.array(found.at[r, place])), "distance": pa.array(found.d[r, place])})

    pairs = left.groupBy("bundle", "piece").cogroup(right.groupBy("bundle", "piece")).applyInArrow(near, found_type)
    place = F.row_number().over(Window.partitionBy("cell").orderBy("distance", "neighbour"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k)


def propagated_labels(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """cell, cluster by label propagation over the neighbour graph: a documented stand-in for modularity clustering, whose
    labels it does not reproduce. Each round takes the most frequent label around a cell, the smallest of equals."""
    both = _checkpointed(edges.select(F.col("cell").alias("u"), F.col("neighbour").alias("v")).union(edges.select("neighbour", "cell")).distinct())
    labels = both.select("u").distinct().withColumn("label", F.col("u"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u", "label").agg(F.count("*").alias("n"))
        votes = votes.union(labels.withColumn("n", F.lit(1).cast("long"))).groupBy("u", "label").agg(F.sum("n").alias("n"))
        new = _checkpointed(votes.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("n"), "label"))).filter("place = 1").select("u", "label"))
        changed = new.join(labels.withColumnRenamed("label", "was"), "u").filter("label <> was").isEmpty()
        labels = new
        if changed:
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    codes = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1)
    return labels.join(codes, "label").select(F.col("u").alias("cell"), "cluster")


def principal_plane(latents: DataFrame) -> DataFrame:
    """cell, x, y on the first two principal components: a documented stand-in for a non-linear embedding. Only the
    covariance, whose size is the latents' dimension squared, reaches the driver."""
    import numpy as np

    z = F.col("z").cast("array<double>")
    rows = latents.select("cell", z.alias("z"))
    flat = rows.select("cell", F.posexplode("z").alias("i", "v"))
    means = [r["m"] for r in flat.groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]
    d = len(means)
    if not d:
        return rows.select("cell", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    products = rows.select(F.posexplode(F.flatten(F.transform("z", lambda a: F.transform(F.col("z"), lambda b: a * b)))).alias("i", "v"))
    sums = {r["i"]: r["s"] for r in products.groupBy("i").agg(F.avg("v").alias("s")).collect()}
    m = np.array(means)
    cov = np.array([sums[i] for i in range(d * d)]).reshape(d, d) - np.outer(m, m)
    _, vectors = np.linalg.eigh((cov + cov.T) / 2)
    axes = vectors[:, ::-1][:, :2].T
    axes = axes * np.where(axes[np.arange(2), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None] if d > 1 else np.array([[1.0], [0.0]])
    along = lambda w: F.aggregate(F.zip_with("z", F.lit([float(x) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) - float(w @ m)
    return rows.select("cell", along(axes[0]).alias("x"), along(axes[1]).alias("y"))
