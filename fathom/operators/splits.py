"""Exact-size, reproducible splits and folds (T1-T3) without a global sort.

All three use one total order of rows: ``(_h, _k)`` with
``_k = key text`` and ``_h = md5(_k || '|' || seed)``. The test set is the
first ``ceil(test_size * n)`` rows of that order, the train rows follow,
and (stratified) folds are contiguous blocks of the train rows — the shape
of scikit-learn's shuffled split followed by unshuffled k-fold; only the
permutation differs (md5 instead of a Mersenne Twister), sizes are exact.

Where does rank ``c`` fall? Rows are counted per hex prefix of ``_h``
(4096 buckets per level, map-side combined); the bucket holding rank ``c``
is refined by its next digits until it holds at most ``EXACT_LIMIT`` rows,
which are then ranked directly. That gives the order key ``T_c`` of the row
at rank ``c``; afterwards "rank >= c" is just ``(_h, _k) >= T_c``: a map
filter with broadcast literals. A group of rows sharing one key (copies)
that straddles a cut is split by a stable index over its checkpointed rows,
so no task ever ranks more than ``EXACT_LIMIT`` rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from fathom.bundle import quote
from fathom.functions.hashing import key_text, order_hash
from fathom.session import ensure_checkpoint_dir, written

HEX_STEP = 3            # hex digits per refinement level: 4096 buckets
EXACT_LIMIT = 100_000   # a bucket this small is ranked directly
TOP = "~"               # sorts after every hex digest: "no row reaches this cut"
ALL = "__all__"
LITERAL_GROUPS = 1000   # up to this many groups the thresholds are inlined as literals


@dataclass
class _Cut:
    group: object
    rank: int           # 0-based rank within the group
    prefix: str = ""
    offset: int = 0     # rank within the rows of the group having ``prefix``
    h: str | None = None
    k: str | None = None
    tie_below: int = 0  # rows with key == (h, k) that still rank below the cut


def with_order(df: DataFrame, key_cols: list[str], seed: int = 42) -> DataFrame:
    """Add the order columns ``_k`` (key text) and ``_h`` (seeded md5)."""
    k = key_text(key_cols)
    return df.withColumn("_k", k).withColumn("_h", order_hash(F.col("_k"), seed))


def _gcol(group: str | None):
    return F.col(group).cast("string") if group else F.lit(ALL)


def first_histogram(df: DataFrame, group: str | None) -> dict[tuple, list]:
    """Level-0 counts per (group, leading hex digits of ``_h``): one map-side-combined pass.

    4096 buckets without a group; 256 per group with one (bounded by classes x 256).
    """
    digits = HEX_STEP if group is None else 2
    counted = (df.select(_gcol(group).alias("_g"), F.substring("_h", 1, digits).alias("_n"))
                 .groupBy("_g", "_n").agg(F.count(F.lit(1)).alias("n")))
    hist: dict[tuple, list] = {}
    for r in counted.collect():
        hist.setdefault((r["_g"], ""), []).append((r["_n"], int(r["n"])))
    return hist


def find_cuts(df: DataFrame, group: str | None, wanted: list[tuple[object, int]],
              first_hist: dict | None = None) -> list[_Cut]:
    """Order keys of the rows at the given (group, rank) positions of ``df``'s order."""
    spark = df.sparkSession
    cuts = [_Cut(g, r, "", r) for g, r in wanted]
    base = df.select(_gcol(group).alias("_g"), "_h", "_k")
    level = 0
    while True:
        pending = [c for c in cuts if c.h is None]
        if not pending:
            break
        plen = len(pending[0].prefix)
        if plen == 0 and first_hist is not None:
            hist = first_hist
        else:
            probe = spark.createDataFrame(sorted({(str(c.group), c.prefix) for c in pending}),
                                          "_g string, _p string")
            counted = (base.withColumn("_p", F.substring("_h", 1, plen) if plen else F.lit(""))
                       .join(F.broadcast(probe), ["_g", "_p"])          # a few (group, prefix) rows
                       .groupBy("_g", "_p", F.substring("_h", plen + 1, HEX_STEP).alias("_n"))
                       .agg(F.count(F.lit(1)).alias("n")))
            hist = {}
            for r in counted.collect():   # <= pending x 4096 rows
                hist.setdefault((r["_g"], r["_p"]), []).append((r["_n"], int(r["n"])))
        small = []
        for c in pending:
            below = 0
            for nxt, n in sorted(hist.get((str(c.group), c.prefix), [])):
                if c.offset < below + n:
                    c.prefix, c.offset = c.prefix + nxt, c.offset - below
                    if n <= EXACT_LIMIT or len(c.prefix) >= 32:
                        small.append((c, n))
                    break
                below += n
            else:
                raise RuntimeError(f"rank {c.rank} beyond group {c.group!r}")
        if small:
            _resolve(base, [c for c, _ in small])
        level += 1
    return cuts


def _resolve(base: DataFrame, cuts: list[_Cut]) -> None:
    """Rank the rows of the small final buckets and read the rows at the cut offsets."""
    spark = base.sparkSession
    plen = len(cuts[0].prefix)
    probe = spark.createDataFrame(sorted({(str(c.group), c.prefix) for c in cuts}), "_g string, _p string")
    rows = base.withColumn("_p", F.substring("_h", 1, plen)).join(F.broadcast(probe), ["_g", "_p"])  # one row per cut
    keys = (rows.groupBy("_g", "_p", "_h", "_k").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("_g", "_p").orderBy("_h", "_k")   # each bucket <= EXACT_LIMIT rows,
    ranked = keys.withColumn("_end", F.sum("n").over(w))     # or one key repeated (one row here)
    wanted = spark.createDataFrame([(str(c.group), c.prefix, c.offset) for c in cuts],
                                   "_g string, _p string, _o bigint")
    hits = (ranked.join(F.broadcast(wanted), ["_g", "_p"])          # one row per cut
                  .where((F.col("_o") < F.col("_end")) & (F.col("_o") >= F.col("_end") - F.col("n")))
                  .select("_g", "_p", "_o", "_h", "_k", (F.col("_o") - (F.col("_end") - F.col("n"))).alias("_t"))
                  .collect())
    found = {(r["_g"], r["_p"], r["_o"]): r for r in hits}
    for c in cuts:
        r = found[(str(c.group), c.prefix, c.offset)]
        c.h, c.k, c.tie_below = r["_h"], r["_k"], int(r["_t"])


def assign_segments(df: DataFrame, group: str | None, cuts_by_group) -> DataFrame:
    """Add ``_seg`` = number of cuts at or below the row's rank in its group.

    ``cuts_by_group`` maps a group's text to an ascending list of 0-based
    ranks (a rank equal to the group size means "past the end"), or is a
    function of the group sizes returning that map: the sizes come from the
    first bucket histogram, so no separate counting pass is needed.
    ``df`` must carry ``_h``/``_k``.
    """
    spark = df.sparkSession
    hist0 = first_histogram(df, group)
    sizes = {g: sum(n for _, n in b) for (g, _), b in hist0.items()}
    if callable(cuts_by_group):
        cuts_by_group = cuts_by_group(sizes)
    wanted = [(g, r) for g, rs in cuts_by_group.items() for r in rs if 0 < r < sizes.get(str(g), 0)]
    found = {(str(c.group), c.rank): c for c in find_cuts(df, group, wanted, hist0)} if wanted else {}
    rows, ties = [], []
    for g, rs in cuts_by_group.items():
        ts = []
        for r in rs:
            if r <= 0:
                ts.append(("", ""))            # every row is at or past rank 0
            elif r >= sizes.get(str(g), 0):
                ts.append((TOP, ""))           # no row reaches it
            else:
                c = found[(str(g), r)]
                ts.append((c.h, c.k))
                if c.tie_below:
                    ties.append(c)
        rows.append((str(g), ts))
    me = F.struct(F.col("_h").alias("h"), F.col("_k").alias("k"))
    joined = df.withColumn("_g", _gcol(group))
    if len(rows) <= LITERAL_GROUPS:
        # a handful of groups: the thresholds are literals in the expression, no join
        arr = lambda ts: F.array(*[F.struct(F.lit(h).alias("h"), F.lit(k).alias("k")) for h, k in ts]) if ts \
            else F.array().cast("array<struct<h:string,k:string>>")
        if group is None:
            t_col = arr(rows[0][1])
        else:
            t_col = F.create_map(*[x for g, ts in rows for x in (F.lit(g), arr(ts))])[F.col("_g")]
        out = joined.withColumn("_t", t_col)
    else:
        # many classes: one threshold row per class, broadcast equi-join on the class
        thresholds = spark.createDataFrame(rows, "_g string, _t array<struct<h:string,k:string>>")
        tj = F.broadcast(thresholds) if len(rows) <= 100_000 else thresholds
        out = joined.join(tj, "_g", "left")
    seg = F.size(F.filter("_t", lambda t: t <= me))
    out = out.withColumn("_seg", F.coalesce(seg, F.lit(0))).drop("_t")
    for c in ties:
        out = _split_tie(out, c)
    return out.drop("_g")


def _split_tie(out: DataFrame, c: _Cut) -> DataFrame:
    """Rows equal to the cut key: the first ``tie_below`` (stable index) stay below."""
    ensure_checkpoint_dir(out.sparkSession)
    is_tie = (F.col("_g") == F.lit(str(c.group))) & (F.col("_h") == c.h) & (F.col("_k") == c.k)
    tie = out.where(is_tie).checkpoint(eager=True)      # stable rows and partitions from here on
    tie = tie.withColumn("_id", F.monotonically_increasing_id())
    tie = tie.withColumn("_pid", F.shiftright("_id", 33))
    per = tie.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"))
    wo = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)   # one row per partition
    offs = per.select("_pid", F.coalesce(F.sum("n").over(wo), F.lit(0)).alias("_off"))
    idx = F.col("_off") + (F.col("_id") - F.shiftleft("_pid", 33))
    tie = (tie.join(F.broadcast(offs), "_pid")                      # one row per partition
              .withColumn("_seg", F.when(idx < c.tie_below, F.col("_seg") - 1).otherwise(F.col("_seg")))
              .drop("_id", "_pid", "_off"))
    return out.where(~is_tie).unionByName(tie)


# ------------------------------------------------------------------ T1-T3
def split_sizes(n: int, test_size: float = 0.2) -> tuple[int, int]:
    n_test = int(math.ceil(test_size * n))
    return n_test, n - n_test


def fold_sizes(n: int, k: int) -> list[int]:
    return [n // k + (1 if i < n % k else 0) for i in range(k)]


def train_test_split(df: DataFrame, key_cols: list[str], test_size: float = 0.2, seed: int = 42,
                     ordered: bool = False) -> DataFrame:
    """Add ``split`` ('test' for the first ceil(test_size*n) rows of the order).

    Keeps ``_h``/``_k`` when ``ordered`` so folds can reuse the same order.
    """
    o = with_order(df, key_cols, seed)
    seg = assign_segments(o, None, lambda sizes: {ALL: [split_sizes(sizes.get(ALL, 0), test_size)[0]]})
    out = seg.withColumn("split", F.when(F.col("_seg") == 0, "test").otherwise("train")).drop("_seg")
    return out if ordered else out.drop("_h", "_k")


def kfold_assign(train: DataFrame, key_cols: list[str] | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` = contiguous block of the ordered train rows; first n mod k folds get one more."""
    o = train if "_h" in train.columns else with_order(train, key_cols, seed)

    def cuts(sizes):
        fs = fold_sizes(sizes.get(ALL, 0), k)
        return {ALL: [sum(fs[:i + 1]) for i in range(k - 1)]}
    out = assign_segments(o, None, cuts).withColumnRenamed("_seg", "fold")
    return out.withColumn("fold", F.col("fold").cast("int"))


def stratified_allocation(class_counts: list[tuple[object, int]], k: int) -> dict:
    """Per class, the fold sizes of stratified k-fold (classes in the given order).

    Class j occupies positions [s, s+c) of the class-sorted labels; fold i
    gets the positions congruent to i mod k: floor((s+c-1-i)/k) - floor((s-1-i)/k).
    """
    out, s = {}, 0
    for cls, c in class_counts:
        out[cls] = [(s + c - 1 - i) // k - (s - 1 - i) // k for i in range(k)]
        s += c
    return out


def stratified_kfold_assign(train: DataFrame, label: str, key_cols: list[str] | None = None,
                            k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified folds — within each class, contiguous blocks of its ordered rows.

    Classes are taken in ascending class order (scikit-learn takes them in
    order of first appearance).
    """
    o = train if "_h" in train.columns else with_order(train, key_cols, seed)
    sizes = written(o.groupBy(_gcol(label).alias("_g"), F.col(quote(label)).alias("_c")).agg(F.count(F.lit(1)).alias("_n")), "class_sizes")
    if sizes.count() > LITERAL_GROUPS:
        return _many_classes(o, label, sizes, k)
    numeric = o.schema[label].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double",
                                                        "decimal")

    def cuts(sizes):
        # group keys are the class as text; classes are ordered by their value
        counts = sorted(((g, n) for g, n in sizes.items() if g is not None),
                        key=lambda x: float(x[0]) if numeric else x[0])
        alloc = stratified_allocation(counts, k)
        return {g: [sum(a[:i + 1]) for i in range(k - 1)] for g, a in alloc.items()}
    out = assign_segments(o, label, cuts).withColumnRenamed("_seg", "fold")
    return out.withColumn("fold", F.col("fold").cast("int"))


def _class_cuts(sizes: DataFrame, k: int) -> DataFrame:
    """``_g, _n, _cuts``: for each class the ranks at which its folds begin, the first left out; no class reaches the driver.

    Positions run over all classes in ascending order: sums inside value ranges, and one offset for each range."""
    parts = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = sizes.where("_c is not null").repartitionByRange(parts, "_c").sortWithinPartitions("_c").withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_part", F.shiftright("_id", 33)), "class_ranges")
    offsets, total = [], 0
    for r in sorted(ranged.groupBy("_part").agg(F.sum("_n").alias("n")).collect(), key=lambda r: r["_part"]):        # one row for each range
        offsets.append((r["_part"], total))
        total += r["n"]
    offsets = sizes.sparkSession.createDataFrame(offsets, "_part bigint, _off bigint")
    before = F.col("_off") + F.sum("_n").over(Window.partitionBy("_part").orderBy("_id")) - F.col("_n")
    at = ranged.join(F.broadcast(offsets), "_part").withColumn("_s", before)
    sizes_of = [F.floor((F.col("_s") + F.col("_n") - 1 - i) / k) - F.floor((F.col("_s") - 1 - i) / k) for i in range(k - 1)]
    return at.select("_g", "_n", F.array(*[sum(sizes_of[1:i + 1], sizes_of[0]) for i in range(k - 1)]).alias("_cuts"))


def _many_classes(o: DataFrame, label: str, sizes: DataFrame, k: int) -> DataFrame:
    """T3 for more classes than thresholds are literals for: the cuts stay a table that is joined to the rows.

    Rows of a class of at most ``EXACT_LIMIT`` rows are ranked in its own group; the few larger classes have their cuts
    found by prefixes."""
    cuts = written(_class_cuts(sizes, k), "class_cuts")
    rows = o.withColumn("_g", _gcol(label))
    ranked = rows.join(cuts.where(F.col("_n") <= EXACT_LIMIT), "_g") \
        .withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_h", "_k")) - 1)
    out = ranked.withColumn("fold", F.size(F.filter("_cuts", lambda c: c <= F.col("_r")))).select(*[quote(c) for c in o.columns], "fold")
    large = cuts.where(F.col("_n") > EXACT_LIMIT)
    found = {r["_g"]: list(r["_cuts"]) for r in large.collect()}               # at most one for each EXACT_LIMIT rows
    if found:
        own = rows.join(F.broadcast(large.select("_g")), "_g", "left_semi").select(*[quote(c) for c in o.columns])
        out = out.unionByName(assign_segments(own, label, found).withColumnRenamed("_seg", "fold"))
    out = out.unionByName(o.where(F.col(quote(label)).isNull()).withColumn("fold", F.lit(0)))
    return out.withColumn("fold", F.col("fold").cast("int"))


def split_and_folds(df: DataFrame, key_cols: list[str], label: str | None = None, k: int = 5,
                    test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """T1 then T2 (or T3 with ``label``) on one shared order: ``split`` and ``fold`` (null on test).

    Unstratified folds are cut positions of the same order as the test cut,
    so all k cuts are found in one shared refinement.
    """
    if label is None:
        o = with_order(df, key_cols, seed)

        def cuts(sizes):
            n_test, n_train = split_sizes(sizes.get(ALL, 0), test_size)
            fs = fold_sizes(n_train, k)
            return {ALL: [n_test] + [n_test + sum(fs[:i + 1]) for i in range(k - 1)]}
        seg = assign_segments(o, None, cuts)
        return (seg.withColumn("split", F.when(F.col("_seg") == 0, "test").otherwise("train"))
                   .withColumn("fold", F.when(F.col("_seg") > 0, F.col("_seg") - 1).cast("int"))
                   .drop("_seg", "_h", "_k"))
    s = train_test_split(df, key_cols, test_size, seed, ordered=True)
    train = s.where(F.col("split") == "train")
    folded = stratified_kfold_assign(train, label, k=k)
    test = s.where(F.col("split") == "test").withColumn("fold", F.lit(None).cast("int"))
    return folded.unionByName(test).drop("_h", "_k")
