"""Splits without leaks: rows that share a key go to the same part."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sieveline.operators.graph import connected_components
from sieveline.operators.sampling import shuffle_key
from sieveline.schemas import ALL_LABELS, MIN_RARE_ROWS, SEED, SPLIT_SHARES
from sieveline.storage import settle

# Fixed value: a part may have so many times its target of rows.
OVER = 1.02


def leakage_groups(df: DataFrame, key: str, links: Sequence[str]) -> DataFrame:
    """``key, leakage_group_id``: rows that share any non-null value of a link column, also through others, are one group.

    A group is named by its smallest key. Rows with a value are linked to the value's smallest row, so a value
    that many rows have makes one edge for each of them.
    """
    each = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in links])
    values = df.select(F.col(key).alias("__k"), F.explode(each).alias("x")).select("__k", "x.*").where("v IS NOT NULL")
    least = values.groupBy("c", "v").agg(F.min("__k").alias("dst"))
    edges = values.join(least, ["c", "v"]).where("__k <> dst").select(F.col("__k").alias("src"), "dst")
    roots = connected_components(edges)
    return df.select(key).join(roots.select(F.col("node").alias(key), "root"), key, "left").select(key, F.coalesce("root", F.col(key)).alias("leakage_group_id"))


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """``column, code``: numbers from 0 for the values, in order.

    Distinct values are parted into sorted ranges, counted, and numbered within their range.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = settle(values.repartitionByRange(column).select(column, F.spark_partition_id().alias("__p")))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))  # a row for each partition
    before = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"))
    ranked = ranged.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(column)))
    return ranked.join(F.broadcast(before), "__p").select(column, (F.col("__before") + F.col("__r") - 1).cast("int").alias("code"))


def group_features(df: DataFrame, group: str, label: str, anchors: Sequence[str] = (), labels: Sequence[str] = ALL_LABELS) -> DataFrame:
    """A row for each group: n_rows, rows by label (``n_<label>``), and whether any row has an anchor flag."""
    by = [F.sum((F.coalesce(F.col(label) == x, F.lit(False))).cast("long")).alias(f"n_{x}") for x in labels]
    return df.groupBy(group).agg(F.count("*").alias("n_rows"), *by, *[F.coalesce(F.bool_or(a), F.lit(False)).alias(f"any_{a}") for a in anchors])


def _places(rows: DataFrame, by: Sequence[str], h: str) -> DataFrame:
    """Adds ``__place``, from 0, in the order of the hash column ``h`` among rows of the same ``by``: counted over slices of the hash and within them."""
    sliced = rows.withColumn("__k", F.substring(h, 1, 3))
    sizes = sliced.groupBy(*by, "__k").agg(F.count("*").alias("__n"))
    same = [f"__b{i}" for i in range(len(by))]
    before = sizes.select(*[F.col(c).alias(x) for c, x in zip(by, same)], F.col("__k").alias("__s"), (F.sum("__n").over(W.partitionBy(*by).orderBy("__k")) - F.col("__n")).alias("__before"))
    ranked = sliced.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__k").orderBy(h)))
    on = F.col("__k") == F.col("__s")
    for c, x in zip(by, same):
        on = on & F.col(c).eqNullSafe(F.col(x))
    return ranked.join(before, on).withColumn("__place", F.col("__before") + F.col("__r") - 1).drop("__k", "__s", "__r", "__before", *same)


def part_quotas(table: Sequence[Mapping], shares: Mapping[str, float], labels: Sequence[str], over: float = OVER) -> dict[tuple[int, str], list[int]]:
    """How many groups of each (size, main label) go to each part.

    ``table`` has a row for each size, main label and fixed part (null: not dealt yet) with ``groups``, ``rows`` and ``n`` (rows by label). Sizes are
    dealt from the largest down. A cell's groups go to the parts in proportion to the rows of their main label that the parts still lack;
    single ones that are left over go where most rows are lacking, among the parts that they fit into. So what large groups spoil, smaller ones mend. At last
    groups move out of parts that have more than ``over`` times their target, as long as that is possible: ``moved_within``.
    """
    total = [sum(r["n"][i] for r in table) for i in range(len(labels))]
    lack = {s: [share * t for t in total] for s, share in shares.items()}
    target = {s: share * sum(r["rows"] for r in table) for s, share in shares.items()}
    room = dict(target)

    def give(part: str, r: Mapping, share: float) -> None:
        room[part] -= share * r["rows"]
        lack[part] = [x - share * n for x, n in zip(lack[part], r["n"])]

    for r in table:
        if r["part"] is not None:
            give(r["part"], r, 1.0)
    out = {}
    for r in sorted((r for r in table if r["part"] is None), key=lambda r: (-r["size"], r["rows"], r["main"])):
        i, groups, size = labels.index(r["main"]), r["groups"], r["size"]
        # half by the main label, half by the label that runs out first
        first = {s: min(lack[s][j] * r["rows"] / n for j, n in enumerate(r["n"]) if n) if any(r["n"]) else room[s] for s in shares}
        wanted = {s: max(0.0, min(lack[s][i] * r["rows"] / max(1, r["n"][i]), room[s]) + min(first[s], room[s])) / 2 for s in shares}
        whole = sum(wanted.values()) or 1.0
        quota = {s: int(groups * w / max(whole, groups * size)) for s, w in wanted.items()}
        left = {s: wanted[s] - quota[s] * size for s in shares}
        extra = groups - sum(quota.values())
        if extra > 4 * len(shares):  # more than the parts lack: by their shares
            for s, share in shares.items():
                quota[s] += int(extra * share)
        for _ in range(groups - sum(quota.values())):
            fits = {s: room[s] - quota[s] * size - size >= (1 - over) * target[s] for s in shares}
            s = max(shares, key=lambda s: (fits[s], left[s], room[s] / max(shares[s], 1e-9)))
            quota[s] += 1
            left[s] -= size
        for s in shares:
            give(s, r, quota[s] / groups)
        out[size, r["main"]] = [quota[s] for s in shares]
    return moved_within(out, {s: over * target[s] for s in shares}, {s: target[s] - room[s] for s in shares}, target)


def moved_within(quotas: dict[tuple[int, str], list[int]], limit: Mapping[str, float], rows: Mapping[str, float], target: Mapping[str, float]) -> dict[tuple[int, str], list[int]]:
    """``quotas`` with groups moved out of parts that are over their limit, into those that have room below theirs.

    Each time the move counts that brings the most: the largest groups that aren't larger than what is over, or else the smallest ones, as many of them as are needed and
    fit, to the part that is emptiest for its target. Where no single group fits anywhere, two parts swap groups of which the one that leaves is the larger.
    """
    names, out, rows = list(limit), {k: list(q) for k, q in quotas.items()}, dict(rows)

    def move(cell: tuple[int, str], a: int, b: int, n: int) -> None:
        out[cell][a] -= n
        out[cell][b] += n
        rows[names[a]] -= n * cell[0]
        rows[names[b]] += n * cell[0]

    for a in sorted(range(len(names)), key=lambda k: rows[names[k]] - limit[names[k]], reverse=True):
        while (excess := rows[names[a]] - limit[names[a]]) > 1e-9:
            others = sorted((k for k in range(len(names)) if k != a), key=lambda k: rows[names[k]] / max(target[names[k]], 1e-9))
            free = {k: limit[names[k]] - rows[names[k]] for k in others}
            mine = sorted((c for c, q in out.items() if q[a]), key=lambda c: (c[0] > excess, -c[0] if c[0] <= excess else c[0], c[1]))
            found = next(((c, k) for c in mine for k in others if c[0] <= free[k]), None)
            if found is not None:
                c, k = found
                move(c, a, k, max(1, min(out[c][a], int(excess // c[0]), int(free[k] // c[0]))))
                continue
            swaps = [(x[0] - y[0], x, y, k) for x in mine for k in others for y, q in out.items() if q[k] and 0 < x[0] - y[0] <= free[k]]
            if not swaps:
                break
            enough = [s for s in swaps if s[0] >= excess]
            _, x, y, k = min(enough, key=lambda s: (s[0], s[1:])) if enough else max(swaps, key=lambda s: (s[0], s[1:]))
            move(x, a, k, 1)
            move(y, k, a, 1)
    return out


def assign_parts(
    features: DataFrame,
    group: str,
    rare: str,
    anchors: Sequence[str] = (),
    shares: Mapping[str, float] = SPLIT_SHARES,
    min_rare: int = MIN_RARE_ROWS,
    seed: int = SEED,
    labels: Sequence[str] = ALL_LABELS,
    over: float = OVER,
) -> DataFrame:
    """``group, split``: groups with an anchor go to test; the smallest groups with the rare label to val until it has enough; the others are dealt so that labels stay balanced
    and no part has more than ``over`` times its target of rows, where that is possible.

    Groups are dealt by size and main label: ``part_quotas`` says, from one table of sums, how many of each go to each part, and groups take the parts' places in the
    order of a hash. So no group is looked at on the driver, and parts have the very rows that were planned. The table has a row for each size that occurs, of which n rows
    allow the root of 2 n at most, and label. Ties are broken by the hash of the group.
    """
    sums = F.array(*[F.col(f"n_{x}") for x in labels])
    anchor = F.lit(False)
    for a in anchors:
        anchor = anchor | F.col(f"any_{a}")
    main = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(sums, F.array_max(sums)).cast("int"))
    feats = features.select(group, "n_rows", sums.alias("n"), F.col(f"n_{rare}").alias("rare"), anchor.alias("anchor"), main.alias("main"), F.col("n_rows").cast("long").alias("size"), shuffle_key(group, seed).alias("h"))
    feats = settle(feats)
    # each brings a row of the label, so there are min_rare of them at most
    first = feats.where("NOT anchor AND rare > 0").orderBy("n_rows", "h").limit(min_rare)
    so_far = F.coalesce(F.sum("rare").over(W.orderBy("n_rows", "h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    to_val = settle(first.select(F.col(group).alias("__val"), so_far.alias("so_far")).where(F.col("so_far") < min_rare).select("__val"))
    placed = feats.join(F.broadcast(to_val), feats[group] == to_val["__val"], "left")
    placed = placed.withColumn("part", F.when(F.col("anchor"), "test").when(F.col("__val").isNotNull(), "val")).drop("__val")
    each = [F.sum(F.col("n")[i]).alias(f"s{i}") for i in range(len(labels))]
    table = placed.groupBy("part", "size", "main").agg(F.count("*").alias("groups"), F.sum("n_rows").alias("rows"), *each).collect()  # sizes x labels x 3 rows at most
    quotas = part_quotas([{**r.asDict(), "n": [r[f"s{i}"] for i in range(len(labels))]} for r in table], shares, list(labels), over)
    names = list(shares)
    ends = [(size, m, [sum(q[: k + 1]) for k in range(len(names) - 1)]) for (size, m), q in quotas.items()]
    bounds = feats.sparkSession.createDataFrame(ends, "size long, main string, ends array<long>")
    dealt = _places(placed.where("part IS NULL").select(group, "size", "main", "h"), ["size", "main"], "h").join(bounds, ["size", "main"])
    at = F.size(F.filter("ends", lambda e: e <= F.col("__place")))
    dealt = dealt.select(group, F.element_at(F.array(*[F.lit(x) for x in names]), at + 1).alias("split"))
    return placed.where("part IS NOT NULL").select(group, F.col("part").alias("split")).unionByName(dealt)


def split_report(df: DataFrame, split: str, group: str, label: str, labels: Sequence[str] = ALL_LABELS) -> DataFrame:
    """Rows, their share, groups and rows by label of each part."""
    by = [F.sum((F.coalesce(F.col(label) == x, F.lit(False))).cast("long")).alias(f"n_{x}") for x in labels]
    rows = df.groupBy(split).agg(F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups"), *by)
    return rows.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(W.partitionBy(F.lit(1))), 4))


def folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """``group, fold``: groups dealt to k folds so that labels are spread: in turn, by size within their main label.

    A group's place among those of its label is counted over slices of the hash and within them.
    """
    main = df.groupBy(group, label).agg(F.count("*").alias("n")).groupBy(group).agg(F.max_by(label, F.struct("n", label)).alias("__main"))
    ranked = _places(main.withColumn("__h", shuffle_key(group, seed)), ["__main"], "__h")
    return ranked.select(group, F.pmod(F.col("__place"), F.lit(k)).cast("int").alias("fold"))
