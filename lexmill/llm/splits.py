"""Problem 6: splits that keep the records of one author together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import folded_name, squeezed
from lexmill.llm._graph import components
from lexmill.session import stored

#: Between the names of joint work.
BETWEEN = "(?i)\\s+(?:und|and|u\\.)\\s+|\\s*[&+/;]\\s*"
SEAT = "^(?:seat|platz)[^0-9]*0*([0-9]+)$"
#: Groups holding at least this part of all records are placed one by one; there are at most 1 / LARGE of them.
LARGE = 0.002
#: Slices of the hash range over which the order of small groups is summed.
SLICES = 512


#: A value that holds at least this part of the rows is joined by broadcast; there are at most 1 / HOT of them.
HOT = 0.001


def hot_join(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """rows joined to known(key, ...), unique by key, though one key hold a third of all rows.

    Keys are counted with map-side combining; those that hold HOT of the rows or more, at most 1 / HOT by arithmetic, are
    broadcast, and only the others are shuffled, so that no task is given a hot key.
    """
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = known.join(F.broadcast(stored(sizes.where(F.col("_n") >= max(2.0, HOT * total)).select(key))), key)
    hot = F.broadcast(stored(hot))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(known.hint("merge"), key))


def author_groups(records: DataFrame, students: DataFrame, accounts: DataFrame) -> DataFrame:
    """records(id, session, student) to (id, group_key), one row per record whose author is known.

    Students, their spellings and their joint works form a bipartite graph; its components come from iterative
    minimum-label propagation over the distinct author entries, not over the records, so that an author with a third of
    all records weighs no more than another. Null, blank and unknown authors, and seat codes without a session, give no
    row; repeated records give one; two registered students of one (folded) name are one entity; empty inputs give no rows.
    """
    entry = F.col("student")
    work = records.select("id", entry, F.regexp_extract(F.col("session"), "([0-9]+)", 1).try_cast("int").alias("_no"))
    work = stored(work.where("id IS NOT NULL AND student IS NOT NULL").distinct())
    named = work.select("student").distinct().select("student", folded_name(entry).alias("_key"))

    held = accounts.select(folded_name("account_name").alias("_key"), "account_id").where("_key <> ''")
    held = held.groupBy("_key").agg(F.concat(F.lit("acc-"), F.min("account_id")).alias("_acc"))

    pieces = named.where(~F.col("_key").rlike("[0-9]")).select(
        "student", F.explode(F.split(squeezed(entry), BETWEEN)).alias("_piece")
    )
    pieces = pieces.select(
        "student", folded_name(F.regexp_replace("_piece", "^([^,]+),\\s*(.+)$", "$2 $1")).alias("_alias")
    ).where("_alias <> ''")
    people = _people(students)
    found = stored(pieces.join(people, "_alias").select("student", "_node").distinct())
    pairs = found.groupBy("student").agg(F.min("_node").alias("a"), F.collect_set("_node").alias("all"))
    edges = pairs.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
    roots = components(edges)
    linked = (
        pairs.select("student", F.col("a").alias("node"))
        .join(roots, "node", "left")
        .select("student", F.concat(F.lit("stu-"), F.coalesce("root", "node")).alias("_stu"))
    )
    known = (
        named.join(F.broadcast(held) if accounts.count() <= 100_000 else held, "_key", "left")
        .join(linked, "student", "left")
        .select("student", "_acc", "_stu", F.regexp_extract("_key", SEAT, 1).alias("_seat"))
        .where("_acc IS NOT NULL OR _stu IS NOT NULL OR _seat <> ''")
    )
    seat = F.when((F.col("_seat") != "") & F.col("_no").isNotNull(), F.concat(F.lit("seat-"), F.col("_seat"), F.lit("-"), F.col("_no")))
    keyed = hot_join(work, stored(known), "student").select("id", F.coalesce("_acc", seat, "_stu").alias("group_key"))
    return keyed.where("group_key IS NOT NULL").groupBy("id").agg(F.min("group_key").alias("group_key"))


def _people(students: DataFrame) -> DataFrame:
    """Register entries to (_alias, _node): first given name or all of them before the family name; _node is the smallest id of that name."""
    given, family = squeezed(F.col("vorname")), squeezed(F.col("nachname"))
    rows = students.where("student_id IS NOT NULL AND nachname IS NOT NULL AND vorname IS NOT NULL").select(
        "student_id",
        folded_name(F.concat_ws(" ", F.substring_index(given, " ", 1), family)).alias("_name"),
        folded_name(F.concat_ws(" ", given, family)).alias("_long"),
    )
    first = rows.groupBy("_name").agg(F.min("student_id").alias("_node"), F.collect_set("_long").alias("_longs"))
    both = first.select("_node", F.explode(F.array_distinct(F.concat(F.array("_name"), F.col("_longs")))).alias("_alias"))
    return both.groupBy("_alias").agg(F.min("_node").alias("_node"))


def split_groups(groups: DataFrame, targets: DataFrame, label: str = "label") -> DataFrame:
    """groups(id, group_key, <label>) to (id, group_key, split_name): whole groups per split, label shares alike.

    targets(split_name, target_permille). Groups above LARGE of all records (a bounded number) are placed greedily, the
    largest first, where the labels' deficit falls most; the others are ordered by hash within their main label and cut
    at what each split still lacks of that label. Null labels are a label of their own; ties fall by key.
    """
    goals = [(r[0], float(r[1])) for r in targets.select("split_name", "target_permille").orderBy("split_name").collect()]
    weight = sum(g for _, g in goals)
    rows = groups.select("id", "group_key", F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_label"))
    cells = stored(rows.groupBy("group_key", "_label").count())
    total = cells.agg(F.sum("count")).first()[0] or 0
    sizes = cells.groupBy("group_key").agg(F.sum("count").alias("n"), F.max_by("_label", F.struct("count", "_label")).alias("main"))
    large = sizes.where(F.col("n") >= max(1.0, LARGE * total)).select("group_key")
    held = cells.join(large, "group_key").select("group_key", "_label", "count").collect()
    lacks: dict[tuple[str, str], float] = {}
    for one in cells.groupBy("_label").agg(F.sum("count").alias("n")).collect():
        for name, goal in goals:
            lacks[name, one["_label"]] = one["n"] * goal / weight
    big: dict[str, dict[str, int]] = {}
    for one in held:
        big.setdefault(one["group_key"], {})[one["_label"]] = one["count"]
    placed = []
    for key, has in sorted(big.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        gain = {name: sum(n * (2 * lacks[name, k] - n) / max(1.0, goal) for k, n in has.items()) for name, goal in goals}
        best = max(goals, key=lambda g: (gain[g[0]], g[0]))[0]
        placed.append((key, best))
        for k, n in has.items():
            lacks[best, k] -= n
    spark = groups.sparkSession
    fixed = spark.createDataFrame(placed, "group_key string, split_name string")
    small = sizes.join(F.broadcast(fixed.select("group_key")), "group_key", "left_anti").withColumn(
        "_slice", F.pmod(F.xxhash64("group_key"), F.lit(SLICES))
    )
    small = stored(small)
    each = small.groupBy("main", "_slice").agg(F.sum("n").alias("_s"))
    whole = Window.partitionBy("main")
    each = each.select(
        "main", "_slice",
        (F.sum("_s").over(whole.orderBy("_slice")) - F.col("_s")).alias("_before"),
        F.sum("_s").over(whole).alias("_all"),
    )
    inside = Window.partitionBy("main", "_slice").orderBy(F.xxhash64("group_key"), "group_key")
    at = small.join(each, ["main", "_slice"]).withColumn(
        "_at", (F.col("_before") + F.sum("n").over(inside) - F.col("n") / 2) / F.col("_all")
    )
    cuts = []
    for k in sorted({k for _, k in lacks}):
        rest = [max(0.0, lacks[name, k]) for name, _ in goals]
        whole_rest, low = sum(rest) or 1.0, 0.0
        for (name, _), r in zip(goals, rest):
            cuts.append((k, name, low, low + r / whole_rest))
            low += r / whole_rest
        cuts[-1] = (*cuts[-1][:3], 2.0)
    bounds = spark.createDataFrame(cuts, "main string, split_name string, _low double, _high double")
    chosen = at.join(F.broadcast(bounds), "main").where("_at >= _low AND _at < _high").select("group_key", "split_name")
    # Large groups, at most 1 / LARGE, go by broadcast; only the small ones are shuffled.
    rows, fixed = groups.select("id", "group_key"), F.broadcast(fixed)
    rest = rows.join(fixed.select("group_key"), "group_key", "left_anti").join(chosen.hint("merge"), "group_key")
    return rows.join(fixed, "group_key").unionByName(rest).select("id", "group_key", "split_name")


def split_report(split: DataFrame, groups: DataFrame, targets: DataFrame, label: str = "label") -> DataFrame:
    """split_groups() of groups(id, group_key, <label>) to (split_name, groups, records, actual_permille, target_permille, label_deviation),
    one row a target: label_deviation is half the sum of the differences between the split's label shares and those of all
    records, in per mille: what part of the split would have to be exchanged. A split without records has null."""
    named = groups.select("id", F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_label")).dropDuplicates(["id"])
    cells = stored(split.join(named, "id").groupBy("split_name", "group_key", "_label").agg(F.count("*").alias("n")))
    by = cells.groupBy("split_name", "_label").agg(F.sum("n").alias("n"))
    whole = cells.groupBy("_label").agg(F.sum("n").alias("all")).withColumn("share", F.col("all") / F.sum("all").over(Window.partitionBy()))  # one row a label
    sums = cells.groupBy("split_name").agg(F.count_distinct("group_key").alias("groups"), F.sum("n").alias("records"))
    grid = sums.select("split_name", "records").crossJoin(F.broadcast(whole.select("_label", "share")))  # targets by labels
    off = grid.join(by, ["split_name", "_label"], "left").groupBy("split_name").agg((500 * F.sum(F.abs(F.coalesce("n", F.lit(0)) / F.col("records") - F.col("share")))).alias("label_deviation"))
    total = cells.agg(F.sum("n").alias("total"))
    goals = targets.groupBy("split_name").agg(F.sum("target_permille").alias("target_permille")).crossJoin(F.broadcast(total))  # one row
    out = goals.join(sums, "split_name", "left").join(off, "split_name", "left")
    return out.select(
        "split_name", F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("records", F.lit(0)).alias("records"),
        F.round(F.try_divide(1000.0 * F.coalesce("records", F.lit(0)), F.col("total")), 3).alias("actual_permille"), "target_permille", F.round("label_deviation", 3).alias("label_deviation"),
    )


def registered_label(level: Column) -> Column:
    """The label that splits are stratified by: the band of the level."""
    return F.substring(level, 1, 2)
