"""Pairs without pairing a whole group: similar word sets, and people who meet."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.storage import materialize

#: Rows of one key that a task compares with each other; larger keys are cut into a grid of parts.
HOT = 256
#: Ids that one list of alike rows holds, on average; pairs are written out list by list.
LIST = 512
#: Rows of one place that one task pairs with all others of the place.
SLAB = 4096
#: Least number of tasks that write out pairs: their inputs are small, their output is not.
TASKS = 96
#: Pairs that one task counts, on average.
PAIRS = 1_000_000
#: People of a container up to which its pairs are written out.
LARGE = 200


def similar_sets(sets: DataFrame, threshold: float, within: Sequence[str] = (), hot: int = HOT) -> DataFrame:
    """Pairs (a, b, score) with a < b of rows (id, words, keys, ``within``) whose Jaccard similarity reaches ``threshold``.

    Only rows that agree in ``within`` and share an element of ``keys`` count.
    Rows alike in all of it are one class: its smallest id is paired with each
    other member, and classes are paired by their smallest ids. The classes
    are found by their rarest words: two sets this similar share one of their
    first ``n - ceil(threshold * n) + 1`` words, and their sizes are close. A
    word that many classes of one place begin with is cut into parts, and the
    grid of its parts is spread over tasks. Sets without words equal each
    other only; nulls are empty sets and keys.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    empty = F.array().cast("array<string>")
    clean = sets.select("id", *within, F.array_sort(F.array_distinct(F.coalesce(F.col("words").cast("array<string>"), empty))).alias("words"), F.array_sort(F.array_distinct(F.coalesce(F.col("keys").cast("array<string>"), empty))).alias("keys"))
    members = materialize(clean.where(F.size("keys") > 0).withColumn("_head", F.min("id").over(Window.partitionBy(*within, "words", "keys"))), "sets")
    copies = members.where("id <> _head").select(F.col("_head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    classes = members.where("id = _head").dropDuplicates(["id"]).select("id", *within, "words", "keys")

    held = classes.select("id", F.explode("words").alias("word"))
    rarity = held.groupBy("word").agg(F.count("*").alias("df"))
    ranked = held.join(rarity, "word").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("by_rarity"))
    n = F.size("by_rarity")
    first = (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int")
    begun = classes.join(ranked, "id").select("id", *within, "words", "keys", F.slice("by_rarity", F.lit(1), first).alias("prefix"))
    # sets without words: classes that differ in keys only
    bare = classes.where(F.size("words") == 0).select("id", *within, "words", "keys", F.array(F.lit("")).alias("prefix"))
    spread = materialize(begun.unionByName(bare).withColumn("_key", F.explode("keys")).withColumn("_word", F.explode("prefix")), "set-prefixes")

    place = [*within, "_key", "_word"]
    crowd = spread.groupBy(*place).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).withColumn("_parts", F.ceil(F.col("_n") / hot).cast("int"))
    at, met_at = spread.alias("s"), crowd.alias("c")
    met = at.join(met_at, reduce(and_, (F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in place))).select("s.*", "c._parts")
    own = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.struct(F.least(own, j).alias("low"), F.greatest(own, j).alias("high")))
    grid = met.withColumn("_own", own).withColumn("_cell", F.explode(cells))
    x, y = grid.alias("x"), grid.alias("y")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*place, "_cell")]
    # in a cell of two parts only rows of different parts meet, so no pair meets twice
    apart = (F.col("x._cell.low") == F.col("x._cell.high")) | (F.col("x._own") != F.col("y._own"))
    nx, ny = F.size("x.words"), F.size("y.words")
    close = (F.least(nx, ny) >= F.greatest(nx, ny) * threshold - 1e-9) & (F.col("x.id") < F.col("y.id"))
    # the first word and key that both share: a pair counts where these meet
    once = (F.element_at(F.array_intersect("x.prefix", "y.prefix"), 1) == F.col("x._word")) & (F.element_at(F.array_intersect("x.keys", "y.keys"), 1) == F.col("x._key"))
    common = F.size(F.array_intersect("x.words", "y.words"))
    total = nx + ny - common
    score = F.when(total == 0, 1.0).otherwise(common / total)
    found = x.join(y, reduce(and_, same) & close & apart & once).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), score.alias("score")).where(F.col("score") >= threshold - 1e-9)
    return found.unionByName(copies)


def similar_classes(rows: DataFrame, threshold: float, within: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (id, words, ``within``) with the ``class`` of all that are alike, and the pairs of similar classes.

    The pairs (class, other, score) hold both directions and each class with
    itself; score is the Jaccard similarity, ``threshold`` or more. Only
    classes are compared, see ``similar_sets``. Nulls leave.
    """
    name = F.sha2(F.to_json(F.struct(*within, F.array_sort("words").alias("words"))), 256)
    classed = materialize(rows.select("id", "words", *within).dropna().withColumn("class", name), "classed")
    kinds = classed.groupBy("class").agg(F.first("words").alias("words"), *(F.first(c).alias(c) for c in within))
    near = similar_sets(kinds.select(F.col("class").alias("id"), *within, "words", F.array(F.lit("")).alias("keys")), threshold, within).where(F.col("score") >= threshold)
    there = near.select(F.col("a").alias("class"), F.col("b").alias("other"), "score")
    back = near.select(F.col("b").alias("class"), F.col("a").alias("other"), "score")
    own = kinds.select("class", F.col("class").alias("other"), F.lit(1.0).alias("score"))
    return classed, materialize(there.unionByName(back).unionByName(own), "class-pairs")


def lists_of(rows: DataFrame, key: Sequence[str], size: int = LIST) -> DataFrame:
    """Rows (id, ``key``) as lists of about ``size`` ids of one key: (``key``, ids, no), where no numbers the lists."""
    heavy = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > size).withColumn("_cuts", F.ceil(F.col("_n") / size).cast("int"))
    r, h = rows.select("id", *key).alias("r"), heavy.alias("h")
    cut = F.pmod(F.xxhash64("r.id"), F.coalesce("h._cuts", F.lit(1))).alias("_cut")
    dealt = r.join(h, reduce(and_, (F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in key)), "left").select("r.*", cut)
    # the number is fixed by writing the lists
    return materialize(dealt.groupBy(*key, "_cut").agg(F.collect_list("id").alias("ids")).drop("_cut").withColumn("no", F.monotonically_increasing_id()), "lists")


def similar_names(names: DataFrame) -> DataFrame:
    """Pairs (name, other), both directions and each with itself, of ``names`` (name, tokens) that may be one person's.

    Names have two tokens at least; others leave. Two are similar if all
    tokens of one are in the other, which is no shorter, or if the last tokens
    are equal and the first ones are equal, at an edit distance of one, or one
    begins the other, both with three letters or more. Candidates meet on the
    rarest token of one of them, on first tokens with a letter left out, and
    on beginnings; no name is compared with all others.
    """
    n = materialize(names.where("size(tokens) >= 2").dropDuplicates(["name"]).withColumns({"first": F.element_at("tokens", 1), "last": F.element_at("tokens", -1)}), "names")
    held = n.select("name", F.explode(F.array_distinct("tokens")).alias("token"))
    rarity = held.groupBy("token").agg(F.count("*").alias("df"))
    rarest = held.join(rarity.hint("merge"), "token").groupBy("name").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    inside = rarest.join(held.withColumnRenamed("name", "other").hint("merge"), "token").select("name", "other")

    length = F.length("first")
    without = F.transform(F.sequence(F.lit(1), length), lambda i: F.concat(F.left("first", i - 1), F.substr("first", i + 1)))
    gaps = n.select("name", "last", F.explode(F.array_distinct(F.concat(F.array("first"), without))).alias("meet"))
    begun = n.where(length > 3).select(F.col("name").alias("other"), "last", F.explode(F.transform(F.sequence(F.lit(3), length - 1), lambda i: F.left("first", i))).alias("meet"))
    whole = n.select("name", "last", F.col("first").alias("meet"))
    near = gaps.join(gaps.withColumnRenamed("name", "other").hint("merge"), ["last", "meet"]).unionByName(whole.join(begun.hint("merge"), ["last", "meet"])).select("name", "other")

    x, y = n.select("name", F.col("tokens").alias("v"), F.col("first").alias("f"), F.col("last").alias("l")), n.select(F.col("name").alias("other"), F.col("tokens").alias("w"), F.col("first").alias("g"), F.col("last").alias("m"))
    told = inside.unionByName(near).distinct().join(x, "name").join(y, "other")
    holds = (F.size("v") <= F.size("w")) & (F.size(F.array_except("v", "w")) == 0)
    begins = (F.length("f") >= 3) & (F.length("g") >= 3) & (F.col("f").startswith(F.col("g")) | F.col("g").startswith(F.col("f")))
    alike = told.where(holds | ((F.col("l") == F.col("m")) & (begins | (F.levenshtein("f", "g") <= 1)))).select("name", "other")
    return materialize(alike.unionByName(alike.select(F.col("other").alias("name"), F.col("name").alias("other"))).distinct(), "name-pairs")


def probable_duplicates(people: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ``people`` (id, name, tokens, company) with similar names and the same company, or someone whom both meet.

    ``members`` (container, person) tells who meets; that someone is neither
    of the two. Names are compared once (``similar_names``), and ids are
    written out from lists. A pair comes once for the company, else once for
    all that both meet. Everyone's partners are written out, so containers
    cost the square of their people.
    """
    rows = materialize(people.dropna(subset=["id", "name", "tokens"]), "people")
    near = similar_names(rows.select("name", "tokens"))
    lists = lists_of(rows.dropna(subset=["company"]).select("id", "name", "company"), ["name", "company"])
    x = lists.select("name", "company", F.col("ids").alias("one"), F.col("no").alias("i"))
    y = lists.select(F.col("name").alias("other"), "company", F.col("ids").alias("two"), F.col("no").alias("j"))
    met = near.join(x, "name").join(y, ["other", "company"]).where("i <= j").select("one", "two", (F.col("i") == F.col("j")).alias("same"))
    colleagues = _written_out(met.repartition(TASKS))

    known, tasks = _meetings(members)
    known = known.repartition(tasks, "a").distinct()
    # whom someone meets, by name and company: only lists of different companies meet again
    named = rows.select(F.col("id").alias("b"), "name", "company").distinct()
    around = materialize(known.join(named, "b").groupBy("a", "name", "company").agg(F.collect_set("b").alias("ids")), "around")
    one = around.join(near, "name").select("a", "name", "company", "other", F.col("ids").alias("one"))
    two = around.select("a", F.col("name").alias("other"), F.col("company").alias("elsewhere"), F.col("ids").alias("two"))
    here, there = F.struct("name", "company"), F.struct(F.col("other").alias("name"), F.col("elsewhere").alias("company"))
    # null companies are the same as none
    apart = (here < there) & ~F.coalesce(F.col("company") == F.col("elsewhere"), F.lit(False)) | (here == there) & F.col("company").isNull()
    through = one.join(two.hint("merge"), ["a", "other"]).where(apart).select("one", "two", (here == there).alias("same"))
    return colleagues.unionByName(_written_out(through).distinct())


def _written_out(pairs: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b, ``columns``), a < b, of pairs of lists (one, two, same, ``columns``); a pair of lists comes once."""
    each = pairs.withColumn("_x", F.explode("one")).withColumn("_y", F.explode("two"))
    return each.where("not same or _x < _y").where("_x <> _y").select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), *columns)


def similar_pairs(rows: DataFrame, threshold: float, within: Sequence[str]) -> DataFrame:
    """All pairs (a, b), a < b, of rows (id, words, ``within``) that agree in ``within`` and whose Jaccard similarity reaches ``threshold``.

    Classes are compared (``similar_classes``); their members are written out
    from lists that are dealt evenly to tasks, so the cost is that of the output.
    """
    classed, near = similar_classes(rows, threshold, within)
    lists = lists_of(classed.select("id", "class"), ["class"])
    x = lists.select("class", F.col("ids").alias("one"), F.col("no").alias("i"))
    y = lists.select(F.col("class").alias("other"), F.col("ids").alias("two"), F.col("no").alias("j"))
    met = near.select("class", "other").join(x, "class").join(y, "other").where("i <= j").select("one", "two", (F.col("i") == F.col("j")).alias("same"))
    return _written_out(met.repartition(TASKS))


def scored_pairs(rows: DataFrame, within: Sequence[str], score: Callable[[Column, Column], Column], most: float | None = None) -> DataFrame:
    """All pairs (a, b, score), a < b, of rows (id, value, ``within``) that agree in ``within``; those of at most ``most`` if it is given.

    ``score`` must be symmetric. It is computed once for two lists of alike
    values, whose ids are then written out. Large places are cut into slabs of
    lists, each of which meets all lists of the place in a task of its own.
    """
    lists = lists_of(rows.dropna(subset=["id", *within]), [*within, "value"])
    slabs = lists.groupBy(*within).agg(F.ceil(F.sum(F.size("ids")) / SLAB).cast("int").alias("_slabs"))
    placed = lists.join(slabs, list(within))
    x = placed.select(*within, F.col("value").alias("v"), F.col("ids").alias("one"), F.col("no").alias("i"), F.pmod(F.xxhash64("no"), F.col("_slabs")).cast("int").alias("_slab"))
    y = placed.select(*within, F.col("value").alias("w"), F.col("ids").alias("two"), F.col("no").alias("j"), F.explode(F.sequence(F.lit(0), F.col("_slabs") - 1)).alias("_slab"))
    place = [*within, "_slab"]
    met = x.repartition(TASKS, *place).join(y.repartition(TASKS, *place).hint("merge"), place).where("i <= j")
    judged = met.select("one", "two", (F.col("i") == F.col("j")).alias("same"), score(F.col("v"), F.col("w")).alias("score"))
    return _written_out(judged if most is None else judged.where(F.col("score") <= most), "score")


def sharing(rows: DataFrame, within: Sequence[str]) -> DataFrame:
    """Rows (keys, ``within`` and more) that agree in ``within`` and one of ``keys`` with some other row.

    Told by counts of hashes, so that only numbers are dealt out; two hashes
    that are equal by chance keep a row more. Rows that meet nobody leave
    before anything else is made of them; repeated rows stay repeated.
    """
    columns = rows.columns
    each = rows.select("*", F.explode(F.array_distinct("keys")).alias("_key")).select(*columns, F.xxhash64(*within, "_key").alias("_met"))
    # written, so that its true size decides how the rows are joined with it
    crowds = materialize(each.groupBy("_met").agg(F.count("*").alias("_n")).where("_n > 1").select("_met"), "met")
    left = each.join(crowds, "_met", "left_semi").groupBy(*columns).agg((F.count("*") / F.count_distinct("_met")).cast("int").alias("_times"))
    return left.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_time")).drop("_time")


def near_duplicate_bullets(bullets: DataFrame, threshold: float = 0.6, worded: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Bullets (id, target, date, refs, words) of one target and date that share a ref and most content words; see ``similar_sets``.

    Only bullets that share a ref are looked at further. ``worded`` may add
    the words to these (id, target, date, keys), so the others need none.
    """
    within = ["target", "date"]
    left = sharing(bullets.withColumnRenamed("refs", "keys"), within)
    return similar_sets(worded(left) if worded else left, threshold, within)


def together(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """Which candidate pairs (a, b) share a container of ``members`` (container, person); nothing else is paired."""
    m = members.select("container", "person").where("container is not null and person is not null").distinct()
    pairs = candidates.select("a", "b").distinct()
    one = pairs.join(m.withColumnRenamed("person", "a"), "a")
    return one.join(m.withColumnRenamed("person", "b"), ["container", "b"]).groupBy("a", "b").agg(F.count("*").alias("shared"))


def _meetings(members: DataFrame) -> tuple[DataFrame, int]:
    """Ordered pairs (a, b), once for each container that both are in, and a number of tasks that follows the number of pairs."""
    m = materialize(members.select("container", "person").where("container is not null and person is not null").distinct(), "members")
    sizes = m.groupBy("container").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_slabs", F.ceil(F.col("_n") / SLAB).cast("int"))
    pairs = sizes.agg(F.sum(F.col("_n") * (F.col("_n") - 1))).first()[0] or 0  # one number
    tasks = max(TASKS, -(-pairs // PAIRS))
    placed = m.join(sizes.drop("_n"), "container")
    x = placed.select("container", F.pmod(F.xxhash64("person"), F.col("_slabs")).cast("int").alias("_slab"), F.col("person").alias("a"))
    y = placed.select("container", F.explode(F.sequence(F.lit(0), F.col("_slabs") - 1)).alias("_slab"), F.col("person").alias("b"))
    return x.repartition(tasks, "container", "_slab").join(y.repartition(tasks, "container", "_slab").hint("merge"), ["container", "_slab"]).where("a <> b").select("a", "b"), tasks


def all_partners(members: DataFrame) -> DataFrame:
    """``(a, b, shared, rank)``: everyone each person shares containers with, most in common first, ties by id.

    All pairs are returned, so the cost is that of the pairs. Large containers
    are cut into slabs that meet the whole container in tasks of their own.
    The number of tasks follows the number of pairs, so what one task holds
    does not grow with the input. Null containers and people are left out.
    """
    met, tasks = _meetings(members)
    shared = met.repartition(tasks, "a").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return shared.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b")))


def partners(members: DataFrame, k: int, large: int = LARGE) -> DataFrame:
    """``(a, b, shared, rank)``: for each person the ``k`` others with most containers in common, ties by id.

    Pairs are written out for containers of up to ``large`` people. Larger
    ones are never paired: people who are in the same set of large containers
    form a class, two classes share as many large containers as their sets,
    and of a class only the ``k + 1`` smallest ids can be among the first ``k``
    of anyone, unless small containers name them. The result equals ranking
    all pairs. Null containers and people are left out; repeated rows count once.
    """
    m = members.select("container", "person").where("container is not null and person is not null").distinct()
    sizes = m.groupBy("container").agg(F.count("*").alias("people"))
    sized = materialize(m.join(sizes, "container"), "members")
    small = sized.where(F.col("people") <= large).select("container", "person")
    pairs = small.withColumnRenamed("person", "a").join(small.withColumnRenamed("person", "b"), "container").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("in_small"))

    crowds = sized.where(F.col("people") > large).groupBy("person").agg(F.array_sort(F.collect_set("container")).alias("set"))
    classed = materialize(crowds.withColumn("class", F.sha2(F.to_json("set"), 256)), "member-classes")
    classes = classed.groupBy("class").agg(F.first("set").alias("set"))
    inside = classes.select("class", F.explode("set").alias("container"))
    near = inside.join(inside.withColumnRenamed("class", "other"), "container").groupBy("class", "other").agg(F.count("*").alias("in_large"))
    heads = classed.withColumn("_r", F.row_number().over(Window.partitionBy("class").orderBy("person"))).where(F.col("_r") <= k + 1).select(F.col("class").alias("other"), F.col("person").alias("b"))
    best = Window.partitionBy("class").orderBy(F.desc("in_large"), "b")
    shown = near.join(heads, "other").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("class", "b", "in_large")
    far = classed.select(F.col("person").alias("a"), "class").join(shown, "class").where("a <> b").select("a", "b", "in_large", F.lit(0).cast("bigint").alias("in_small"))

    sets = classed.select("person", "set")
    by_name = pairs.join(sets.select(F.col("person").alias("a"), F.col("set").alias("sa")), "a", "left").join(sets.select(F.col("person").alias("b"), F.col("set").alias("sb")), "b", "left")
    told = by_name.select("a", "b", F.when(F.col("sa").isNotNull() & F.col("sb").isNotNull(), F.size(F.array_intersect("sa", "sb"))).otherwise(0).cast("bigint").alias("in_large"), "in_small")
    every = told.unionByName(far).groupBy("a", "b").agg((F.max("in_large") + F.max("in_small")).alias("shared"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)
