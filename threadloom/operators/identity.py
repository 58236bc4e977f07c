"""Who is who: statistics of handles, clusters of handles, people.

Every operator keeps one owner's history; with many owners, put a tenant
column into the grouping keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import handles as H
from threadloom.functions import text as T
from threadloom.operators.graph import connected_components

#: Meetings of more people, and mail or messages to more, count for nobody.
MEETING_PEOPLE, MAIL_PEOPLE, MESSAGE_PEOPLE = 11, 5, 1
TIER_INNER, TIER_ACTIVE, TIER_NETWORK, INNER_MOST = 75, 50, 25, 30


def handle_stats(records: DataFrame, now: Column, window_days: int = 365) -> DataFrame:
    """One row for each other side of the records (columns other, kind, is_from_me, ts, duration_s).

    Active days are counted in two steps, (handle, day) before (handle), so a
    busy handle is summed before it is shuffled.
    """
    day = F.to_date("ts")
    recent = F.col("ts") >= now - F.make_interval(days=F.lit(window_days))
    inbound = F.col("kind").isin("message", "email") & ~F.col("is_from_me")
    outbound = F.col("kind").isin("message", "email") & F.col("is_from_me")
    daily = records.groupBy("other", day.alias("day")).agg(
        F.count_if(inbound).alias("inbound"),
        F.count_if(outbound).alias("outbound"),
        F.count_if(F.col("kind") == "meeting").alias("meetings"),
        F.count_if(F.col("kind") == "call").alias("calls"),
        F.count_if((F.col("kind") == "call") & (F.col("duration_s") > 0)).alias("answered"),
        F.count_if((F.col("kind") == "email") & ~F.col("is_from_me")).alias("emails"),
        F.max(recent.cast("int")).alias("active"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )
    sums = [F.sum(c).alias(c) for c in ("inbound", "outbound", "meetings", "calls", "answered", "emails")]
    return daily.groupBy(F.col("other").alias("handle")).agg(*sums, F.sum("active").alias("days"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def two_way(stats: DataFrame) -> Column:
    return ((F.col("inbound") > 0) & (F.col("outbound") > 0)) | (F.col("meetings") > 0) | (F.col("answered") > 0)


def relationship_strength(days: Column, days_ago: Column, both_ways: Column) -> Column:
    """0 to 100 from active days, how long ago the last contact was, and whether it goes both ways."""
    often = F.least(F.lit(1.0), F.ln(1 + days) / F.ln(F.lit(121.0)))
    return F.round(100 * (0.45 * often + 0.35 * F.exp(-days_ago / 90.0) + 0.2 * both_ways.cast("int"))).cast("int")


def tier_rank(people: DataFrame, key: str = "handle") -> DataFrame:
    """Adds tier: by strength, with at most the first thirty inner.

    The rank is needed only for the few strong enough to be inner, so only
    those are sorted in one place.
    """
    strong = people.where(F.col("strength") >= TIER_INNER).select(key, F.col("strength").alias("_s"))
    first = strong.orderBy(F.desc("_s"), key).limit(INNER_MOST).select(key, F.lit(True).alias("_inner"))
    tier = (
        F.when((F.col("strength") >= TIER_INNER) & F.col("_inner"), "inner")
        .when(F.col("strength") >= TIER_ACTIVE, "active")
        .when(F.col("strength") >= TIER_NETWORK, "network")
        .otherwise("cold")
    )
    return people.join(F.broadcast(first), key, "left").withColumn("tier", tier).drop("_inner")  # at most thirty rows


def person_kind() -> Column:
    """Kind of an identity from its summed statistics; ``automated`` says that all its handles are short codes or no-reply."""
    only_in = (F.col("outbound") == 0) & (F.col("meetings") == 0) & (F.col("answered") == 0)
    return (
        F.when(F.col("automated"), "system")
        .when((F.col("calls") > 0) & (F.col("answered") == 0) & (F.col("inbound") + F.col("outbound") + F.col("meetings") == 0) & ~F.col("has_card"), "system")
        .when(~F.col("has_card") & only_in & (F.col("inbound") >= 10) & (F.col("inbound") == F.col("emails")), "system")
        .otherwise("person")
    )


def owner_inference(sent: DataFrame) -> DataFrame:
    """Handles sent-as-me more often than as another, from (handle, is_from_me)."""
    counts = sent.groupBy("handle").agg(F.count_if("is_from_me").alias("from_me"), F.count_if(~F.col("is_from_me")).alias("from_other"))
    return counts.where((F.col("from_me") > 0) & (F.col("from_me") > F.col("from_other")))


def shared_handles(cards: DataFrame, most: int = 2) -> DataFrame:
    """Handles on more than ``most`` cards; they never join people."""
    return cards.groupBy("handle").agg(F.count_distinct("card").alias("cards")).where(F.col("cards") > most)


def identity_edges(cards: DataFrame, handles: DataFrame, owners: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """``(src, dst)`` between handles that belong together.

    Edges are stars, never pairs: a card's handles all link to its smallest,
    handles with equal last ten digits to the smallest of them.
    """
    good = cards.join(shared_handles(cards), "handle", "left_anti").join(owners.select("handle"), "handle", "left_anti")
    by_card = good.join(good.groupBy("card").agg(F.min("handle").alias("head")), "card").select(F.col("handle").alias("src"), F.col("head").alias("dst"))
    every = handles.select("handle").unionByName(good.select("handle")).distinct().withColumn("tail", H.last10(F.col("handle")))
    tails = every.where("tail is not null").groupBy("tail").agg(F.min("handle").alias("head"))
    by_tail = every.join(tails, "tail").select(F.col("handle").alias("src"), F.col("head").alias("dst"))
    edges = by_card.unionByName(by_tail)
    return edges if merges is None else edges.unionByName(merges.select("src", "dst"))


def connected_identities(edges: DataFrame) -> DataFrame:
    """``(handle, root)``: clusters of handles, named by the smallest."""
    return connected_components(edges).select(F.col("node").alias("handle"), "root")


def person_id(root: Column) -> Column:
    return F.concat(F.lit("p_"), F.left(F.sha1(root), F.lit(10)))


def person_rollup(stats: DataFrame, clusters: DataFrame) -> DataFrame:
    """Sums of a cluster's handles; a handle without a cluster is one of its own."""
    joined = stats.join(clusters, "handle", "left").withColumn("root", F.coalesce("root", "handle"))
    sums = [F.sum(c).alias(c) for c in ("inbound", "outbound", "meetings", "calls", "answered", "emails", "days")]
    return joined.groupBy("root").agg(*sums, F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count("*").alias("handles"))


def top_name(names: DataFrame, key: str) -> DataFrame:
    """The most frequent name of each key; ties go to the longer, then to the first by letters."""
    counts = names.groupBy(key, "name").agg(F.count("*").alias("n"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), F.desc(F.length("name")), "name")
    return counts.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def person_aliases(names: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Up to ``most`` other names of each key by frequency, one of each normalised form."""
    counts = names.groupBy(key, "name").agg(F.count("*").alias("n")).withColumn("norm", T.name_norm(F.col("name")))
    one = Window.partitionBy(key, "norm").orderBy(F.desc("n"), "name")
    rank = Window.partitionBy(key).orderBy(F.desc("n"), "name")
    kept = counts.withColumn("o", F.row_number().over(one)).where("o = 1").withColumn("r", F.row_number().over(rank)).where(F.col("r").between(2, most + 1))
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("aliases"))


def company_hint(stats: DataFrame, key: str, owner_domain: str) -> DataFrame:
    """The business mail domain that writes most to the owner."""
    domain = H.email_domain(F.col("handle"))
    rows = stats.withColumn("domain", domain).where(F.col("domain").isNotNull() & ~F.col("domain").isin(H.FREE_MAIL) & (F.col("domain") != owner_domain) & ~H.is_automated(F.col("handle")))
    sums = rows.groupBy(key, "domain").agg(F.sum(F.col("inbound") + 1).alias("weight"))
    best = Window.partitionBy(key).orderBy(F.desc("weight"), "domain")
    return sums.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def group_chats(parties: DataFrame, least: int = 2) -> DataFrame:
    """Threads of ``least`` or more other parties: members by count, the first four as a name."""
    per = parties.groupBy("thread", "party").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    all_ = per.groupBy("thread").agg(F.array_sort(F.collect_set("party")).alias("members"), F.sum("n").alias("messages"), F.max("last").alias("last_seen"))
    return all_.where(F.size("members") >= least).withColumn("name", F.array_join(F.slice("members", 1, 4), ", "))


def same_name_pairs(people: DataFrame, most: int = 300, pairs: int = 60) -> DataFrame:
    """Pairs among the strongest people that share a normalised name."""
    top = people.orderBy(F.desc("strength"), "id").limit(most).withColumn("norm", T.name_norm(F.col("name")))
    a, b = top.select("norm", F.col("id").alias("a")), top.select("norm", F.col("id").alias("b"))
    return a.join(b, "norm").where("a < b and norm <> ''").orderBy("norm", "a", "b").limit(pairs)


def stable_ids(clusters: DataFrame, prior: DataFrame, rounds: int = 5) -> DataFrame:
    """``(root, person_id)``: a cluster takes over the prior id that shares most handles, each id once.

    Rounds of mutual best choice over (cluster, id) pairs with their overlap;
    what is free after ``rounds`` gets a new id.
    """
    from threadloom.storage import materialize

    pairs = materialize(clusters.join(prior, "handle").groupBy("root", "person_id").agg(F.count("*").alias("n")), "overlap")
    chosen = None
    for _ in range(rounds):
        left = pairs if chosen is None else pairs.join(chosen, "root", "left_anti").join(chosen, "person_id", "left_anti")
        mine = Window.partitionBy("root").orderBy(F.desc("n"), "person_id")
        its = Window.partitionBy("person_id").orderBy(F.desc("n"), "root")
        both = left.withColumn("x", F.row_number().over(mine)).withColumn("y", F.row_number().over(its)).where("x = 1 and y = 1").select("root", "person_id")
        chosen = materialize(both if chosen is None else chosen.unionByName(both), "stable")
    roots = clusters.select("root").distinct()
    return roots.join(chosen, "root", "left").withColumn("person_id", F.coalesce("person_id", person_id(F.col("root"))))
