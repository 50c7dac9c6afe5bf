"""Sorts, top-k lists, quotas and question selection."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studyloom.functions.numbers import half_up, lookup
from studyloom.operators.scan import row_numbers


def numbered(df, order, name="rn"):
    """Row numbers over a result that a limit has already bounded."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)).cast("bigint"))


def shuffle_key(seed, *cols):
    """Deterministic stand-in for shuffling: order by this hash."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def last_n(df, n, order="id"):
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def bank_filter(bank, src="all", years=None, module=None, sub=None, source=None, topic=None):
    """Answered questions under the optional predicates; the newest year is taken over the whole bank."""
    known = bank.where("answer IS NOT NULL")
    df = known
    for col, val in (("module", module), ("sub", sub), ("source", source), ("topic", topic)):
        if val:
            df = df.where(F.col(col) == val)
    if src == "builtin":
        df = df.where(F.col("src").isin("builtin", "import"))
    elif src != "all":
        df = df.where(F.col("src") == src)
    if years is not None:
        newest = known.agg(F.max("year")).scalar()
        df = df.where((F.col("year") == 0) | (F.col("year") > newest - years))
    return df


def pick(rows, done, order, count, seed, wrong=None, favorites=None):
    """Ids in the order they are asked. Questions of one material stay together and may overshoot ``count`` (0 = all).

    ``done(id, last)`` holds the last answer time of done questions. Groups are ranked by their best row; at most
    ``count`` groups can be needed, so only those are numbered, and only their questions are read back.
    """
    if order == "wrong":
        rows = rows.join(wrong, "id", "left_semi")
    elif order == "fav":
        rows = rows.join(favorites, "id", "left_semi")
    d = rows.join(done, "id", "left")
    if order == "seq":
        start = d.where("last IS NULL").agg(F.min("id")).scalar()
        d = d.where(F.col("id") >= F.coalesce(start, F.lit(-1)))
    h = shuffle_key(seed, "id")
    is_done = F.when(F.col("last").isNull(), 0).otherwise(1)
    key = {"seq": F.struct(F.col("id")), "all": F.struct(F.col("id")),
           "new": F.struct(is_done, F.col("last"), h)}.get(order, F.struct(h))
    g = F.when(F.col("material").isNotNull(), F.concat(F.lit("m"), "material")).otherwise(F.concat(F.lit("q"), "id"))
    d = d.select("id", g.alias("g"), key.alias("k"))
    groups = d.groupBy("g").agg(F.min("k").alias("gk"), F.count("*").alias("size"))
    if not count:
        return d.join(groups, "g").orderBy("gk", "id").select("id")
    top = groups.orderBy("gk").limit(count)
    run = F.sum("size").over(W.partitionBy(F.lit(1)).orderBy("gk").rowsBetween(W.unboundedPreceding, -1))
    kept = top.withColumn("before", F.coalesce(run, F.lit(0))).where(F.col("before") < count)
    return d.join(kept.select("g", "gk"), "g").orderBy("gk", "id").select("id")


def pick_by_user(rows, asked, count, seed, by=("user_id",)):
    """As :func:`pick` for everybody's own list ``asked(user_id, id)``, such as wrong or favourite questions: (user_id, pos, id).

    A user's groups are ranked by their best row; more than ``count`` of them are never needed.
    """
    g = F.when(F.col("material").isNotNull(), F.concat(F.lit("m"), "material")).otherwise(F.concat(F.lit("q"), "id"))
    d = asked.select(*by, "id").distinct().join(rows.select("id", g.alias("g"), shuffle_key(seed, "id").alias("k")), "id")
    first = W.partitionBy(*by).orderBy("gk", "g")
    top = d.groupBy(*by, "g").agg(F.min("k").alias("gk"), F.count("*").alias("size")).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= count)
    before = F.coalesce(F.sum("size").over(first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = top.withColumn("before", before).where(F.col("before") < count)
    return (d.join(kept.select(*by, "g", "gk"), [*by, "g"]).withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy("gk", "g", "id")).cast("bigint")).select(*by, "pos", "id"))


def mock_quotas(real, ratio, grouped, floor=2, step=5):
    """Questions per module of a mock paper; the module ``grouped`` comes in whole materials of ``step`` questions."""
    out = {}
    for m, n in real.items():
        want = max(step if m == grouped else floor, int(n * ratio + 0.5))
        out[m] = max(step, int(want / step + 0.5) * step) if m == grouped else want
    return out


def compose(rows, quotas, seed, by="module"):
    """Up to the quota of every module in hash order. The constant rank limit lets the cut run before the shuffle."""
    rn = F.row_number().over(W.partitionBy(by).orderBy(shuffle_key(seed, "id"), "id"))
    return (rows.where(F.col(by).isin(list(quotas))).select(by, "id").withColumn("rn", rn.cast("bigint"))
            .where(F.col("rn") <= max(quotas.values())).where(F.col("rn") <= lookup(F.col(by), quotas)))


def compose_plan(rows, quotas, real_total, minutes=120, by="module"):
    """Per module: wanted, available and given count, and the scaled time of the whole paper."""
    have = rows.where(F.col(by).isin(list(quotas))).groupBy(by).agg(F.count("*").alias("available"))
    got = have.withColumn("want", lookup(F.col(by), quotas).cast("bigint")).withColumn("got", F.least("want", "available"))
    n = F.sum("got").over(W.partitionBy(F.lit(1)))
    return got.withColumn("minutes", F.greatest(F.lit(10), half_up(minutes * n / real_total)))


def proportional_quota(totals, n, fixed=None, fixed_share=5 / 75):
    """Share ``n`` items over the groups of ``totals(module, total)`` by size; what rounding leaves goes round the largest first.

    Rounding misses by less than one per two groups, so one round settles it and a rank comparison is enough.
    """
    keep = int(fixed_share * n + 0.5) if fixed else 0
    rest = n - keep
    w = W.partitionBy(F.lit(1))
    t = totals if fixed is None else totals.where(F.col("module") != fixed)
    t = t.withColumn("want", half_up(F.col("total") / F.sum("total").over(w) * rest))
    t = (t.withColumn("diff", F.lit(rest) - F.sum("want").over(w))
         .withColumn("r", F.row_number().over(w.orderBy(F.desc("total"), "module")) - 1)
         .withColumn("m", F.count("*").over(w)))
    d = F.abs("diff")
    turns = F.floor(d / F.col("m")) + F.when(F.col("r") < d % F.col("m"), 1).otherwise(0)
    t = t.select("module", F.greatest(F.lit(0), F.col("want") + F.signum("diff").cast("bigint") * turns).cast("bigint").alias("want"))
    if not fixed or not keep:
        return t
    return t.unionByName(totals.where(F.col("module") == fixed).select("module", F.lit(keep).cast("bigint").alias("want")))


def sample_distinct(rows, key, n, seed, id_col="id"):
    """Random ``n`` rows, one per non-empty key, and the number of distinct ones."""
    one = rows.groupBy(key.alias("k")).agg(F.min(id_col).alias(id_col))
    total = one.agg(F.count("*")).scalar()
    return one.orderBy(shuffle_key(seed, id_col)).limit(n).select(id_col, total.alias("total"))


def case_listing(cases):
    return cases.orderBy(F.col("kind") != "paper", F.desc("year"), F.col("half") != "second", "no", "id")


def study_queue(cards, today, cap, new_limit, session, seed):
    """Due cards in hash order up to the cap, then new ones in listing order up to the quota; cut at the session size.

    Rank limits are constants, so both parts are cut before they are brought together.
    """
    due = (cards.where(F.col("due") <= F.lit(today).cast("date")).select("card", shuffle_key(seed, "card").alias("k"))
           .orderBy("k").limit(cap).select(F.lit(0).alias("part"), "k", "card"))
    new = (cards.where("due IS NULL").orderBy("card").limit(new_limit)
           .select(F.lit(1).alias("part"), F.lit("").alias("k"), "card"))
    return numbered(due.unionByName(new).orderBy("part", "k", "card").limit(session), ["part", "k", "card"], "pos").select("pos", "card")


def study_queue_by_user(listing, states, today, cap, new_limit, session, seed, by=("user_id",)):
    """Everybody's queue of today: (user_id, pos, card).

    ``listing(card)`` are all cards in the order of their number, ``states(user_id, card, due, first_review, last_review)`` what a user has met. Due cards come in hash
    order, as many as the cap leaves after today's reviews, then new ones in listing order up to what is left of the quota; the session size cuts both. A
    user with an empty queue gets cards in hash order, met or not. A user's new cards are among the first ``new_limit`` + (cards met) of the
    listing, so only that many places are looked at.
    """
    day = F.lit(today).cast("date")
    places = row_numbers(listing.select("card").distinct(), [], "card", name="place")
    size = places.count()
    met = states.groupBy(*by).agg(F.count("*").alias("met"), F.count_if((F.col("last_review") == day) & (F.col("first_review") < day)).alias("reviewed"), F.count_if(F.col("first_review") == day).alias("new_today"))
    key = shuffle_key(seed, "card").alias("k")
    due = states.where(F.col("due") <= day).select(*by, "card", key)
    due = due.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy("k", "card"))).where(F.col("rn") <= cap).join(met.select(*by, "reviewed"), list(by)).where(F.col("rn") <= cap - F.col("reviewed"))
    ahead = met.where(F.col("new_today") < new_limit).select(*by, "new_today", F.explode(F.sequence(F.lit(1), F.least(F.lit(size), F.col("met") + new_limit).cast("int"))).alias("place")) if size else None
    queue = due.select(*by, F.lit(0).alias("part"), "k", "card")
    if ahead is not None:
        seen = states.select(*by, "card").join(places, "card").select(*by, "place")
        new = ahead.join(seen, [*by, "place"], "left_anti").withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy("place"))).where(F.col("rn") <= new_limit - F.col("new_today"))
        queue = queue.unionByName(new.join(places, "place").select(*by, F.lit(1).alias("part"), F.lit("").alias("k"), "card"))
    pos = F.row_number().over(W.partitionBy(*by).orderBy("part", "k", "card"))
    queue = queue.withColumn("pos", pos).where(F.col("pos") <= session).select(*by, F.col("pos").cast("bigint").alias("pos"), "card")
    spare = [r.card for r in listing.select("card").distinct().orderBy(shuffle_key(seed, "card"), "card").limit(session).collect()]  # at most ``session``
    if not spare:
        return queue
    kind = listing.schema["card"].dataType
    idle = met.select(*by).join(queue.select(*by).distinct(), list(by), "left_anti")
    return queue.unionByName(idle.select(*by, F.posexplode(F.array(*[F.lit(c).cast(kind) for c in spare])).alias("pos", "card")).select(*by, (F.col("pos") + 1).cast("bigint").alias("pos"), "card"))


def continue_reading(progress, n=4, by=()):
    """Unfinished documents, the last read first; with ``by``, ``n`` for everybody."""
    if by:
        rn = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("updated"), "doc"))
        return progress.where("done = 0 AND pct > 0 AND pct < 100").withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")
    return progress.where("done = 0 AND pct > 0 AND pct < 100").orderBy(F.desc("updated"), "doc").limit(n)


def per_group_cap(hits, group, order, per_group, overall):
    rn = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return hits.withColumn("rn", rn).where(F.col("rn") <= per_group).drop("rn").orderBy(*group, *order).limit(overall)


def priority_order(files):
    return files.orderBy(F.col("has_text").desc(), "scanned", "day", "fid")


def keep_groups_together(rows, group, pos):
    """Rows of one group follow each other from the group's first position on; rows without a group stay alone."""
    first = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(pos).alias("first"))
    return rows.join(first, group, "left").withColumn("first", F.coalesce("first", F.col(pos))).orderBy("first", pos)


def tagged_set(cases, first_tag, tags, year, seed, size=5):
    """A set of ``size`` cases: the real one of ``year`` when it is complete, else one case per tag, none twice.

    A pick can lose at most to the picks before it, so ``size`` + 1 candidates per tag decide the outcome exactly and
    the greedy choice runs over a bounded array.
    """
    real = (cases.where((F.col("kind") == "paper") & (F.col("year") == year)).orderBy("no", "id").limit(size)
            .withColumn("have", F.count("*").over(W.partitionBy(F.lit(1)))).where(F.col("have") == size))
    order = [first_tag, *tags]
    tag_no = F.create_map(*[F.lit(x) for i, t in enumerate(order) for x in (t, i)])
    cand = (cases.where("answered").select("id", F.explode("tags").alias("tag")).where(F.col("tag").isin(order))
            .withColumn("k", shuffle_key(seed, "tag", "id")))
    rn = F.row_number().over(W.partitionBy("tag").orderBy("k", "id"))
    cand = cand.withColumn("rn", rn).where(F.col("rn") <= len(order)).select(tag_no[F.col("tag")].alias("t"), "rn", "id")
    arr = cand.agg(F.array_sort(F.collect_list(F.struct("t", "rn", "id"))).alias("c"))
    start = F.struct(F.array().cast("array<int>").alias("tags"), F.array().cast("array<bigint>").alias("ids"))
    take = lambda s, c: F.struct(F.array_append(s["tags"], c["t"]).alias("tags"), F.array_append(s["ids"], c["id"]).alias("ids"))
    skip = lambda s, c: F.array_contains(s["tags"], c["t"]) | F.array_contains(s["ids"], c["id"]) | (F.size(s["ids"]) >= size)
    made = arr.select(F.posexplode(F.aggregate("c", start, lambda s, c: F.when(skip(s, c), s).otherwise(take(s, c)))["ids"]).alias("pos", "id"))
    enough = real.agg(F.count("*")).scalar()
    by_no = numbered(real, ["no", "id"], "pos").select((F.col("pos") - 1).alias("pos"), "id")
    return by_no.unionByName(made.where(enough == 0).select(F.col("pos").cast("bigint").alias("pos"), "id"))
