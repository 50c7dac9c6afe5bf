"""Windows over the ordered blocks of a document.

A document's blocks come out of one text cell, so a document is bounded by a row of the source and its window fits one
task. All windows share the partition key ``doc``: chained steps reuse one shuffle.
"""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORD = ["seq"]


def by_doc(*extra):
    return W.partitionBy("doc", *extra).orderBy("seq")


def so_far(*extra):
    return by_doc(*extra).rowsBetween(W.unboundedPreceding, 0)


def whole(*extra):
    return W.partitionBy("doc", *extra)


def majority_smooth(rows, label, radius=3, votes=4, passes=2, least=20, labels_ok=4, share_ok=60):
    """Replace a label by the majority of the rows around it, in documents whose labels look broken.

    A document is left alone when it has fewer than ``least`` rows, or enough different labels none of which dominates.
    ``votes`` of 2 * radius + 1 is an absolute majority, so the winner is unique.
    """
    out = rows.withColumn("_l", F.col(label))
    around = by_doc().rowsBetween(-radius, radius)
    for _ in range(passes):
        out = out.withColumn("_a", F.collect_list("_l").over(around)).withColumn("_m", F.mode("_l").over(around))
        out = out.withColumn("_l", F.when(F.size(F.filter("_a", lambda x: x == F.col("_m"))) >= votes, F.col("_m")).otherwise(F.col("_l"))).drop("_a", "_m")
    size = F.count("*").over(whole())
    per = F.count("*").over(whole(label))
    out = out.withColumn("_n", size).withColumn("_p", per)
    fine = (F.size(F.collect_set(label).over(whole())) >= labels_ok) & (F.max("_p").over(whole()) <= share_ok)
    return out.withColumn(label, F.when((F.col("_n") >= least) & ~fine, F.col("_l")).otherwise(F.col(label))).drop("_l", "_n", "_p")


def repeat_heading_drop(blocks):
    """Adjacent equal headings: the first stays; a paragraph between them breaks the run."""
    prev = F.lag(F.struct("kind", "text")).over(by_doc())
    return (blocks.withColumn("_p", prev)
            .where(~((F.col("kind") == "h") & (F.coalesce(F.col("_p.kind"), F.lit("")) == "h") & (F.col("_p.text") == F.col("text")))).drop("_p"))


#: Depths of headings that documents can have (word processors have nine).
LEVELS = tuple(range(1, 10))


def _open_headings(levels, frame):
    """Per level the last heading in the frame, and whether a shallower one came after it (then it is closed)."""
    last = {k: F.last(F.when((F.col("kind") == "h") & (F.col("level") == k), F.struct("seq", "text")), ignorenulls=True).over(frame) for k in levels}
    return last


def heading_path(blocks, levels=LEVELS, sep=" > "):
    """The stack of open headings of every block, itself included when it is one: a heading closes equal and deeper ones."""
    d = blocks
    for k, c in _open_headings(levels, so_far()).items():
        d = d.withColumn(f"_h{k}", c)
    parts = []
    for i, k in enumerate(levels):
        later = [F.col(f"_h{j}.seq") for j in levels[:i]]
        open_ = F.col(f"_h{k}").isNotNull()
        for s in later:
            open_ = open_ & (F.coalesce(s, F.lit(-1)) < F.col(f"_h{k}.seq"))
        parts.append(F.when(open_, F.col(f"_h{k}.text")))
    return d.withColumn("path", F.concat_ws(sep, *parts)).drop(*[f"_h{k}" for k in levels])


def level_renest(blocks, levels=LEVELS):
    """Heading levels rewritten so that none is more than one deeper than its parent: open ancestors + 1."""
    d = blocks
    for k, c in _open_headings(levels, by_doc().rowsBetween(W.unboundedPreceding, -1)).items():
        d = d.withColumn(f"_h{k}", c["seq"])
    n = F.lit(1)
    for i, k in enumerate(levels):
        open_ = F.col(f"_h{k}").isNotNull() & (F.col("level") > k)
        for j in levels[:i]:
            open_ = open_ & (F.coalesce(f"_h{j}", F.lit(-1)) < F.col(f"_h{k}"))
        n = n + F.when(open_, 1).otherwise(0)
    return d.withColumn("level", F.when(F.col("kind") == "h", n.cast("bigint")).otherwise(F.col("level"))).drop(*[f"_h{k}" for k in levels])


# Marks that end a sentence, and marks that begin a new item.
SENTENCE_END = r"[。！？：:；;）)」”\"]$"
ITEM_START = r"^([A-H][\.．、]|[①②③④⑤⑥⑦⑧⑨⑩]|（\d+）|\(\d+\)|\d+[\.．、]|[一二三四五六七八九十]+、)"


def line_rejoin(blocks, end=SENTENCE_END, item=ITEM_START, least=0, glue=""):
    """Join wrapped lines: a line continues the one above unless that one ends a sentence or this one starts an item.

    With ``least`` the text gathered so far must have that many characters. Within a run of lines that could join, the
    gathered text is long enough from the first long line on, so the condition is a running maximum over the run.
    Empty lines are dropped first.
    """
    blocks = blocks.where("text <> ''")
    prev = F.lag("text").over(by_doc())
    could = F.coalesce(prev.isNotNull() & ~prev.rlike(end) & ~F.col("text").rlike(item), F.lit(False))
    d = blocks.withColumn("_c", could).withColumn("_long", F.coalesce(F.length(prev) >= least, F.lit(False)))
    d = d.withColumn("_run", F.sum(F.when(F.col("_c"), 0).otherwise(1)).over(so_far()))
    d = d.withColumn("_j", F.col("_c") & F.max(F.when(F.col("_c"), F.col("_long")).otherwise(F.lit(False))).over(so_far("_run")))
    d = d.withColumn("_g", F.sum(F.when(F.col("_j"), 0).otherwise(1)).over(so_far()))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return d.groupBy("doc", "_g").agg(F.min("seq").alias("seq"), F.count("*").cast("bigint").alias("lines"), texts.alias("t")).select(
        "doc", "seq", "lines", F.array_join("t", glue).alias("text"))


def statement_merge(blocks, circled=r"^\s*[①-⑳]", start=r"^\s*(?:\d{1,3}\s*[.．、]|[（(]\s*(?:单选|多选|不定项|判断)\s*[）)]|【[^】]{1,8}】\s*[（(])"):
    """Lines that begin with a circled digit join the question stem above them."""
    c = (F.col("kind") == "p") & F.col("text").rlike(circled)
    d = blocks.withColumn("_c", c).withColumn("_run", F.sum(F.when(c, 0).otherwise(1)).over(so_far()))
    head = F.first(F.struct(~F.col("_c") & (F.col("kind") == "p") & F.col("text").rlike(start))).over(by_doc("_run"))
    d = d.withColumn("_g", F.when(F.col("_c") & head["col1"], F.min("seq").over(whole("_run"))).otherwise(F.col("seq")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return d.groupBy("doc", F.col("_g").alias("seq")).agg(texts.alias("t")).select("doc", "seq", F.array_join("t", "\n").alias("text"))


def section_slice(blocks, lesson, first=0.15, last=0.7, floor=3, least=10):
    """Rows between this lesson's header (near the start) and the next lesson's (near the end).

    ``lesson`` is the lesson number of a header row, else NULL. Headings right above the header on its page stay.
    """
    d = blocks.withColumn("_l", lesson).withColumn("_i", F.row_number().over(by_doc()) - 1).withColumn("_n", F.count("*").over(whole()))
    d = d.withColumn("_f", F.min(F.when(F.col("_l").isNotNull(), F.struct("_i", "_l", "page"))).over(whole()))
    d = d.withColumn("_k", F.size(F.collect_set("_l").over(whole())))
    f_i, f_l, f_p = F.col("_f._i"), F.col("_f._l"), F.col("_f.page")
    nxt = F.min(F.when(F.col("_l").isNotNull() & (F.col("_l") != f_l) & (F.col("_i") > f_i) & (F.col("_i") >= F.col("_n") * last), F.col("_i"))).over(whole())
    above = F.max(F.when((F.col("_i") < f_i) & ~((F.col("kind") == "h") & (F.col("page") == f_p)), F.col("_i"))).over(whole())
    d = d.withColumn("_e", F.coalesce(nxt, F.col("_n"))).withColumn("_s", F.coalesce(above + 1, F.lit(0)))
    use = F.col("_f").isNotNull() & (F.col("_n") >= least) & (F.col("_k") <= 2) & (f_i <= F.greatest(F.lit(float(floor)), F.col("_n") * first))
    keep = ~F.coalesce(use, F.lit(False)) | ((F.col("_i") >= F.col("_s")) & (F.col("_i") < F.col("_e")))
    return d.where(keep).drop("_l", "_i", "_n", "_f", "_k", "_e", "_s")


def toggle_region(blocks, on, off, head=120):
    """Drop the pages between an "on" mark and the next "off" mark at the top of a page, unless that drops all pages."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    pages = blocks.groupBy("doc", "page").agg(F.substring(F.array_join(lines, "\n"), 1, head).alias("t"))
    mark = F.when(F.col("t").rlike(on), 1).when(F.col("t").rlike(off), 0)
    w = W.partitionBy("doc").orderBy("page")
    p = pages.withColumn("drop", F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    p = p.withColumn("all", F.min("drop").over(W.partitionBy("doc"))).where("drop = 1 AND all = 0").select("doc", "page")
    return blocks.join(p, ["doc", "page"], "left_anti")


def consecutive_entries(blocks, num, least=30, distinct=0.8, steps=0.75):
    """Documents whose numbered lines are one long entry list: those lines become headings of one level.

    ``num`` is the entry number of a line, else NULL. The level is one deeper than the deepest other heading, at most 4.
    """
    d = blocks.withColumn("_n", num)
    e = d.where("_n IS NOT NULL").withColumn("_step", F.when(F.col("_n") == F.lag("_n").over(by_doc()) + 1, 1).otherwise(0))
    ok = e.groupBy("doc").agg(F.count("*").alias("k"), F.countDistinct("_n").alias("u"), F.sum("_step").alias("s"))
    ok = ok.where((F.col("k") >= least) & (F.col("u") >= F.col("k") * distinct) & (F.col("s") >= (F.col("k") - 1) * steps)).select("doc", F.lit(1).alias("_ok"))
    deepest = F.max(F.when((F.col("kind") == "h") & F.col("_n").isNull(), F.col("level"))).over(whole())
    d = d.join(ok, "doc", "left").withColumn("_lv", F.least(F.lit(4), F.coalesce(deepest, F.lit(0)) + 1))
    hit = F.col("_ok").isNotNull() & F.col("_n").isNotNull()
    return (d.withColumn("kind", F.when(hit, "h").otherwise(F.col("kind"))).withColumn("level", F.when(hit, F.col("_lv")).otherwise(F.col("level")))
            .withColumn("entry", hit.cast("int")).drop("_n", "_ok", "_lv"))


def neighbor_fragment(blocks, fragment, weak):
    """Drop a short fragment only when a neighbour is a fragment or otherwise weak (noise, image)."""
    d = blocks.withColumn("_f", fragment).withColumn("_w", fragment | weak)
    w = by_doc()
    near = F.coalesce(F.lag("_w").over(w), F.lit(False)) | F.coalesce(F.lead("_w").over(w), F.lit(False))
    return d.withColumn("_d", F.col("_f") & near).where("NOT _d").drop("_f", "_w", "_d")


def outline_levels(docs, pat, size, body, margin=1.5, share=0.22, floor=12, deepest=4):
    """Heading levels from size and numbering pattern. ``docs(doc, b)``: blocks (seq, kind, ..) in their document's own row, candidates (kind 'h?') and
    paragraphs ('p'); ``pat`` and ``size`` make a column of a block. One row per block, with its kind and level.

    While candidates exceed max(floor, share of the lines), the weakest pattern class (6, 5, 4) of body size is demoted.
    Larger sizes rank first, then patterns; levels are dense and capped, so no more than ``deepest`` ranks are looked up.
    """
    def marked(x):
        z = F.bround(size(x) * 2) / 2
        return F.struct(x.alias("x"), (x["kind"] == "h?").alias("c"), pat(x).alias("pat"), z.alias("size"), (size(x) < body + margin).alias("small"))
    count = lambda of: F.size(F.filter("_m", of))
    body_of = lambda p: count(lambda m: m["c"] & m["small"] & (m["pat"] == p))
    d = docs.withColumn("_m", F.transform("b", marked)).drop("b")
    d = d.withColumn("_all", count(lambda m: m["c"])).withColumn("_lim", F.greatest(F.lit(float(floor)), F.size("_m") * F.lit(share)))
    d = d.withColumn("_w6", body_of(6)).withColumn("_w5", body_of(5))
    d = d.withColumn("_x6", F.col("_all") > F.col("_lim"))
    d = d.withColumn("_x5", F.col("_x6") & (F.col("_all") - F.col("_w6") > F.col("_lim")))
    d = d.withColumn("_x4", F.col("_x5") & (F.col("_all") - F.col("_w6") - F.col("_w5") > F.col("_lim")))
    weak = lambda m: F.coalesce(m["small"] & (((m["pat"] == 6) & F.col("_x6")) | ((m["pat"] == 5) & F.col("_x5")) | ((m["pat"] == 4) & F.col("_x4"))), F.lit(False))
    d = d.withColumn("_m", F.transform("_m", lambda m: m.withField("h", m["c"] & ~weak(m))))
    kinds = lambda of, c: F.array_distinct(F.transform(F.filter("_m", lambda m: m["h"] & of(m)), lambda m: m[c]))
    d = d.withColumn("_bs", F.sort_array(kinds(lambda m: ~m["small"], "size"), asc=False)).withColumn("_sp", F.array_sort(kinds(lambda m: m["small"], "pat")))
    # sorting puts a missing size last and a missing pattern last, as the ranks have it
    rank = lambda among, x: F.coalesce(F.nullif(F.array_position(F.slice(among, 1, deepest), x), F.lit(0)), F.lit(deepest))
    level = lambda m: F.when(m["h"], F.least(F.lit(deepest), F.when(m["small"], F.size("_bs") + rank("_sp", m["pat"])).otherwise(rank("_bs", m["size"]))))
    return d.select("doc", F.inline(F.transform("_m", lambda m: m["x"].withField("kind", F.when(m["h"], "h").otherwise("p")).withField("level", level(m).cast("bigint")))))


def list_continuation(blocks, num):
    """Headings that are item n next to an item n - 1 above or n + 1 below: list items, back to paragraphs."""
    d = blocks.withColumn("_n", num)
    w = by_doc()
    item = (F.lag("_n").over(w) == F.col("_n") - 1) | (F.lead("_n").over(w) == F.col("_n") + 1)
    return d.withColumn("kind", F.when((F.col("kind") == "h") & F.coalesce(item, F.lit(False)), "p").otherwise(F.col("kind"))).drop("_n")
